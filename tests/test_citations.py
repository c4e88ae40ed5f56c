"""Grams, pages and their best occurrences on small rows; no pair is lost against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quaystone.functions import urls
from quaystone.operators import citations

CLAIM, CITED = "claim_id long, heading string", "citation_id long, url string, source string, keyword string, url_rank long, domain_rank long"


def test_page_of_a_citation(spark):
    u = ["HTTPS://A.example/x//?UTM_source=1&b=2&a=1#f", "https://a.example", "https://a.example//", "no url", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(u)], "i int, u string").select("i", urls.citation_url(F.col("u")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == ["https://a.example/x?b=2&a=1", "https://a.example/", "https://a.example/", None, None]


def test_best_occurrence(spark):
    claims = spark.createDataFrame([(1, "ＩＴ 企業!"), (2, "x"), (3, None), (4, "zz qq")], CLAIM)
    rows = [
        (9, "https://a.example/p/?utm_source=t", "IT企業", "other", None, 4), (8, "https://a.example/p#top", "unrelated", "it企業", None, None),
        (7, "https://b.example/", "X", None, 99, 1), (6, None, "it企", None, None, None), (5, "https://c.example/", "no match here", "none", 1, 1),
    ]
    got = {(r.claim_id, r.url): r for r in citations.claim_citations(claims, spark.createDataFrame(rows, CITED)).collect()}
    assert set(got) == {(1, "https://a.example/p"), (1, None), (2, "https://b.example/")}
    one = got[1, "https://a.example/p"]
    assert (one.citation_id, one.occurrences, one.heading_similarity, one.query_similarity, one.organic_rank, one.score, one.position) == (9, 2, 1.0, 1.0, 4, 0.98, 1)
    assert (got[2, "https://b.example/"].score, got[2, "https://b.example/"].organic_rank) == (0.72, None)
    assert got[1, None].score == pytest.approx(0.72 * 4 / 5, abs=1e-6)


def test_empty(spark):
    none, some = spark.createDataFrame([], CITED), spark.createDataFrame([(1, "abc")], CLAIM)
    assert citations.claim_citations(some, none).count() == 0


def grams(s):
    k = re.sub(r"[\W_]+", "", (s or "").lower())
    return {k} if len(k) == 1 else {k[i : i + 2] for i in range(len(k) - 1)}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


@pytest.mark.parametrize("seed", [1, 25])
def test_no_pair_is_lost(spark, seed):
    """Words of skewed frequency, so that common bigrams are in nearly every text."""
    rng = random.Random(seed)
    words = ["the", "then", "there", "other"] * 6 + ["alpha", "bravo", "carbon", "delta", "echoes", "fjord", "glyph", "hymn", "ivory", "jumps"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    claims = [(i, say(rng.randint(0, 7))) for i in range(60)]
    rank = lambda: rng.choice([None, None, 1, 2, 5, 30, 99])
    cited = [(i, f"https://h.example/{rng.randint(0, 150)}", say(rng.randint(0, 9)), say(rng.randint(0, 3)), rank(), rank()) for i in range(300)]
    pages, want = {}, set()
    for r in cited:
        pages.setdefault(r[1], []).append(r)
    for cid, heading in claims:
        scored = []
        for url, rows in pages.items():
            lead = min(rows, key=lambda r: (r[4] or 99, r[5] or 99, r[0]))
            h, q = dice(grams(heading), grams(lead[2])), max(dice(grams(heading), grams(r[3])) for r in rows)
            best = min(r[4] or r[5] or 99 for r in rows)
            score = round(min(1, 0.72 * h + 0.2 * q + (min(0.12, 0.12 / best**0.5) if best < 99 else 0)), 6)
            if (h or q) and score >= 0.08:
                scored.append((-score, best, url))
        want |= {(cid, url, i, -s) for i, (s, _, url) in enumerate(sorted(scored)[:3], 1)}
    frame = citations.claim_citations(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(cited, CITED), seed=seed)
    assert {(r.claim_id, r.url, r.position, r.score) for r in frame.collect()} == want and len(want) > 100
