"""Fingerprints: collision rates against exact similarities, edited texts and neighbours against a plain loop."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaystone.llm import fingerprint

SCHEMA = "doc_id long, text string, n_chars int, row_ string, term_ int, part_ string"


def bag(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w)


def similarity(a, b):
    a, b = bag(a), bag(b)
    if not a or not b:
        return float(not a and not b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(text, following):
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def texts():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    out = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(40)], k=rnd.randrange(1, 120))) for _ in range(60)]
    return out + ["", "  \n", None, "one", "ONE", "\x0bone ", "x " * 5000, "日本 🙂 é", "a b", out[3], out[3] + " w1"]


@pytest.mark.parametrize("parts", [1, 5])
def test_edits_and_neighbours(spark, parts):
    rows = [(i * 3 % 71 - 20, t, 7, "r", 1, "p") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r.doc_id: r for r in fingerprint.compare_edits(df, samples=1024).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        t, following, r = t or "", following or "", got[i]
        new = edited(t, following)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == pytest.approx(similarity(t, new), abs=0.075)
        assert r.near_next == pytest.approx(similarity(t, following), abs=0.075)
        assert (r.fingerprint == r.edited_fingerprint) == (bag(t) == bag(new)) or abs(similarity(t, new) - 1) < 0.02
    alone = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df, samples=1024).collect()}
    assert alone == {i: r.fingerprint for i, r in got.items()}
    assert alone[-20] and len({alone[i] for i, t, *_ in rows if t == texts()[3]}) == 1
    assert {alone[i] for i, t, *_ in rows if not bag(t)} == {""}


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1, "", 1, "")] * 30 + [(None, "q r s", 1, "", 1, "")] * 2 + [(4, None, 1, "", 1, "")], SCHEMA).repartition(4)
    rows = fingerprint.compare_edits(df).collect()
    assert sorted(Counter(r.doc_id for r in rows).items(), key=str) == [(4, 1), (5, 30), (None, 2)]
    assert sum(r.near_next == 1.0 for r in rows if r.doc_id == 5) == 29
    one = df.where("doc_id = 4")
    assert [(r.n_chars, r.near_edited, r.near_next) for r in fingerprint.compare_edits(one).collect()] == [(0, 1.0, 1.0)]
    assert fingerprint.compare_edits(df.limit(0)).count() == fingerprint.fingerprints(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fingerprint.fingerprints(df, samples=3)


def test_stretches(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") % 50).alias("order_"), F.col("id").alias("row_"))
    at, last, n = fingerprint._stretches(rows, 130)
    got = rows.select("order_", "row_", at.alias("at"), last.alias("last")).orderBy("order_", "row_").collect()
    assert n > 64 and [r["at"] for r in got] == sorted(r["at"] for r in got) and {r["at"] for r in got} == set(range(n))
    assert [r["last"] for r in got] == [i + 1 == len(got) or got[i + 1]["at"] != r["at"] for i, r in enumerate(got)]
