"""Pages are parsed once, a text's grams work it out once, and close rivals are found level by level."""

import random

from pyspark.sql import functions as F

from quaystone.functions.text import grams
from quaystone.operators import review
from quaystone.plans.catalog import Source


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grams_work_out_their_text_once(spark):
    df = spark.createDataFrame([("a-b-c",), ("-",), ("a-b",), (None,)], "t string")
    key = F.regexp_replace("t", "-", "")
    got = df.select(grams(key).alias("two"), review.trigrams(key).alias("three"))
    assert [(r.two, r.three) for r in got.collect()] == [(["ab", "bc"], ["abc"]), ([], []), (["ab"], ["ab"]), ([], [])]
    assert plan(got).count("regexp_replace") == 2


def test_articles_parse_pages_once(spark):
    articles = Source(spark, "/root/testdata/sf0.001").articles
    assert articles.count() > 0 and "regexp_extract" not in plan(articles)


def test_close_rivals_of_copies_and_of_all_levels(spark):
    rng = random.Random(8)
    c, r = [], []
    for i in range(60):
        base = rng.sample(range(40), 24)
        c += [(2 * i, i % 3, sorted(map(str, base))), (2 * i + 1, i % 3, sorted(map(str, base)))]
        for cut in rng.sample(range(9), 2):
            r.append((i % 3, sorted(map(str, base[cut:] + [50 + k for k in range(cut % 3)]))))
    best = {}
    for i, g, x in c:
        v = max(len(set(x) & set(y)) / len(set(x) | set(y)) for h, y in r if h == g)
        if v >= 0.75:
            best[i] = round(v, 9)
    assert {1.0} < set(best.values()) and any(0.75 <= v < 0.9 for v in best.values()) and len(best) < len(c)
    found = review.close_rivals(spark.createDataFrame(c, "candidate_id long, group_id int, g array<string>"), spark.createDataFrame(r, "group_id int, g array<string>"))
    assert {x.candidate_id: round(x.similarity, 9) for x in found.collect()} == best
