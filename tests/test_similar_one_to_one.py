"""G26 from texts, in bands of scores, against the greedy order of all pairs."""

import random

from pyspark.sql import functions as F

from quaystone.operators import assign, cluster, matching


def rows(spark, n, seed):
    rng = random.Random(seed)
    words = ["an", "the", "ring", "bolt", "large", "green", "small", "hot", "cold", "x", ""]
    return spark.createDataFrame([(i, None if i % 29 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), i % 3) for i in range(n)], "i long, title string, grp long")


def test_bands_give_the_greedy_order(spark):
    a, b = rows(spark, 120, 1), rows(spark, 90, 2).drop("grp")
    left, right = a.withColumnRenamed("i", "l"), b.withColumnRenamed("i", "r")
    pairs = matching.gram_pairs(left, right, "l", "r", "title", "title").join(left.select("l", "grp"), "l").withColumn("score", F.round("dice", 6))
    want = sorted(map(tuple, cluster.greedy_one_to_one(pairs, "grp", "l", "r", "score").collect()))
    for how in ({"block": 8, "budget": 30}, {}):
        got = assign.similar_one_to_one(left, right, "grp", "l", "r", "title", **how)
        assert got.columns == ["grp", "l", "r", "score"] and sorted(map(tuple, got.collect())) == want
    assert len({s for *_, s in want}) > 3 and any(s < 1 for *_, s in want)


def test_copies_make_no_pairs(spark, monkeypatch):
    """A thousand copies on each side are one pair of classes, and are not compared with each other."""
    made, keep = {}, assign.materialise
    monkeypatch.setattr(assign, "materialise", lambda df, name: made.setdefault(name, keep(df, name)))
    left, right = (spark.range(1000).select(F.col("id").alias(c), F.lit("the same title").alias("title"), F.lit(0).alias("grp")) for c in "lr")
    got = assign.similar_one_to_one(left, right.drop("grp"), "grp", "l", "r", "title").collect()
    assert sorted((x.l, x.r, x.score) for x in got) == [(i, i, 1.0) for i in range(1000)]
    assert made["sets"].count() == 1 and "found" not in made
