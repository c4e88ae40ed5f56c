"""M1, M3: containment by the rarest token, by plain loops, and winners of rows that stand for several."""

import random

from quaystone.operators import matching


def test_containment_with_copies(spark):
    rng = random.Random(8)
    say = lambda least, most: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(least, most)))
    k, t = [(i, say(0, 3)) for i in range(80)] + [(900, None), (901, "zz a")], [(i, say(0, 5)) for i in range(120)] + [(900, None)]
    want = set()
    for i, x in k:
        for j, y in t:
            a, b = set((x or "").split()), set((y or "").split())
            if a and a <= b and (a == b or len(a) >= 2):
                want.add((i, j, "exact" if a == b else "contains"))
    out = matching.containment(spark.createDataFrame(k, "k long, w string"), spark.createDataFrame(t, "t long, w string"), "k", "t", "w", "w")
    got = out.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    shuffled = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" not in shuffled and "hashpartitioning(t#" not in shuffled


def test_a_text_of_several_articles_is_no_winner(spark):
    rows = [("k", 1, 9, 1), ("k", 2, 3, 4), ("m", 3, 9, 2), ("m", 4, 3, 1)]
    df = spark.createDataFrame(rows, "key string, c long, score long, copies long")
    assert {tuple(r) for r in matching.unique_winners(df, "key", "c").collect()} == {("k", 1, 9, "matched"), ("m", None, 9, "ambiguous")}


def test_rows_of_copies_are_small(spark):
    """All pairs of two rows of copies stand in memory at once, so a row holds few ids."""
    rows = spark.range(1000).selectExpr("id", "'large ring' AS w")
    held = matching._held(rows, "id", "w", "k").collect()
    assert max(len(r.k_ids) for r in held) <= 128 and sorted(i for r in held for i in r.k_ids) == [*range(1000)]
