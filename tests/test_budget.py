"""Taking what still fits, in rounds and in one walk, against the plain loop."""

import random

import pytest

from quaystone.operators import demand


def plain(rows, cap):
    left, out = {}, {}
    for b, i, c in sorted(r for r in rows if r[0] is not None and r[2] is not None):
        rest = left.get(b, cap)
        out[i] = c <= rest + 1e-9
        left[b] = rest - c if out[i] else rest
    return {i: out.get(i, False) for _, i, _ in rows}


@pytest.mark.parametrize("local", [0, 40, 20_000])
def test_rounds_take_what_the_loop_takes(spark, local):
    rng = random.Random(5)
    # one budget has a third of the rows; some cost nothing, some more than the cap
    rows = [(rng.choice(["hot", "hot", "b", "c", "d", "e"]), i, float(rng.choice([0, 1, 2, 5, 7, 11, 40, 200]))) for i in range(400)] + [(None, 400, 1.0), ("b", 401, None), ("only", 402, 500.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "b string, i long, c double")
    got = demand.greedy_budget(df, "b", ["i"], "c", 90, local=local)
    assert got.columns == ["b", "i", "c", "selected"]
    taken = {r.i: r.selected for r in got.collect()}
    assert taken == plain(rows, 90) and {True, False} == set(taken.values())


def test_no_rows(spark):
    assert demand.greedy_budget(spark.createDataFrame([], "b string, i long, c double"), "b", ["i"], "c", 10).count() == 0
