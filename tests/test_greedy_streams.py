"""One-to-one pairs and dependency orders without a pandas group each, by plain loops, and the plan."""

import random

from quaystone.operators import cluster


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_to_one_reads_no_group_whole(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(40), rng.randrange(40), rng.choice([0.2, 0.4, 0.6, 0.6, 0.9])) for _ in range(900)]
    want, used = set(), set()
    for g, l, r, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if s >= 0.4 and (g, "l", l) not in used and (g, "r", r) not in used:
            used |= {(g, "l", l), (g, "r", r)}
            want.add((g, l, r, s))
    out = cluster.greedy_one_to_one(spark.createDataFrame(rows, "g long, l long, r long, s double"), "g", "l", "r", "s")
    got = out.collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert "FlatMapGroups" not in plan(out) and ">= 0.4" in plan(out)


def test_dependency_order_of_many_stories(spark):
    rng = random.Random(6)
    edges = [(f"s{s}", a, b) for s in range(50) for a in range(6) for b in range(a) if rng.random() < 0.5]
    out = cluster.dependency_order(spark.createDataFrame(edges + edges, "story string, a long, b long"), "story", "a", "b")
    got = {}
    for r in out.collect():
        got.setdefault(r.story, {})[r.position] = r.step
    for story, steps in got.items():
        left, mine = {n for s, *e in edges if s == story for n in e}, [(a, b) for s, a, b in edges if s == story]
        for position in range(1, len(steps) + 1):
            free = min(n for n in left if not any(b == n and a in left for a, b in mine))
            assert steps[position] == free
            left.remove(free)
        assert not left
    assert len(got) == len({s for s, *_ in edges}) and "FlatMapGroups" not in plan(out)
