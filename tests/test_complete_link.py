"""Complete linkage in rounds and in tasks, against the greedy loop."""

import random

import pytest

from quaystone.operators import cluster, graph


def greedy(edges):
    best = {}
    for a, b, r in edges:
        if a is not None and b is not None and a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(r, best.get(k, r))
    home = {n: {n} for k in best for n in k}
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        x, y = home[a], home[b]
        if x is not y and all((min(i, j), max(i, j)) in best for i in x for j in y):
            for n in x | y:
                home[n] = x | y
    return {n: min(c) for n, c in home.items()}


def clusters(spark, edges, **how):
    got = cluster.complete_link(spark.createDataFrame(edges, "l long, r long, ratio double"), "l", "r", "ratio", **how).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.cluster for r in got}


@pytest.mark.parametrize("local,rounds", [(0, 2), (20_000, 1), (6, 2)])
def test_random_graphs_with_ties(spark, local, rounds):
    rnd = random.Random(local + rounds)
    edges = []
    for block, (n, p) in enumerate([(9, 0.8), (14, 0.4), (7, 1.0), (12, 0.6), (10, 0.2)]):
        edges += [(block * 100 + i, block * 100 + j, rnd.choice((0.3, 0.6, 0.6, 1.0))) for i in range(n) for j in range(n) if i != j and rnd.random() < p]
    edges += [(1, 1, 1.0), (None, 2, 1.0), (3, None, 0.5), (0, 100, 0.3), (100, 0, 0.9)]
    assert clusters(spark, edges, local=local, rounds=rounds) == greedy(edges)


def test_chain_and_nothing(spark):
    chain = [(i, i + 1, 0.5) for i in range(7)]
    assert clusters(spark, chain, local=0) == greedy(chain)
    assert clusters(spark, []) == {}


def test_copies_of_tasks(spark, monkeypatch):
    rnd, rows = random.Random(3), []
    for t in range(60):
        urls = [*"abcde"] if t % 3 == 0 else rnd.sample("abcdefgh", 4 if t % 11 == 0 else 5)
        rows += [(t, None if t % 17 == 0 else t % 2, i + 1, u) for i, u in enumerate(urls)]
    edges = spark.createDataFrame(rows, "task_id long, site_id long, rank long, url string")
    pairs = graph.overlap_grades(edges).where("grade IN ('high', 'possible')").select("left_id", "right_id", "ratio")
    made, link = [], cluster.complete_link
    monkeypatch.setattr(cluster, "complete_link", lambda e, *a: link(made.append(e) or e, *a))
    got = {r.node: r.cluster for r in cluster.task_groups(edges).collect()}
    assert got == greedy([tuple(r) for r in pairs.collect()])
    classes = {(s, frozenset(u for t_, _, _, u in rows if t_ == t)) for t, s, _, _ in rows}
    ends = {n for r in made[0].collect() for n in (r.left_id, r.right_id)}
    assert len(ends) <= len(classes) < 45


def test_parts_in_tasks(spark):
    """Parts linked by rows of bits in a task each, beside a part that is too large and a part of null."""
    rnd, rows = random.Random(9), []
    for part, (n, p) in enumerate([(40, 0.5), (25, 0.8), (60, 0.3), (12, 1.0)]):
        rows += [(None if part == 3 else part, part * 100 + i, part * 100 + j, rnd.choice((0.6, 0.8, 0.8, 1.0))) for i in range(n) for j in range(n) if i < j and rnd.random() < p]
    edges = spark.createDataFrame(rows, "part long, l long, r long, ratio double")
    for nodes in (30, 1000):
        got = cluster.complete_link(edges, "l", "r", "ratio", "part", nodes=nodes).collect()
        assert {r.node: r.cluster for r in got} == greedy([r[1:] for r in rows]) and len(got) == len({r.node for r in got})


def test_sites_are_compared_alone(spark):
    """Tasks of two sites make no pairs, and pairs below the grades never leave their block."""
    rnd = random.Random(4)
    rows = [(t, t % 3, i + 1, u) for t in range(90) for i, u in enumerate(rnd.sample("abcdefghij", 5))]
    edges = spark.createDataFrame(rows, "task_id long, site_id long, rank long, url string")
    close = graph.close_tasks(edges)
    want = graph.overlap_grades(edges).where("grade IN ('high', 'possible')").select("left_id", "right_id", "ratio").collect()
    assert sorted(map(tuple, close.drop("site").collect())) == sorted(map(tuple, want))
    assert all(r.site == r.left_id % 3 for r in close.collect())
    got = {r.node: r.cluster for r in cluster.task_groups(edges).collect()}
    assert {n: c for n, c in got.items() if n in greedy([tuple(r) for r in want])} == greedy([tuple(r) for r in want])
