"""Cycles, depths and visiting orders of small graphs, against plain loops."""

import random

import pytest

from quaystone.operators import hierarchy


def reachable(edges, a):
    seen, todo = set(), [t for s, t in edges if s == a]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [t for s, t in edges if s == x]
    return seen


GRAPHS = {
    "none": [],
    "chain": [(1, 2), (2, 3), (3, 4)],
    "self": [(1, 1), (1, 2)],
    "two cycles and a bridge": [(1, 2), (2, 3), (3, 1), (3, 7), (7, 8), (8, 9), (9, 8), (9, 5), (0, 1), (5, 6), (2, 2)],
    "nested": [(5, 6), (6, 7), (7, 5), (6, 8), (8, 6), (8, 9), (1, 5), (1, 5), (9, 10), (10, 11), (11, 9), (11, 12)],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_cycles(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame([*edges, (None, 3), (2, None)], "a long, b long")
    assert {r.node for r in hierarchy.cyclic_nodes(df, "a", "b").collect()} == {a for a, _ in edges if a in reachable(edges, a)}


def test_random_graphs(spark):
    rnd = random.Random(6)
    edges = [(b * 100 + rnd.randrange(9), b * 100 + rnd.randrange(9)) for b in range(30) for _ in range(rnd.randrange(2, 14))]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node for r in hierarchy.cyclic_nodes(df, "a", "b").collect()} == {a for a, _ in edges if a in reachable(edges, a)}
    plain = [(a, b) for a, b in edges if a != b]
    depth, level = {a: 0 for a, _ in plain if a not in {b for _, b in plain}}, 0
    while True:
        level += 1
        new = {b for a, b in plain if depth.get(a) == level - 1 and b not in depth}
        if not new:
            break
        depth |= dict.fromkeys(new, level)
    got = hierarchy.least_depths(df, "a", "b").collect()
    assert {r.node: r.depth for r in got} == depth and len(got) == len(depth)


def test_questions(spark):
    rows = [(1, "A", "b"), (1, "a ", "B"), (2, "b", "c？"), (2, "c?", "d"), (3, "d", "c?"), (3, None, "alone"), (4, "x", " "), (4, "Self", "self"), (5, "a", "e"), (5, "b", "e")]
    nodes, edges = hierarchy.question_hierarchy(spark.createDataFrame(rows, "task_id long, seed_question string, question string"))
    got = {r.node: (r.occurrences, r.in_degree, r.out_degree, r.depth, r.cycle_detected, r.heading_candidate_state[:8]) for r in nodes.collect()}
    assert got == {
        "a": (0, 0, 2, 0, False, "blocked_"), "b": (2, 1, 2, 1, False, "eligible"), "c?": (2, 2, 1, 2, True, "blocked_"), "d": (1, 1, 1, 3, True, "blocked_"),
        "e": (2, 2, 0, 1, False, "blocked_"), "alone": (1, 0, 0, 0, False, "blocked_"), "self": (1, 0, 0, 0, False, "blocked_"),
    }
    assert {(r.parent, r.child, r.occurrences, r.tasks, r.review_required) for r in edges.collect()} == {("a", "b", 2, 1, False), ("b", "c?", 1, 1, True), ("c?", "d", 1, 1, True), ("d", "c?", 1, 1, True), ("a", "e", 1, 1, True), ("b", "e", 1, 1, True)}


def test_demand(spark):
    def row(i, keyword, seed, value, depth, kind="paa", group=1):
        return (1, group, i, 10, keyword, seed, value, kind, i, depth)

    rows = [
        row(1, "kw", None, "a", 1), row(2, "kw", "", "b", 1), row(3, "kw", "A", "c", 2), row(4, "kw", "b", "d", 2), row(5, "kw", "c", "a", 2), row(6, "kw", "x", "e", 3), row(7, None, None, "f", 1), row(8, "kw", None, None, 1),
        row(9, "kw", None, "g", 2), row(10, "other", "seed", "a", None), row(11, "kw", "b", "c", 2, "related"), row(12, "k2", None, "z", 1, group=2),
        row(13, "k3", "p", "q", 2, group=3), row(14, "k3", "q", "p", 2, group=3),
    ]
    df = spark.createDataFrame(rows, "site_id long, group_id long, occurrence_id long, task_id long, source_keyword string, seed_value string, value string, demand_type string, occurrence_order long, depth long")
    nodes, edges = hierarchy.demand_traversal(df, 2)
    got = {(r.group_id, r.node): (r.depth, r.occurrences, r.parents, r.children, r.cycle_detected, r.review_state == "review_required") for r in nodes.collect()}
    assert got == {
        (1, "seed"): (0, 4, 0, 3, False, False), (1, "demand:a"): (1, 4, 2, 1, True, True), (1, "demand:b"): (1, 3, 1, 2, False, False), (1, "demand:c"): (1, 3, 2, 1, True, True),
        (1, "demand:d"): (2, 1, 1, 0, False, False), (1, "demand:g"): (2, 1, 1, 0, False, False), (2, "seed"): (0, 1, 0, 1, False, False), (2, "demand:z"): (1, 1, 1, 0, False, False),
        (3, "demand:p"): (1, 2, 1, 1, True, True), (3, "demand:q"): (1, 2, 1, 1, True, True),
    }
    assert {(r.group_id, r.parent, r.child, r.demand_type, r.depth, r.occurrences) for r in edges.where("group_id = 1 and parent = 'demand:b'").collect()} == {(1, "demand:b", "demand:d", "paa", 2, 1), (1, "demand:b", "demand:c", "related", 2, 1)}
    orders = hierarchy.visiting_orders(nodes, edges, 2).collect()
    line = {(g, s): [(r.node.replace("demand:", ""), r.depth) for r in sorted((r for r in orders if (r.group_id, r.strategy) == (g, s)), key=lambda r: r.visit_order)] for g in (1, 2, 3) for s in ("breadth_first", "depth_first")}
    assert line[1, "breadth_first"] == [("seed", 0), ("a", 1), ("b", 1), ("g", 1), ("c", 2), ("d", 2)]
    assert line[1, "depth_first"] == [("seed", 0), ("a", 1), ("c", 2), ("b", 1), ("d", 2), ("g", 1)]
    assert line[2, "breadth_first"] == line[2, "depth_first"] == [("seed", 0), ("z", 1)]
    assert line[3, "breadth_first"] == [("p", 1), ("q", 2)]
    assert [r.path for r in orders if r.node == "demand:c" and r.strategy == "depth_first"] == [["seed", "demand:a", "demand:c"]]
    apart = hierarchy.first_divergence(hierarchy.visiting_orders(nodes, edges, 2)).collect()
    assert [tuple(r) for r in apart] == [(1, 1, 2, "demand:b", "demand:c")]
    with pytest.raises(ValueError):
        hierarchy.demand_traversal(df, 3)


@pytest.mark.parametrize("local", [0, 6, 20_000])
def test_parts_in_tasks_and_in_rounds(spark, local):
    rnd = random.Random(8)
    edges = [(b, rnd.randrange(7), rnd.randrange(7)) for b in range(6) for _ in range(rnd.randrange(2, 12))]
    df = spark.createDataFrame([*edges, (None, 1, 2), (None, 2, 1), (9, None, 1)], "part long, a long, b long")
    edges += [(None, 1, 2), (None, 2, 1)]
    want = {}
    for part in {p for p, _, _ in edges}:
        own = [(a, b) for p, a, b in edges if p == part]
        plain = [(a, b) for a, b in own if a != b]
        depth, level = {a: 0 for a, _ in plain if a not in {b for _, b in plain}}, 0
        while new := {b for a, b in plain if depth.get(a) == level and b not in depth}:
            level += 1
            depth |= dict.fromkeys(new, level)
        want |= {(part, n): (depth.get(n), n in reachable(own, n)) for e in own for n in e}
    got = hierarchy.cycle_depths(df, "a", "b", ["part"], local).collect()
    assert {(r.part, r.node): (r.depth, r.cycle_detected) for r in got} == want and len(got) == len(want)
    apart = df.where("part IS NOT NULL").selectExpr("part * 10 + a AS a", "part * 10 + b AS b")
    got = hierarchy.cycle_depths(apart, "a", "b", None, local).collect()
    assert {r.node: (r.depth, r.cycle_detected) for r in got} == {p * 10 + n: v for (p, n), v in want.items() if p is not None}


def test_small_groups_need_no_rounds(spark, monkeypatch):
    for name in ("cyclic_nodes", "least_depths"):
        monkeypatch.setattr(hierarchy, name, lambda *_: pytest.fail("rounds for a small graph"))
    rows = [(1, "a", "b"), (1, "b", "c"), (2, "c", "b")]
    nodes, _ = hierarchy.question_hierarchy(spark.createDataFrame(rows, "task_id long, seed_question string, question string"))
    assert {r.node: (r.depth, r.cycle_detected) for r in nodes.collect()} == {"a": (0, False), "b": (1, True), "c": (2, True)}


def test_an_order_of_very_many_roots(spark):
    n = 30_000
    nodes = spark.range(n).selectExpr("1L AS site_id", "1L AS group_id", "concat('n', id) AS node", "1L AS depth", "id AS first")
    edges = nodes.selectExpr("site_id", "group_id", "node AS parent", "concat('n', CASE WHEN first % 2 = 0 THEN first + 1 ELSE first - 1 END) AS child", "'x' AS demand_type", "first")
    orders = hierarchy.visiting_orders(nodes, edges, 2)
    assert "CoGroups" not in orders._jdf.queryExecution().toString()  # a stream of sorted groups, none by itself
    got = orders.where("strategy = 'breadth_first'").collect()
    assert [(r.visit_order, r.node, r.depth, len(r.path)) for r in got] == [(i, f"n{i}", 1 + i % 2, 1 + i % 2) for i in range(n)]
