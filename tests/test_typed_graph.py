"""Bounded traversal against a plain queue."""

import random

import pytest

from quaystone.operators import typed_graph


def plain(relations, start, depth, most, types=None):
    rows, visited, frontier = [], set(start), [(n, [n], []) for n in start]
    for level in range(1, depth + 1):
        following = []
        for node, path, used in frontier:
            for i, kind, s, t in sorted((r for r in relations if node in (r[2], r[3]) and (not types or r[1] in types)), key=lambda r: (r[1], r[2], r[3], r[0])):
                out = s == node
                other = t if out else s
                rows.append((i, level, "outgoing" if out else "incoming", node, other, (*path, other), (*used, i)))
                if level < depth and other not in visited:
                    visited.add(other)
                    following.append((other, [*path, other], [*used, i]))
                if len(rows) >= most:
                    return rows, True
        frontier = following
    return rows, False


@pytest.mark.parametrize("depth,most", [(1, 2000), (2, 2000), (3, 5000), (3, 40), (2, 7), (3, 1)])
def test_traversal(spark, depth, most):
    rnd = random.Random(9)
    relations = [(i, rnd.choice(("hype", "syn", "caus")), f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for i in range(60)]
    df = spark.createDataFrame(relations, "relation_id long, relation_type string, source string, target string").repartition(3)
    start = spark.createDataFrame([("n3", 1), ("n1", 2)], "node string, place long")
    for types in (None, ["hype", "syn"]):
        want, cut = plain(relations, ["n3", "n1"], depth, most, types)
        got = sorted(typed_graph.traverse(df, start, depth, types, most).collect(), key=lambda r: r.visit_order)
        assert [(r.relation_id, r.depth, r.direction, r.from_node, r.to_node, tuple(r.path_nodes), tuple(r.path_relations)) for r in got] == want
        assert {r.truncated for r in got} == {cut}
    deep = sorted(typed_graph.traverse(df, start, depth, None, most, "depth_first").collect(), key=lambda r: r.visit_order)
    assert {(r.relation_id, r.direction) for r in deep} == {(w[0], w[2]) for w in plain(relations, ["n3", "n1"], depth, most)[0]}
    seen = [tuple(r.path_relations) for r in deep]
    assert all(p[:-1] in seen[:i] for i, p in enumerate(seen) if len(p) > 1)


def test_names_and_seeds(spark):
    df = spark.createDataFrame([(1, "hype", "a", "b"), (2, "own", "b", "a"), (3, "syn", "a", "a")], "relation_id long, relation_type string, source string, target string")
    start = spark.createDataFrame([("a", 1)], "node string, place long")
    assert {(r.relation_id, r.traversal_type) for r in typed_graph.traverse(df, start).collect()} == {(1, "hype"), (2, "own_inverse"), (3, "syn")}
    assert typed_graph.traverse(df, start.limit(0), 3).count() == 0
    senses = spark.createDataFrame([(n, w, t) for n, w, t in [("z", 1, "Cat"), ("a", 2, "cat"), ("a", 1, "cat"), ("m", 1, "catalogue"), ("k", 3, "a cat")] + [(f"x{i:02}", 1, f"dogs {i:02}") for i in range(40)]], "node string, word_id long, term string")
    assert [(r.node, r.place, r.match) for r in typed_graph.seeds(senses, " CAT ").orderBy("place").collect()] == [("a", 1, "exact"), ("z", 2, "exact")]
    assert [(r.node, r.match) for r in typed_graph.seeds(senses, "ca").orderBy("place").collect()] == [("a", "partial"), ("z", "partial"), ("k", "partial"), ("m", "partial")]
    assert typed_graph.seeds(senses, "dogs").count() == 25 and typed_graph.seeds(senses, "").count() == typed_graph.seeds(senses, "bird").count() == 0
    with pytest.raises(ValueError):
        typed_graph.traverse(df, start, 4)
