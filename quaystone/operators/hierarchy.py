"""Directed graphs of questions and demand: nodes on cycles, least depths, and visiting orders.

Parts of a graph with few edges are walked through in tasks, each part read from a sorted stream. Larger ones are done in
rounds of joins over the edge table; a round's result is a table, and the one before it is deleted. No node's neighbours are gathered in one task there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaystone.operators.components import connected_components
from quaystone.plans.storage import drop_table, materialise


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that are left when nodes without an edge in or out are taken away again and again, and their number."""
    n = edges.count()
    while n:
        step = edges
        for _ in range(2):  # two steps to a table
            into, out = step.select(F.col("t").alias("s")).distinct(), step.select(F.col("s").alias("t")).distinct()
            step = step.join(into, "s", "left_semi").join(out, "t", "left_semi").select("s", "t")
        step = materialise(step, "trimmed")
        drop_table(edges)
        edges, last, n = step, n, step.count()
        if n == last:
            break
    return edges, n


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which a node can be reached, itself included."""
    nodes = edges.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    labels, before = materialise(nodes.select("node", F.col("node").alias("label")), "labels"), None
    while True:
        handed = edges.join(labels, edges["s"] == labels["node"]).select(F.col("t").alias("node"), "label")
        after = materialise(labels.withColumnRenamed("label", "old").join(handed.groupBy("node").agg(F.min("label").alias("new")), "node", "left").select("node", F.least("old", "new").alias("label"), (F.col("new") < F.col("old")).alias("moved")), "labels")
        drop_table(labels)
        if not after.where("moved").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _reach_back(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) from which a root can be reached along edges (s, t), roots included."""
    found = frontier = materialise(roots, "reached")
    while True:
        step = materialise(edges.join(frontier, edges["t"] == frontier["node"]).select(F.col("s").alias("node")).distinct().join(found, "node", "left_anti"), "reached")
        if not step.limit(1).count():
            return found
        found, frontier = found.unionByName(step), step


def cyclic_nodes(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node) for each node that can be reached from itself: strongly connected components.

    What cannot lie on a cycle is trimmed first. Then every node is labelled with the smallest node
    that reaches it; the nodes of one label that reach back to it are its component. Components are
    taken out and the rest goes on. Null ends are ignored, repeated edges count once, an edge from a
    node to itself is a cycle. Rounds: the length of the longest path without detours in what is left
    after trimming, for each layer of components.
    """
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    out = [e.where("s = t").select(F.col("s").alias("node"))]
    now, n = _trimmed(materialise(e.where("s <> t"), "trimmed"))
    while n:
        labels = _least_reaching(now)
        a, b = labels.select(F.col("node").alias("s"), F.col("label").alias("la")), labels.select(F.col("node").alias("t"), F.col("label").alias("lb"))
        inner = materialise(now.join(a, "s").join(b, "t").where("la = lb").select("s", "t"), "inner")
        reached = materialise(_reach_back(inner, labels.where("node = label").select("node")), "component")
        sizes = reached.join(labels, "node").groupBy("label").count().where("count > 1")
        out.append(materialise(reached.join(labels, "node").join(sizes, "label").select("node"), "cyclic"))
        gone = reached.select("node")
        left = materialise(now.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("s", "t"), "trimmed")
        for table in (now, labels, inner):
            drop_table(table)
        now, n = _trimmed(left)
    return reduce(lambda x, y: x.unionByName(y), out).distinct()


def least_depths(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, depth long) for each node that can be reached from one without an edge into it: the fewest steps, 0 for that node itself."""
    e = materialise(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(F.col(source).alias("s"), F.col(target).alias("t")).distinct(), "edges")
    roots = e.select(F.col("s").alias("node")).distinct().join(e.select(F.col("t").alias("node")), "node", "left_anti")
    found = frontier = materialise(roots.withColumn("depth", F.lit(0).cast("long")), "depths")
    depth = 0
    while frontier.limit(1).count():
        depth += 1
        step = e.join(frontier, e["s"] == frontier["node"]).select(F.col("t").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = materialise(step, "depths")
        found = found.unionByName(frontier)
    return found


def _walked(sources: list, targets: list) -> dict:
    """node: (depth, cyclic) of one part: strongly connected components by Tarjan's stack, least depths breadth first; see :func:`cycle_depths`."""
    then: dict = {}
    inner, looped = set(), set()
    for a, b in zip(sources, targets):
        then.setdefault(b, [])
        if a == b:
            looped.add(a)
            then.setdefault(a, [])
        else:
            then.setdefault(a, []).append(b)
            inner.add(b)
    depth = {n: 0 for n, t in then.items() if t and n not in inner}
    line = deque(depth)
    while line:
        n = line.popleft()
        for t in then[n]:
            if t not in depth:
                depth[t] = depth[n] + 1
                line.append(t)
    place, low, stack, on = {}, {}, [], set()
    for start in then:
        if start in place:
            continue
        calls = [(start, iter(then[start]))]
        place[start] = low[start] = len(place)
        stack.append(start)
        on.add(start)
        while calls:
            n, rest = calls[-1]
            t = next(rest, None)
            if t is None:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[n])
                if low[n] == place[n]:
                    part = [stack.pop()]
                    while part[-1] != n:
                        part.append(stack.pop())
                    on.difference_update(part)
                    if len(part) > 1:
                        looped.update(part)
            elif t not in place:
                place[t] = low[t] = len(place)
                stack.append(t)
                on.add(t)
                calls.append((t, iter(then[t])))
            elif t in on:
                low[n] = min(low[n], place[t])
    return {n: (depth.get(n), n in looped) for n in then}


def cycle_depths(edges: DataFrame, source: str, target: str, within: list[str] | None = None, local: int = 20_000) -> DataFrame:
    """(``within``, node, depth long, cycle_detected) for each node of an edge: :func:`least_depths` (null if no node without parents leads there) and :func:`cyclic_nodes`.

    No edge leaves the part that the columns ``within`` name; without them, parts are the connected
    components. Parts of at most ``local`` distinct edges are walked through in tasks, the others go in rounds.
    """
    at, keys = within or [], [f"w{i}_" for i in range(len(within or [0]))]
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(at, keys)), F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    if not at:
        e = materialise(e, "edges")
        part = connected_components(e, "s", "t").select(F.col("node").alias("s"), F.col("component").alias("of_"))
        e = e.join(part, "s", "left").select(F.coalesce("of_", "s").alias(keys[0]), "s", "t")
    e = materialise(e, "edges")
    large = materialise(e.groupBy(*keys).count().where(F.col("count") > local).select(*(F.col(k).alias(f"x{k}") for k in keys)), "large")
    out = [*keys, "node", "depth", "cycle_detected"]
    kinds = dict(e.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, rows, types = None, ([], []), [], None

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=out)
            rows.clear()
            return batch

        for batch in batches:
            types = [*(batch.schema.field(k).type for k in keys), batch.schema.field("s").type, pa.int64(), pa.bool_()]
            for *part, s, t in zip(*(batch.column(c).to_pylist() for c in (*keys, "s", "t"))):
                if part != now:
                    rows += [(*now, n, *x) for n, x in _walked(*ends).items()] if now is not None else []
                    if len(rows) >= 4096:
                        yield full()
                    now, ends = part, ([], [])
                ends[0].append(s)
                ends[1].append(t)
        rows += [(*now, n, *x) for n, x in _walked(*ends).items()] if now is not None else []
        if rows:
            yield full()

    any_large = large.limit(1).count() > 0
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"x{k}")) for k in keys))
    here = e.join(large, same, "left_anti") if any_large else e
    found = here.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", node {kinds['s']}, depth long, cycle_detected boolean")
    if any_large:
        # Every key is a field of the node, so that equal names in different parts are different nodes.
        there = materialise(e.join(large, same, "left_semi").select(*(F.struct(*keys, F.col(c).alias("node")).alias(c) for c in "st")), "edges")
        nodes = there.select(F.explode(F.array("s", "t")).alias("node")).distinct()
        cyclic = cyclic_nodes(there, "s", "t").withColumn("cycle_detected", F.lit(True))
        more = nodes.join(least_depths(there, "s", "t"), "node", "left").join(cyclic, "node", "left").na.fill(False, ["cycle_detected"])
        found = found.unionByName(more.select("node.*", "depth", "cycle_detected"))
    return materialise(found.select(*(F.col(k).alias(c) for c, k in zip(at, keys)), "node", "depth", "cycle_detected"), "depths")


def _plain(text: Column) -> Column:
    """One spelling of a question: lower case, single spaces, an ASCII question mark; null if nothing is left."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "？", "?"), r"\s+", " "))
    return F.when(c != "", c)


def question_hierarchy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph from seed questions to the questions shown for them; rows are (task_id, seed_question, question).

    Spellings of a question are one node. Rows without a question are nothing; without a seed, or with
    itself as its seed, a question is a node that occurs but has no edge. depth is the least number of
    steps from a node without parents, null if none leads there. A node on a cycle or with several
    parents is no heading before someone has looked at it; an edge is to be looked at if one of its
    ends is on a cycle or its child has several parents.
    """
    r = rows.select("task_id", _plain(F.col("seed_question")).alias("parent"), _plain(F.col("question")).alias("child")).where("child is not null")
    edges = r.where("parent is not null and parent <> child").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("task_id").alias("tasks"))
    edges = materialise(edges, "questions")
    shown = r.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("occurrences"))
    out = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    nodes = shown.join(out, "node", "full").join(into, "node", "full").join(cycle_depths(edges, "parent", "child"), "node", "left")
    nodes = nodes.na.fill(0, ["occurrences", "out_degree", "in_degree"]).na.fill(False, ["cycle_detected"])
    nodes = nodes.withColumn("depth", F.when((F.col("in_degree") == 0) & F.col("depth").isNull(), 0).otherwise(F.col("depth")))
    fine = (F.col("depth") > 0) & ~F.col("cycle_detected") & (F.col("in_degree") < 2)
    nodes = nodes.withColumn("heading_candidate_state", F.when(fine, "eligible_for_editor_review").otherwise("blocked_hierarchy_review"))
    end = nodes.select("node", "cycle_detected", "in_degree")
    marked = edges.join(end.select(F.col("node").alias("parent"), F.col("cycle_detected").alias("a_")), "parent").join(end.select(F.col("node").alias("child"), F.col("cycle_detected").alias("b_"), "in_degree"), "child")
    return nodes, marked.select("parent", "child", "occurrences", "tasks", (F.col("a_") | F.col("b_") | (F.col("in_degree") > 1)).alias("review_required"))


def demand_traversal(rows: DataFrame, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of latent demand; rows are (site_id, group_id, occurrence_id, task_id, source_keyword, seed_value, value, demand_type, occurrence_order, depth).

    A depth that is null or below 1 is 1; deeper rows than ``max_depth`` (1 or 2) go, and so do those
    without a value or a parent. The parent is the seed value, else the source keyword. Below depth 1 a
    seed value is a demand itself; every other parent is the seed of its group, which is one node. A
    demand is a node by its spelling, whatever its type. Depths are the least seen (0 for a seed).
    ``first`` is the place of the first occurrence in the order of task, source keyword, type, order and id.
    """
    if max_depth not in (1, 2):
        raise ValueError("max_depth is 1 or 2")
    seed, value = F.when(F.col("seed_value") != "", F.col("seed_value")), F.when(F.col("value") != "", F.col("value"))
    depth = F.when(F.col("depth") >= 1, F.col("depth")).otherwise(1).cast("long")
    last = F.lit(2**62)
    first = F.struct(F.coalesce("task_id", last).alias("task"), F.coalesce("source_keyword", F.lit("")).alias("keyword"), F.coalesce("demand_type", F.lit("")).alias("type"), F.coalesce(F.col("occurrence_order").cast("long"), last).alias("order"), F.coalesce("occurrence_id", last).alias("id"))
    r = rows.select("site_id", "group_id", "occurrence_id", "demand_type", depth.alias("depth"), F.coalesce(seed, F.when(F.col("source_keyword") != "", F.col("source_keyword"))).alias("parent_value"), value.alias("value"), seed.isNotNull().alias("seeded"), first.alias("first"))
    r = r.where(F.col("depth") <= max_depth).where("parent_value is not null and value is not null")
    deep = (F.col("depth") > 1) & F.col("seeded")
    r = r.select("site_id", "group_id", "occurrence_id", "demand_type", "depth", "first", F.when(deep, F.concat(F.lit("demand:"), _plain(F.col("parent_value")))).otherwise("seed").alias("parent"), F.concat(F.lit("demand:"), _plain(F.col("value"))).alias("child"), F.when(deep, F.col("depth") - 1).otherwise(0).alias("parent_depth"))
    r = materialise(r.where("parent is not null and child is not null"), "demand")
    at = ["site_id", "group_id"]
    edges = r.groupBy(*at, "parent", "child", "demand_type").agg(F.min("depth").alias("depth"), F.count_distinct("occurrence_id").alias("occurrences"), F.min("first").alias("first"))
    ends = r.select(*at, F.explode(F.array(F.struct(F.col("parent").alias("node"), F.col("parent_depth").cast("long").alias("depth")), F.struct(F.col("child").alias("node"), F.col("depth").alias("depth")))).alias("n"), "occurrence_id", "first").select(*at, "n.*", "occurrence_id", "first")
    nodes = ends.groupBy(*at, "node").agg(F.min("depth").alias("depth"), F.count_distinct("occurrence_id").alias("occurrences"), F.min("first").alias("first"))
    into = r.groupBy(*at, F.col("child").alias("node")).agg(F.count_distinct("parent").alias("parents"))
    out = r.groupBy(*at, F.col("parent").alias("node")).agg(F.count_distinct("child").alias("children"))
    cyclic = cycle_depths(r, "parent", "child", at).where("cycle_detected").drop("depth")
    key = [*at, "node"]
    nodes = nodes.join(into, key, "left").join(out, key, "left").join(cyclic, key, "left").na.fill(0, ["parents", "children"]).na.fill(False, ["cycle_detected"])
    several = F.col("parents") > 1
    return nodes.withColumn("multi_parent", several).withColumn("review_state", F.when(F.col("cycle_detected") | several, "review_required").otherwise("observed_path")), edges


def visiting_orders(nodes: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """(site_id, group_id, strategy, visit_order long, node, depth long, path array): the nodes of each group breadth first and depth first.

    A node is visited once, from the parent that comes to it first; of several roots or children the
    one that occurred first is taken first (depth first: the last root first, as a stack gives them).
    Nodes that no root leads to start anew, in the order of their first occurrence. An order is
    sequential by definition, so a keyword group is in one task, which reads its sorted nodes and
    distinct edges as a stream and holds one group at a time.
    """
    at = ["site_id", "group_id"]
    names = [*at, "strategy", "visit_order", "node", "depth", "path"]

    def orders(depth: dict, children: dict, inner: set) -> Iterator[tuple]:
        for strategy in ("breadth_first", "depth_first"):
            pending = deque((n, d, [n]) for n, d in depth.items() if n not in inner)
            planned, seen, at_ = {n for n, _, _ in pending}, set(), 0
            rest = iter(depth)
            take = pending.pop if strategy == "depth_first" else pending.popleft
            while True:
                if not pending:
                    node = next((n for n in rest if n not in seen), None)
                    if node is None:
                        break
                    pending.append((node, depth[node], [node]))
                    planned.add(node)
                node, d, path = take()
                if node in seen:
                    continue
                seen.add(node)
                if d > max_depth:
                    continue
                yield strategy, at_, node, d, path
                at_ += 1
                following = [c for c in children.get(node, ()) if c not in seen] if d < max_depth else []
                for c in reversed(following) if strategy == "depth_first" else following:
                    if c not in planned:
                        planned.add(c)
                        pending.append((c, d + 1, [*path, c]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph, rows, types = None, ({}, {}, set()), [], None

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]
            for site, group, kind, end, parent, d in zip(*(batch.column(c).to_pylist() for c in (*at, "kind_", "end_", "parent_", "depth_"))):
                if (site, group) != now:
                    if now is not None:
                        for row in orders(*graph):
                            rows.append((*now, *row))
                            if len(rows) >= 4096:
                                yield full()
                    now, graph = (site, group), ({}, {}, set())
                depth, children, inner = graph
                if kind == 0:
                    depth[end] = d
                else:
                    children.setdefault(parent, []).append(end)
                    inner.add(end)
        if now is not None:
            for row in orders(*graph):
                rows.append((*now, *row))
                if len(rows) >= 4096:
                    yield full()
        if rows:
            yield full()

    kinds = dict(nodes.dtypes)
    schema = f"site_id {kinds['site_id']}, group_id {kinds['group_id']}, strategy string, visit_order long, node string, depth long, path array<string>"
    nothing = F.lit(None).cast("string")
    n = nodes.select(*at, F.lit(0).alias("kind_"), "first", F.col("node").alias("end_"), nothing.alias("parent_"), nothing.alias("type_"), F.col("depth").cast("long").alias("depth_"))
    e = edges.select(*at, F.lit(1).alias("kind_"), "first", F.col("child").alias("end_"), F.col("parent").alias("parent_"), F.col("demand_type").alias("type_"), F.lit(None).cast("long").alias("depth_"))
    lines = n.unionByName(e).repartition(*at).sortWithinPartitions(*at, "kind_", "first", "end_", "parent_", "type_")
    return lines.select(*at, "kind_", "end_", "parent_", "depth_").mapInArrow(run, schema)


def first_divergence(orders: DataFrame) -> DataFrame:
    """(site_id, group_id, visit_order, breadth_first_node, depth_first_node): where both orders of a group differ first; groups without a difference have no row."""
    at = ["site_id", "group_id", "visit_order"]
    both = orders.groupBy(*at).agg(F.max(F.when(F.col("strategy") == "breadth_first", F.col("node"))).alias("b"), F.max(F.when(F.col("strategy") == "depth_first", F.col("node"))).alias("d")).where(~F.col("b").eqNullSafe(F.col("d")))
    return both.groupBy("site_id", "group_id").agg(F.min(F.struct("visit_order", F.col("b").alias("breadth_first_node"), F.col("d").alias("depth_first_node"))).alias("f")).select("site_id", "group_id", "f.*")
