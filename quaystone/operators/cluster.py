"""Clusters: complete-link groups, token components, greedy assignments.

Greedy assignments work inside one group, which is what makes them exact: no pair joins two groups.
Complete linkage merges all pairs of clusters that are the best of both in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quaystone.operators.components import connected_components
from quaystone.operators.graph import close_tasks, result_classes
from quaystone.plans.storage import drop_table, materialise


def modifier(tokens, modifiers: list[str]):
    """The longest run of trailing modifiers (which is never the whole keyword's head), and the keyword without one of them."""
    m = F.array(*map(F.lit, modifiers))
    trailing = F.aggregate(F.reverse(tokens), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, t: F.struct((s["n"] + F.when(s["open"] & F.array_contains(m, t), 1).otherwise(0)).alias("n"), (s["open"] & F.array_contains(m, t)).alias("open")), lambda s: s["n"])
    parent = F.when((trailing > 0) & (F.size(tokens) > 1), F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1))), " "))
    return trailing, F.size(tokens) == trailing, parent


def _link_round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, pairs) of one round: pairs that are the best of both their clusters merge; see :func:`complete_link`."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), "best").groupBy("c").agg(F.min("best").alias("best"))
    merges = pairs.join(ends.select(F.col("c").alias("a"), "best"), ["a", "best"], "left_semi").join(ends.select(F.col("c").alias("b"), "best"), ["b", "best"], "left_semi")
    merges = materialise(merges.select(F.col("a").alias("keep"), F.col("b").alias("gone")), "merges")
    home = merges.select(F.col("gone").alias("old"), "keep").unionByName(merges.select(F.col("keep").alias("old"), "keep"))

    def moved(df: DataFrame, end: str) -> DataFrame:
        to = home.select(F.col("old").alias(end), F.col("keep").alias(f"{end}_to"))
        return df.join(to, end, "left").withColumn(f"{end}_parts", F.when(F.col(f"{end}_to").isNull(), 1).otherwise(2)).withColumn(end, F.coalesce(f"{end}_to", end))

    m = moved(moved(pairs, "a"), "b").where("a <> b")
    m = m.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a_parts") * F.col("b_parts")).alias("needed"), "best").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"), F.min("best").alias("best"))
    return merges, materialise(m.where("n = needed").select("a", "b", "best"), "pairs")


def _merge_locally(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same merges in the order of the best pairs, for the pairs of one component."""
    pairs = set(zip(pdf["a"], pdf["b"]))
    members = {n: [n] for n in set(pdf["a"]) | set(pdf["b"])}
    home = {n: n for n in members}
    for row in pdf.sort_values(["ratio", "l", "r"], ascending=[False, True, True]).itertuples():
        x, y = home[row.a], home[row.b]
        if x != y and all((min(i, j), max(i, j)) in pairs for i in members[x] for j in members[y]):
            keep, gone = min(x, y), max(x, y)
            for n in members[gone]:
                home[n] = keep
            members[keep] += members.pop(gone)
    return pd.DataFrame({"old": list(home), "keep": list(home.values())})


class _Links:
    """Greedy complete linkage of one part: nodes in their order, then pairs in theirs, as they come. Which nodes are linked with all of a cluster is a row of bits."""

    def __init__(self):
        self.nodes, self.pairs, self.bits = [], [], None

    def add(self, l: pa.Array, r: pa.Array) -> None:
        if self.bits is None:
            self.nodes = pa.concat_arrays(self.nodes)
            self.bits = np.zeros((len(self.nodes), (len(self.nodes) + 7) // 8), np.uint8)
        x, y = (pc.index_in(c, value_set=self.nodes).to_numpy().astype(np.int32) for c in (l, r))
        for p, q in ((x, y), (y, x)):
            np.bitwise_or.at(self.bits, (p, q >> 3), np.left_shift(1, q & 7).astype(np.uint8))
        self.pairs.append((x, y))

    def clusters(self) -> pa.Array:
        n, bits = len(self.nodes), self.bits
        home, members = np.arange(n), {}
        left, right = (np.concatenate(c) for c in zip(*self.pairs))
        self.pairs = []
        linked = lambda x, q: (bits[x, q >> 3] >> (q & 7)) & 1 != 0
        for start, end in _runs(left):
            q = right[start:end]
            while len(q):
                x = int(home[left[start]])
                at = np.flatnonzero(linked(x, q) & (home[q] != x))
                for i in at:
                    y = int(home[q[i]])
                    if y not in members or linked(x, members[y]).all():
                        break
                else:
                    break
                keep, gone = min(x, y), max(x, y)
                both = np.concatenate([members.pop(c, np.array([c])) for c in (keep, gone)])
                members[keep], home[both] = both, keep
                bits[keep] &= bits[gone]
                q = q[i + 1 :]
        return self.nodes.take(pa.array(home))


def _runs(x: np.ndarray) -> zip:
    """(start, end) of stretches of equal values."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)])


def _linked(e: DataFrame) -> DataFrame:
    """(node, cluster) of pairs (part, l, r, ratio), each part in a task: its nodes and then its pairs are read as a sorted stream."""
    kind = e.schema["l"].dataType.simpleString()
    nodes = e.select("part", F.explode(F.array("l", "r")).alias("l")).distinct()
    rows = nodes.select("part", F.lit(0).alias("kind"), F.lit(0.0).alias("o"), "l", F.lit(None).cast(kind).alias("r")).unionByName(e.select("part", F.lit(1).alias("kind"), (-F.col("ratio")).alias("o"), "l", "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None

        def done() -> pa.RecordBatch:
            c = part.clusters()
            return pa.RecordBatch.from_arrays([part.nodes, c], names=["node", "cluster"])

        for batch in batches:
            codes = batch.column("part").dictionary_encode().indices.to_numpy()
            for start, end in _runs(codes) if len(codes) else ():
                b = batch.slice(start, end - start)
                if (g := b.column("part")[0].as_py()) != now:
                    if part is not None:
                        yield done()
                    now, part = g, _Links()
                first = int(pc.sum(pc.equal(b.column("kind"), 0)).as_py())
                if first:
                    part.nodes.append(b.column("l").slice(0, first))
                if first < len(b):
                    part.add(b.column("l").slice(first), b.column("r").slice(first))
        if part is not None:
            yield done()

    return rows.repartition("part").sortWithinPartitions("part", "kind", "o", "l", "r").mapInArrow(run, f"node {kind}, cluster {kind}")


def complete_link(edges: DataFrame, left: str, right: str, ratio: str, part: str | None = None, local: int = 20_000, rounds: int = 8, nodes: int = 65_536, most: int = 60_000_000) -> DataFrame:
    """(node, cluster) by greedy complete linkage: edges by ratio (largest first), then ids; two clusters merge only if every cross pair is an edge.

    The cluster is named by its smallest node. Null ends and self loops are ignored, of repeated edges
    the largest ratio counts. Nodes without an edge are not in the result.

    ``part`` names what ends of an edge have in common: no node is in two parts. Parts of at most ``nodes`` nodes and ``most`` edges are linked in
    one task each, which holds a bit for each two nodes and eight bytes for an edge, 1 GB at most. Larger parts, those of null, and edges without parts go on as follows.

    Greedy order does not need one task: a pair of clusters that is the best of both is merged next for
    either of them whatever happens elsewhere, so all such pairs merge in one round. Only complete pairs
    are kept, as one that lacks a cross pair lacks it for ever: a pair of merged clusters is complete
    if all the pairs it is made of are there. Once no more than ``local`` pairs are left, a task merges
    them; before that, after every ``rounds`` rounds, components of at most that many pairs get a task each.
    Larger ones go on in rounds, whatever their size.
    """
    ends = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.least(left, right).alias("l"), F.greatest(left, right).alias("r"), F.col(ratio).cast("double").alias("ratio"), *([F.col(part).alias("part")] if part else [])).where("l <> r")
    if part is None:
        return _in_rounds(ends, local, rounds)
    e = materialise(ends.groupBy("part", "l", "r").agg(F.max("ratio").alias("ratio")), "edges")
    held = e.select("part", F.explode(F.array("l", "r")).alias("n")).distinct().groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    small = e.groupBy("part").agg(F.count(F.lit(1)).alias("edges")).join(held, "part").where((F.col("nodes") <= nodes) & (F.col("edges") <= most)).select("part")
    small = materialise(small, "parts")
    here, rest = _linked(e.join(small, "part", "left_semi")), e.join(small, "part", "left_anti").drop("part")
    return here.unionByName(_in_rounds(rest, local, rounds)) if rest.limit(1).count() else here


def _in_rounds(e: DataFrame, local: int, rounds: int) -> DataFrame:
    """:func:`complete_link` of (l, r, ratio) with l < r."""
    best = F.struct((-F.col("ratio")).alias("o"), "l", "r")
    pairs = materialise(e.groupBy("l", "r").agg(F.max("ratio").alias("ratio")).select(F.col("l").alias("a"), F.col("r").alias("b"), best.alias("best")), "pairs")
    labels = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")), "labels")
    kind = pairs.schema["a"].dataType.simpleString()

    def relabelled(moves: DataFrame) -> DataFrame:
        to = moves.select(F.col("old").alias("cluster"), "keep")
        return labels.join(to, "cluster", "left").select("node", F.coalesce("keep", "cluster").alias("cluster"))

    def merged_here(placed: DataFrame) -> DataFrame:
        here = placed.select("component", "a", "b", (-F.col("best.o")).alias("ratio"), F.col("best.l").alias("l"), F.col("best.r").alias("r"))
        moves = materialise(here.groupBy("component").applyInPandas(_merge_locally, f"old {kind}, keep {kind}"), "merges")
        return materialise(relabelled(moves), "labels")

    done = 0
    while left_ := pairs.count():
        if left_ <= local:
            return merged_here(pairs.withColumn("component", F.lit(0)))
        merges, after = _link_round(pairs)
        drop_table(pairs)
        labels, pairs, done = relabelled(merges.withColumnRenamed("gone", "old")), after, done + 1
        if done % rounds == 0 and pairs.limit(1).count():
            comp = connected_components(pairs, "a", "b")
            placed = materialise(pairs.join(comp.withColumnRenamed("node", "a"), "a"), "placed")
            small = placed.groupBy("component").count().where(F.col("count") <= local).select("component")
            labels = merged_here(placed.join(small, "component", "left_semi"))
            pairs = materialise(placed.join(small, "component", "left_anti").select("a", "b", "best"), "pairs")
    return labels


def task_groups(edges: DataFrame, depth: int = 5) -> DataFrame:
    """G2 over tasks: (node, cluster) by :func:`complete_link` over the high and possible grades of :func:`overlap_grades`.

    Tasks of a site with the same results have the same pairs, and the largest ratio between them, so greedy order always
    puts them into one cluster. Of each class its smallest task stands for all, whose pairs come before those of the others;
    pairs between copies are never made.
    """
    e = materialise(edges.where(F.col("rank") <= depth).select("task_id", "site_id", "rank", "url"), "results")
    classes = materialise(result_classes(e, depth), "classes")
    close = close_tasks(e.join(classes.where("task_id = first").select("task_id"), "task_id", "left_semi"), depth)
    found = complete_link(close, "left_id", "right_id", "ratio", "site").withColumnRenamed("node", "first")
    copied = classes.groupBy("first").count().where("count > 1").select("first", F.col("first").alias("own_"))
    homes = found.join(copied, "first", "full").select("first", F.coalesce("cluster", "own_").alias("cluster"))
    return classes.join(homes, "first").select(F.col("task_id").alias("node"), "cluster")


def keyword_groups(keywords: DataFrame, clusters: DataFrame, is_modifier: str) -> DataFrame:
    """Per cluster the main keyword: the largest volume among those that are no modifiers (ties to the smaller id); a cluster of modifiers alone is unresolved. Keywords without a cluster are groups of one."""
    k = keywords.join(clusters, keywords["id"] == clusters["node"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    usable = ~F.col(is_modifier)
    order = F.struct(F.coalesce("volume", F.lit(-1)).alias("v"), (-F.col("id")).alias("i"))
    g = k.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.max_by(F.when(usable, F.col("keyword")), F.when(usable, order)).alias("main_keyword"))
    return g.withColumn("state", F.when(F.col("main_keyword").isNull(), "unresolved").otherwise("resolved"))


def token_components(rows: DataFrame, id_col: str, token: str) -> DataFrame:
    """Components of rows that share a token: a token links its rows to the smallest of them, so a frequent one makes no pairs."""
    first = rows.groupBy(token).agg(F.min(id_col).alias("first_"))
    comp = connected_components(rows.join(first, token).select(F.col(id_col).alias("a"), F.col("first_").alias("b")), "a", "b")
    return rows.select(F.col(id_col).alias("id_")).distinct().join(comp, F.col("id_") == F.col("node"), "left").select(F.col("id_").alias(id_col), F.coalesce("component", "id_").alias("component"))


def greedy_one_to_one(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float = 0.4) -> DataFrame:
    """Per group, best pair first, each side used once; a pair must reach ``least``.

    Pairs that do not reach it never leave Spark. The others are sorted within their partition and read as a stream: a task holds
    a batch and the sides that are used, never the pairs of a group.
    """
    p = pairs.select(group, left, right, score).where(F.col(score) >= least)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen_l, seen_r = (), set(), set()
        for pdf in batches:
            keep = []
            for i, (g, l, r) in enumerate(zip(pdf[group], pdf[left], pdf[right])):
                g = None if g != g else g
                if g != now:
                    now, seen_l, seen_r = g, set(), set()
                if l not in seen_l and r not in seen_r:
                    seen_l.add(l)
                    seen_r.add(r)
                    keep.append(i)
            yield pdf.iloc[keep]

    return p.repartition(F.col(group)).sortWithinPartitions(group, F.desc(score), left, right).mapInPandas(choose, p.schema)


def dependency_order(edges: DataFrame, story: str, before: str, after: str) -> DataFrame:
    """Per story the topological order of its steps, the smallest id first among those that are free; a cycle is an error.

    A story is a row of its distinct edges, so that small stories come to Python many at a time.
    """
    import heapq

    def order(firsts: list, seconds: list) -> list:
        nodes = {*firsts, *seconds}
        waits, then = dict.fromkeys(nodes, 0), {n: [] for n in nodes}
        for a, b in zip(firsts, seconds):
            waits[b] += 1
            then[a].append(b)
        free, out = [n for n in nodes if not waits[n]], []
        heapq.heapify(free)
        while free:
            out.append(n := heapq.heappop(free))
            for b in then[n]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(free, b)
        if len(out) < len(nodes):
            raise ValueError("the steps depend on each other in a cycle")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [order(a, b) for a, b in zip(batch.column("a_").to_pylist(), batch.column("b_").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("story_"), pa.array(orders, batch.schema.field("a_").type)], names=["story_", "steps_"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    e = F.collect_set(F.struct(F.col(before).alias("a"), F.col(after).alias("b")))
    rows = edges.groupBy(F.col(story).alias("story_")).agg(e.alias("e_")).select("story_", F.col("e_.a").alias("a_"), F.col("e_.b").alias("b_"))
    orders = rows.mapInArrow(run, f"story_ {kinds[story]}, steps_ array<{kinds[before]}>")
    return orders.select(F.col("story_").alias(story), F.posexplode("steps_").alias("position", "step")).select(story, "step", (F.col("position") + 1).cast("long").alias("position"))


def survivors(scores: DataFrame, pair: str, candidate: str, margin: float = 0.05) -> DataFrame:
    """Per pair of articles the one to keep: .35 competition + .25 title + .3 evidence + .1 unique; closer than the margin is for review."""
    from quaystone.operators.demand import margins

    s = scores.withColumn("score", F.round(0.35 * F.col("competition") + 0.25 * F.col("title") + 0.3 * F.col("evidence") + 0.1 * F.col("unique"), 6)).withColumnRenamed(candidate, "candidate")
    return margins(s, pair, margin).withColumn("state", F.when(F.col("margin") < margin, "margin_review").otherwise("survivor")).withColumnRenamed("candidate", candidate)
