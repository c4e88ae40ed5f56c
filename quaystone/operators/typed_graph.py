"""Bounded traversal of a typed graph from the senses of a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.plans.storage import materialise

#: Relation types and what they are called against their direction.
INVERSE = {
    "hype": "hypo", "hypo": "hype", "inst": "hasi", "hasi": "inst", "mmem": "hmem", "hmem": "mmem", "mprt": "hprt", "hprt": "mprt", "msub": "hsub", "hsub": "msub",
    "dmnc": "dmtc", "dmtc": "dmnc", "dmnr": "dmtr", "dmtr": "dmnr", "dmnu": "dmtu", "dmtu": "dmnu", "caus": "caused_by", "enta": "entailed_by",
}


def seeds(senses: DataFrame, term: str, most: int = 25) -> DataFrame:
    """(node, place long, match): the nodes whose term is the one asked for; if there is none, of the ``most`` first partial matches.

    ``senses``: node, word_id, term. Exact matches are in the order of node and word, partial ones in that
    of the term's length, term, node and word. A node counts once. An empty term has no seed.
    """
    wanted = " ".join(term.lower().split())
    t = senses.select("node", "word_id", F.trim(F.lower("term")).alias("term"))
    exact = t.where(F.col("term") == wanted) if wanted else t.limit(0)
    if wanted and not exact.limit(1).count():
        few = t.where(F.col("term").contains(wanted)).orderBy(F.length("term"), "term", "node", "word_id").limit(most)
        order, match, found = ["n_", "term", "node", "word_id"], "partial", few.withColumn("n_", F.length("term"))
    else:
        order, match, found = ["node", "word_id"], "exact", exact
    # Only what has the term, or ``most`` rows, is put in order here.
    first = found.groupBy("node").agg(F.min(F.struct(*order)).alias("o"))
    return first.select("node", F.row_number().over(Window.orderBy("o")).cast("long").alias("place"), F.lit(match).alias("match"))


def _against(kind: Column) -> Column:
    named = F.coalesce(*(F.when(kind == k, v) for k, v in INVERSE.items()))
    return F.coalesce(named, F.concat(kind, F.lit("_inverse")))


def traverse(relations: DataFrame, start: DataFrame, depth: int = 1, types: list[str] | None = None, most: int = 2000, strategy: str = "breadth_first") -> DataFrame:
    """The relations met within ``depth`` (1 to 3) steps of the seeds, with their paths, at most ``most`` (1 to 5000) of them.

    ``relations``: relation_id, relation_type, source, target; ``start``: node, place. A node is
    expanded once, from the relation that comes to it first: in the order of its parent's place, type,
    source and target. Each of its relations is a row, those into it under the name of the inverse type.
    ``types`` keeps relations of these types only. What comes after ``most`` relations in that order
    is neither returned nor followed; the column ``truncated`` says whether the bound was reached.

    Rows: relation_id, relation_type, source, target, depth, direction, traversal_type, from_node, to_node,
    path_nodes, path_relations (arrays), visit_order, truncated. visit_order is the order of levels, or
    with ``depth_first`` that of the same paths in pre-order.

    A level is one join of all relations with a frontier of at most ``most`` rows, which is sent to all, and a
    distributed top ``most`` of what it meets; nothing larger is ever in one place.
    """
    if not 1 <= depth <= 3 or not 1 <= most <= 5000 or strategy not in ("breadth_first", "depth_first"):
        raise ValueError("depth is 1 to 3, most is 1 to 5000, and the strategy breadth_first or depth_first")
    r = relations.select("relation_id", "relation_type", "source", "target")
    if types:
        r = r.where(F.col("relation_type").isin(types))
    out = r.withColumn("from_node", F.col("source")).withColumn("to_node", F.col("target")).withColumn("direction", F.lit("outgoing"))
    into = r.where("source <> target").withColumn("from_node", F.col("target")).withColumn("to_node", F.col("source")).withColumn("direction", F.lit("incoming"))
    both = out.unionByName(into)
    frontier = materialise(start.orderBy("place").limit(most).select("node", "place", F.array("node").alias("path_nodes"), F.array().cast(f"array<{dict(r.dtypes)['relation_id']}>").alias("path_relations"), F.array().cast("array<long>").alias("steps")), "frontier")
    visited, found, n = frontier.select("node"), None, 0
    order = ["place", "relation_type", "source", "target", "relation_id", "direction"]
    for level in range(1, depth + 1):
        met = both.join(F.broadcast(frontier), both["from_node"] == frontier["node"]).drop("node").orderBy(*order).limit(most - n)
        met = met.withColumn("seen_", F.row_number().over(Window.orderBy(*order)).cast("long"))  # of at most ``most`` rows
        met = met.select(
            "relation_id", "relation_type", "source", "target", F.lit(level).cast("long").alias("depth"), "direction", F.when(F.col("direction") == "outgoing", F.col("relation_type")).otherwise(_against(F.col("relation_type"))).alias("traversal_type"),
            "from_node", "to_node", F.concat("path_nodes", F.array("to_node")).alias("path_nodes"), F.concat("path_relations", F.array("relation_id")).alias("path_relations"),
            F.concat("steps", F.array("place", "seen_")).alias("steps"), (F.col("seen_") + n).alias("order_"),
        )
        met = materialise(met, "met")
        found = met if found is None else found.unionByName(met)
        n += met.count()
        if n >= most or level == depth:
            break
        new = met.join(F.broadcast(visited), met["to_node"] == visited["node"], "left_anti").groupBy("to_node").agg(F.min(F.struct("order_", "path_nodes", "path_relations", "steps")).alias("f"))
        frontier = materialise(new.select(F.col("to_node").alias("node"), F.col("f.order_").alias("place"), "f.path_nodes", "f.path_relations", "f.steps"), "frontier")
        visited = visited.unionByName(frontier.select("node"))
    # Steps are places and order numbers along the path: compared as arrays, a parent comes before what it leads to.
    key = F.col("order_") if strategy == "breadth_first" else F.col("steps")
    ordered = found.withColumn("visit_order", F.row_number().over(Window.orderBy(key)).cast("long"))
    return ordered.withColumn("truncated", F.lit(n >= most)).drop("steps", "order_")
