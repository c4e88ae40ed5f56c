"""Connected components of an edge table, by alternating star contractions.

Every round replaces edges by shorter ones to the smallest neighbour, so chains shrink
geometrically and no vertex's neighbourhood is ever gathered in one task: the smallest neighbour is
a partial aggregate written as a table, and the join that spreads it can be split by adaptive
execution when one vertex has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaystone.plans.storage import drop_table, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Edges are (hi, lo) with hi > lo."""
    if large:
        seen = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        seen = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    # Written first, so that the join has a plain shuffle on both sides and a vertex of very many
    # edges can be split by adaptive execution.
    least = materialise(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = seen.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("hi"), F.col("m").alias("lo"))
    out = materialise(moved.where(F.col("hi") != F.col("lo")).distinct(), "edges")
    drop_table(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and a digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every vertex of an edge; component is the smallest vertex reachable.

    Null ends and self loops are ignored; repeated edges count once; an empty table gives none.
    """
    now = materialise(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 0):
        half = _star(now, True)
        drop_table(now)
        now = _star(half, False)
        drop_table(half)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
