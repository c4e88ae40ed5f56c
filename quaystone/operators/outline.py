"""Outlines: which headings become sections and which of the others go under them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quaystone.functions.text import evidence_key, grams, jaccard


def _ordered(candidates: DataFrame) -> DataFrame:
    """Eligible headings with ``place_``, by which they sort: ready before others, then quality, evidence and strength, largest first, then id."""
    state = F.when(F.col("state") == "ready", 0).when(F.col("state") == "needs_review", 1).otherwise(2)
    largest = [-F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("quality", "evidence_count", "strength")]
    c = candidates.where(F.coalesce(F.col("state") != "blocked", F.lit(True)) & F.coalesce("resolved", F.lit(True)))
    return c.withColumn("place_", F.struct(state.alias("s"), largest[0].alias("q"), largest[1].alias("e"), largest[2].alias("w"), F.col("candidate_id").alias("i")))


def _trigram_set(df: DataFrame, unicode: bool) -> DataFrame:
    df = df.withColumn("key_", evidence_key(F.coalesce("text", F.lit("")), unicode))
    return df.withColumn("tri_", F.when(F.char_length("key_").between(1, 2), F.array("key_")).otherwise(grams(F.col("key_"), 3)))


def _assign(per_parent: int):
    """Children of a group in their order, each to the first parent of its list that has room."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        load, target = {}, []
        for wanted in pdf.sort_values("turn")["wanted"]:
            free = next((p for p in wanted if load.get(p, 0) < per_parent), None)
            load[free] = load.get(free, 0) + 1
            target.append(free)
        out = pdf.sort_values("turn")[["group_id", "turn"]].assign(parent_position=target)
        return out[out["parent_position"].notna()]

    return choose


def evidence_outlines(candidates: DataFrame, max_h2: int = 8, max_h3: int = 4, unicode: bool = True) -> DataFrame:
    """Each group's outline: its first ``max_h2`` headings of level 2, and under each at most ``max_h3`` of level 3.

    Candidates are (group_id, candidate_id, text, heading_level, evidence_type, evidence_ids, state, resolved, quality,
    evidence_count, strength); ids are unique. Blocked ones and those whose evidence is known to be unresolved take no
    part. Headings of level 3 choose in their order; each goes to the best parent that has room: 100 for each shared
    evidence id + 10 trigram jaccard + 1 for the same type + 1 if one text contains the other, ties to the earlier parent.
    A parent without shared evidence, trigrams or text is never chosen. Rows are (group_id, candidate_id,
    parent_id, position, child_position, score), sections with nulls for parent, child position and score.

    A group of any size is cut before one task walks through it. Of the children that want the same parents in the same order only
    the first ``max_h3`` for each of those parents can be placed, as these fill them all; the others never leave the sort.
    """
    c = _trigram_set(_ordered(candidates), unicode)
    in_order = Window.partitionBy("group_id").orderBy("place_")
    h2 = c.where("heading_level = 2").withColumn("position", F.row_number().over(in_order)).where(F.col("position") <= max_h2)
    p = h2.select("group_id", F.col("position").alias("p_"), F.col("evidence_ids").alias("p_ids"), F.col("evidence_type").alias("p_type"), F.col("key_").alias("p_key"), F.col("tri_").alias("p_tri"))
    shared = F.coalesce(F.size(F.array_intersect("evidence_ids", "p_ids")), F.lit(0))
    shared = F.greatest(shared, F.lit(0))
    near = jaccard(F.col("tri_"), F.col("p_tri"))
    inside = F.contains("key_", "p_key") | F.contains("p_key", "key_")
    same = F.coalesce(F.col("evidence_type") == F.col("p_type"), F.col("evidence_type").isNull() & F.col("p_type").isNull())
    j = c.where("heading_level = 3").join(p, "group_id").where((shared > 0) | (near > 0) | inside)
    scored = F.struct((-(100 * shared + 10 * near + same.cast("int") + inside.cast("int"))).alias("o"), F.col("p_").alias("p"))
    # A child meets at most max_h2 parents, so its list is short.
    lists = j.groupBy("group_id", "candidate_id", "place_").agg(F.array_sort(F.collect_list(scored)).alias("l")).withColumn("wanted", F.transform("l", lambda x: x["p"]))
    same_list = Window.partitionBy("group_id", F.array_join("wanted", ",")).orderBy("place_")
    kept = lists.withColumn("n_", F.row_number().over(same_list)).where(F.col("n_") <= max_h2 * max_h3).where(F.col("n_") <= max_h3 * F.size("wanted"))
    kept = kept.withColumn("turn", F.row_number().over(in_order))
    kind = candidates.schema["group_id"].dataType.simpleString()
    placed = kept.select("group_id", "turn", "wanted").groupBy("group_id").applyInPandas(_assign(max_h3), f"group_id {kind}, turn int, parent_position int")
    under = Window.partitionBy("group_id", "parent_position").orderBy("turn")
    k = kept.select("group_id", "turn", "candidate_id", "l").join(placed.withColumn("child_position", F.row_number().over(under)), ["group_id", "turn"])
    chosen = F.element_at(F.filter("l", lambda x: x["p"] == F.col("parent_position")), 1)["o"]
    k = k.select("group_id", "candidate_id", F.col("parent_position").alias("position"), "child_position", F.round(-chosen, 6).alias("score"))
    sections = h2.select("group_id", "candidate_id", "position")
    children = k.join(sections.select("group_id", "position", F.col("candidate_id").alias("parent_id")), ["group_id", "position"])
    return children.select("group_id", "candidate_id", "parent_id", "position", "child_position", "score").unionByName(sections, allowMissingColumns=True)
