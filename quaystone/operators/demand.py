"""Demand and query rows: roll-ups, primary queries, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.plans.storage import materialise


def normalized_queries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By normalised query: sums, ctr, position weighted by impressions (1 at least), and the representative spelling (impressions, clicks, text)."""
    w = F.greatest(F.col("impressions"), F.lit(1))
    return rows.groupBy(*keys, "normalized_query").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.sum("clicks") / F.sum("impressions"), 6).alias("ctr"), F.round(F.sum(F.col("position") * w) / F.sum(w), 6).alias("position"),
        F.min_by("query", F.struct((-F.col("impressions")).alias("i"), (-F.col("clicks")).alias("c"), "query")).alias("representative"),
    )


def query_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and the nearest-rank 95th percentile of impressions."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY impressions)").cast("bigint").alias("p95"))


def primary_queries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by ln(1 + impressions) + ln(1 + clicks) ln(1 + max(1, p95)); ties by clicks, impressions, position, text."""
    stats = query_stats(rows, keys).select(*keys, "p95")
    score = F.round(F.log1p("impressions") + F.log1p("clicks") * F.log1p(F.greatest(F.lit(1), F.col("p95"))), 6)
    j = rows.join(stats, keys).withColumn("score", score)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("clicks"), F.desc("impressions"), "position", "query")
    return j.withColumn("rank", F.row_number().over(w)).select(*keys, "query", "score", "rank")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; cut before the shuffle."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def demand_rollup(rows: DataFrame) -> DataFrame:
    """Values by type: occurrences, tasks, groups, first and last day, best place, depth; importance = round(100 (.6 t/max t + .25 g/max g + .15 o/max o)) within the type."""
    g = rows.groupBy("demand_type", "value").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("task_id").alias("tasks"), F.count_distinct("group_id").alias("groups"), F.min("observed_on").alias("first_seen"), F.max("observed_on").alias("last_seen"), F.min("occurrence_order").alias("best_order"), F.max("depth").alias("max_depth"))
    w = Window.partitionBy("demand_type")
    part = lambda c: F.col(c) / F.max(c).over(w)
    return g.withColumn("importance", F.round(100 * (0.6 * part("tasks") + 0.25 * part("groups") + 0.15 * part("occurrences"))))


def length_quantiles(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Quartiles of lengths by linear interpolation (2 places), with mean and extremes."""
    q = F.percentile(length, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.round(F.avg(length), 2).alias("mean"), F.min(length).alias("least"), F.max(length).alias("most")).select(*keys, "n", *(F.round(F.col("q")[i], 2).alias(a) for i, a in enumerate(("q25", "median", "q75"))), "mean", "least", "most")


def level_summary(headings: DataFrame, levels: list[str]) -> DataFrame:
    """Headings of each page by level, as columns, and their mean length."""
    return headings.groupBy("page_id").pivot("level", levels).agg(F.count(F.lit(1))).na.fill(0).join(headings.groupBy("page_id").agg(F.count(F.lit(1)).alias("headings"), F.round(F.avg(F.char_length("text")), 6).alias("mean_chars")), "page_id")


def state_counters(rows: DataFrame, by: list[str], state: str, states: list[str]) -> DataFrame:
    """Rows in each state, with those that none is in."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(state) == x).alias(x) for x in states))


def type_vote(rows: DataFrame, key: str) -> DataFrame:
    """The page type of a task: the first five ranks count twice, news and Q&A as articles, ``other`` not; ties by name."""
    t = F.when(F.col("page_type").isin("news", "qa_forum"), "article").otherwise(F.col("page_type"))
    g = rows.withColumn("vote", t).where("vote <> 'other'").groupBy(key, "vote").agg(F.sum(F.when(F.col("rank") <= 5, 2).otherwise(1)).alias("weight"))
    return latest(g, [key], [F.desc("weight"), F.asc("vote")])


def fingerprints(edges: DataFrame) -> DataFrame:
    """Per task the sums of 1/rank by domain, as a map, and their total."""
    w = edges.groupBy("task_id", "domain").agg(F.round(F.sum(1 / F.col("rank")), 6).alias("w"))
    return w.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "w")))).alias("weights"), F.round(F.sum("w"), 6).alias("total"))


def suggest_evidence(rows: DataFrame, key: Column) -> DataFrame:
    """By normalised keyword its spellings, sheets, rows acquired or not, and whether the volumes agree."""
    g = rows.groupBy(key.alias("normalized")).agg(F.count_distinct("raw_keyword").alias("forms"), F.array_join(F.array_sort(F.collect_set("sheet")), ",").alias("sheets"), F.count_if(F.col("state") == "acquired").alias("acquired"), F.count_if(F.col("state") == "unacquired").alias("unacquired"), F.count_distinct("volume").alias("v"))
    return g.withColumn("volume_state", F.when(F.col("v") > 1, "conflicting").when(F.col("v") == 1, "single").otherwise("not_observed")).drop("v")


def qa_rollup(edges: DataFrame) -> DataFrame:
    """Q&A pages with their keywords, groups and best rank."""
    return edges.where(F.col("source").isNotNull()).groupBy("source", "url").agg(F.count_distinct("keyword").alias("keywords"), F.count_distinct("group_id").alias("groups"), F.min("rank").alias("best_rank"))


def ranked_branches(paths: DataFrame, level: int = 2) -> DataFrame:
    """The second level of keyword paths: rows and volume; most rows first, then volume, then name. Paths without that level and null names take no part.

    Branches are dealt by ranges of that order and written, so that the ranges stay; a place is the branches of the ranges before and the row's place in its own. Only the counts, one row a range, meet in one task.
    """
    order = [F.desc("n"), F.desc("volume"), F.col("branch")]
    g = paths.where(F.size("path") >= level).groupBy(F.element_at("path", level).alias("branch")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume")).where("branch IS NOT NULL")
    t = materialise(g.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "branches")
    before = F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = t.groupBy("part_").agg(F.count(F.lit(1)).alias("c_")).select("part_", before.alias("start_"))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return t.join(F.broadcast(starts), "part_").withColumn("position", F.col("start_") + place).drop("part_", "start_")


def reconcile_reviews(decisions: DataFrame) -> DataFrame:
    """The last state of each reviewer of an item: unreviewed, one state, or disagreement; two reviewers who agree settle it."""
    last = latest(decisions, ["item", "reviewer"], [F.desc("at")])
    g = last.groupBy("item").agg(F.count_distinct("reviewer").alias("reviewers"), F.array_sort(F.collect_set("state")).alias("s"))
    n = F.size("s")
    return g.select("item", "reviewers", F.when(n == 0, "unreviewed").when(n > 1, "reviewer_disagreement").otherwise(F.col("s")[0]).alias("state"), F.when(n > 1, "adjudicate").when(F.col("reviewers") >= 2, "settled").otherwise("second_review").alias("next"))


def cost_ledger(rows: DataFrame, cap: float) -> DataFrame:
    """Committed and planned cost in 8 decimals, sources that occur twice, and whether both stay within the cap."""
    d = rows.groupBy("source_id", "kind").agg(F.max(F.col("cost").cast("decimal(18,8)")).alias("cost"), F.count(F.lit(1)).alias("n"))
    g = d.agg(F.sum(F.when(F.col("kind") == "committed", F.col("cost"))).alias("committed"), F.sum(F.when(F.col("kind") == "planned", F.col("cost"))).alias("planned"), F.count_if(F.col("n") > 1).alias("duplicate_sources"))
    return g.withColumn("within_cap", F.coalesce("committed", F.lit(0)) + F.coalesce("planned", F.lit(0)) <= cap)


def credit_estimate(requests: DataFrame) -> DataFrame:
    """Credits of request batches by kind: keywords max(15, n (.03 + .75 difficulty)), ranks n (.9 + .3 (depth - 30) / 10), suggestions max(4.5, .45 n)."""
    n, d = F.col("n"), F.col("depth")
    c = F.when(F.col("kind") == "keywords", F.greatest(F.lit(15.0), n * (0.03 + 0.75 * F.col("difficulty")))).when(F.col("kind") == "ranks", n * (0.9 + 0.3 * (d - 30) / 10)).otherwise(F.greatest(F.lit(4.5), 0.45 * n))
    return requests.withColumn("credits", F.round(c, 6))


def margins(rows: DataFrame, key: str, clear: float = 10.0) -> DataFrame:
    """The leader of each key and its margin to the runner-up: unique, tie (1e-6), clear leader, or for review."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "candidate")
    r = rows.withColumns({"position": F.row_number().over(w), "next": F.lead("score").over(w)}).where("position = 1")
    gap = F.col("score") - F.col("next")
    return r.select(key, "candidate", F.round(gap, 6).alias("margin"), F.when(F.col("next").isNull(), "unique").when(gap <= 1e-6, "tie").when(gap >= clear, "clear_leader").otherwise("margin_review").alias("state"))


def stratified_order(rows: DataFrame, stratum: str, order: list) -> DataFrame:
    """Place within the stratum over its size, so strata interleave."""
    w = Window.partitionBy(stratum)
    return rows.withColumn("quantile", F.round(F.row_number().over(w.orderBy(*order)) / F.count(F.lit(1)).over(w), 6))


def running_budget(rows: DataFrame, budget: str, order: list, cost: str, cap: float) -> DataFrame:
    """W9, equal costs: running cost within a budget and whether the row still fits. Costs that differ: :func:`greedy_budget`."""
    w = Window.partitionBy(budget).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.round(F.sum(cost).over(w), 6)).withColumn("selected", F.col("running") <= cap)


def _walk(pdf):
    """The rows of one budget in order: those that still fit in what is left of it."""
    left, taken = pdf["left_"].iloc[0] if len(pdf) else 0.0, []
    pdf = pdf.sort_values("row_")
    for cost in pdf["cost_"]:
        taken.append(bool(cost <= left + 1e-9))
        left -= cost if taken[-1] else 0.0
    return pdf.loc[taken, ["row_"]]


def greedy_budget(rows: DataFrame, budget: str, order: list[str], cost: str, cap: float, local: int = 20_000) -> DataFrame:
    """In order, take each row that still fits and skip those that do not; adds ``selected``.

    Costs are not negative. A row without a cost or a budget is not selected; null places come first, rows of one
    place in any order. Each choice depends on all before, but all rows up to a budget's first misfit are taken at once, by
    running sums over ranges of the order. Then what costs more than is left drops out, the misfit with it, and the next
    round goes on with the rest. No task holds a budget: sums within a range start from the totals of the ranges before.
    Once no more than ``local`` rows are open, they are walked through budget by budget.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, budget, *order).sortWithinPartitions(budget, *order).withColumns({"row_": F.monotonically_increasing_id(), "range_": F.spark_partition_id()})
    placed = materialise(placed, "budget_rows")
    open_ = placed.where(F.col(budget).isNotNull()).select(F.col(budget).alias("b_"), "row_", "range_", F.col(cost).cast("double").alias("cost_"), F.lit(float(cap)).alias("left_")).where("cost_ <= left_ + 1e-9")
    taken = None
    while True:
        left_rows = open_.count()
        if left_rows <= local:
            break
        totals = open_.groupBy("b_", "range_").agg(F.sum("cost_").alias("t_"))
        before = totals.withColumn("base_", F.sum("t_").over(Window.partitionBy("b_").orderBy("range_")) - F.col("t_")).drop("t_")
        within = F.sum("cost_").over(Window.partitionBy("b_", "range_").orderBy("row_").rowsBetween(Window.unboundedPreceding, 0))
        run = open_.withColumn("within_", within).join(before, ["b_", "range_"]).withColumn("running_", F.col("base_") + F.col("within_"))
        run = materialise(run.select("b_", "row_", "range_", "cost_", "left_", "running_", (F.col("running_") <= F.col("left_") + 1e-9).alias("fits_")), "budget_round")
        fits = run.where("fits_").select("row_")
        taken = fits if taken is None else taken.unionByName(fits)
        spent = run.where("fits_").groupBy("b_").agg(F.max("running_").alias("spent_"))
        open_ = run.where("NOT fits_").join(spent, "b_", "left").withColumn("left_", F.col("left_") - F.coalesce("spent_", F.lit(0.0))).where("cost_ <= left_ + 1e-9").select("b_", "row_", "range_", "cost_", "left_")
    last = open_.groupBy("b_").applyInPandas(_walk, "row_ long")
    taken = (last if taken is None else taken.unionByName(last)).withColumn("selected", F.lit(True))
    return placed.join(taken, "row_", "left").drop("row_", "range_").withColumn("selected", F.coalesce("selected", F.lit(False)))


def batches(rows: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    """Chunks of ``size`` rows in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("bigint"))


def hash_sample(rows: DataFrame, keys: list[str], seed: str, size: int) -> DataFrame:
    """The ``size`` rows of smallest sha256(seed, keys), the same at any parallelism."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)
    return rows.withColumn("h_", h).orderBy("h_").limit(size).drop("h_")


def bounded_retention(rows: DataFrame, keep: Column, order: list, limit: int = 250) -> DataFrame:
    """All rows to be kept, and the first ``limit`` of the others."""
    return rows.where(keep).unionByName(rows.where(~keep).orderBy(*order).limit(limit))
