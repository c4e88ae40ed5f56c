"""Histories of snapshots. Not being seen in a retained list is never read as being unranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_pair(snapshots: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last two snapshot times of each key: before, after. Keys that were seen once are not compared."""
    times = snapshots.select(*keys, at).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return times.withColumn("n_", F.row_number().over(w)).where("n_ <= 2").groupBy(*keys).agg(F.min(at).alias("before"), F.max(at).alias("after"), F.count(F.lit(1)).alias("c_")).where("c_ = 2").drop("c_")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Per URL retained / entered / exited between two retained lists, with the change of rank and title.

    What is missing on one side is outside the observed set, its rank unknown; it is not unranked.
    """
    a = before.groupBy(*keys, url).agg(F.min("rank").alias("old_rank"), F.min_by("title", "rank").alias("old_title"))
    b = after.groupBy(*keys, url).agg(F.min("rank").alias("new_rank"), F.min_by("title", "rank").alias("new_title"))
    state = F.when(F.col("old_rank").isNull(), "entered").when(F.col("new_rank").isNull(), "exited").otherwise("retained")
    return a.join(b, [*keys, url], "full").select(*keys, url, state.alias("state"), "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("rank_delta"), (F.col("old_title") != F.col("new_title")).alias("title_changed"))


def diff_summary(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state and the overlap of both lists; null where nothing was observed."""
    n = F.count(F.lit(1))
    kept = F.count_if(F.col("state") == "retained")
    return diff.groupBy(*keys).agg(kept.alias("retained"), F.count_if(F.col("state") == "entered").alias("entered"), F.count_if(F.col("state") == "exited").alias("exited"), F.round(kept / n, 6).alias("overlap_rate"))


def appearance_history(diff: DataFrame, domain: Column) -> DataFrame:
    """By domain: persistent / gained / lost, best ranks, sum of 1/rank before and after and its change (4 places)."""
    d = diff.withColumn("domain", domain).groupBy("domain").agg(F.min("old_rank").alias("old_best"), F.min("new_rank").alias("new_best"), F.coalesce(F.sum(1 / F.col("old_rank")), F.lit(0.0)).alias("o"), F.coalesce(F.sum(1 / F.col("new_rank")), F.lit(0.0)).alias("n"))
    return d.select("domain", F.when(F.col("old_best").isNull(), "gained").when(F.col("new_best").isNull(), "lost").otherwise("persistent").alias("state"), "old_best", "new_best", F.round("o", 4).alias("old_visibility"), F.round("n", 4).alias("new_visibility"), F.round(F.col("n") - F.col("o"), 4).alias("visibility_delta"))


def demand_history(occurrences: DataFrame, cohort: list[str], value: str, at: str) -> DataFrame:
    """A value in the first and the last snapshot of its cohort: persistent, gained or lost; others were seen in between only. Cohorts with one snapshot are not compared."""
    bounds = occurrences.groupBy(*cohort).agg(F.min(at).alias("first_"), F.max(at).alias("last_")).where("first_ < last_")
    per = occurrences.join(bounds, cohort).groupBy(*cohort, value).agg(F.bool_or(F.col(at) == F.col("first_")).alias("f"), F.bool_or(F.col(at) == F.col("last_")).alias("l"), F.count_distinct(at).alias("observation_days"))
    return per.select(*cohort, value, F.when(F.col("f") & F.col("l"), "persistent").when(F.col("l"), "gained").when(F.col("f"), "lost").otherwise("between").alias("state"), "observation_days")


def scoped_history(scoped_diff: DataFrame) -> DataFrame:
    """T4: per host, directory and page scope: keywords, and how many URLs each state has."""
    s = F.col("state")
    return scoped_diff.groupBy("scope", "scope_value").agg(F.count_distinct("keyword").alias("keywords"), F.count_if(s == "retained").alias("retained"), F.count_if(s == "entered").alias("entered"), F.count_if(s == "exited").alias("exited"))


def target_track(diff: DataFrame, target: str, mode: str, url: str = "url") -> DataFrame:
    """T5: the rows of one target, by domain, exact_url or url_prefix."""
    c = F.col(url)
    keep = {"domain": F.regexp_extract(c, "^[a-z]+://([^/]*)", 1) == target, "exact_url": c == target, "url_prefix": c.startswith(target)}[mode]
    return diff.where(keep)


def depth_inventory(organic: DataFrame, key: str = "task_id", bands: tuple[tuple[int, int], ...] = ((1, 3), (1, 5), (1, 10), (11, 20))) -> DataFrame:
    """Per key and band of ranks the observed slots, those missing, and whether the band is full, partial or not observed."""
    band = F.explode(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in bands))).alias("band")
    per = organic.groupBy(key).agg(F.collect_set(F.col("rank").cast("int")).alias("ranks")).select(key, "ranks", band).select(key, "ranks", "band.low", "band.high")
    want = F.sequence("low", "high")
    missing = F.array_except(want, F.col("ranks"))
    seen = F.size(want) - F.size(missing)
    return per.select(key, "low", "high", seen.alias("observed"), F.array_join(F.array_sort(missing).cast("array<string>"), ",").alias("missing"), F.when(seen == F.size(want), "full").when(seen > 0, "partial").otherwise("not_observed").alias("state"))


def monitoring_schedule(snapshots: DataFrame, keys: list[str], at: str, cadence_days: int = 7, horizon_days: int = 120) -> DataFrame:
    """Next due day, snapshots that remain of ceil(horizon / cadence) + 1, and what the history allows."""
    planned = -(-horizon_days // cadence_days) + 1
    g = snapshots.select(*keys, at).distinct().groupBy(*keys).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("seen"))
    return g.select(*keys, "last", "seen", F.date_add("last", cadence_days).alias("next_due"), F.greatest(F.lit(0), planned - F.col("seen")).alias("remaining"), F.when(F.col("seen") >= 2, "comparable").otherwise("single_snapshot").alias("state"))


def candidate_stability(evidence: DataFrame, history: DataFrame, candidate: str, value: str) -> DataFrame:
    """The states of a candidate's evidence values: stable if all persist, volatile if none does, else mixed; without a history, single snapshot."""
    j = evidence.select(candidate, value).distinct().join(history.select(value, "state"), value, "left")
    g = j.groupBy(candidate).agg(F.count("state").alias("known"), F.count_if(F.col("state") == "persistent").alias("persistent"))
    return g.select(candidate, "known", "persistent", F.when(F.col("known") == 0, "single_snapshot").when(F.col("persistent") == F.col("known"), "stable").when(F.col("persistent") == 0, "volatile").otherwise("mixed").alias("stability"))


def task_holdout(candidate_tokens: DataFrame, baseline_tokens: DataFrame, evidence: DataFrame, task_tokens: DataFrame) -> DataFrame:
    """How much of the text of tasks that gave no evidence a candidate covers, against its main keyword alone.

    Frames: (group_id, token) twice, (group_id, task_id) of evidence, (group_id, task_id, token).
    The difference counts as an improvement or a regression from .01 on.
    """
    held = task_tokens.join(evidence, ["group_id", "task_id"], "left_anti").groupBy("group_id", "token").agg(F.count(F.lit(1)).alias("n"))
    c = candidate_tokens.select("group_id", "token").distinct().withColumn("c_", F.lit(True))
    b = baseline_tokens.select("group_id", "token").distinct().withColumn("b_", F.lit(True))
    j = held.join(c, ["group_id", "token"], "left").join(b, ["group_id", "token"], "left").groupBy("group_id").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("c_"), F.col("n")).otherwise(0)).alias("ct"), F.sum(F.when(F.col("b_"), F.col("n")).otherwise(0)).alias("bt"))
    d = F.col("ct") / F.col("t") - F.col("bt") / F.col("t")
    return j.select("group_id", F.round(F.col("ct") / F.col("t"), 6).alias("candidate_coverage"), F.round(F.col("bt") / F.col("t"), 6).alias("baseline_coverage"), F.when(d >= 0.01, "improvement").when(d <= -0.01, "regression").otherwise("tie").alias("outcome"))


def freshness(rows: DataFrame, task: str, observed: str, published: str, top: int = 10) -> DataFrame:
    """Ages of a task's first ``top`` results. Unparseable or absent stamps are unavailable, stamps over a day ahead invalid; both are kept and counted."""
    stamp = F.try_to_timestamp(F.col(published))
    age = F.round((F.unix_micros(F.col(observed).cast("timestamp")) - F.unix_micros(stamp)) / 86_400_000_000.0)
    r = rows.where(F.col("rank") <= top).withColumn("age", age)
    ok = F.col("age") >= -1
    g = r.groupBy(task).agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.col("age").isNull()).alias("unavailable"), F.count_if(F.col("age") < -1).alias("invalid"), F.count_if(ok).alias("dated"), F.count_if(ok & (F.col("age") <= 90)).alias("fresh"), F.count_if(F.col("age") >= 730).alias("stale"), F.median(F.when(ok, F.col("age"))).alias("median_age")
    )
    f, s, m = F.col("fresh") / F.col("dated"), F.col("stale") / F.col("dated"), F.col("median_age")
    return g.withColumn("state", F.when((F.col("dated") == 0) | (F.col("dated") / F.col("results") < 0.3), "insufficient").when((m <= 180) & (f >= 0.3), "fresh_dominant").when((m >= 730) & (s >= 0.5), "stale_dominant").otherwise("mixed"))


def as_of_pairs(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each new row the latest older row with equal keys; without one it is out of scope."""
    j = new.withColumnRenamed(at, "new_at").join(old.select(*keys, F.col(at).alias("old_at"), F.col("id").alias("old_id")), keys, "left")
    older = F.col("old_at") < F.col("new_at")
    g = j.groupBy(*keys, "id", "new_at").agg(F.max_by(F.when(older, F.col("old_id")), F.when(older, F.struct("old_at", "old_id"))).alias("old_id"))
    return g.select(*keys, "id", "old_id", F.when(F.col("old_id").isNull(), "out_of_scope").otherwise("paired").alias("state"))


def windowed_counts(rows: DataFrame, at: str, by: list[str], width: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling (or sliding) windows; the same expression runs on a stream with a watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def session_counts(rows: DataFrame, at: str, by: list[str], gap: str) -> DataFrame:
    """Counts in sessions that a gap ends."""
    return rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), *by, "n")
