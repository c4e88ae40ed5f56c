"""Queries of histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.operators import history, sets
from quaystone.plans.catalog import Source, query

_D1, _D2 = "DATE '2024-01-01'", "DATE '2024-01-02'"
_DIFF = f"""ob AS (SELECT keyword, url, min(rank) AS r, arg_min(title, rank) AS t FROM {{snapshots}} WHERE day = {_D1} GROUP BY ALL), nb AS (SELECT keyword, url, min(rank) AS r, arg_min(title, rank) AS t FROM {{snapshots}} WHERE day = {_D2} GROUP BY ALL),
    df AS (SELECT coalesce(ob.keyword, nb.keyword) AS keyword, coalesce(ob.url, nb.url) AS url, CASE WHEN ob.r IS NULL THEN 'entered' WHEN nb.r IS NULL THEN 'exited' ELSE 'retained' END AS state, ob.r AS old_rank, nb.r AS new_rank, ob.r - nb.r AS rank_delta, ob.t <> nb.t AS title_changed FROM ob FULL JOIN nb ON ob.keyword = nb.keyword AND ob.url = nb.url)"""


def _diff(s: Source):
    one, two = (s.snapshots.where(F.col("day") == F.lit(d).cast("date")) for d in ("2024-01-01", "2024-01-02"))
    return history.snapshot_diff(one, two, ["keyword"])


@query("T1_snapshot_diff", f"WITH {_DIFF} SELECT * FROM df")
def t1(s: Source):
    return _diff(s)


@query("T1_diff_summary", f"WITH {_DIFF} SELECT keyword, count(CASE WHEN state = 'retained' THEN 1 END) AS retained, count(CASE WHEN state = 'entered' THEN 1 END) AS entered, count(CASE WHEN state = 'exited' THEN 1 END) AS exited, round(count(CASE WHEN state = 'retained' THEN 1 END) / count(*), 6) AS overlap_rate FROM df GROUP BY keyword")
def t1s(s: Source):
    return history.diff_summary(_diff(s), ["keyword"])


@query(
    "T2_appearance_history",
    f"""
    WITH {_DIFF}, d AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS domain, min(old_rank) AS ob, min(new_rank) AS nb, coalesce(sum(1 / old_rank), 0) AS o, coalesce(sum(1 / new_rank), 0) AS n FROM df GROUP BY 1)
    SELECT domain, CASE WHEN ob IS NULL THEN 'gained' WHEN nb IS NULL THEN 'lost' ELSE 'persistent' END AS state, ob AS old_best, nb AS new_best, round(o, 4) AS old_visibility, round(n, 4) AS new_visibility, round(n - o, 4) AS visibility_delta FROM d""",
)
def t2(s: Source):
    return history.appearance_history(_diff(s), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1))


@query(
    "T3_demand_history",
    """
    WITH b AS (SELECT group_id, demand_type, min(observed_on) AS f, max(observed_on) AS l FROM {demands} GROUP BY ALL), p AS (SELECT d.group_id, d.demand_type, d.value, bool_or(observed_on = f) AS f, bool_or(observed_on = l) AS l, count(DISTINCT observed_on) AS observation_days FROM {demands} d JOIN b ON d.group_id = b.group_id AND d.demand_type = b.demand_type WHERE b.f < b.l GROUP BY ALL)
    SELECT group_id, demand_type, value, CASE WHEN f AND l THEN 'persistent' WHEN l THEN 'gained' WHEN f THEN 'lost' ELSE 'between' END AS state, observation_days FROM p""",
)
def t3(s: Source):
    return history.demand_history(s.demands, ["group_id", "demand_type"], "value", "observed_on")


@query(
    "T4_scoped_history",
    f"""
    WITH {_DIFF}, x AS (SELECT 'host' AS scope, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS scope_value, keyword, state FROM df UNION ALL SELECT 'directory', regexp_extract(url, '^[a-z]+://([^/]*)', 1) || regexp_extract(url, '^[a-z]+://[^/]*(/[^/]+)', 1) || '/', keyword, state FROM df UNION ALL SELECT 'page', url, keyword, state FROM df)
    SELECT scope, scope_value, count(DISTINCT keyword) AS keywords, count(CASE WHEN state = 'retained' THEN 1 END) AS retained, count(CASE WHEN state = 'entered' THEN 1 END) AS entered, count(CASE WHEN state = 'exited' THEN 1 END) AS exited FROM x GROUP BY ALL""",
)
def t4(s: Source):
    return history.scoped_history(sets.scopes(_diff(s), "url"))


@query("T5_target_track", f"WITH {_DIFF} SELECT * FROM df WHERE url LIKE 'https://u7.example/%'")
def t5(s: Source):
    return history.target_track(_diff(s), "u7.example", "domain")


@query("T6_qa_history", f"WITH {_DIFF} SELECT CASE WHEN url LIKE 'https://u1.example/%' THEN 'one' ELSE 'two' END AS source, state, count(*) AS n FROM df WHERE url LIKE 'https://u1.example/%' OR url LIKE 'https://u2.example/%' GROUP BY ALL")
def t6(s: Source):
    from quaystone.functions.rules import qa_source

    d = _diff(s).withColumn("source", qa_source(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), {"u1.example": "one", "u2.example": "two"})).where(F.col("source").isNotNull())
    return d.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T7_depth_inventory",
    """
    WITH o AS (SELECT DISTINCT task_id, rank FROM {organic} WHERE (task_id + rank) % 4 <> 0), b AS (SELECT * FROM (VALUES (1, 3), (1, 5), (1, 10), (11, 20)) v(low, high)), k AS (SELECT DISTINCT task_id FROM o), w AS (SELECT task_id, low, high, unnest(range(low, high + 1)) AS r FROM k, b)
    SELECT w.task_id, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, count(o.rank) AS observed, coalesce(string_agg(CASE WHEN o.rank IS NULL THEN CAST(r AS STRING) END, ',' ORDER BY r), '') AS missing, CASE WHEN count(o.rank) = high - low + 1 THEN 'full' WHEN count(o.rank) > 0 THEN 'partial' ELSE 'not_observed' END AS state
    FROM w LEFT JOIN o ON w.task_id = o.task_id AND w.r = o.rank GROUP BY w.task_id, low, high""",
)
def t7(s: Source):
    return history.depth_inventory(s.organic.where("(task_id + rank) % 4 <> 0"))


@query("T9_monitoring_schedule", "SELECT keyword, max(day) AS last, count(DISTINCT day) AS seen, CAST(max(day) + 7 AS DATE) AS next_due, greatest(0, 19 - count(DISTINCT day)) AS remaining, CASE WHEN count(DISTINCT day) >= 2 THEN 'comparable' ELSE 'single_snapshot' END AS state FROM {snapshots} GROUP BY keyword")
def t9(s: Source):
    return history.monitoring_schedule(s.snapshots, ["keyword"], "day")


@query(
    "T10_candidate_stability",
    """
    WITH o AS (SELECT demand_type AS value, group_id, observed_on, min(observed_on) OVER (PARTITION BY group_id) AS f, max(observed_on) OVER (PARTITION BY group_id) AS l FROM {demands}),
    h AS (SELECT group_id, value, CASE WHEN bool_or(observed_on = f) AND bool_or(observed_on = l) THEN 'persistent' ELSE 'other' END AS state FROM o WHERE f < l GROUP BY ALL), e AS (SELECT DISTINCT task_id, demand_type AS value FROM {demands})
    SELECT task_id, count(state) AS known, count(CASE WHEN state = 'persistent' THEN 1 END) AS persistent, CASE WHEN count(state) = 0 THEN 'single_snapshot' WHEN count(CASE WHEN state = 'persistent' THEN 1 END) = count(state) THEN 'stable' WHEN count(CASE WHEN state = 'persistent' THEN 1 END) = 0 THEN 'volatile' ELSE 'mixed' END AS stability
    FROM e LEFT JOIN h ON e.value = h.value AND h.group_id < 3 GROUP BY task_id""",
)
def t10(s: Source):
    h = history.demand_history(s.demands.withColumnRenamed("demand_type", "v"), ["group_id"], "v", "observed_on").where("group_id < 3").withColumnRenamed("v", "value")
    return history.candidate_stability(s.demands.select("task_id", F.col("demand_type").alias("value")), h, "task_id", "value")


@query(
    "T11_competitive_stability",
    f"""
    WITH {_DIFF}, d AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS value, CASE WHEN min(old_rank) IS NULL THEN 'gained' WHEN min(new_rank) IS NULL THEN 'lost' ELSE 'persistent' END AS state FROM df GROUP BY 1), e AS (SELECT DISTINCT keyword, domain AS value FROM {{snapshots}} WHERE rank <= 5)
    SELECT keyword, count(state) AS known, count(CASE WHEN state = 'persistent' THEN 1 END) AS persistent, CASE WHEN count(state) = 0 THEN 'single_snapshot' WHEN count(CASE WHEN state = 'persistent' THEN 1 END) = count(state) THEN 'stable' WHEN count(CASE WHEN state = 'persistent' THEN 1 END) = 0 THEN 'volatile' ELSE 'mixed' END AS stability FROM e LEFT JOIN d ON e.value = d.value GROUP BY keyword""",
)
def t11(s: Source):
    h = history.appearance_history(_diff(s), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).withColumnRenamed("domain", "value")
    return history.candidate_stability(s.snapshots.where("rank <= 5").select("keyword", F.col("domain").alias("value")), h, "keyword", "value")


@query(
    "T12_task_holdout",
    """
    WITH tt AS (SELECT conv_id % 20 AS group_id, turn AS task_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations), ev AS (SELECT DISTINCT group_id, task_id FROM tt WHERE task_id < 2), h AS (SELECT tt.group_id, token, count(*) AS n FROM tt WHERE (group_id, task_id) NOT IN (SELECT (group_id, task_id) FROM ev) GROUP BY ALL),
    c AS (SELECT DISTINCT group_id, token FROM tt WHERE task_id = 0), b AS (SELECT DISTINCT group_id, token FROM tt WHERE token IN ('the', 'la')),
    j AS (SELECT h.group_id, CAST(sum(n) AS BIGINT) AS t, CAST(sum(CASE WHEN c.token IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS ct, CAST(sum(CASE WHEN b.token IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS bt FROM h LEFT JOIN c ON h.group_id = c.group_id AND h.token = c.token LEFT JOIN b ON h.group_id = b.group_id AND h.token = b.token GROUP BY h.group_id)
    SELECT group_id, round(ct / t, 6) AS candidate_coverage, round(bt / t, 6) AS baseline_coverage, CASE WHEN ct / t - bt / t >= 0.01 THEN 'improvement' WHEN ct / t - bt / t <= -0.01 THEN 'regression' ELSE 'tie' END AS outcome FROM j""",
)
def t12(s: Source):
    tt = s.conversations.select((F.col("conv_id") % 20).alias("group_id"), F.col("turn").alias("task_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return history.task_holdout(tt.where("task_id = 0"), tt.where("token in ('the', 'la')"), tt.where("task_id < 2").select("group_id", "task_id").distinct(), tt)


_FRESH = "SELECT user_id AS task_id, ts AS observed, event_id % 12 AS rank, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 17 = 0 THEN '2031-01-01 00:00:00' WHEN event_id % 3 = 0 THEN '2020-05-01 00:00:00' ELSE '2023-12-01 00:00:00' END AS published FROM {events}"


@query(
    "A14_T16_freshness",
    f"""
    WITH r AS (SELECT *, round((epoch_us(observed) - epoch_us(TRY_CAST(published AS TIMESTAMP))) / 86400000000.0) AS age FROM ({_FRESH}) f WHERE rank <= 10),
    g AS (SELECT task_id, count(*) AS results, count(CASE WHEN age IS NULL THEN 1 END) AS unavailable, count(CASE WHEN age < -1 THEN 1 END) AS invalid, count(CASE WHEN age >= -1 THEN 1 END) AS dated, count(CASE WHEN age >= -1 AND age <= 90 THEN 1 END) AS fresh, count(CASE WHEN age >= 730 THEN 1 END) AS stale, median(CASE WHEN age >= -1 THEN age END) AS median_age FROM r GROUP BY task_id)
    SELECT *, CASE WHEN dated = 0 OR dated / results < 0.3 THEN 'insufficient' WHEN median_age <= 180 AND fresh / dated >= 0.3 THEN 'fresh_dominant' WHEN median_age >= 730 AND stale / dated >= 0.5 THEN 'stale_dominant' ELSE 'mixed' END AS state FROM g""",
)
def a14(s: Source):
    return history.freshness(s.sql(_FRESH), "task_id", "observed", "published")


@query(
    "J10_as_of_pairs",
    """
    WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS id, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 2 = 1)
    SELECT n.o_custkey, n.id, arg_max(o.id, (o.o_orderdate, o.id)) AS old_id, CASE WHEN count(o.id) = 0 THEN 'out_of_scope' ELSE 'paired' END AS state FROM n LEFT JOIN o ON n.o_custkey = o.o_custkey AND o.o_orderdate < n.o_orderdate GROUP BY n.o_custkey, n.id""",
)
def j10(s: Source):
    o = s.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return history.as_of_pairs(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["o_custkey"], "o_orderdate").select("o_custkey", "id", "old_id", "state")


@query("T14_tumbling_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t14(s: Source):
    return history.windowed_counts(s.events, "ts", ["event_type"], "1 day")


@query("T14_sliding_counts", "WITH h AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS window_start, event_type FROM events) SELECT window_start, event_type, count(*) AS n FROM h GROUP BY ALL")
def t14s(s: Source):
    return history.windowed_counts(s.events, "ts", ["event_type"], "12 hours", "6 hours")


@query(
    "T14_session_counts",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS session_start, user_id, count(*) AS n FROM n GROUP BY user_id, k""",
)
def t14n(s: Source):
    return history.session_counts(s.events, "ts", ["user_id"], "4 hours")
