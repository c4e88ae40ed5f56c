"""Queries of demand, query rows and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import rules, text
from quaystone.operators import demand, terms
from quaystone.plans.catalog import Source, query


@query(
    "A7_normalized_queries",
    """SELECT article_id, normalized_query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(clicks) / sum(impressions), 6) AS ctr, round(sum(position * greatest(impressions, 1)) / sum(greatest(impressions, 1)), 6) AS position,
       arg_min(query, (-impressions, -clicks, query)) AS representative FROM (SELECT *, substring(query, 1, 1) AS normalized_query FROM {article_queries}) q GROUP BY article_id, normalized_query""",
)
def a7(s: Source):
    return demand.normalized_queries(s.article_queries.withColumn("normalized_query", F.substring("query", 1, 1)), ["article_id"])


@query("A8_query_stats", "SELECT article_id, count(*) AS queries, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, quantile_disc(impressions, 0.95) AS p95 FROM {article_queries} GROUP BY article_id")
def a8(s: Source):
    return demand.query_stats(s.article_queries, ["article_id"])


@query(
    "W1_primary_queries",
    """
    WITH p AS (SELECT article_id, quantile_disc(impressions, 0.95) AS p95 FROM {article_queries} GROUP BY 1), j AS (SELECT q.*, round(ln(1 + impressions) + ln(1 + clicks) * ln(1 + greatest(1, p95)), 6) AS score FROM {article_queries} q JOIN p ON q.article_id = p.article_id)
    SELECT article_id, query, score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, clicks DESC, impressions DESC, position, query) AS rank FROM j""",
)
def w1(s: Source):
    return demand.primary_queries(s.article_queries, ["article_id"])


@query("W2_latest_window", "SELECT article_id, query, window_days FROM {article_queries} QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY window_days DESC, impressions DESC, query) = 1")
def w2(s: Source):
    return demand.latest(s.article_queries, ["article_id"], [F.desc("window_days"), F.desc("impressions"), F.asc("query")]).select("article_id", "query", "window_days")


@query(
    "A9_demand_rollup",
    """
    WITH g AS (SELECT demand_type, value, count(*) AS occurrences, count(DISTINCT task_id) AS tasks, count(DISTINCT group_id) AS groups, min(observed_on) AS first_seen, max(observed_on) AS last_seen, min(occurrence_order) AS best_order, max(depth) AS max_depth FROM {demands} GROUP BY ALL)
    SELECT *, round(100 * (0.6 * tasks / max(tasks) OVER (PARTITION BY demand_type) + 0.25 * groups / max(groups) OVER (PARTITION BY demand_type) + 0.15 * occurrences / max(occurrences) OVER (PARTITION BY demand_type))) AS importance FROM g""",
)
def a9(s: Source):
    return demand.demand_rollup(s.demands)


_EN = "SELECT doc_id AS page_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE lang = 'en'"


@query(
    "X11_X12_A10_term_weights",
    f"""
    WITH t AS ({_EN}), p AS (SELECT page_id, term, count(*) AS c, page_id % 3 = 0 AS in_title, page_id % 5 = 0 AS in_heading, page_id % 6 + 1 AS rank FROM t GROUP BY ALL)
    SELECT term, count(*) AS page_count, CAST(sum(c) AS BIGINT) AS total_count, count(CASE WHEN in_title THEN 1 END) AS title_pages, count(CASE WHEN in_heading THEN 1 END) AS heading_pages, round(sum(1 + ln(1 + c) + CASE WHEN in_title THEN 3 ELSE 0 END + CASE WHEN in_heading THEN 2 ELSE 0 END + 0.25 * greatest(0, 4 - rank)), 6) AS weight
    FROM p GROUP BY term HAVING count(*) >= 2""",
)
def a10(s: Source):
    t = terms.page_terms(s.documents.where("lang = 'en'").withColumnRenamed("doc_id", "page_id"), "page_id", "text")
    p = t.withColumns({"in_title": (F.col("page_id") % 3 == 0).cast("int"), "in_heading": (F.col("page_id") % 5 == 0).cast("int"), "rank": F.col("page_id") % 6 + 1})
    return terms.term_weights(p)


@query(
    "A12_hashtag_evidence",
    """
    WITH t AS (SELECT conv_id % 10 AS site_id, role, unnest(regexp_extract_all(replace(lower(text), ' a', ' #a'), '#[\\p{L}\\p{N}_]+')) AS tag FROM conversations)
    SELECT site_id, tag, count(*) AS occurrences, count(DISTINCT role) AS source_kinds, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'ambiguous' END AS class FROM t GROUP BY site_id, tag""",
)
def a12(s: Source):
    t = s.conversations.select((F.col("conv_id") % 10).alias("site_id"), "role", F.explode(text.hashtags(F.replace(F.lower("text"), F.lit(" a"), F.lit(" #a")))).alias("tag"))
    return t.groupBy("site_id", "tag").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("role").alias("source_kinds"), F.when(F.count_distinct("role") == 1, F.min("role")).otherwise("ambiguous").alias("class"))


_TITLES = "SELECT page_id, page_id % 7 AS group_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}"


@query("A15_A17_title_lengths", f"SELECT group_id, count(*) AS n, round(quantile_cont(length(title), 0.25), 2) AS q25, round(quantile_cont(length(title), 0.5), 2) AS median, round(quantile_cont(length(title), 0.75), 2) AS q75, round(avg(length(title)), 2) AS mean, min(length(title)) AS least, max(length(title)) AS most FROM ({_TITLES}) t GROUP BY group_id")
def a15(s: Source):
    return demand.length_quantiles(s.pages.select((F.col("page_id") % 7).alias("group_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")), ["group_id"], F.char_length("title"))


@query("A18_feature_summary", "SELECT demand_type, count(*) AS n, count(DISTINCT task_id) AS tasks FROM {demands} GROUP BY demand_type")
def a18(s: Source):
    return s.demands.groupBy("demand_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("tasks"))


@query("A19_state_counters", "SELECT group_id, count(CASE WHEN demand_type = 'O' THEN 1 END) AS O, count(CASE WHEN demand_type = 'F' THEN 1 END) AS F, count(CASE WHEN demand_type = 'X' THEN 1 END) AS X FROM {demands} GROUP BY group_id")
def a19(s: Source):
    return demand.state_counters(s.demands, ["group_id"], "demand_type", ["O", "F", "X"])


_TYPES = "SELECT task_id, rank, CASE WHEN domain IN ('shop0.example', 'shop3.example') THEN 'news' WHEN domain = 'shop1.example' THEN 'qa_forum' WHEN domain = 'shop2.example' THEN 'other' WHEN domain = 'shop4.example' THEN 'tool' ELSE 'category' END AS page_type FROM {edges}"


@query("A20_type_vote", f"WITH v AS (SELECT task_id, CASE WHEN page_type IN ('news', 'qa_forum') THEN 'article' ELSE page_type END AS vote, CASE WHEN rank <= 5 THEN 2 ELSE 1 END AS w FROM ({_TYPES}) t), g AS (SELECT task_id, vote, CAST(sum(w) AS BIGINT) AS weight FROM v WHERE vote <> 'other' GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, vote) = 1")
def a20(s: Source):
    return demand.type_vote(s.sql(_TYPES), "task_id")


@query("A21_fingerprints", "WITH w AS (SELECT task_id, domain, round(sum(1 / rank), 6) AS w FROM {edges} GROUP BY ALL) SELECT task_id, arg_max(domain, (w, domain)) AS top_domain, count(*) AS domains, round(sum(w), 6) AS total FROM w GROUP BY task_id")
def a21(s: Source):
    f = demand.fingerprints(s.edges)
    top = F.array_max(F.transform(F.map_entries("weights"), lambda x: F.struct(x["value"], x["key"])))["key"]
    return f.select("task_id", top.alias("top_domain"), F.size("weights").alias("domains"), "total")


@query("A22_suggest_evidence", "SELECT lower(raw_keyword) AS normalized, count(DISTINCT raw_keyword) AS forms, array_to_string(list_sort(list_distinct(list(sheet))), ',') AS sheets, count(CASE WHEN state = 'acquired' THEN 1 END) AS acquired, count(CASE WHEN state = 'unacquired' THEN 1 END) AS unacquired, CASE WHEN count(DISTINCT volume) > 1 THEN 'conflicting' WHEN count(DISTINCT volume) = 1 THEN 'single' ELSE 'not_observed' END AS volume_state FROM {keywords} GROUP BY lower(raw_keyword)")
def a22(s: Source):
    return demand.suggest_evidence(s.keywords, text.normalize_keyword(F.col("raw_keyword"), unicode=False))


@query("A23_qa_rollup", "SELECT CASE domain WHEN 'shop1.example' THEN 'one' ELSE 'two' END AS source, url, count(DISTINCT keyword) AS keywords, count(DISTINCT group_id) AS groups, min(rank) AS best_rank FROM {edges} WHERE domain IN ('shop1.example', 'shop5.example') GROUP BY domain, url")
def a23(s: Source):
    return demand.qa_rollup(s.edges.withColumn("source", rules.qa_source(F.col("domain"), {"shop1.example": "one", "shop5.example": "two"})))


@query("A24_ranked_branches", "WITH g AS (SELECT split_part(raw_keyword, ' ', 2) AS branch, count(*) AS n, coalesce(CAST(sum(volume) AS BIGINT), 0) AS volume FROM {keywords} WHERE contains(raw_keyword, ' ') GROUP BY 1) SELECT *, rank() OVER (ORDER BY n DESC, volume DESC, branch) AS position FROM g")
def a24(s: Source):
    return demand.ranked_branches(s.keywords.select(F.split("raw_keyword", " ").alias("path"), "volume"))


@query(
    "A25_reconcile_reviews",
    """
    WITH d AS (SELECT conv_id AS item, turn % 2 AS reviewer, role AS state, turn AS seen_at FROM conversations), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item, reviewer ORDER BY seen_at DESC) = 1)
    SELECT item, count(DISTINCT reviewer) AS reviewers, CASE WHEN count(DISTINCT state) > 1 THEN 'reviewer_disagreement' ELSE min(state) END AS state, CASE WHEN count(DISTINCT state) > 1 THEN 'adjudicate' WHEN count(DISTINCT reviewer) >= 2 THEN 'settled' ELSE 'second_review' END AS next FROM l GROUP BY item""",
)
def a25(s: Source):
    return demand.reconcile_reviews(s.conversations.select(F.col("conv_id").alias("item"), (F.col("turn") % 2).alias("reviewer"), F.col("role").alias("state"), F.col("turn").alias("at")))


@query("A26_cost_ledger", "WITH d AS (SELECT o_custkey AS source_id, CASE WHEN o_orderstatus = 'O' THEN 'planned' ELSE 'committed' END AS kind, CAST(max(CAST(o_totalprice AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS cost, count(*) AS n FROM orders GROUP BY 1, 2) SELECT CAST(sum(CASE WHEN kind = 'committed' THEN cost END) AS DOUBLE) AS committed, CAST(sum(CASE WHEN kind = 'planned' THEN cost END) AS DOUBLE) AS planned, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_sources, sum(cost) <= 1000000 AS within_cap FROM d")
def a26(s: Source):
    return demand.cost_ledger(s.orders.select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "O", "planned").otherwise("committed").alias("kind"), F.col("o_totalprice").alias("cost")), 1_000_000)


@query("A27_record_counts", "SELECT kind, state, count(*) AS n FROM (SELECT 'demand' AS kind, demand_type AS state FROM {demands} UNION ALL SELECT 'keyword', state FROM {keywords} UNION ALL SELECT 'turn', role FROM conversations) u GROUP BY kind, state")
def a27(s: Source):
    u = s.demands.select(F.lit("demand").alias("kind"), F.col("demand_type").alias("state")).unionByName(s.keywords.select(F.lit("keyword").alias("kind"), "state")).unionByName(s.conversations.select(F.lit("turn").alias("kind"), F.col("role").alias("state")))
    return u.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


_REQ = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'keywords' WHEN 1 THEN 'ranks' ELSE 'suggestions' END AS kind, o_custkey % 90 + 1 AS n, o_orderkey % 2 AS difficulty, 30 + o_orderkey % 8 * 10 AS depth FROM {orders}"


@query("A28_credit_estimate", f"SELECT *, round(CASE kind WHEN 'keywords' THEN greatest(15.0, n * (0.03 + 0.75 * difficulty)) WHEN 'ranks' THEN n * (0.9 + 0.3 * (depth - 30) / 10) ELSE greatest(4.5, 0.45 * n) END, 6) AS credits FROM ({_REQ}) r".replace("15.0", "CAST(15 AS DOUBLE)").replace("4.5,", "CAST(4.5 AS DOUBLE),").replace("0.03 + 0.75", "CAST(0.03 AS DOUBLE) + CAST(0.75 AS DOUBLE)").replace("(0.9 + 0.3", "(CAST(0.9 AS DOUBLE) + CAST(0.3 AS DOUBLE)").replace("0.45 * n", "CAST(0.45 AS DOUBLE) * n"))
def a28(s: Source):
    return demand.credit_estimate(s.sql(_REQ))


_ASSOC = """t AS (SELECT DISTINCT source_keyword_id AS doc_id, unnest(regexp_extract_all(lower(raw_keyword), '[\\p{L}\\p{N}]+')) AS term FROM {keywords}), f AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 3), k AS (SELECT t.*, df FROM t JOIN f ON t.term = f.term),
    p AS (SELECT a.term, b.term AS other, count(*) AS support, round(count(*) / sqrt(min(a.df) * min(b.df)), 6) AS cosine FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY a.term, b.term HAVING count(*) >= 3)"""


@query("G6_W3_associations", f"WITH {_ASSOC} SELECT term, other, support, cosine, row_number() OVER (PARTITION BY term ORDER BY cosine DESC, support DESC, other) AS rank FROM p QUALIFY rank <= 12")
def g6(s: Source):
    return terms.associations(terms.document_terms(s.keywords, "source_keyword_id", "raw_keyword"), "source_keyword_id")


#: Both words of a keyword as Japanese terms, a third by its size, a generic one, and words that are no terms.
_TERMS = """SELECT source_keyword_id AS doc_id, concat('語', split_part(raw_keyword, ' ', 1)) AS term FROM {keywords} UNION ALL SELECT source_keyword_id, concat('語', split_part(raw_keyword, ' ', 2)) FROM {keywords} WHERE size % 6 <> 0
    UNION ALL SELECT source_keyword_id, concat('型', CAST(size % 7 AS STRING)) FROM {keywords} WHERE size % 3 = 0 UNION ALL SELECT source_keyword_id, CASE size % 4 WHEN 0 THEN 'ai' WHEN 1 THEN '就活' WHEN 2 THEN 'x' ELSE 'latin' END FROM {keywords}"""


@query(
    "G6_keyword_associations",
    f"""WITH v AS (SELECT DISTINCT * FROM ({_TERMS}) x WHERE term = 'ai' OR term LIKE '語%' OR term LIKE '型%'), t AS (SELECT * FROM v WHERE doc_id IN (SELECT doc_id FROM v GROUP BY doc_id HAVING count(*) > 1)), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    p AS (SELECT a.term, b.term AS other, count(*) AS support, array_to_string(list_sort(list(a.doc_id))[1:20], ',') AS evidence FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY 1, 2 HAVING count(*) >= 3),
    c AS (SELECT p.term, other, support, x.df AS df_term, y.df AS df_other, round(support / sqrt(x.df * y.df), 6) AS cosine, evidence FROM p JOIN f x ON p.term = x.term JOIN f y ON other = y.term WHERE x.df >= 3 AND y.df >= 3)
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY cosine DESC, support DESC, other) AS rank FROM c QUALIFY rank <= 12""",
)
def g6k(s: Source):
    return terms.keyword_associations(s.sql(_TERMS), "doc_id").withColumn("evidence", F.array_join("evidence", ","))


@query("G7_variants", "SELECT replace(lower(raw_keyword), ' ', '') AS representative, sheet, count(DISTINCT raw_keyword) AS forms, count(*) AS rows, array_to_string(list_sort(list_distinct(list(raw_keyword))), '|') AS surface FROM (SELECT CASE WHEN size % 2 = 0 THEN upper(raw_keyword) ELSE raw_keyword END AS raw_keyword, sheet FROM {keywords}) k GROUP BY 1, 2 HAVING count(DISTINCT raw_keyword) > 1")
def g7(s: Source):
    k = s.keywords.withColumn("raw_keyword", F.when(F.col("size") % 2 == 0, F.upper("raw_keyword")).otherwise(F.col("raw_keyword")))
    return terms.variants(k, "raw_keyword", text.compact(F.col("raw_keyword"), unicode=False), ["sheet"])


@query(
    "G5_W7_prefix_tree",
    """
    WITH k AS (SELECT source_keyword_id, CASE WHEN size % 3 = 0 THEN split_part(raw_keyword, ' ', 1) ELSE raw_keyword END AS kw FROM {keywords}), t AS (SELECT source_keyword_id, unnest(string_split(kw, ' ')) AS token FROM k), f AS (SELECT token, count(DISTINCT source_keyword_id) AS df FROM t GROUP BY token),
    p AS (SELECT source_keyword_id, string_agg(t.token, '/' ORDER BY df DESC, t.token) AS path, count(*) AS depth FROM t JOIN f ON t.token = f.token GROUP BY source_keyword_id), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source_keyword_id) AS n, split_part(path, '/', 1) AS head FROM p)
    SELECT source_keyword_id, path, depth, CASE WHEN depth > 1 AND head IN (SELECT path FROM p) THEN head END AS parent_path, CASE WHEN n > 1 THEN 'reordered_alias' WHEN depth = 1 OR head NOT IN (SELECT path FROM p) THEN 'root' ELSE 'child' END AS relation FROM n""",
)
def g5(s: Source):
    k = s.keywords.withColumn("kw", F.when(F.col("size") % 3 == 0, F.split("raw_keyword", " ")[0]).otherwise(F.col("raw_keyword")))
    return terms.prefix_tree(k, "source_keyword_id", "kw")


_CAND = "SELECT group_id, task_id AS candidate, round(coalesce(volume, 0) / 100, 4) AS score FROM {tasks}"


@query("W6_margins", f"WITH r AS (SELECT *, row_number() OVER w AS position, lead(score) OVER w AS next FROM ({_CAND}) c WINDOW w AS (PARTITION BY group_id ORDER BY score DESC, candidate)) SELECT group_id, candidate, round(score - next, 6) AS margin, CASE WHEN next IS NULL THEN 'unique' WHEN score - next <= 1e-6 THEN 'tie' WHEN score - next >= 10 THEN 'clear_leader' ELSE 'margin_review' END AS state FROM r WHERE position = 1")
def w6(s: Source):
    return demand.margins(s.sql(_CAND), "group_id")


@query("W8_stratified_order", "SELECT source_keyword_id, sheet, round(row_number() OVER (PARTITION BY sheet ORDER BY size, source_keyword_id) / count(*) OVER (PARTITION BY sheet), 6) AS quantile FROM {keywords}")
def w8(s: Source):
    return demand.stratified_order(s.keywords, "sheet", ["size", "source_keyword_id"]).select("source_keyword_id", "sheet", "quantile")


@query("W9_running_budget", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 6) AS running, round(sum(o_totalprice) OVER w, 6) <= 500000 AS selected FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def w9(s: Source):
    return demand.running_budget(s.orders, "o_custkey", ["o_orderkey"], "o_totalprice", 500_000).select("o_orderkey", "running", "selected")


@query(
    "W9_greedy_budget",
    """
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    r AS (SELECT o_custkey, o_orderkey, o_totalprice, n, o_totalprice <= 500000 AS selected, 500000 - CASE WHEN o_totalprice <= 500000 THEN o_totalprice ELSE 0 END AS rest FROM o WHERE n = 1
        UNION ALL SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, o.n, o.o_totalprice <= rest + 1e-9, rest - CASE WHEN o.o_totalprice <= rest + 1e-9 THEN o.o_totalprice ELSE 0 END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
    SELECT o_custkey, o_orderkey, o_totalprice, selected FROM r""",
)
def w9g(s: Source):
    return demand.greedy_budget(s.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"], "o_totalprice", 500_000)


@query("W10_batches", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders")
def w10(s: Source):
    return demand.batches(s.orders, ["o_orderpriority"], ["o_orderkey"], 100).select("o_orderkey", "batch")


@query("W13_hash_sample", "SELECT p_partkey, p_name FROM part ORDER BY sha256('seed:' || CAST(p_partkey AS STRING)) LIMIT 50")
def w13(s: Source):
    return demand.hash_sample(s.part.select("p_partkey", "p_name"), ["p_partkey"], "seed", 50)


@query("W15_bounded_retention", "SELECT p_partkey FROM part WHERE p_size > 48 UNION ALL (SELECT p_partkey FROM part WHERE p_size <= 48 ORDER BY p_retailprice DESC, p_partkey LIMIT 250)")
def w15(s: Source):
    return demand.bounded_retention(s.part, F.col("p_size") > 48, [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey")
