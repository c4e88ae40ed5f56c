"""Queries of clusters, pages, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.operators import assign, cluster, html, outline
from quaystone.plans.catalog import Source, query
from quaystone.plans.storage import new_path
from quaystone.sources import readers, writers
from quaystone.streaming import streams


@query("G4_modifiers", "SELECT source_keyword_id, CASE WHEN w2 IN ('ring', 'bolt') THEN CASE WHEN w1 IN ('ring', 'bolt', 'small') THEN 2 ELSE 1 END WHEN w2 = 'small' THEN 1 ELSE 0 END::BIGINT AS trailing, CASE WHEN w2 IN ('ring', 'bolt', 'small') THEN w1 END AS parent FROM (SELECT source_keyword_id, split_part(raw_keyword, ' ', 1) AS w1, split_part(raw_keyword, ' ', 2) AS w2 FROM {keywords}) k")
def g4(s: Source):
    n, _, parent = cluster.modifier(F.split("raw_keyword", " "), ["ring", "bolt", "small"])
    return s.keywords.select("source_keyword_id", n.alias("trailing"), parent.alias("parent"))


def _clusters(s: Source):
    return cluster.task_groups(s.edges)


@query("G2_complete_link")
def g2(s: Source):
    return _clusters(s)


@query("G3_keyword_groups")
def g3(s: Source):
    k = s.tasks.select(F.col("task_id").alias("id"), "keyword", "volume", (F.col("task_id") % 10 == 0).alias("is_modifier"))
    return cluster.keyword_groups(k, _clusters(s), "is_modifier")


@query("G25_token_components", "SELECT conv_id, 0 * conv_id + min(conv_id) OVER (PARTITION BY k) AS component FROM (SELECT DISTINCT conv_id, conv_id % 7 AS k FROM conversations) c")
def g25(s: Source):
    return cluster.token_components(s.conversations.select("conv_id", (F.col("conv_id") % 7).alias("token")), "conv_id", "token")


@query("G26_one_to_one")
def g26(s: Source):
    a = s.articles.select((F.col("article_id") % 5).alias("grp"), F.col("article_id").alias("id"), "title")
    return assign.similar_one_to_one(a.where("id % 2 = 0").withColumnRenamed("id", "l"), a.where("id % 2 = 1").withColumnRenamed("id", "r"), "grp", "l", "r", "title")


@query("G28_outline")
def g28(s: Source):
    """Articles as headings: every fourth is of level 2; evidence and quality from ids, some blocked, some unresolved."""
    i = F.col("article_id")
    c = s.articles.select(
        (i % 40).alias("group_id"), i.alias("candidate_id"), F.col("title").alias("text"), F.when(F.floor(i / 40) % 4 == 0, 2).otherwise(3).alias("heading_level"), (i % 3).alias("evidence_type"), F.array(i % 7, i % 11 + 7).alias("evidence_ids"),
        F.when(i % 9 == 0, "blocked").when(i % 2 == 0, "ready").otherwise("needs_review").alias("state"), (i % 13 != 5).alias("resolved"), (i % 5 * 20).alias("quality"), (i % 4).alias("evidence_count"), (i % 6).alias("strength"),
    )
    return outline.evidence_outlines(c, unicode=False)


@query("G27_survivors", "WITH s AS (SELECT group_id, task_id, round(0.35 * (task_id % 7) / 7 + 0.25 * (task_id % 5) / 5 + 0.3 * (task_id % 3) / 3 + 0.1 * (task_id % 2), 6) AS score FROM {tasks}), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nx FROM s WINDOW w AS (PARTITION BY group_id ORDER BY score DESC, task_id)) SELECT group_id, task_id, round(score - nx, 6) AS margin, CASE WHEN round(score - nx, 6) < 0.05 THEN 'margin_review' ELSE 'survivor' END AS state FROM r WHERE n = 1")
def g27(s: Source):
    t = F.col("task_id")
    return cluster.survivors(s.tasks.select("group_id", "task_id", (t % 7 / 7).alias("competition"), (t % 5 / 5).alias("title"), (t % 3 / 3).alias("evidence"), (t % 2).alias("unique")), "group_id", "task_id")


@query("G29_dependency_order", "SELECT l_orderkey AS story, CAST(l_linenumber AS BIGINT) AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1)")
def g29(s: Source):
    n = s.lineitem.select(F.col("l_orderkey").alias("story"), F.col("l_linenumber").alias("n")).distinct()
    e = n.alias("a").join(n.alias("b"), (F.col("a.story") == F.col("b.story")) & (F.col("a.n") < F.col("b.n"))).select("a.story", F.col("a.n").cast("bigint").alias("first"), F.col("b.n").cast("bigint").alias("second"))
    return cluster.dependency_order(e, "story", "first", "second")


@query("X6_headings", "SELECT page_id, 1::BIGINT AS level, trim(replace(replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')) AS text FROM pages WHERE regexp_matches(html, '<h1[^>]*>[^<]*</h1>')")
def x6(s: Source):
    return html.headings(html.parse(s.pages)).where("level = 1").select("page_id", "level", "text")


@query("X7_structure")
def x7(s: Source):
    return html.structure(html.parse(s.pages))


@query("X8_metadata")
def x8(s: Source):
    return html.metadata(html.parse(s.pages))


@query("X9_links", "SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<a [^>]*href=')) AS a FROM pages) x GROUP BY page_id")
def x9(s: Source):
    return html.links(html.parse(s.pages)).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


_H = "SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey % 3 + 1 AS level, CAST(o_orderkey AS STRING) AS text FROM {orders}"


@query(
    "X15_heading_context",
    f"""
    WITH h AS ({_H}), a AS (SELECT *, (SELECT max(position) FROM h b WHERE b.page_id = h.page_id AND b.position < h.position AND b.level = 1) AS p1, (SELECT max(position) FROM h b WHERE b.page_id = h.page_id AND b.position < h.position AND b.level = 2) AS p2 FROM h)
    SELECT a.page_id, a.position, a.level, a.text, concat_ws(' > ', x.text, CASE WHEN a.level > 2 AND coalesce(a.p1, 0) < a.p2 THEN y.text END) AS context FROM a LEFT JOIN h x ON x.page_id = a.page_id AND x.position = a.p1 LEFT JOIN h y ON y.page_id = a.page_id AND y.position = a.p2 WHERE a.level >= 2""",
)
def x15(s: Source):
    return html.heading_context(s.sql(_H))


@query("X13_json_leaves", "SELECT 'k' AS path, count(*) AS n, count(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 THEN 1 END) AS nonempty, 0::BIGINT AS empty, 0::BIGINT AS \"null\", count(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 0 THEN 1 END) AS zero, 0::BIGINT AS \"false\", 0::BIGINT AS invalid FROM events")
def x13(s: Source):
    return readers.json_leaves(s.events, "event_id", "props")


@query("S10_tsv_cells", "SELECT CAST(conv_id AS STRING) AS conv_id, CAST(turn AS STRING) AS turn, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS text FROM conversations")
def s10(s: Source):
    return writers.tsv_cells(s.conversations.select("conv_id", "turn", "text"))


@query("S3_export_numbers", "SELECT o_orderkey, floor(o_totalprice) AS clicks, round((o_orderkey % 100) / 100, 6) AS ctr FROM orders")
def s3(s: Source):
    shown = F.format_number(F.floor("o_totalprice"), 0)
    return s.orders.select("o_orderkey", readers.export_number(shown).alias("clicks"), F.round(readers.export_number(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%"))), 6).alias("ctr"))


@query("S5_missing_requests", "SELECT p_name AS keyword FROM part GROUP BY 1 HAVING max(CASE WHEN p_size > 48 THEN 1 ELSE 0 END) = 0")
def s5(s: Source):
    r = s.part.select(F.col("p_name").alias("keyword"), F.when(F.col("p_size") > 48, 20000).otherwise(40000).alias("status_code"))
    return readers.missing_requests(r, r, "keyword")


@query("S6_sitemap", "SELECT concat('https://site.example/', CAST(p_partkey AS STRING)) AS canonical_url, CASE WHEN min(p_size) % 2 = 0 THEN 'post' ELSE 'page' END AS surface_type FROM part GROUP BY p_partkey")
def s6(s: Source):
    entry = F.concat(F.lit("<url><loc> https://site.example/"), F.col("p_partkey").cast("string"), F.lit("?utm_source=x </loc><lastmod>2024-01-01</lastmod></url>"))
    t = s.part.groupBy((F.col("p_size") % 2).alias("odd")).agg(F.concat_ws("", F.collect_list(entry)).alias("xml")).select(F.when(F.col("odd") == 0, "https://site.example/post.xml").otherwise("https://site.example/page.xml").alias("sitemap_url"), "xml")
    return readers.sitemap(t, "https://site.example").select("canonical_url", "surface_type")


@query("S8_publish", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def s8(s: Source):
    root = new_path(s.spark, "published")
    writers.publish({"brands": s.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))}, root, "run-1")
    return writers.published(s.spark, root, "brands")


def _snapshots(s: Source):
    """Each task's results as the JSON text of a provider's response."""
    organic = F.struct(F.lit("organic").alias("type"), F.col("rank").alias("rank_group"), F.col("rank").alias("rank_absolute"), "domain", "title", F.concat("url", F.lit("?utm_source=x")).alias("url"))
    items = s.edges.groupBy("task_id", "keyword").agg(F.to_json(F.array_sort(F.collect_list(organic))).alias("o"))
    more = F.concat(F.lit(',{"type":"people_also_ask","items":[{"title":"What is '), F.col("keyword"), F.lit('?","seed_question":null},{"title":"Why?"}]},{"type":"related_searches","items":["'), F.col("keyword"), F.lit(' price"]},{"type":"video"}]'))
    content = F.concat(F.lit('{"tasks":[{"id":"t'), F.col("task_id").cast("string"), F.lit('","status_code":20000,"cost":0.0006,"data":{"keyword":"'), F.col("keyword"), F.lit('","depth":10},"result":[{"datetime":"2024-01-01","items":'), F.expr("substring(o, 1, length(o) - 1)"), more, F.lit("}]}]}"))
    texts = items.select(F.concat(F.lit("set/raw/"), F.col("task_id").cast("string"), F.lit(".json")).alias("path"), F.lit("set").alias("dataset"), content.alias("content"))
    return readers.parse_snapshots(texts)


@query("S1_X1_organic", "SELECT 't' || CAST(task_id AS STRING) AS task_id, rank AS rank_absolute, url AS canonical_url, title FROM {edges}")
def s1(s: Source):
    return readers.organic(_snapshots(s)).select("task_id", "rank_absolute", "canonical_url", "title")


@query("X2_demand_occurrences", "SELECT 't' || CAST(task_id AS STRING) AS task_id, demand_type, occurrence_order::BIGINT AS occurrence_order, v AS value FROM (SELECT DISTINCT task_id, keyword FROM {edges}) e, LATERAL (VALUES ('people_also_ask', 0, 'What is ' || keyword || '?'), ('people_also_ask', 1, 'Why?'), ('related_searches', 0, keyword || ' price')) x(demand_type, occurrence_order, v)")
def x2(s: Source):
    return readers.demand_occurrences(_snapshots(s)).select("task_id", "demand_type", "occurrence_order", "value")


@query("X3_feature_items", "SELECT 't' || CAST(task_id AS STRING) AS task_id, f AS feature_type, n::BIGINT AS n_items FROM (SELECT DISTINCT task_id FROM {edges}) e, (VALUES ('people_also_ask', 2), ('related_searches', 1), ('video', 0)) x(f, n)")
def x3(s: Source):
    return readers.feature_items(_snapshots(s)).select("task_id", "feature_type", "n_items")


_AN = "SELECT l_orderkey AS question_id, l_linenumber > 2 AS requested, CASE WHEN l_linenumber = 7 THEN l_returnflag END AS answer, l_linenumber = 6 AS pending FROM {lineitem}"


@query("X4_paa_answers", f"WITH r AS (SELECT question_id, max(CASE WHEN answer IS NOT NULL THEN 3 WHEN pending THEN 2 WHEN requested THEN 1 ELSE 0 END) AS l FROM ({_AN}) x GROUP BY 1) SELECT question_id, CASE l WHEN 3 THEN 'resolved' WHEN 2 THEN 'async_pending' WHEN 1 THEN 'empty' ELSE 'not_requested_or_missing' END AS response_state FROM r")
def x4(s: Source):
    return readers.paa_answers(s.sql(_AN)).select("question_id", "response_state")


@query("X5_element_sources", "SELECT task_id, rank AS element_id, CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS links, CASE WHEN rank % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS references, CASE WHEN rank % 3 = 1 THEN 'referenced' WHEN rank % 3 = 2 THEN 'link_only' ELSE 'unreferenced' END AS lineage FROM {edges}")
def x5(s: Source):
    e = s.edges
    elements = e.select("task_id", F.col("rank").alias("element_id"), F.when(F.col("rank") % 3 > 0, F.array(F.concat("url", F.lit("/?utm_medium=y#z")))).alias("urls"))
    return readers.element_sources(elements, e.where("rank % 3 = 1").select("task_id", "url"))


@query("Q12_retention", "SELECT * FROM (VALUES ('k', 'exact_structured')) v(path, state) WHERE (SELECT count(*) FROM events) > 0")
def q12(s: Source):
    from quaystone.operators import review

    leaves = readers.json_leaves(s.events, "event_id", "props").select("path", "n")
    columns = s.events.select(F.get_json_object("props", "$.k").alias("v")).agg(F.count("v").alias("kept")).select(F.lit("k").alias("path"), F.lit("k").alias("column"), "kept")
    return review.retention(leaves, columns)


@query("S9_payload_archive", "SELECT event_id, octet_length(encode(props)) AS bytes, sha256(props) AS digest FROM events")
def s9(s: Source):
    path = new_path(s.spark, "archive")
    writers.archive_payloads(s.events.withColumn("on_day", F.col("ts").cast("date")), path, "event_id", "props", "on_day")
    return s.spark.read.parquet(path).select("event_id", "bytes", "digest")


@query("S7_regions", "SELECT DISTINCT n_name AS prefecture, CASE WHEN c_custkey % 3 = 0 THEN 'K' || CAST(c_custkey % 5 AS STRING) || '郡' ELSE '' END AS county, c_mktsegment AS municipality FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s7(s: Source):
    c = s.customer.join(s.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return readers.postal_regions(c.select(F.col("n_name").alias("prefecture"), F.when(k % 3 == 0, F.concat(F.lit("K"), (k % 5).cast("string"), F.lit("郡"), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment")).alias("municipality")))


@query("S4_reference_tsv", "SELECT p_partkey, p_name, p_brand FROM part")
def s4(s: Source):
    path = new_path(s.spark, "reference")
    s.part.select("p_partkey", "p_name", "p_brand").write.option("sep", "\t").option("compression", "gzip").csv(path)
    return readers.reference_tsv(s.spark, path, "p_partkey long, p_name string, p_brand string")


@query("S2_quoted_csv", "SELECT conv_id, turn, text FROM conversations")
def s2(s: Source):
    path = new_path(s.spark, "csv")
    s.conversations.select("conv_id", "turn", "text").write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.quoted_csv(s.spark, path, "conv_id long, turn long, text string")


def _event_stream(s: Source, rows_per_file: int = 250_000):
    """The events as a stream of files, in batches that are a stretch of days each."""
    path = new_path(s.spark, "event-stream")
    e = s.events.withColumn("ts", F.col("ts").cast("timestamp"))
    # Files are read in the order in which they were written, so each stretch is written after the one before.
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    stretch = F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / max(1, high - low)))
    sizes = {r.i: r["count"] for r in e.groupBy(stretch.alias("i")).count().collect()}
    held = [sizes[i] for i in range(4) if i in sizes]
    # All stretches have this number of files, none of them empty: rows are dealt in turn, and the smallest stretch has rows_per_file for each. So a batch of as many files is a stretch.
    files = max(1, min(held, default=0) // rows_per_file)
    for i in range(4):
        part = e.where(stretch == i)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    return streams.replay(s.spark, path, e.schema, files)


@query("T13_ingest_once", "SELECT event_id, user_id FROM events")
def t13(s: Source):
    twice = _event_stream(s)
    once = streams.ingest_once(twice.select("event_id", "ts", "user_id"), "event_id", "ts", "60 days")
    return streams.run_to_table(once, new_path(s.spark, "stream-out"), new_path(s.spark, "stream-state")).select("event_id", "user_id")


@query("T14_stream_counts", "SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS STRING) AS day, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '3 days' <= (SELECT max(ts) FROM events) GROUP BY ALL")
def t14(s: Source):
    out = streams.windowed_counts(_event_stream(s), "ts", ["event_type"], "1 day", "2 days")
    return streams.run_to_table(out, new_path(s.spark, "stream-out"), new_path(s.spark, "stream-state")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


#: An event type with a part of its users is a key, a user a member, a day a snapshot.
_SEEN = "SELECT concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS keyword, CAST(user_id AS STRING) AS url"


@query(
    "T15_stream_tracker",
    f"""WITH d AS (SELECT DISTINCT keyword, url, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS snapshot FROM ({_SEEN}, ts FROM events) e),
    s AS (SELECT *, lag(snapshot) OVER (PARTITION BY keyword ORDER BY snapshot) AS before, lead(snapshot) OVER (PARTITION BY keyword ORDER BY snapshot) AS next FROM (SELECT DISTINCT keyword, snapshot FROM d) x),
    r AS (
        SELECT d.keyword, d.url, d.snapshot, CASE WHEN p.url IS NULL THEN 'gained' ELSE 'persistent' END AS state FROM d JOIN s ON d.keyword = s.keyword AND d.snapshot = s.snapshot LEFT JOIN d p ON p.keyword = d.keyword AND p.url = d.url AND p.snapshot = s.before
        UNION ALL SELECT d.keyword, d.url, s.next, 'lost' FROM d JOIN s ON d.keyword = s.keyword AND d.snapshot = s.snapshot LEFT JOIN d n ON n.keyword = d.keyword AND n.url = d.url AND n.snapshot = s.next WHERE s.next IS NOT NULL AND n.url IS NULL)
    SELECT * FROM r WHERE DATE '1970-01-01' + CAST(snapshot + 3 AS INTEGER) <= (SELECT max(ts) FROM events)""",
)
def t15(s: Source):
    events = _event_stream(s).selectExpr("concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS keyword", "CAST(user_id AS STRING) AS url", "ts")
    out = streams.track_appearances(events, ["keyword"], "url", "ts", 86_400_000, "2 days")
    return streams.run_to_table(out, new_path(s.spark, "stream-out"), new_path(s.spark, "stream-state"))
