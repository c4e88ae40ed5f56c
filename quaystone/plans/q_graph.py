"""Queries of page-keyword graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.text import grams
from quaystone.operators import graph, hierarchy, sets, typed_graph
from quaystone.plans.catalog import Source, query

_PAIRS = """p AS (SELECT a.task_id AS left_id, b.task_id AS right_id, count(*) AS shared, round(sum(1 / a.rank + 1 / b.rank), 6) AS score, bool_and(a.group_id = b.group_id) AS same_group
    FROM {edges} a JOIN {edges} b ON a.url = b.url AND a.task_id < b.task_id GROUP BY a.task_id, b.task_id)"""


@query("A1_best_rank", "SELECT domain, task_id, min(rank) AS rank FROM {edges} GROUP BY domain, task_id")
def a1(s: Source):
    return graph.best_rank(s.edges.select("domain", "task_id", "rank"), ["domain", "task_id"])


@query("J5_co_ranked", f"WITH {_PAIRS} SELECT left_id, right_id, shared, score, same_group, shared / 10 AS overlap FROM p")
def j5(s: Source):
    return graph.co_ranked(s.edges)


@query(
    "J5_co_ranked_parts",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS task_id, l_partkey AS url FROM lineitem)
    SELECT a.task_id AS left_id, b.task_id AS right_id, count(*) AS shared FROM e a JOIN e b ON a.url = b.url AND a.task_id < b.task_id GROUP BY a.task_id, b.task_id""",
)
def j5v(s: Source):
    e = s.lineitem.select(F.col("l_suppkey").alias("task_id"), F.col("l_partkey").alias("url")).distinct().withColumns({"rank": F.lit(1), "group_id": F.lit(0)})
    return graph.shared_results(e, 10, ["shared"])


@query("A2_page_coverage", "SELECT url, count(DISTINCT task_id) AS keyword_count, count(DISTINCT group_id) AS group_count, min(rank) AS best_rank, round(sum(1 / rank), 6) AS visibility, arg_min(keyword, rank * 1000000 + task_id) AS top_keyword FROM {edges} GROUP BY url")
def a2(s: Source):
    return graph.page_coverage(s.edges)


@query("A3_domain_coverage", "SELECT domain, count(DISTINCT url) AS page_count, count(DISTINCT task_id) AS keyword_count, count(DISTINCT group_id) AS group_count, min(rank) AS best_rank, round(sum(1 / rank), 6) AS visibility FROM {edges} GROUP BY domain")
def a3(s: Source):
    return graph.domain_coverage(s.edges)


_SCOPED = """sc AS (SELECT 'host' AS scope, replace(domain, 'shop', 'shop') AS scope_value, keyword, rank, task_id FROM {edges} UNION ALL SELECT 'directory', domain || '/b/', keyword, rank, task_id FROM {edges} UNION ALL SELECT 'page', url, keyword, rank, task_id FROM {edges}),
    per AS (SELECT scope, scope_value, keyword, min(rank) AS rank, count(*) AS n, min(task_id) AS task FROM sc GROUP BY ALL)"""


@query("A4_ranked_keyword_index", f"WITH {_SCOPED} SELECT scope, scope_value, count(*) AS keyword_count, CAST(sum(n) AS BIGINT) AS observations, min(rank) AS best_rank, arg_min(keyword, rank * 1000000 + task) AS top_keyword FROM per GROUP BY scope, scope_value")
def a4(s: Source):
    return graph.ranked_keyword_index(sets.scopes(s.edges, "url"))


@query("A4_scope_rollup", "SELECT site_id, domain, CAST(grouping(site_id, domain) AS BIGINT) AS level, count(*) AS observations, min(rank) AS best_rank FROM {edges} GROUP BY ROLLUP (site_id, domain)")
def a4r(s: Source):
    return graph.scope_rollup(s.edges)


@query(
    "A5_site_directory",
    """
    WITH e AS (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM {edges}),
    f AS (SELECT e.*, CASE WHEN domain = 'shop6.example' AND path IN (SELECT path FROM e WHERE domain = 'shop1.example') THEN 'shop1.example' ELSE domain END AS site_domain FROM e)
    SELECT site_domain, count(DISTINCT keyword) AS keywords, count(DISTINCT url) AS pages, count(DISTINCT group_id) AS groups, min(rank) AS best_rank, count(DISTINCT domain) AS domains FROM f GROUP BY site_domain""",
)
def a5(s: Source):
    return graph.site_directory(s.edges, s.sql("SELECT DISTINCT 'shop6.example' AS alias_domain, 'shop1.example' AS target FROM {edges} WHERE domain = 'shop6.example'"))


_BRAND = "SELECT *, split_part(title, ' · ', 2) AS brand FROM {edges}"


@query("A6_brand_occupancy", f"WITH b AS ({_BRAND}) SELECT brand, count(*) AS observations, count(DISTINCT task_id) AS tasks, count(DISTINCT group_id) AS groups, count(DISTINCT domain) AS domains, min(rank) AS best_rank, count(CASE WHEN rank <= 3 THEN 1 END) AS top3, round(sum(1 / rank), 6) AS visibility, CASE WHEN count(DISTINCT domain) > 1 THEN 'multi_domain_review' ELSE 'single_domain' END AS review FROM b GROUP BY brand")
def a6(s: Source):
    return graph.brand_occupancy(s.sql(_BRAND))


@query("A6_modal_name", f"WITH b AS ({_BRAND}), n AS (SELECT domain, brand, count(*) AS n FROM b GROUP BY domain, brand) SELECT domain, brand AS display_name, n FROM n QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, brand) = 1")
def a6m(s: Source):
    return graph.modal_name(s.sql(_BRAND))


_CITES = "SELECT task_id + 1 AS task_id, url, domain FROM {edges} WHERE rank <= 4"


@query(
    "A13_J9_citation_domains",
    f"""
    WITH c AS ({_CITES}), u AS (SELECT task_id, url, min(rank) AS r FROM {{edges}} GROUP BY ALL), d AS (SELECT task_id, domain, min(rank) AS r FROM {{edges}} GROUP BY ALL)
    SELECT c.domain, count(*) AS citations, count(DISTINCT c.task_id) AS tasks, count(DISTINCT c.url) AS urls, count(u.r) AS url_overlap, count(CASE WHEN u.r IS NULL THEN d.r END) AS domain_overlap, min(coalesce(u.r, d.r)) AS best_rank, c.domain = 'shop2.example' AS own_domain
    FROM c LEFT JOIN u ON c.task_id = u.task_id AND c.url = u.url LEFT JOIN d ON c.task_id = d.task_id AND c.domain = d.domain GROUP BY c.domain""",
)
def a13(s: Source):
    return graph.citation_domains(s.sql(_CITES), s.edges, s.edges.select("domain").where("domain = 'shop2.example'").distinct())


@query(
    "G1_overlap_grades",
    """
    WITH e AS (SELECT DISTINCT task_id, url, site_id FROM {edges} WHERE rank <= 5), n AS (SELECT task_id, count(*) AS n FROM e GROUP BY task_id),
    p AS (SELECT a.task_id AS left_id, b.task_id AS right_id, bool_and(a.site_id = b.site_id) AS same_site, count(*) AS shared FROM e a JOIN e b ON a.url = b.url AND a.task_id < b.task_id GROUP BY 1, 2)
    SELECT left_id, right_id, shared, round(shared / least(x.n, y.n), 6) AS ratio, CASE WHEN NOT same_site THEN 'context_separate' WHEN least(x.n, y.n) < 5 THEN 'insufficient' WHEN shared / least(x.n, y.n) >= 0.8 THEN 'high' WHEN shared / least(x.n, y.n) >= 0.6 THEN 'possible' ELSE 'separate' END AS grade
    FROM p JOIN n x ON x.task_id = left_id JOIN n y ON y.task_id = right_id""",
)
def g1(s: Source):
    return graph.overlap_grades(s.edges)


_INTENT = """d AS (SELECT site_id, task_id, domain AS key, sum(1 / rank) AS w FROM {edges} GROUP BY ALL), dn AS (SELECT task_id, sum(w) AS total FROM d GROUP BY ALL),
    dp AS (SELECT a.task_id AS l, b.task_id AS r, sum(least(a.w, b.w)) AS low FROM d a JOIN d b ON a.site_id = b.site_id AND a.key = b.key AND a.task_id < b.task_id GROUP BY ALL),
    dj AS (SELECT l, r, low / (x.total + y.total - low) AS domain FROM dp JOIN dn x ON x.task_id = l JOIN dn y ON y.task_id = r),
    t AS (SELECT site_id, task_id, split_part(title, ' · ', 2) AS key, sum(1 / rank) AS w FROM {edges} GROUP BY ALL), tn AS (SELECT task_id, sqrt(sum(w * w)) AS norm FROM t GROUP BY ALL),
    tp AS (SELECT a.task_id AS l, b.task_id AS r, sum(a.w * b.w) AS dot FROM t a JOIN t b ON a.site_id = b.site_id AND a.key = b.key AND a.task_id < b.task_id GROUP BY ALL),
    tj AS (SELECT l, r, dot / (x.norm * y.norm) AS page_type FROM tp JOIN tn x ON x.task_id = l JOIN tn y ON y.task_id = r),
    g AS (SELECT DISTINCT site_id, task_id, unnest(list_transform(range(1, length(keyword)), lambda i: substring(keyword, CAST(i AS INT), 2))) AS key FROM {tasks}), gn AS (SELECT task_id, count(*) AS n FROM g GROUP BY ALL),
    gp AS (SELECT a.task_id AS l, b.task_id AS r, count(*) AS c FROM g a JOIN g b ON a.site_id = b.site_id AND a.key = b.key AND a.task_id < b.task_id GROUP BY ALL),
    gj AS (SELECT l, r, c / (x.n + y.n - c) AS topic FROM gp JOIN gn x ON x.task_id = l JOIN gn y ON y.task_id = r),
    fe AS (SELECT DISTINCT site_id, t.task_id, l_returnflag || CASE WHEN l_quantity > 49 THEN l_linestatus ELSE '' END || CASE WHEN l_tax > 0.075 AND l_discount > 0.095 THEN 'x' ELSE '' END AS key FROM lineitem JOIN {tasks} t ON l_suppkey = t.task_id), fn AS (SELECT task_id, count(*) AS n FROM fe GROUP BY ALL),
    fp AS (SELECT a.task_id AS l, b.task_id AS r, count(*) AS c FROM fe a JOIN fe b ON a.site_id = b.site_id AND a.key = b.key AND a.task_id < b.task_id GROUP BY ALL),
    fj AS (SELECT l, r, c / (x.n + y.n - c) AS feature FROM fp JOIN fn x ON x.task_id = l JOIN fn y ON y.task_id = r),
    m AS (SELECT site_id, t.task_id, l_returnflag || l_linestatus AS key, count(*) AS w FROM lineitem JOIN {tasks} t ON l_suppkey = t.task_id GROUP BY ALL), mn AS (SELECT task_id, sqrt(sum(w * w)) AS norm FROM m GROUP BY ALL),
    mp AS (SELECT a.task_id AS l, b.task_id AS r, sum(a.w * b.w) AS dot FROM m a JOIN m b ON a.site_id = b.site_id AND a.key = b.key AND a.task_id < b.task_id GROUP BY ALL),
    mj AS (SELECT l, r, dot / (x.norm * y.norm) AS demand FROM mp JOIN mn x ON x.task_id = l JOIN mn y ON y.task_id = r),
    sg AS (SELECT a.task_id AS l, b.task_id AS r FROM {tasks} a JOIN {tasks} b ON a.site_id = b.site_id AND a.group_id = b.group_id AND a.task_id < b.task_id),
    k AS (SELECT a.task_id AS l, b.task_id AS r FROM {tasks} a JOIN {tasks} b ON a.site_id = b.site_id AND a.task_id < b.task_id),
    i AS (SELECT * FROM (SELECT k.l AS left_id, k.r AS right_id, sg.l IS NOT NULL AS same_group, coalesce(domain, 0) AS domain, coalesce(topic, 0) AS topic, round(0.35 * coalesce(domain, 0) + 0.25 * coalesce(page_type, 0) + 0.15 * coalesce(feature, 0) + 0.15 * coalesce(demand, 0) + 0.1 * coalesce(topic, 0), 6) AS score
          FROM k LEFT JOIN dj ON k.l = dj.l AND k.r = dj.r LEFT JOIN tj ON k.l = tj.l AND k.r = tj.r LEFT JOIN gj ON k.l = gj.l AND k.r = gj.r LEFT JOIN fj ON k.l = fj.l AND k.r = fj.r LEFT JOIN mj ON k.l = mj.l AND k.r = mj.r LEFT JOIN sg ON k.l = sg.l AND k.r = sg.r) z WHERE same_group OR score >= 0.38)"""


def _parts(s: Source):
    domains = s.edges.select("site_id", "task_id", F.col("domain").alias("key"), (1 / F.col("rank")).alias("weight"))
    types = s.edges.select("site_id", "task_id", F.split("title", " · ")[1].alias("key"), (1 / F.col("rank")).alias("weight"))
    topics = s.tasks.select("site_id", "task_id", F.explode(grams(F.col("keyword"))).alias("key"), F.lit(1.0).alias("weight"))
    lines = s.lineitem.join(s.tasks, F.col("l_suppkey") == F.col("task_id"))
    feature = F.concat("l_returnflag", F.when(F.col("l_quantity") > 49, F.col("l_linestatus")).otherwise(""), F.when((F.col("l_tax") > 0.075) & (F.col("l_discount") > 0.095), "x").otherwise(""))
    features = lines.select("site_id", "task_id", feature.alias("key")).distinct().withColumn("weight", F.lit(1.0))
    demands = lines.groupBy("site_id", "task_id", F.concat("l_returnflag", "l_linestatus").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return s.tasks, domains, types, features, demands, topics


def _evidence(s: Source, *depths: int, marked: bool = False):
    return graph.evidence(s.edges, graph.profiles(*_parts(s)), depths, marked=marked)


_DECIDED = "CASE WHEN same_group AND score < 0.38 THEN 'split_review' WHEN NOT same_group AND score >= 0.62 AND domain >= 0.3 AND topic >= 0.25 THEN 'merge_review' ELSE 'related_intent' END"


@query("G8_J6_intent_pairs", f"WITH {_INTENT} SELECT left_id, right_id, same_group, score, {_DECIDED} AS decision, {_DECIDED} <> 'related_intent' AS review_required FROM i")
def g8(s: Source):
    return graph.intent_pairs(*_parts(s))


@query(
    "G9_J7_boundary_consensus",
    f"""
    WITH {_INTENT}, {_PAIRS}, seen AS (SELECT DISTINCT task_id FROM {{edges}}),
    sides AS (SELECT coalesce(p.left_id, i.left_id) AS left_id, coalesce(p.right_id, i.right_id) AS right_id, p.shared / 10 AS u, i.score AS s, coalesce(i.same_group, p.same_group, false) AS g FROM p FULL JOIN i ON p.left_id = i.left_id AND p.right_id = i.right_id),
    judged AS (SELECT k.left_id, k.right_id, coalesce(u, CASE WHEN a.task_id IS NOT NULL AND b.task_id IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS u, s, g FROM sides k LEFT JOIN seen a ON a.task_id = k.left_id LEFT JOIN seen b ON b.task_id = k.right_id)
    SELECT left_id, right_id, u AS url_overlap, s AS score, CASE WHEN u IS NULL THEN 'insufficient_url_evidence_review' WHEN g AND u < 0.3 AND s < 0.38 THEN 'split_consensus_review' WHEN g THEN 'current_group_boundary_review'
        WHEN u >= 0.6 AND s >= 0.62 THEN 'merge_consensus_review' WHEN u >= 0.6 THEN 'url_only_merge_review' WHEN u >= 0.3 AND s >= 0.62 THEN 'merge_signal_conflict_review' WHEN s >= 0.62 THEN 'semantic_adjacency_review' ELSE 'internal_link_boundary_review' END AS decision FROM judged""",
)
def g9(s: Source):
    return graph.boundaries(_evidence(s)).select("left_id", "right_id", "url_overlap", "score", "decision")


_DEPTH = """depth_q AS (SELECT a.task_id AS left_id, b.task_id AS right_id, min(a.group_id) AS left_group, min(b.group_id) AS right_group, count(CASE WHEN greatest(a.rank, b.rank) <= 3 THEN 1 END) / 3 AS ratio_3, count(CASE WHEN greatest(a.rank, b.rank) <= 5 THEN 1 END) / 5 AS ratio_5, count(*) / 10 AS ratio_10 FROM {edges} a JOIN {edges} b ON a.url = b.url AND a.task_id < b.task_id GROUP BY 1, 2),
    depth_c AS (SELECT *, CASE WHEN ratio_3 >= 0.6 THEN 'merge' WHEN ratio_3 >= 0.3 THEN 'related' ELSE 'separate' END AS class_3, CASE WHEN ratio_5 >= 0.6 THEN 'merge' WHEN ratio_5 >= 0.3 THEN 'related' ELSE 'separate' END AS class_5, CASE WHEN ratio_10 >= 0.6 THEN 'merge' WHEN ratio_10 >= 0.3 THEN 'related' ELSE 'separate' END AS class_10 FROM depth_q),
    st AS (SELECT *, CASE WHEN class_3 = class_5 AND class_5 = class_10 THEN 'stable_' || class_3 ELSE 'threshold_flip' END AS state FROM depth_c)"""


@query("G10_depth_stability", f"WITH {_DEPTH} SELECT left_id, right_id, ratio_3, ratio_5, ratio_10, class_3, class_5, class_10, state FROM st")
def g10(s: Source):
    return graph.depth_stability(s.edges)


_DECIDED_I = _DECIDED.replace("same_group", "i.same_group").replace("score", "i.score").replace("domain", "i.domain").replace("topic", "i.topic")
_REVIEWED = f"""{_INTENT}, {_PAIRS}, seen AS (SELECT DISTINCT task_id FROM {{edges}} WHERE rank BETWEEN 1 AND 10),
    sides AS (SELECT coalesce(p.left_id, i.left_id) AS left_id, coalesce(p.right_id, i.right_id) AS right_id, p.shared / 10 AS u, i.score AS s, coalesce(i.same_group, p.same_group, false) AS g
        FROM p FULL JOIN i ON p.left_id = i.left_id AND p.right_id = i.right_id WHERE coalesce(p.shared >= 6 AND NOT p.same_group, false) OR coalesce({_DECIDED_I} <> 'related_intent', false)),
    judged AS (SELECT k.left_id, k.right_id, coalesce(u, CASE WHEN a.task_id IS NOT NULL AND b.task_id IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS u, s, g FROM sides k LEFT JOIN seen a ON a.task_id = k.left_id LEFT JOIN seen b ON b.task_id = k.right_id),
    bound AS (SELECT left_id, right_id, u AS url_overlap, s AS score, CASE WHEN u IS NULL THEN 'insufficient_url_evidence_review' WHEN g AND u < 0.3 AND s < 0.38 THEN 'split_consensus_review' WHEN g THEN 'current_group_boundary_review'
        WHEN u >= 0.6 AND s >= 0.62 THEN 'merge_consensus_review' WHEN u >= 0.6 THEN 'url_only_merge_review' WHEN u >= 0.3 AND s >= 0.62 THEN 'merge_signal_conflict_review' WHEN s >= 0.62 THEN 'semantic_adjacency_review' ELSE 'internal_link_boundary_review' END AS decision FROM judged)"""


def _reviewed(s: Source, *depths: int):
    return graph.boundaries(_evidence(s, *depths, marked=True))


@query("G9_reviewed_boundaries", f"WITH {_REVIEWED} SELECT * FROM bound")
def g9r(s: Source):
    return _reviewed(s).select("left_id", "right_id", "url_overlap", "score", "decision")


@query(
    "G10_boundary_stability",
    f"""WITH {_DEPTH}, {_REVIEWED} SELECT b.left_id, b.right_id, decision, coalesce(ratio_3, 0) AS ratio_3, coalesce(ratio_5, 0) AS ratio_5, coalesce(ratio_10, 0) AS ratio_10, coalesce(class_3, 'separate') AS class_3, coalesce(class_5, 'separate') AS class_5, coalesce(class_10, 'separate') AS class_10,
    coalesce(state, 'stable_separate') AS state, coalesce(least(ratio_3, ratio_5, ratio_10), 0) AS least_ratio, coalesce(greatest(ratio_3, ratio_5, ratio_10), 0) AS greatest_ratio, coalesce(state = 'stable_merge' AND decision = 'merge_consensus_review', false) AS robust_merge
    FROM bound b LEFT JOIN st ON b.left_id = st.left_id AND b.right_id = st.right_id""",
)
def g10b(s: Source):
    depths = (3, 5, 10)
    judged = graph.depth_states(_reviewed(s, *depths), depths)
    return graph.robust_merges(judged).select("left_id", "right_id", "decision", *(f"{n}_{d}" for n in ("ratio", "class") for d in depths), "state", "least_ratio", "greatest_ratio", "robust_merge")


@query(
    "G11_topology",
    f"""
    WITH {_DEPTH}, {_INTENT}, told AS (SELECT least(left_group, right_group) AS left_group, greatest(left_group, right_group) AS right_group, state, state = 'stable_merge' AND coalesce(i.score >= 0.62, false) AS robust FROM st LEFT JOIN i ON i.left_id = st.left_id AND i.right_id = st.right_id)
    SELECT left_group, right_group, count(*) AS pairs, CASE WHEN bool_or(robust) THEN 'consolidation_review' WHEN bool_or(state = 'threshold_flip') THEN 'depth_sensitive_hold'
        WHEN bool_and(state = 'stable_related') THEN CASE WHEN left_group = right_group THEN 'retain_group_review' ELSE 'sibling_article_link_review' END
        WHEN bool_and(state = 'stable_separate') THEN CASE WHEN left_group = right_group THEN 'split_group_review' ELSE 'retain_separate' END ELSE 'mixed_stability_review' END AS topology FROM told GROUP BY 1, 2""",
)
def g11(s: Source):
    return graph.topology_of(s.edges, graph.profiles(*_parts(s)))


_SIM = """d AS (SELECT domain, keyword, min(rank) AS rank FROM {edges} GROUP BY ALL), n AS (SELECT domain, count(*) AS n FROM d GROUP BY ALL),
    sp AS (SELECT a.domain, b.domain AS neighbour, count(*) AS shared, round(sum(2 / (a.rank + b.rank)), 6) AS rank_score FROM d a JOIN d b ON a.keyword = b.keyword AND a.domain <> b.domain GROUP BY ALL),
    sim AS (SELECT sp.*, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM sp JOIN n x ON x.domain = sp.domain JOIN n y ON y.domain = sp.neighbour)"""


@query("G12_site_similarity", f"WITH {_SIM} SELECT domain, neighbour, shared, jaccard, rank_score, row_number() OVER (PARTITION BY domain ORDER BY jaccard DESC, rank_score DESC, neighbour) AS position FROM sim QUALIFY position <= 20")
def g12(s: Source):
    return graph.site_similarity(s.edges)


@query(
    "G13_domain_competition",
    """
    WITH d AS (SELECT DISTINCT domain, keyword FROM {edges}), o AS (SELECT keyword FROM d WHERE domain = 'shop3.example'), c AS (SELECT domain, count(*) AS n, count(o.keyword) AS dup FROM d LEFT JOIN o ON d.keyword = o.keyword WHERE domain <> 'shop3.example' GROUP BY domain)
    SELECT domain, dup AS duplicates, n - dup AS theirs_only, (SELECT count(*) FROM o) - dup AS ours_only, round(dup / (n + (SELECT count(*) FROM o) - dup), 6) AS jaccard, round(dup / n, 6) AS duplicate_rate FROM c""",
)
def g13(s: Source):
    return graph.domain_competition(s.edges, "shop3.example")


_OPP = f"""{_SIM}, op AS (SELECT d.keyword, count(*) AS neighbours, min(d.rank) AS best_rank, round(sum((1 / d.rank) * (1 + jaccard)), 6) AS score FROM d JOIN sim ON sim.domain = 'shop3.example' AND sim.neighbour = d.domain
    WHERE d.keyword NOT IN (SELECT keyword FROM d WHERE domain = 'shop3.example') GROUP BY d.keyword)"""


@query("G14_keyword_opportunities", f"WITH {_OPP} SELECT keyword, neighbours, best_rank, score FROM op")
def g14(s: Source):
    return graph.keyword_opportunities(s.edges, graph.site_similarity(s.edges), "shop3.example")


@query("G15_route_opportunities", f"WITH {_OPP}, g AS (SELECT keyword, group_id, task_id % 3 = 0 AS has_article FROM {{tasks}} WHERE group_id <> 3) SELECT op.keyword, score, CASE WHEN group_id IS NULL THEN 'boundary_review' WHEN has_article THEN 'article_expansion' ELSE 'new_article' END AS route, round(score * (1 + log2(1 + neighbours)), 6) AS priority FROM op LEFT JOIN g ON op.keyword = g.keyword")
def g15(s: Source):
    groups = s.tasks.where("group_id <> 3").select("keyword", "group_id", (F.col("task_id") % 3 == 0).alias("has_article"))
    return graph.route_opportunities(graph.keyword_opportunities(s.edges, graph.site_similarity(s.edges), "shop3.example"), groups)


_GATE = "SELECT t.task_id, CASE WHEN t.task_id % 4 = 0 THEN NULL ELSE t.group_id END AS article_id, t.task_id % 5 = 0 AS query_covered, x.n / 10 AS coverage FROM {tasks} t JOIN (SELECT task_id, count(DISTINCT domain) AS n FROM {edges} GROUP BY task_id) x ON t.task_id = x.task_id"


@query("G16_coverage_gate", f"SELECT *, CASE WHEN article_id IS NULL THEN 'no_article' WHEN query_covered THEN 'query_covered' WHEN coverage >= 0.5 + 0.3 THEN 'content_covered' ELSE 'partial' END AS gate FROM ({_GATE}) g")
def g16(s: Source):
    return graph.coverage_gate(s.sql(_GATE))


_LINKS = "SELECT DISTINCT group_id AS source_group, group_id + 1 AS target_group FROM {tasks}"


@query("G24_J4_internal_links", f"WITH g AS (SELECT group_id, url, min(rank) AS rank FROM {{edges}} GROUP BY ALL) SELECT a.group_id AS source_group, b.group_id AS target_group, count(*) AS shared, round(10 * count(*) + sum(1 / a.rank + 1 / b.rank), 6) AS score FROM g a JOIN g b ON a.url = b.url AND a.group_id <> b.group_id WHERE (a.group_id, b.group_id) NOT IN (SELECT (source_group, target_group) FROM ({_LINKS}) l) GROUP BY 1, 2")
def g24(s: Source):
    return graph.internal_links(s.edges, s.sql(_LINKS))


_TYPED = "SELECT DISTINCT p_name AS source, p_brand AS target, p_type AS type FROM {part}"


@query(
    "G18_traverse",
    f"""
    WITH e AS ({_TYPED}), both_ways AS (SELECT source, target, type, 'forward' AS direction FROM e UNION ALL SELECT target, source, type, 'inverse' FROM e),
    s1 AS (SELECT * FROM both_ways WHERE source = 'small ring'), s2 AS (SELECT * FROM both_ways WHERE source IN (SELECT target FROM s1))
    SELECT source, target, type, direction, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT *, 1 AS depth FROM s1 UNION ALL SELECT *, 2 FROM s2) x GROUP BY ALL""",
)
def g18(s: Source):
    e = s.sql(_TYPED)
    return graph.traverse(e, e.where("source = 'small ring'").select(F.col("source").alias("node")), 2)


@query("G21_question_graph", "WITH e AS (SELECT DISTINCT p_name AS seed, p_brand AS question FROM part UNION SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 5), n AS (SELECT seed AS node FROM e UNION SELECT question FROM e), o AS (SELECT seed, count(*) AS c FROM e GROUP BY 1), i AS (SELECT question, count(*) AS c FROM e GROUP BY 1) SELECT node, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree, coalesce(i.c, 0) = 0 AS is_root, coalesce(i.c, 0) > 1 AS multi_parent FROM n LEFT JOIN o ON node = seed LEFT JOIN i ON node = question")
def g21(s: Source):
    e = s.part.select(F.col("p_name").alias("seed"), F.col("p_brand").alias("question")).unionByName(s.part.where("p_size < 5").select(F.col("p_brand").alias("seed"), F.col("p_type").alias("question")))
    return graph.question_graph(e)


#: A customer leads to another one of the same eight; every third customer to two.
_ASKED = """SELECT k AS task_id, concat(CASE WHEN k % 5 = 0 THEN ' Q' ELSE 'q' END, CAST(b + k % 8 AS STRING), '?') AS seed_question, concat('q', CAST(b + n % 8 AS STRING), CASE WHEN k % 7 = 0 THEN ' ?' ELSE '?' END) AS question
    FROM (SELECT c_custkey AS k, c_custkey - c_custkey % 8 AS b, c_nationkey AS n FROM {customer}) c
    UNION ALL SELECT k, CASE WHEN k % 4 = 0 THEN NULL ELSE concat('q', CAST(b + k % 8 AS STRING), '?') END, concat('Q', CAST(b + (n * 3 + 1) % 8 AS STRING), '?') FROM (SELECT c_custkey AS k, c_custkey - c_custkey % 8 AS b, c_nationkey AS n FROM {customer} WHERE c_custkey % 3 = 0) d"""

_ASKED_GRAPH = f"""q AS (SELECT task_id, nullif(trim(regexp_replace(lower(trim(seed_question)), '\\s+', ' ', 'g')), '') AS parent, trim(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g')) AS child FROM ({_ASKED}) a),
    e AS (SELECT parent, child, count(*) AS occurrences, count(DISTINCT task_id) AS tasks FROM q WHERE parent <> child GROUP BY ALL),
    r AS (SELECT parent AS a, child AS b FROM e UNION SELECT r.a, e.child FROM r JOIN e ON r.b = e.parent),
    i AS (SELECT child AS node, count(*) AS n FROM e GROUP BY 1), o AS (SELECT parent AS node, count(*) AS n FROM e GROUP BY 1), c AS (SELECT child AS node, count(*) AS n FROM q GROUP BY 1), z AS (SELECT a AS node FROM r WHERE a = b),
    d AS (SELECT parent AS node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON d.node = e.parent WHERE d.depth < 8),
    m AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY 1),
    g AS (SELECT a.node, coalesce(c.n, 0) AS occurrences, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, CASE WHEN i.n IS NULL THEN 0 ELSE m.depth END AS depth, z.node IS NOT NULL AS cycle_detected
        FROM (SELECT node FROM c UNION SELECT node FROM o UNION SELECT node FROM i) a LEFT JOIN c ON a.node = c.node LEFT JOIN o ON a.node = o.node LEFT JOIN i ON a.node = i.node LEFT JOIN m ON a.node = m.node LEFT JOIN z ON a.node = z.node)"""


@query("G21_question_hierarchy", f"WITH RECURSIVE {_ASKED_GRAPH} SELECT *, CASE WHEN depth > 0 AND NOT cycle_detected AND in_degree < 2 THEN 'eligible_for_editor_review' ELSE 'blocked_hierarchy_review' END AS heading_candidate_state FROM g")
def g21h(s: Source):
    return hierarchy.question_hierarchy(s.sql(_ASKED))[0]


@query("G21_question_edges", f"WITH RECURSIVE {_ASKED_GRAPH} SELECT parent, child, e.occurrences, tasks, p.cycle_detected OR k.cycle_detected OR k.in_degree > 1 AS review_required FROM e JOIN g p ON parent = p.node JOIN g k ON child = k.node")
def g21e(s: Source):
    return hierarchy.question_hierarchy(s.sql(_ASKED))[1]


#: A customer is a keyword group, its orders are occurrences; below depth 1 their seeds are values of others.
_WISHED = """SELECT task_id % 3 AS site_id, task_id AS group_id, occurrence_id, task_id, demand_type AS source_keyword, CASE WHEN occurrence_id % 9 = 0 THEN NULL WHEN occurrence_id % 11 = 0 THEN '' ELSE concat('p', CAST(occurrence_id % 7 AS STRING)) END AS seed_value,
    CASE WHEN occurrence_id % 13 = 0 THEN NULL ELSE concat('P', CAST((occurrence_id * 3 + 1) % 5 AS STRING)) END AS value, demand_type, occurrence_order, depth FROM {demands}"""

_WISHED_GRAPH = f"""x AS (SELECT *, greatest(depth, 1) AS d, nullif(seed_value, '') AS seed FROM ({_WISHED}) w),
    y AS (SELECT site_id, group_id, occurrence_id, demand_type, d, CASE WHEN d > 1 AND seed IS NOT NULL THEN 'demand:' || seed ELSE 'seed' END AS parent, 'demand:' || lower(value) AS child, CASE WHEN d > 1 AND seed IS NOT NULL THEN d - 1 ELSE 0 END AS pd FROM x WHERE d <= 2 AND value IS NOT NULL),
    e AS (SELECT DISTINCT site_id, group_id, parent, child FROM y),
    r AS (SELECT group_id, parent AS a, child AS b FROM e UNION SELECT r.group_id, r.a, e.child FROM r JOIN e ON r.group_id = e.group_id AND r.b = e.parent),
    n AS (SELECT site_id, group_id, node, min(depth) AS depth, count(DISTINCT occurrence_id) AS occurrences FROM (SELECT site_id, group_id, parent AS node, pd AS depth, occurrence_id FROM y UNION ALL SELECT site_id, group_id, child, d, occurrence_id FROM y) u GROUP BY ALL),
    i AS (SELECT group_id, child AS node, count(*) AS parents FROM e GROUP BY ALL), o AS (SELECT group_id, parent AS node, count(*) AS children FROM e GROUP BY ALL), z AS (SELECT group_id, a AS node FROM r WHERE a = b)"""


@query(
    "G22_demand_nodes",
    f"""WITH RECURSIVE {_WISHED_GRAPH} SELECT n.*, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children, z.node IS NOT NULL AS cycle_detected, coalesce(parents, 0) > 1 AS multi_parent, CASE WHEN z.node IS NOT NULL OR parents > 1 THEN 'review_required' ELSE 'observed_path' END AS review_state
    FROM n LEFT JOIN i ON n.group_id = i.group_id AND n.node = i.node LEFT JOIN o ON n.group_id = o.group_id AND n.node = o.node LEFT JOIN z ON n.group_id = z.group_id AND n.node = z.node""",
)
def g22n(s: Source):
    return hierarchy.demand_traversal(s.sql(_WISHED), 2)[0].drop("first")


@query("G22_demand_edges", f"WITH RECURSIVE {_WISHED_GRAPH} SELECT site_id, group_id, parent, child, demand_type, min(d) AS depth, count(DISTINCT occurrence_id) AS occurrences FROM y GROUP BY ALL")
def g22e(s: Source):
    return hierarchy.demand_traversal(s.sql(_WISHED), 2)[1].drop("first")


@query("G22_visiting_orders")
def g22v(s: Source):
    return hierarchy.visiting_orders(*hierarchy.demand_traversal(s.sql(_WISHED), 2), 2).withColumn("path", F.array_join("path", " > "))


@query("G22_first_divergence")
def g22f(s: Source):
    return hierarchy.first_divergence(hierarchy.visiting_orders(*hierarchy.demand_traversal(s.sql(_WISHED), 2), 2))


@query(
    "G18_paths",
    """
    WITH few AS (SELECT * FROM (SELECT p_name AS node, p_partkey AS w FROM part WHERE p_name LIKE '%small%' ORDER BY length(p_name), p_name, p_partkey LIMIT 25) x),
    st AS (SELECT node, row_number() OVER (ORDER BY min(length(node)), node) AS place FROM few GROUP BY node),
    b AS (SELECT p_partkey AS id, p_type AS kind, p_name AS s, p_brand AS t, p_name AS f, p_brand AS o, 'outgoing' AS dir FROM part UNION ALL SELECT p_partkey, p_type, p_name, p_brand, p_brand, p_name, 'incoming' FROM part),
    l1 AS (SELECT * FROM (SELECT b.*, row_number() OVER (ORDER BY place, kind, s, t, id, dir) AS n, node || ' > ' || o AS path, CAST(id AS STRING) AS ids FROM b JOIN st ON f = node) x WHERE n <= 2000),
    f2 AS (SELECT o AS node, min(n) AS place, min_by(path, n) AS path, min_by(ids, n) AS ids FROM l1 WHERE o NOT IN (SELECT node FROM st) GROUP BY o),
    l2 AS (SELECT * FROM (SELECT b.*, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY place, kind, s, t, id, dir) AS n, path || ' > ' || o AS path, ids || ' > ' || CAST(id AS STRING) AS ids FROM b JOIN f2 ON f = node) x WHERE n <= 2000),
    a AS (SELECT *, 1::BIGINT AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2)
    SELECT id AS relation_id, kind AS relation_type, depth, dir AS direction, CASE dir WHEN 'outgoing' THEN kind ELSE kind || '_inverse' END AS traversal_type, f AS from_node, o AS to_node, path, ids AS relations, n AS visit_order, (SELECT count(*) FROM a) >= 2000 AS truncated FROM a""",
)
def g18p(s: Source):
    start = typed_graph.seeds(s.part.select(F.col("p_name").alias("node"), F.col("p_partkey").alias("word_id"), F.col("p_name").alias("term")), "small")
    r = s.part.select(F.col("p_partkey").alias("relation_id"), F.col("p_type").alias("relation_type"), F.col("p_name").alias("source"), F.col("p_brand").alias("target"))
    out = typed_graph.traverse(r, start, 2, most=2000)
    return out.select("relation_id", "relation_type", "depth", "direction", "traversal_type", "from_node", "to_node", F.array_join("path_nodes", " > ").alias("path"), F.array_join("path_relations", " > ").alias("relations"), "visit_order", "truncated")
