"""Queries of candidates, plans, queues and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import rules
from quaystone.functions.text import GENERIC
from quaystone.operators import demand, graph, matching, review
from quaystone.plans.catalog import Source, query
from quaystone.plans.q_content import _TOPOLOGY
from quaystone.plans.q_text import _KINDS, _TYPED


@query("J11_combine", "SELECT source_keyword_id, raw_keyword || ' ' || w AS combined FROM {keywords}, (VALUES ('price'), ('review'), ('shop')) v(w)")
def j11(s: Source):
    return review.combine(s.keywords, ["price", "review", "shop"], "raw_keyword").select("source_keyword_id", "combined")


_TP = "SELECT source_keyword_id AS topic_id, size AS group_id, raw_keyword AS topic, coalesce(volume, 0) AS priority, 'small ring' AS main_keyword FROM {keywords}"


@query("M6_structure_candidates", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority DESC, topic_id) AS n FROM ({_TP}) x QUALIFY n <= 8) SELECT group_id, string_agg(topic, ' | ' ORDER BY n) AS headings, string_agg(topic, ' / ' ORDER BY n) FILTER (n <= 2) AS title_topics FROM t GROUP BY 1")
def m6(s: Source):
    return review.structure_candidates(s.sql(_TP))


_EL = "SELECT article_id * 2 AS element_id, CASE WHEN article_id % 6 = 0 THEN -1 ELSE article_id END AS article_id, split_part(CASE WHEN article_id % 2 = 0 THEN title ELSE heading END, ' ', 2) AS text FROM {articles}"
_K = "regexp_replace(lower({0}), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')"


@query("M8_element_coverage", f"WITH e AS ({_EL}) SELECT element_id, CASE WHEN a.title IS NULL THEN 'unassigned' WHEN contains({_K.format('a.title')}, {_K.format('e.text')}) THEN 'covered_title' WHEN contains({_K.format('a.heading')}, {_K.format('e.text')}) THEN 'covered_heading' ELSE 'missing' END AS coverage FROM e LEFT JOIN {{articles}} a ON e.article_id = a.article_id")
def m8(s: Source):
    return review.element_coverage(s.sql(_EL), s.articles)


_TG = "SELECT split_part(lower(title), ' ', 1) AS tag, article_id FROM {articles} UNION ALL SELECT split_part(lower(title), ' ', 1), article_id + 1 FROM {articles} WHERE article_id % 2 = 0"


@query("M9_tag_coverage", f"WITH t AS ({_TG}), j AS (SELECT tag, lower(title || ' ' || heading) AS x FROM t JOIN {{articles}} a ON t.article_id = a.article_id WHERE tag <> ''), g AS (SELECT tag, count(*) AS articles, count(CASE WHEN contains(x, '#' || tag) THEN 1 END) AS marked, count(CASE WHEN contains(x, tag) THEN 1 END) AS as_term FROM j GROUP BY tag) SELECT *, CASE WHEN marked = articles THEN 'none' WHEN as_term = articles THEN 'mark_tag' WHEN as_term > 0 THEN 'extend_coverage' ELSE 'review_relevance' END AS action FROM g")
def m9(s: Source):
    t = s.sql(_TG).where("tag <> ''").groupBy("tag").agg(F.collect_list("article_id").alias("article_ids"))
    return review.tag_coverage(t, s.articles)


_QU = "SELECT size AS group_id, source_keyword_id AS position, CASE WHEN source_keyword_id % 2 = 0 THEN raw_keyword ELSE concat(upper(raw_keyword), '?') END AS question FROM {keywords}"


@query("M10_question_candidates", f"WITH q AS (SELECT *, {_K.format('question')} AS k FROM ({_QU}) x), o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY group_id, k ORDER BY position) = 1) SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY position) AS rank, question FROM o QUALIFY rank <= 12")
def m10(s: Source):
    return review.question_candidates(s.sql(_QU))


@query("M11_generation_candidates", f"WITH t AS ({_TP}) SELECT topic_id, group_id, 'title' AS content_type, main_keyword || ': ' || topic AS text FROM t UNION ALL SELECT topic_id, group_id, 'heading', topic FROM t UNION ALL SELECT topic_id, group_id, 'question', 'What is ' || topic || '?' FROM t")
def m11(s: Source):
    return review.generation_candidates(s.sql(_TP))


_CA = """SELECT article_id AS candidate_id, lower(split_part(title, ' ', 1)) AS group_id, split_part(title, ' ', CASE WHEN article_id % 3 = 0 THEN 1 ELSE 2 END) AS main_keyword, CASE WHEN article_id % 3 = 0 THEN 'title' ELSE 'heading' END AS content_type,
    CASE article_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS heading_level, CASE WHEN article_id % 3 = 0 THEN concat(title, CASE WHEN article_id % 6 = 0 THEN '|' ELSE ' ' END, heading) ELSE heading END AS text,
    CASE article_id % 4 WHEN 0 THEN 'competitor_term' WHEN 1 THEN 'serp_feature_item' ELSE 'serp_demand' END AS evidence_type, CASE WHEN article_id % 7 = 0 THEN NULL ELSE split(concat(CAST(article_id AS STRING), ',', CAST(article_id % 50 AS STRING)), ',') END AS evidence_ids, article_id % 5 AS axes FROM {articles}"""
_RI = "SELECT lower(split_part(title, ' ', 1)) AS group_id, CASE WHEN article_id % 4 = 0 THEN concat(title, ' more') ELSE heading END AS text FROM {articles}"
_OLD = "SELECT concat(heading, CASE WHEN article_id % 5 = 0 THEN '' ELSE '!x' END) AS text FROM {articles}"
_KNOWN = "SELECT 'serp_demand' AS evidence_type, CAST(article_id AS STRING) AS evidence_id, CASE WHEN article_id % 2 = 0 THEN heading ELSE concat(heading, ' review price costs') END AS topic FROM {articles} UNION ALL SELECT 'competitor_term', CAST(article_id AS STRING), NULL FROM {articles} WHERE article_id % 8 <> 0 UNION ALL SELECT 'serp_feature_item', CAST(article_id AS STRING), NULL FROM {articles} WHERE article_id % 3 <> 0"
_T3 = "CASE WHEN length(k) < 1 THEN CAST([] AS VARCHAR[]) WHEN length(k) < 3 THEN [k] ELSE list_distinct(list_transform(range(1, length(k) - 1), lambda i: substring(k, CAST(i AS INT), 3))) END"
_GENERIC = ", ".join(f"'{t}'" for t in GENERIC)
#: The issues in SQL, in the order of the operator.
_ISSUES = {
    "evidence_missing": "evidence_ids IS NULL",
    "evidence_reference_unresolved": "evidence_ids IS NOT NULL AND NOT resolved",
    "serp_feature_observation_review": "evidence_type = 'serp_feature_item'",
    "main_keyword_missing": "ti AND m <> '' AND NOT contains(c.k, m)",
    "title_length_review": "ti AND (length(text) < 20 OR length(text) > 50)",
    "title_segment_redundancy": "ti AND red",
    "heading_length_review": "NOT ti AND (length(text) < 4 OR length(text) > 45)",
    "orphan_h3": "heading_level = 3 AND h2.group_id IS NULL",
    "candidate_duplicate": "own > 1",
    "cross_group_candidate_duplicate": "allc > 1",
    "evidence_text_not_covered": "cov < 0.6",
    "existing_content_collision": "x.k IS NOT NULL",
    "competitor_copy_risk": "sim >= 0.9",
    "competitor_similarity_review": "sim >= 0.75 AND sim < 0.9",
    "title_axis_overload": "ti AND axes > 3",
    "term_repetition_review": "len(list_filter(list_distinct(w), lambda a: len(list_filter(w, lambda b: b = a)) >= 3)) > 0",
}
_SUM = " - ".join(f"CASE WHEN {c} THEN {review.PENALTIES[k]} ELSE 0 END" for k, c in _ISSUES.items())
_LIST = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _ISSUES.items())
_BLOCK = " OR ".join(f"coalesce({_ISSUES[k]}, false)" for k in review.BLOCKERS)
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"


@query(
    "M12_review_candidates",
    f"""
    WITH c AS (SELECT *, {_T3} AS g, count(*) OVER (PARTITION BY group_id, content_type, k) AS own, count(*) OVER (PARTITION BY content_type, k) AS allc, content_type = 'title' AS ti, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda z: lower(z)) AS w,
        list_filter(list_transform(string_split(replace(text, '｜', '|'), '|'), lambda p: regexp_replace({_K.format('p')}, '(を)?解説$', '')), lambda p: length(p) >= 4) AS seg FROM (SELECT *, {_K.format('text')} AS k, {_K.format('main_keyword')} AS m FROM ({_CA}) q) q),
    sg AS (SELECT candidate_id, bool_or(contains(b.p, a.p)) AS red FROM (SELECT candidate_id, unnest(seg) AS p, generate_subscripts(seg, 1) AS i FROM c) a JOIN (SELECT candidate_id, unnest(seg) AS p, generate_subscripts(seg, 1) AS i FROM c) b USING (candidate_id) WHERE a.i <> b.i GROUP BY 1),
    r AS (SELECT DISTINCT group_id, {_T3} AS g FROM (SELECT group_id, {_K.format('text')} AS k FROM ({_RI}) q) q), s AS (SELECT candidate_id, max(len(list_intersect(c.g, r.g)) / (len(c.g) + len(r.g) - len(list_intersect(c.g, r.g)))) AS sim FROM c JOIN r ON c.group_id = r.group_id WHERE len(c.g) > 0 AND len(r.g) > 0 GROUP BY 1),
    kn AS ({_KNOWN}), e1 AS (SELECT candidate_id, evidence_id, k, evidence_type FROM (SELECT *, unnest(evidence_ids) AS evidence_id FROM c) q),
    e2 AS (SELECT candidate_id, e1.evidence_id, coalesce(bool_or(kn.evidence_type = e1.evidence_type), false) AS found, max(CASE WHEN topic IS NOT NULL THEN CASE WHEN len(list_filter({_WORDS.format('topic')}, lambda t: t NOT IN ({_GENERIC}))) = 0 THEN 1 ELSE len(list_filter({_WORDS.format('topic')}, lambda t: t NOT IN ({_GENERIC}) AND contains(k, t))) / len(list_filter({_WORDS.format('topic')}, lambda t: t NOT IN ({_GENERIC}))) END END) AS share FROM e1 LEFT JOIN kn ON e1.evidence_id = kn.evidence_id GROUP BY ALL),
    e AS (SELECT candidate_id, bool_and(found) AS resolved, avg(share) AS cov FROM e2 GROUP BY 1), h2 AS (SELECT DISTINCT group_id FROM c WHERE NOT ti AND heading_level = 2), x AS (SELECT DISTINCT {_K.format('text')} AS k FROM ({_OLD}) q),
    j AS (SELECT c.candidate_id, CASE WHEN sim >= 0.75 THEN round(sim, 6) END AS similarity, concat_ws(',', {_LIST}) AS issues, CAST(greatest(0, 100 - {_SUM}) AS BIGINT) AS score, {_BLOCK} AS blocked FROM c LEFT JOIN sg ON c.candidate_id = sg.candidate_id LEFT JOIN s ON c.candidate_id = s.candidate_id LEFT JOIN e ON c.candidate_id = e.candidate_id LEFT JOIN h2 ON c.group_id = h2.group_id LEFT JOIN x ON c.k = x.k)
    SELECT candidate_id, similarity, issues, score, CASE WHEN blocked THEN 'blocked' WHEN score >= 85 THEN 'ready' ELSE 'needs_review' END AS state FROM j""",
)
def m12(s: Source):
    return review.review_candidates(s.sql(_CA), s.sql(_RI), s.sql(_OLD), s.sql(_KNOWN))


_PG = "SELECT DISTINCT lower(split_part(title, ' ', 1)) AS group_id, CASE WHEN length(split_part(title, ' ', 1)) % 7 = 0 THEN 'draft' ELSE 'outline_ready' END AS outline_status FROM {articles}"
_PT = "SELECT lower(split_part(title, ' ', 1)) AS group_id, article_id AS candidate_id, title AS text, 80 + article_id % 21 AS quality, CASE article_id % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'blocked' ELSE 'ready' END AS state, split(concat('e', CAST(article_id % 6 AS STRING), ',e', CAST(article_id % 4 AS STRING)), ',') AS evidence_ids FROM {articles}"
_PH = "SELECT lower(split_part(title, ' ', 1)) AS group_id, article_id AS candidate_id, CASE WHEN article_id % 2 = 0 THEN heading ELSE split_part(heading, ' ', 2) END AS text, 60 + article_id % 37 AS quality, CASE article_id % 9 WHEN 0 THEN 'needs_review' ELSE 'ready' END AS state, split(concat('e', CAST(article_id % 3 AS STRING), ',e', CAST(article_id % 5 AS STRING)), ',') AS evidence_ids FROM {articles}"
_PW = f"list_filter({_WORDS.format('text')}, lambda t: t NOT IN ({_GENERIC}, " + ", ".join(f"'{t}'" for t in review.BOILERPLATE) + "))"


@query(
    "M13_plan_coherence",
    f"""
    WITH t0 AS (SELECT * EXCLUDE (evidence_ids), list_distinct(evidence_ids) AS ids, {_PW} AS w, CASE state WHEN 'ready' THEN 2 ELSE 1 END AS r, abs(length(text) - 35) AS far FROM ({_PT}) q WHERE state <> 'blocked'), h AS (SELECT *, {_PW} AS w FROM ({_PH}) q),
    hs AS (SELECT group_id, list_distinct(flatten(list(evidence_ids))) AS hi, list_distinct(flatten(list(w))) AS hw, avg(quality) AS hq, count(CASE WHEN state = 'needs_review' THEN 1 END) AS op FROM h GROUP BY 1),
    t1 AS (SELECT t0.*, CASE WHEN len(ids) > 0 THEN len(list_intersect(ids, hi)) / len(ids) ELSE 0 END AS e, CASE WHEN len(w) > 0 THEN len(list_intersect(w, hw)) / len(w) ELSE 0 END AS l FROM t0 JOIN hs ON t0.group_id = hs.group_id),
    b AS (SELECT group_id, candidate_id AS bid, r AS br, quality AS bq, e AS be, l AS bl FROM t1 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY r DESC, quality DESC, len(ids) DESC, far, candidate_id) = 1),
    p AS (SELECT t1.*, bid, r = br AND quality >= greatest(85, bq - 5) AND e >= be AND l >= bl AS pool FROM t1 JOIN b ON t1.group_id = b.group_id),
    o AS (SELECT * FROM p WHERE pool OR candidate_id = bid QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pool DESC, round(0.65 * quality + 20 * e + 15 * l - 0.02 * far, 9) DESC, r DESC, quality DESC, len(ids) DESC, far, candidate_id) = 1),
    z AS (SELECT g.group_id, outline_status, candidate_id AS title_id, bid AS baseline_id, coalesce(quality, 0) AS q, coalesce(hq, 0) AS hq, coalesce(op, 0) AS op, coalesce(e, 0) AS e, coalesce(l, 0) AS l, coalesce(len(ids), 0) AS n FROM ({_PG}) g LEFT JOIN o ON g.group_id = o.group_id LEFT JOIN hs ON g.group_id = hs.group_id)
    SELECT group_id, title_id, baseline_id, CAST(greatest(0, floor(round(0.4 * q + 0.35 * hq + 15 * e + 10 * l - CASE WHEN op > 0 THEN 5 ELSE 0 END, 6) + 0.5)) AS BIGINT) AS score, round(e, 4) AS evidence_coverage, round(l, 4) AS lexical_coverage,
        concat_ws(',', CASE WHEN title_id IS NULL THEN 'title_unavailable' END, CASE WHEN outline_status <> 'outline_ready' THEN 'outline_unavailable' END, CASE WHEN title_id IS NOT NULL AND n > 0 AND e < 0.5 THEN 'title_evidence_weakly_represented' END, CASE WHEN title_id IS NOT NULL AND l < 0.5 THEN 'title_outline_lexical_gap' END, CASE WHEN op > 0 THEN 'selected_heading_review_required' END) AS issues,
        CASE WHEN title_id IS NULL OR outline_status <> 'outline_ready' THEN 'blocked' WHEN (n > 0 AND e < 0.5) OR l < 0.5 OR op > 0 THEN 'needs_review' ELSE 'ready' END AS state FROM z""",
)
def m13(s: Source):
    return review.plan_coherence(s.sql(_PG), s.sql(_PT), s.sql(_PH))


@query("M17_citation_backfill", "WITH sc AS (SELECT l_orderkey AS claim_id, l_partkey AS citation_id, round(max(l_quantity) / 50, 6) AS score, bool_and(l_suppkey % 2 = 0) AS pair_known FROM lineitem GROUP BY ALL) SELECT claim_id, citation_id, score, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, citation_id) AS position, CASE WHEN pair_known AND score >= 0.5 THEN 'robust' WHEN pair_known THEN 'adjacent' ELSE 'unverified' END AS eligibility FROM sc WHERE claim_id IN (SELECT o_orderkey FROM orders) AND claim_id % 3 <> 0 AND score >= 0.25 QUALIFY position <= 3")
def m17(s: Source):
    scored = s.lineitem.groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("citation_id")).agg(F.round(F.max("l_quantity") / 50, 6).alias("score"), F.bool_and(F.col("l_suppkey") % 2 == 0).alias("pair_known"))
    claims = s.orders.select(F.col("o_orderkey").alias("claim_id"))
    return review.citation_backfill(claims, claims.where("claim_id % 3 = 0"), scored)


@query("M18_citation_lineage", "SELECT l_orderkey * 10 + l_linenumber AS citation_id, CASE WHEN o_custkey IS NULL THEN 'unresolved_reference' WHEN c_name IS NULL THEN 'unresolved_snapshot' ELSE 'resolved' END AS lineage FROM (SELECT * FROM lineitem) l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o_custkey = c_custkey")
def m18(s: Source):
    return review.citation_lineage(
        s.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation_id"), F.col("l_orderkey").alias("reference_id")),
        s.orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("reference_id"), F.col("o_custkey").alias("task_id")),
        s.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("digest")),
    )


_BARE = "regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')"
_AC = f"SELECT page_id AS candidate_id, url, title, CASE WHEN page_id % 3 <> 0 THEN 'organic' END AS source FROM ({_KINDS}) z"
_AO = f"SELECT url, CASE WHEN page_id % 4 = 0 THEN title END AS website_name FROM ({_KINDS}) z"
_AUTH = f"""{_TYPED}, fi AS (SELECT {_BARE} AS key, arg_min(page_type, page_id) AS page_type, count(*) AS citations, count(CASE WHEN page_id % 3 <> 0 THEN 1 END) AS labels, count(CASE WHEN page_id % 4 = 0 THEN 1 END) AS names FROM ty GROUP BY 1),
    au AS (SELECT key AS url, page_type, CASE page_type WHEN 'social' THEN 'user_generated_platform' WHEN 'database' THEN 'aggregator_database' WHEN 'article' THEN 'editorial_or_commercial_publisher' ELSE 'unclassified_web_source' END AS source_class, citations,
        CASE page_type WHEN 'social' THEN 'user_generated_source' WHEN 'database' THEN 'aggregator_source' ELSE 'publisher_source_not_official_entity_proof' END AS reason, 'not_proven_from_retained_evidence' AS primary_source_state, CASE WHEN labels > 0 AND names > 0 THEN 'labels_observed_not_identity_verified' ELSE 'identity_evidence_incomplete' END AS identity_state FROM fi)"""


@query("M19_source_authority", f"WITH {_AUTH} SELECT * FROM au")
def m19(s: Source):
    return review.source_authority(s.sql(_AC), s.sql(_AO))


@query("M20_primary_sources")
def m20(s: Source):
    r = s.claims.select(F.col("claim_id").alias("requirement_id"), "heading", F.lit("article").alias("wanted_type"))
    p = s.citations.select(F.col("citation_id").alias("page_id"), "source", "keyword", F.when(F.col("rank") <= 3, "article").otherwise("other").alias("page_type"))
    topic = matching.gram_pairs(r, p, "requirement_id", "page_id", "heading", "source")
    word = matching.gram_pairs(r, p, "requirement_id", "page_id", "heading", "keyword")
    return review.primary_sources(r.select("requirement_id", "wanted_type"), p.select("page_id", "page_type"), topic, word)


_SI = "SELECT group_id, task_id, CASE WHEN demand_type = 'O' THEN 'price' WHEN value = '5-LOW' THEN 'video' WHEN demand_type = 'F' THEN 'rating' END AS signal FROM {demands}"


@query("M22_action_signals", f"SELECT group_id, count(DISTINCT task_id) AS tasks, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals, array_to_string(list_sort(list_distinct(list(CASE signal WHEN 'price' THEN 'show prices' WHEN 'video' THEN 'add a video' ELSE 'collect ratings' END))), ',') AS guidance FROM ({_SI}) x WHERE signal IS NOT NULL GROUP BY group_id")
def m22(s: Source):
    return review.action_signals(s.sql(_SI), {"price": "show prices", "video": "add a video", "rating": "collect ratings"})


_CC = "SELECT p_size AS group_id, split_part(p_name, ' ', 1) AS term FROM {part} GROUP BY p_size, split_part(p_name, ' ', 1)"


@query("M24_concept_coverage", f"WITH c AS ({_CC}), t AS (SELECT p_size AS group_id, p_name AS text FROM part), h AS (SELECT c.group_id, term, coalesce(bool_or(contains(' ' || text || ' ', ' ' || term || ' ')), false) AS hit FROM c LEFT JOIN t ON c.group_id = t.group_id GROUP BY ALL) SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS concepts, count(CASE WHEN hit THEN 1 END) AS covered, round(count(CASE WHEN hit THEN 1 END) / count(*), 6) AS coverage_ratio FROM h GROUP BY group_id")
def m24(s: Source):
    return review.concept_coverage(s.part.select(F.col("p_size").alias("group_id"), F.col("p_name").alias("text")), s.sql(_CC))


@query("M27_payload_gaps", "WITH t AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'paa' ELSE 'aio' END AS kind FROM orders), p AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'paa' ELSE 'aio' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'async_pending' END AS state FROM orders WHERE o_orderkey % 5 <> 0) SELECT t.kind, coalesce(state, 'missing') AS state, count(*) AS tasks, CAST(sum(CASE t.kind WHEN 'paa' THEN 0.00015 ELSE 0.0006 END) AS DOUBLE) AS cost FROM t LEFT JOIN p ON t.task_id = p.task_id AND t.kind = p.kind WHERE coalesce(state, 'missing') <> 'resolved' GROUP BY ALL")
def m27(s: Source):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "paa").otherwise("aio").alias("kind")
    t = s.orders.select(F.col("o_orderkey").alias("task_id"), kind)
    p = s.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("task_id"), kind, F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("async_pending").alias("state"))
    return review.payload_gaps(t, p, {"paa": 0.00015, "aio": 0.0006})


_BR = "SELECT size AS group_id, raw_keyword AS keyword, coalesce(volume, 0) * 1000000 + source_keyword_id AS priority, CASE WHEN state = 'acquired' THEN 'waiting' ELSE 'ready' END AS state FROM {keywords}"
_BC = "SELECT size AS group_id, size % 3 = 0 AS has_source FROM {keywords}"


@query("M28_brief_queue", f"WITH r AS ({_BR}), g AS (SELECT group_id, count(*) AS rows, max(priority) AS priority, arg_max(keyword, priority) AS lead_keyword FROM r WHERE state = 'ready' GROUP BY 1), c AS (SELECT group_id, count(*) AS claims, count(CASE WHEN has_source THEN 1 END) AS sourced FROM ({_BC}) x GROUP BY 1) SELECT g.*, CASE WHEN claims IS NULL THEN 'claim_preparation' ELSE 'composition_review' END AS stage, CASE WHEN claims IS NULL THEN 'waiting' WHEN sourced > 0 THEN 'retained_candidates' ELSE 'discovery_required' END AS source_state FROM g LEFT JOIN c ON g.group_id = c.group_id")
def m28(s: Source):
    return review.brief_queue(s.sql(_BR), s.sql(_BC))


_EN = "SELECT source_keyword_id AS candidate_id, size AS group_id, CAST(source_keyword_id % 100 AS DOUBLE) AS quality, CASE WHEN source_keyword_id % 7 = 0 THEN 'blocked' WHEN source_keyword_id % 3 = 0 THEN 'ready' ELSE 'review' END AS review, source_keyword_id % 9 AS evidence, source_keyword_id % 4 AS demand, source_keyword_id % 6 AS competition, source_keyword_id % 5 = 0 AS pattern, source_keyword_id % 11 = 0 AS copied, source_keyword_id % 20 = 0 AS selected FROM {keywords}"


@query("W12_ensemble", f"WITH c AS (SELECT *, round(CAST(0.3 AS DOUBLE) * quality + CASE review WHEN 'ready' THEN 10 WHEN 'blocked' THEN -100 ELSE 2 END + least(15, 4 * log2(1 + evidence)) + demand + competition + CASE WHEN pattern THEN 10 ELSE 0 END - CASE WHEN copied THEN 30 ELSE 0 END, 6) AS score FROM ({_EN}) x), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, candidate_id) AS position FROM c) SELECT group_id, candidate_id, score, position, CASE WHEN position = 1 AND selected THEN 'agreed' WHEN position = 1 THEN 'recommended' WHEN selected THEN 'selected_only' ELSE 'unselected' END AS state FROM r")
def w12(s: Source):
    return review.ensemble(s.sql(_EN))


_RT = "SELECT article_id AS candidate_id, article_id % 50 AS group_id, title AS text, article_id % 3 AS state_rank, article_id % 101 AS quality, article_id % 13 AS evidence, CAST(article_id % 10 AS DOUBLE) AS similarity FROM {articles}"


@query("W11_recommended_title", f"WITH c AS (SELECT *, round(1000 * state_rank + 10 * quality + least(evidence, 9) - abs(length(text) - 35) / 100 - similarity / 1000, 6) AS score FROM ({_RT}) x) SELECT group_id, candidate_id, score FROM c QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, candidate_id) = 1")
def w11(s: Source):
    return review.recommended_title(s.sql(_RT))


@query("W16_null_ordering", "SELECT source_keyword_id, row_number() OVER (PARTITION BY sheet, size ORDER BY volume ASC NULLS LAST, source_keyword_id) AS position FROM {keywords}")
def w16(s: Source):
    from pyspark.sql import Window

    w = Window.partitionBy("sheet", "size").orderBy(F.asc_nulls_last("volume"), "source_keyword_id")
    return s.keywords.select("source_keyword_id", F.row_number().over(w).alias("position"))


@query("W17_stratum", "WITH p AS (SELECT a.task_id AS left_id, b.task_id AS right_id, count(*) AS shared FROM {edges} a JOIN {edges} b ON a.url = b.url AND a.task_id < b.task_id GROUP BY ALL) SELECT left_id, right_id FROM p WHERE shared >= 6")
def w17(s: Source):
    # Pairs of fewer common URLs are of no other stratum here, so they never leave their block.
    pairs = graph.co_ranked(s.edges, least=6).select("left_id", "right_id", F.lit("merge").alias("decision"))
    return review.stratum(pairs, "merge", ordered=False)[0].select("left_id", "right_id")


_GG = "SELECT source_keyword_id AS group_id, CASE WHEN size > 25 THEN source_keyword_id END AS article_id FROM {keywords}"


@query(
    "G17_new_article_gate",
    f"""
    WITH e AS (SELECT * FROM ({_TOPOLOGY}) x WHERE left_group <> right_group), b AS (SELECT left_group AS g, right_group AS o, decision FROM e UNION ALL SELECT right_group, left_group, decision FROM e),
    r AS (SELECT g, count(DISTINCT o) AS related, count(DISTINCT CASE WHEN article_id IS NOT NULL THEN o END) AS existing, bool_or(decision = 'depth_sensitive_hold') AS held FROM b LEFT JOIN ({_GG}) y ON o = group_id GROUP BY 1)
    SELECT source_keyword_id AS keyword_id, source_keyword_id AS group_id, CASE WHEN existing > 0 AND held THEN 'existing_article_boundary_review' WHEN existing > 0 THEN 'new_article_with_internal_link_review' WHEN related > 0 THEN 'planned_group_topology_review' ELSE 'ready_new_article_review' END AS review_action,
        coalesce(existing, 0) AS existing_articles, coalesce(related - existing, 0) AS planned_groups FROM {{keywords}} LEFT JOIN r ON source_keyword_id = g""",
)
def g17(s: Source):
    return review.new_article_gate(s.keywords.select(F.col("source_keyword_id").alias("keyword_id"), F.col("source_keyword_id").alias("group_id")), s.sql(_TOPOLOGY), s.sql(_GG))


_LD = "SELECT group_id % 3 AS site_id, group_id, demand_type AS source_keyword, CASE WHEN occurrence_id % 9 = 0 THEN NULL ELSE demand_type END AS seed_value, value, depth + 1 AS depth FROM {demands}"


@query("G22_latent_demand", f"WITH r AS (SELECT *, CASE WHEN depth > 1 THEN seed_value ELSE source_keyword END AS parent, CASE WHEN depth > 1 THEN 'demand' ELSE 'keyword' END AS parent_kind FROM ({_LD}) x WHERE depth <= 3) SELECT site_id, group_id, parent, parent_kind, value, min(depth) AS min_depth, count(*) AS occurrences FROM r WHERE parent IS NOT NULL GROUP BY ALL")
def g22(s: Source):
    return review.latent_demand(s.sql(_LD), 3)[0]


@query("G22_latent_demand_nodes", f"WITH r AS (SELECT *, CASE WHEN depth > 1 THEN seed_value ELSE source_keyword END AS parent FROM ({_LD}) x WHERE depth <= 3), e AS (SELECT site_id, group_id, parent, value, min(depth) AS d FROM r WHERE parent IS NOT NULL GROUP BY ALL) SELECT site_id, group_id, value AS node, count(DISTINCT parent) AS parents, min(d) AS min_depth, 0::BIGINT AS children, false AS is_root, count(DISTINCT parent) > 1 AS multi_parent FROM e GROUP BY ALL UNION ALL SELECT site_id, group_id, parent, 0, NULL, count(DISTINCT value), true, false FROM e GROUP BY ALL")
def g22n(s: Source):
    return review.latent_demand(s.sql(_LD), 3)[1]


@query("G23_expansion_lineage", "SELECT 'has_type' AS edge_type, raw_keyword AS source, sheet AS target FROM {keywords} GROUP BY ALL UNION ALL SELECT 'ranked_for', domain, keyword FROM {edges} GROUP BY ALL")
def g23(s: Source):
    e, _ = review.expansion_lineage({"has_type": s.keywords.select(F.col("raw_keyword").alias("source"), F.col("sheet").alias("target")), "ranked_for": s.edges.select(F.col("domain").alias("source"), F.col("keyword").alias("target"))}, s.keywords.select(F.col("raw_keyword").alias("keyword"), F.lit("ok").alias("status"), F.col("volume").alias("result_count")))
    return e.drop("edge_id")


@query("G23_dispositions", "SELECT source_keyword_id AS keyword, CASE WHEN size = 1 THEN 'failed' WHEN volume IS NULL THEN 'not_acquired' WHEN volume % 10 = 0 THEN 'zero' ELSE 'retained' END AS disposition FROM {keywords}")
def g23d(s: Source):
    k = s.keywords.select(F.col("source_keyword_id").alias("keyword"), F.when(F.col("size") == 1, "failed").otherwise("ok").alias("status"), (F.col("volume") % 10).alias("result_count"))
    return review.expansion_lineage({"x": k.select(F.col("keyword").alias("source"), F.col("keyword").alias("target"))}, k)[1]


_TU = "SELECT domain AS term, url FROM {edges} UNION ALL SELECT keyword AS term, url FROM {edges}"
_TT = "SELECT DISTINCT domain AS term, keyword AS other FROM {edges}"


@query("G30_semantic_pairs", f"WITH u AS (SELECT DISTINCT term, url FROM ({_TU}) x), n AS (SELECT term, count(*) AS n FROM u GROUP BY 1), t AS ({_TT}), s AS (SELECT t.term, t.other, count(*) AS shared FROM t JOIN u a ON a.term = t.term JOIN u b ON b.term = t.other AND a.url = b.url GROUP BY ALL) SELECT t.term, t.other, coalesce(shared, 0) AS shared, CASE WHEN least(x.n, y.n) < 3 THEN 'insufficient' WHEN coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) >= 0.8 THEN 'compound' WHEN coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) >= 0.2 THEN 'contextual' ELSE 'unrelated' END AS relation FROM t LEFT JOIN s ON t.term = s.term AND t.other = s.other LEFT JOIN n x ON x.term = t.term LEFT JOIN n y ON y.term = t.other")
def g30(s: Source):
    return review.semantic_pairs(s.sql(_TT), s.sql(_TU))


@query("M32_demand_ledger", "WITH e AS (SELECT l_orderkey AS evidence_id, list(l_linenumber) AS u FROM lineitem GROUP BY 1) SELECT CAST(unit AS BIGINT) AS unit_id, count(*) AS evidence FROM (SELECT unnest(u) AS unit FROM e WHERE len(u) = len(list_distinct(u))) x GROUP BY 1")
def m32(s: Source):
    return review.demand_ledger(s.lineitem.groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.collect_list("l_linenumber").alias("unit_ids")))[0]


@query("M33_evidence_packet", "WITH p AS (SELECT task_id, string_agg(url, ' ' ORDER BY rank) AS pages FROM {edges} WHERE rank <= 5 GROUP BY 1), d AS (SELECT task_id, array_to_string(list_sort(list_distinct(list(value))), ',') AS demands FROM {demands} GROUP BY 1) SELECT p.*, demands FROM p LEFT JOIN d ON p.task_id = d.task_id")
def m33(s: Source):
    return review.evidence_packet(s.edges, s.demands)


@query("M34_content_lineage", "SELECT g.group_id, CASE WHEN g.group_id % 2 = 0 THEN g.group_id END AS article_id, g.group_id % 4 AS candidates, CASE WHEN g.group_id % 2 = 1 THEN 'no_article' WHEN g.group_id % 4 = 0 THEN 'no_candidates' ELSE 'connected' END AS lineage FROM {groups} g")
def m34(s: Source):
    g = s.groups.select("group_id")
    c = g.where("group_id % 4 > 0").select("group_id", F.explode(F.sequence(F.lit(1), (F.col("group_id") % 4).cast("int"))).alias("c"))
    return review.content_lineage(g, g.where("group_id % 2 = 0").select("group_id", F.col("group_id").alias("article_id")), c)


@query("M35_benchmark_readiness", "WITH t AS (SELECT task_id, url FROM {edges} WHERE rank = 1), h AS (SELECT url, count(*) AS headings FROM {edges} WHERE rank = 2 GROUP BY 1), k AS (SELECT url, count(DISTINCT keyword) AS keywords FROM {edges} WHERE rank > 1 GROUP BY 1) SELECT task_id, t.url, coalesce(headings, 0) AS headings, coalesce(keywords, 0) AS keywords, CASE WHEN headings IS NULL THEN 'headings_missing' WHEN keywords IS NULL THEN 'keywords_missing' ELSE 'ready' END AS state FROM t LEFT JOIN h ON t.url = h.url LEFT JOIN k ON t.url = k.url")
def m35(s: Source):
    return review.benchmark_readiness(s.edges.where("rank = 1"), s.edges.where("rank = 2"), s.edges.where("rank > 1"))


_REQ = f"CASE WHEN regexp_matches(title, '{rules.CLAIM_FIGURES}') THEN '{rules.CLAIM_SOURCES['P0']}' WHEN regexp_matches(title, '{rules.CLAIM_DEFINITIONS}') THEN '{rules.CLAIM_SOURCES['P1']}' ELSE '{rules.CLAIM_SOURCES['P2']}' END"


@query("M36_citation_suitability", f"WITH {_AUTH}, q AS (SELECT page_id AS claim_id, {_BARE} AS url, CASE WHEN page_id % 11 = 0 THEN 'unknown' ELSE {_REQ} END AS source_requirement FROM ty) SELECT claim_id, q.url, source_requirement, source_class, CASE WHEN source_requirement = 'independent_corroboration_required' THEN 'independence_not_proven' ELSE 'primary_source_proof_missing' END AS suitability FROM q JOIN au ON q.url = au.url")
def m36(s: Source):
    k = s.sql(_KINDS)
    r = k.select(F.col("page_id").alias("claim_id"), F.expr(_BARE).alias("url"))
    q = k.where("page_id % 11 <> 0").select(F.col("page_id").alias("claim_id"), rules.claim_source(rules.claim_class(F.col("title"))).alias("source_requirement"))
    return review.citation_suitability(r, q, m19(s))


@query("M37_discovery_manifest", "SELECT group_id, count(*) AS claims, count(CASE WHEN occurrence_id % 3 = 0 THEN 1 END) AS p0, count(DISTINCT value) AS queries FROM {demands} GROUP BY group_id")
def m37(s: Source):
    c = s.demands.select("group_id", F.concat(F.lit("P"), (F.col("occurrence_id") % 3).cast("string")).alias("requirement"), F.col("value").alias("query"))
    return review.discovery_manifest(c, s.demands)


@query("M38_reframes", "SELECT occurrence_id AS claim_id, CASE WHEN value IN ('1-URGENT', '2-HIGH') THEN 'evidence_absent' ELSE 'scope_mismatch' END AS failure, CASE WHEN value IN ('1-URGENT', '2-HIGH') THEN 'claim' ELSE 'source' END AS scope FROM {demands} WHERE demand_type = 'F'")
def m38(s: Source):
    d = s.demands.select(F.col("occurrence_id").alias("claim_id"), F.when(F.col("demand_type") == "F", "not_supported").otherwise("supported").alias("decision"), F.col("value").alias("reason"))
    return review.reframes(d, [("urgent|high", "evidence_absent", "claim"), ("medium|not specified|low", "scope_mismatch", "source")])


_DC = "SELECT day, keyword, url, rank FROM {snapshots}"


@query("T8_depth_content", "WITH i AS (SELECT concat(keyword, CAST(day AS STRING)) AS task_id, url FROM {snapshots} WHERE rank BETWEEN 11 AND 20), f AS (SELECT DISTINCT url, CASE WHEN length(url) % 2 = 0 THEN 200 ELSE 404 END AS status FROM {snapshots} WHERE rank <= 12) SELECT task_id, count(*) AS results, count(CASE WHEN status = 200 THEN 1 END) AS fetched, count(CASE WHEN status <> 200 THEN 1 END) AS failed, count(CASE WHEN status IS NULL THEN 1 END) AS not_fetched FROM i LEFT JOIN f ON i.url = f.url GROUP BY task_id")
def t8(s: Source):
    i = s.snapshots.select(F.concat("keyword", F.col("day").cast("string")).alias("task_id"), "url", "rank")
    f = s.snapshots.where("rank <= 12").select("url", F.when(F.char_length("url") % 2 == 0, 200).otherwise(404).alias("status")).distinct()
    return review.depth_content(i, f)


@query("Q11_question_lineage", "SELECT l_orderkey * 10 + l_linenumber AS question_id, CASE WHEN l_returnflag = 'A' AND o_orderkey IS NULL THEN 'unlinked_answer' WHEN o_orderkey IS NULL THEN 'unlinked' WHEN o_custkey <> CASE WHEN l_linenumber = 1 THEN -1 ELSE o_custkey END THEN 'other_task' ELSE 'linked' END AS lineage FROM (SELECT l.*, oo.o_custkey AS own FROM lineitem l JOIN orders oo ON l.l_orderkey = oo.o_orderkey) l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 <> 0) o ON l_orderkey = o_orderkey")
def q11(s: Source):
    j = s.lineitem.join(s.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    q = j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), F.col("l_orderkey").alias("feature_id"), F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("o_custkey")).alias("task_id"), F.when(F.col("l_returnflag") == "A", "resolved").otherwise("async_pending").alias("state"))
    return review.question_lineage(q, s.orders.where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("feature_id"), F.col("o_custkey").alias("task_id")))


@query("Q17_canonical_targets", "WITH t AS (SELECT o_orderkey AS candidate_id, o_custkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'observed' ELSE 'redacted' END AS state, o_orderpriority AS target_url FROM orders), x AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS c, count(*) OVER (PARTITION BY task_id) AS n FROM t), f AS (SELECT c_custkey AS task_id, '5-LOW' AS url FROM customer WHERE c_custkey % 3 <> 0) SELECT candidate_id, x.task_id, concat_ws(',', CASE WHEN c > 1 THEN 'candidate_twice' END, CASE WHEN n > 1 THEN 'task_twice' END, CASE WHEN state = 'observed' AND url IS NULL THEN 'no_rank_one' END, CASE WHEN state = 'observed' AND url <> target_url THEN 'other_url' END) AS violations FROM x LEFT JOIN f ON x.task_id = f.task_id")
def q17(s: Source):
    t = s.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "observed").otherwise("redacted").alias("state"), F.col("o_orderpriority").alias("target_url"))
    return review.canonical_targets(t, s.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("task_id"), F.lit("5-LOW").alias("url")))


@query("A11_page_keywords", "SELECT url AS page_id, keyword, min(rank) AS best_rank, count(*) AS observations FROM {edges} GROUP BY ALL")
def a11(s: Source):
    return s.edges.groupBy(F.col("url").alias("page_id"), "keyword").agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("observations"))


_HE = "SELECT o_custkey AS page_id, concat('h', CAST(o_orderkey % 3 + 1 AS STRING)) AS level, o_orderpriority AS text FROM {orders}"


@query("A16_level_summary", f"SELECT page_id, count(CASE WHEN level = 'h1' THEN 1 END) AS h1, count(CASE WHEN level = 'h2' THEN 1 END) AS h2, count(CASE WHEN level = 'h3' THEN 1 END) AS h3, count(*) AS headings, round(avg(length(text)), 6) AS mean_chars FROM ({_HE}) x GROUP BY page_id")
def a16(s: Source):
    return demand.level_summary(s.sql(_HE), ["h1", "h2", "h3"])
