"""Queries of the scalar layer and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import rules, text, urls
from quaystone.operators import sets, terms
from quaystone.plans.catalog import Source, query

_U = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([?]([^#]*))?"


def _p(n: int) -> str:
    return f"regexp_extract(url, '{_U}', {n})"


@query("F1_normalize_keyword", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized FROM conversations")
def f1(s: Source):
    return s.conversations.select("conv_id", "turn", text.normalize_keyword(F.col("text")).alias("normalized"))


@query("F2_compact", "SELECT p_partkey, regexp_replace(lower(p_name), '\\s+', '', 'g') AS compact FROM part")
def f2(s: Source):
    return s.part.select("p_partkey", text.compact(F.col("p_name"), unicode=False).alias("compact"))


@query("F3_evidence_key", "SELECT conv_id, turn, regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]+', '', 'g') AS evidence_key FROM conversations")
def f3(s: Source):
    return s.conversations.select("conv_id", "turn", text.evidence_key(F.col("text")).alias("evidence_key"))


@query("F4_lexical_alias", "SELECT p_partkey, replace(p_name, 'widget', 'gadget') AS replaced, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'crimson' WHEN 'small' THEN 'tiny' ELSE split_part(p_name, ' ', 1) END AS alias FROM part")
def f4(s: Source):
    return s.part.select("p_partkey", text.replace_all(F.col("p_name"), {"widget": "gadget"}).alias("replaced"), text.alias(F.split("p_name", " ")[0], {"red": "crimson", "small": "tiny"}).alias("alias"))


@query(
    "F5_canonical_serp_url",
    f"""
    SELECT page_id, lower({_p(1)}) || '://' || lower({_p(2)}) || CASE WHEN {_p(3)} IN ('', '/') THEN '/' ELSE regexp_replace({_p(3)}, '/+$', '') END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical
    FROM (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split({_p(5)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|yclid|mc_cid|mc_eid)(=|$)'))), '&'), '') AS kept FROM pages) x""",
)
def f5(s: Source):
    return s.pages.select("page_id", urls.canonical_serp_url(F.col("url")).alias("canonical"))


@query(
    "F6_canonical_url",
    f"""
    SELECT page_id, lower({_p(1)}) || '://' || lower({_p(2)}) || CASE WHEN {_p(3)} = '' THEN '/' ELSE {_p(3)} END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical
    FROM (SELECT *, coalesce(array_to_string(list_filter(string_split({_p(5)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&'), '') AS kept FROM pages) x""",
)
def f6(s: Source):
    return s.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("F7_page_key", f"SELECT page_id, lower({_p(1)}) || '://' || lower({_p(2)}) || CASE WHEN regexp_replace({_p(3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_p(3)}, '/+$', '') END AS page_key FROM pages")
def f7(s: Source):
    return s.pages.select("page_id", urls.page_key(F.col("url")).alias("page_key"))


@query(
    "F8_X14_url_scopes",
    f"""
    SELECT page_id, 'host' AS scope, regexp_replace(lower({_p(2)}), '^www[.]', '') AS scope_value FROM pages
    UNION ALL SELECT page_id, 'directory', regexp_replace(lower({_p(2)}), '^www[.]', '') || '/' || regexp_extract({_p(3)}, '^/([^/]+)', 1) || '/' FROM pages WHERE regexp_extract({_p(3)}, '^/([^/]+)', 1) <> ''
    UNION ALL SELECT page_id, 'page', lower({_p(1)}) || '://' || lower({_p(2)}) || CASE WHEN regexp_replace({_p(3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_p(3)}, '/+$', '') END FROM pages""",
)
def f8(s: Source):
    return sets.scopes(s.pages.select("page_id", "url"), "url").select("page_id", "scope", "scope_value")


@query("F9_redacted", "SELECT page_id, regexp_matches(CASE WHEN page_id % 5 = 0 THEN 'https://x/%3CREDACTED-1%3E' WHEN page_id % 5 = 1 THEN 'https://x/<redacted>' ELSE url END, '(?i)(<|%3C)redacted([-_][^<>]*?)?(>|%3E)') AS redacted FROM pages")
def f9(s: Source):
    shown = F.when(F.col("page_id") % 5 == 0, "https://x/%3CREDACTED-1%3E").when(F.col("page_id") % 5 == 1, "https://x/<redacted>").otherwise(F.col("url"))
    return s.pages.select("page_id", urls.is_redacted(shown).alias("redacted"))


#: Addresses and titles of all kinds: the given paths, with a word in front by the page's id, and titles with a word behind.
_KINDS = """
    SELECT page_id, CASE page_id % 10 WHEN 3 THEN 'https://www.youtube.com/watch' WHEN 5 THEN 'https://m.x.com/a' WHEN 6 THEN 'https://nhk.or.jp/a' ELSE concat(regexp_extract(url, '^[a-z]+://[^/]*', 0), CASE page_id % 13 WHEN 1 THEN '/' WHEN 2 THEN '/Blog/' WHEN 3 THEN '/jobs/' WHEN 4 THEN '/tag/' WHEN 5 THEN '/column' WHEN 6 THEN '/%E5%8F%A3%E3%82%B3%E3%83%9F' WHEN 7 THEN '/a.PDF/' ELSE regexp_replace(url, '^[a-z]+://[^/]*', '') END) END AS url,
           concat(regexp_extract(html, '<title>([^<]*)</title>', 1), CASE page_id % 17 WHEN 1 THEN ' とは' WHEN 2 THEN ' 質問' WHEN 3 THEN ' 株式会社' WHEN 4 THEN ' 一覧' WHEN 5 THEN ' Checker' WHEN 6 THEN ' 比較？' WHEN 7 THEN ' の選び方' WHEN 8 THEN ' いつ' WHEN 9 THEN ' のやり方' WHEN 10 THEN ' なぜ' WHEN 11 THEN ' 資格' WHEN 12 THEN ' 種類？？' ELSE '' END) AS title
    FROM {pages}"""


def _under(hosts: list[str]) -> str:
    return "(" + " OR ".join(f"h = '{x}' OR h LIKE '%.{x}'" for x in hosts) + ")"


#: Common table expressions up to ``ty`` (page_id, url, title, page_type).
_TYPED = f"""k AS ({_KINDS}), u AS (SELECT *, regexp_replace(lower({_p(2)}), '^www[.]', '') AS h, regexp_replace(url_decode({_p(3)}), '/+$', '') AS p FROM k), b AS (SELECT *, lower(CASE WHEN p = '' THEN '/' ELSE p END || ' ' || title) AS t FROM u),
    ty AS (SELECT page_id, url, title, CASE WHEN lower(p) LIKE '%.pdf' THEN 'pdf' WHEN {_under(rules.VIDEO_HOSTS)} THEN 'video' WHEN {_under(rules.SOCIAL_HOSTS)} THEN 'social' WHEN {_under(rules.QA_HOSTS)} OR regexp_matches(t, '{rules.QA_SIGNS}') THEN 'qa_forum'
        WHEN p = '' AND regexp_matches(title, '{rules.CORPORATE_SIGNS}') THEN 'corporate_home' WHEN p = '' THEN 'service_top' WHEN regexp_matches(t, '{rules.DATABASE_SIGNS}') THEN 'database' WHEN regexp_matches(t, '{rules.LISTING_SIGNS}') THEN 'category'
        WHEN regexp_matches(t, '{rules.TOOL_SIGNS}') THEN 'tool' WHEN {_under(rules.NEWS_HOSTS)} THEN 'news' WHEN regexp_matches(p, '{rules.ARTICLE_PATHS}') OR regexp_matches(title, '{rules.ARTICLE_TITLES}') THEN 'article' ELSE 'other' END AS page_type FROM b)"""


@query("F10_page_type", f"WITH {_TYPED} SELECT page_id, page_type FROM ty")
def f10(s: Source):
    return s.sql(_KINDS).select("page_id", rules.page_type(F.col("url"), F.col("title")).alias("page_type"))


@query("F11_qa_source", f"SELECT page_id, CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'com' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'net' END AS qa_source FROM (SELECT page_id, regexp_replace(lower({_p(2)}), '^www[.]', '') AS h FROM pages) x")
def f11(s: Source):
    return s.pages.select("page_id", rules.qa_source(urls.host(F.col("url")), {"example.com": "com", "example.net": "net"}).alias("qa_source"))


@query("F12_display_name", "SELECT task_id, url, CASE WHEN domain IN ('shop1.example', 'shop2.example') THEN split_part(title, ' · ', 1) ELSE title END AS brand, CASE WHEN domain IN ('shop1.example', 'shop2.example') THEN split_part(title, ' · ', 2) END AS publisher FROM {organic}")
def f12(s: Source):
    brand, publisher = rules.split_display_name(F.col("title"), F.col("domain"), ["shop1.example", "shop2.example"])
    return s.organic.select("task_id", "url", brand.alias("brand"), publisher.alias("publisher"))


@query("F13_difficulty_band", "SELECT source_keyword_id, CASE WHEN volume IS NULL THEN 'missing' WHEN volume % 101 = 0 THEN 'zero_observed' WHEN volume % 101 <= 33 THEN 'low' WHEN volume % 101 <= 66 THEN 'medium' ELSE 'high' END AS band FROM {keywords}")
def f13(s: Source):
    return s.keywords.select("source_keyword_id", rules.difficulty_band(F.col("volume") % 101).alias("band"))


@query("F14_category_path", "SELECT source_keyword_id, CASE WHEN lower(raw_keyword) LIKE '%ring%' THEN 'jewellery/ring' WHEN lower(raw_keyword) LIKE '%widget%' THEN 'hardware/widget' WHEN lower(raw_keyword) LIKE '%red%' THEN 'colour/red' ELSE 'uncategorised' END AS path FROM {keywords}")
def f14(s: Source):
    return s.keywords.select("source_keyword_id", rules.category_path(F.col("raw_keyword"), [("ring", "jewellery/ring"), ("widget", "hardware/widget"), ("red", "colour/red")]).alias("path"))


@query("F15_grams", "SELECT source_keyword_id, array_to_string(list_sort(list_distinct(list_transform(range(1, length(raw_keyword)), lambda i: substring(raw_keyword, CAST(i AS INT), 2)))), '|') AS grams FROM {keywords}")
def f15(s: Source):
    return s.keywords.select("source_keyword_id", F.array_join(text.grams(F.col("raw_keyword")), "|").alias("grams"))


@query(
    "F16_set_similarity",
    """
    WITH k AS (SELECT source_keyword_id AS id, sheet, size, list_distinct(list_transform(range(1, length(raw_keyword)), lambda i: substring(raw_keyword, CAST(i AS INT), 2))) AS g FROM {keywords}),
    p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.g, b.g)) AS common, len(a.g) AS na, len(b.g) AS nb FROM k a JOIN k b ON a.sheet = b.sheet AND a.size = b.size AND a.id < b.id)
    SELECT left_id, right_id, round(common / (na + nb - common), 6) AS jaccard, round(2 * common / (na + nb), 6) AS dice, round(common / least(na, nb), 6) AS overlap FROM p""",
)
def f16(s: Source):
    k = s.keywords.select(F.col("source_keyword_id").alias("id"), "sheet", "size", text.grams(F.col("raw_keyword")).alias("g"))
    return sets.set_similarity(k, "id", ["sheet", "size"], "g")


@query("F17_hashtags", "SELECT conv_id, turn, array_to_string(regexp_extract_all('#' || replace(text, ' ', ' #'), '#[\\p{L}\\p{N}_]+'), ' ') AS tags FROM conversations")
def f17(s: Source):
    return s.conversations.select("conv_id", "turn", F.array_join(text.hashtags(F.concat(F.lit("#"), F.replace("text", F.lit(" "), F.lit(" #")))), " ").alias("tags"))


@query(
    "F18_text_shape",
    """
    SELECT page_id, length(title) AS char_count, regexp_matches(title, '[?？]') AS has_question, regexp_matches(title, '[0-9]') AS has_number, regexp_matches(title, '[\\[\\]()【】「」]') AS has_bracket, regexp_matches(title, '[|:：\\-–]') AS has_separator,
           CASE WHEN strpos(lower(title), 'the') = 1 THEN 'leading' WHEN strpos(lower(title), 'the') > 1 THEN 'included' ELSE 'absent' END AS main_position
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) x""",
)
def f18(s: Source):
    t = s.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return t.select("page_id", *(c.alias(k) for k, c in text.shape(F.col("title"), F.lit("the")).items()))


_ENDINGS = " ".join(f"WHEN regexp_matches(bare, '{a}') THEN '{b}'" for a, b in rules.QUESTION_ENDINGS)


@query(
    "F19_F20_question_and_claim",
    f"""
    WITH k AS ({_KINDS}), t AS (SELECT page_id, title, page_id % 4 = 0 AS observed, regexp_replace(trim(title), '[？?]+$', '') AS bare FROM k)
    SELECT page_id, bare || CASE WHEN observed THEN '？' {_ENDINGS} ELSE '{rules.QUESTION_ENDING}' END AS question, claim_class,
           CASE claim_class WHEN 'P0' THEN '{rules.CLAIM_SOURCES["P0"]}' WHEN 'P1' THEN '{rules.CLAIM_SOURCES["P1"]}' ELSE '{rules.CLAIM_SOURCES["P2"]}' END AS source_requirement
    FROM (SELECT *, CASE WHEN regexp_matches(title, '{rules.CLAIM_FIGURES}') THEN 'P0' WHEN regexp_matches(title, '{rules.CLAIM_DEFINITIONS}') THEN 'P1' ELSE 'P2' END AS claim_class FROM t) x""",
)
def f19(s: Source):
    t = s.sql(_KINDS).withColumn("claim_class", rules.claim_class(F.col("title")))
    return t.select("page_id", rules.derive_question(F.col("title"), F.col("page_id") % 4 == 0).alias("question"), "claim_class", rules.claim_source(F.col("claim_class")).alias("source_requirement"))


@query("F21_mention", "SELECT doc_id, CASE WHEN contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' ring ') THEN 'word_boundary' WHEN contains(lower(text), 'ring') THEN 'substring_only' ELSE 'absent' END AS mention FROM documents")
def f21(s: Source):
    return s.documents.select("doc_id", text.mention(F.col("text"), F.lit("ring")).alias("mention"))


@query("F22_digest", "SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand, p_type)) AS digest FROM part")
def f22(s: Source):
    return s.part.select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("digest"))


@query(
    "F23_keyword_coverage",
    """
    WITH k AS (SELECT DISTINCT sheet, raw_keyword, regexp_replace(lower(raw_keyword), '\\s+', '', 'g') AS c FROM {keywords}), d AS (SELECT item_id, regexp_replace(lower(text || ' small ring'), '\\s+', '', 'g') AS c FROM benchmark)
    SELECT item_id, sheet, count(CASE WHEN contains(d.c, k.c) THEN 1 END) AS present, count(CASE WHEN NOT contains(d.c, k.c) THEN 1 END) AS missing, bool_and(contains(d.c, k.c)) AS pass FROM d JOIN k ON d.item_id % 5 = length(sheet) % 5 GROUP BY item_id, sheet""",
)
def f23(s: Source):
    wanted = s.keywords.select("sheet", "raw_keyword").distinct().withColumn("scope", F.char_length("sheet") % 5)
    content = s.benchmark.select("item_id", F.concat("text", F.lit(" small ring")).alias("text"), (F.col("item_id") % 5).alias("scope"))
    return terms.keyword_coverage(content, wanted, on="scope", content_id="item_id", group_id="sheet", keyword="raw_keyword", text_col="text")


@query(
    "F24_conditions",
    """
    SELECT a.task_id, b.task_id AS other_id,
        concat_ws(',', CASE WHEN a.site_id <> b.site_id THEN 'site_id' END, CASE WHEN a.group_id <> b.group_id THEN 'group_id' END, CASE WHEN a.volume <> b.volume THEN 'volume' END) AS differing,
        concat_ws(',', CASE WHEN a.volume IS NULL OR b.volume IS NULL THEN 'volume' END) AS unknown
    FROM {tasks} a JOIN {tasks} b ON b.task_id = a.task_id + 1""",
)
def f24(s: Source):
    a, b = s.tasks.alias("a"), s.tasks.alias("b")
    j = a.join(b, F.col("b.task_id") == F.col("a.task_id") + 1)
    left, right = ({k: F.col(f"{x}.{k}") for k in ("site_id", "group_id", "volume")} for x in "ab")
    return j.select(F.col("a.task_id"), F.col("b.task_id").alias("other_id"), F.array_join(rules.differing(left, right), ",").alias("differing"), F.array_join(rules.unknown(left, right), ",").alias("unknown"))


@query("F25_W14_search_page", "SELECT source_keyword_id, raw_keyword, total FROM (SELECT *, count(*) OVER () AS total FROM {keywords} WHERE contains(lower(raw_keyword), 'ring') AND sheet IN ('ECONOMY', 'SMALL', 'LARGE') AND NOT contains(lower(raw_keyword), 'blue')) x ORDER BY raw_keyword, source_keyword_id LIMIT 25 OFFSET 5")
def f25(s: Source):
    return sets.search_page(s.keywords, query="ring", fields=["raw_keyword"], enums={"sheet": ["ECONOMY", "SMALL", "LARGE"]}, exclude=["blue"], order=["raw_keyword", "source_keyword_id"], limit=25, offset=5).select("source_keyword_id", "raw_keyword", "total")


@query("F26_sort_number", "SELECT p_partkey, TRY_CAST(replace(regexp_extract('¥' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || ',000 each', '-?[0-9][0-9,]*([.][0-9]+)?'), ',', '') AS DOUBLE) AS number FROM part")
def f26(s: Source):
    return s.part.select("p_partkey", text.sort_number(F.concat(F.lit("¥"), F.col("p_retailprice").cast("bigint").cast("string"), F.lit(",000 each"))).alias("number"))


@query("U1_union", "SELECT 'task' AS kind, task_id AS id, keyword AS label FROM {tasks} UNION ALL SELECT 'keyword', source_keyword_id, raw_keyword FROM {keywords}")
def u1(s: Source):
    return sets.union_records({"task": s.tasks.select(F.col("task_id").alias("id"), F.col("keyword").alias("label")), "keyword": s.keywords.select(F.col("source_keyword_id").alias("id"), F.col("raw_keyword").alias("label"))})


_L, _R = "(SELECT raw_keyword AS line, min(source_keyword_id) AS id FROM {keywords} WHERE size < 25 GROUP BY 1)", "(SELECT upper(raw_keyword) AS line FROM {keywords} WHERE size >= 45 GROUP BY 1)"


def _lines(s: Source):
    left = s.keywords.where("size < 25").groupBy(F.col("raw_keyword").alias("line")).agg(F.min("source_keyword_id").alias("id"))
    right = s.keywords.where("size >= 45").select(F.upper("raw_keyword").alias("line")).distinct()
    return left, right


@query("U2_intersect", f"SELECT line, id FROM {_L} l WHERE lower(line) IN (SELECT lower(line) FROM {_R} r)")
def u2(s: Source):
    left, right = _lines(s)
    return sets.intersect_on(left, right, text.normalize_keyword(F.col("line"), unicode=False))


@query("U3_except", f"SELECT line, id FROM {_L} l WHERE lower(line) NOT IN (SELECT lower(line) FROM {_R} r)")
def u3(s: Source):
    left, right = _lines(s)
    return sets.except_on(left, right, text.normalize_keyword(F.col("line"), unicode=False))


@query("U4_diff", f"SELECT '-' AS mark, line FROM {_L} l WHERE lower(line) NOT IN (SELECT lower(line) FROM {_R} r) UNION ALL SELECT '+', line FROM {_R} r WHERE lower(line) NOT IN (SELECT lower(line) FROM {_L} l)")
def u4(s: Source):
    left, right = _lines(s)
    return sets.diff_on(left.select("line"), right, text.normalize_keyword(F.col("line"), unicode=False))


@query("U5_dedupe", "SELECT source_keyword_id, raw_keyword FROM {keywords} QUALIFY row_number() OVER (PARTITION BY lower(raw_keyword) ORDER BY source_keyword_id) = 1")
def u5(s: Source):
    return sets.dedupe_on(s.keywords, text.normalize_keyword(F.col("raw_keyword"), unicode=False), ["source_keyword_id"]).select("source_keyword_id", "raw_keyword")


@query("U6_line_tools", "SELECT source_keyword_id, replace(raw_keyword, ' ', '-') AS replaced, lower(raw_keyword) AS normalized, length(raw_keyword) AS chars FROM {keywords}")
def u6(s: Source):
    k = F.col("raw_keyword")
    return s.keywords.select("source_keyword_id", text.replace_all(k, {" ": "-"}).alias("replaced"), text.normalize_keyword(k, unicode=False).alias("normalized"), F.char_length(k).alias("chars"))


@query(
    "U7_compare_urls",
    """
    WITH l AS (SELECT DISTINCT task_id AS pair_id, url FROM {edges}), r AS (SELECT DISTINCT task_id - 1 AS pair_id, url FROM {edges}),
    j AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, l.url AS lu, r.url AS ru FROM l FULL JOIN r ON l.pair_id = r.pair_id AND l.url = r.url)
    SELECT pair_id, count(CASE WHEN lu IS NOT NULL AND ru IS NOT NULL THEN 1 END) AS shared, count(CASE WHEN ru IS NULL THEN 1 END) AS left_only, count(CASE WHEN lu IS NULL THEN 1 END) AS right_only,
           CASE WHEN count(lu) > 0 AND count(ru) > 0 THEN round(count(CASE WHEN lu IS NOT NULL AND ru IS NOT NULL THEN 1 END) / count(*), 6) END AS jaccard
    FROM j GROUP BY pair_id""",
)
def u7(s: Source):
    return sets.compare_urls(s.edges.select(F.col("task_id").alias("pair_id"), "url"), s.edges.select((F.col("task_id") - 1).alias("pair_id"), "url"), "pair_id", "url")
