"""Ordered classification rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quaystone.functions.urls import host, part, valid


def first_rule(rules: list[tuple[Column, str]], other: str) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(other)


# Hosts and signs of page types.
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com"]
SOCIAL_HOSTS = ["x.com", "twitter.com", "instagram.com", "tiktok.com", "facebook.com", "note.com"]
QA_HOSTS = ["detail.chiebukuro.yahoo.co.jp", "quora.com", "teratail.com"]
NEWS_HOSTS = ["news.yahoo.co.jp", "nhk.or.jp", "nikkei.com", "asahi.com", "mainichi.jp", "yomiuri.co.jp"]
QA_SIGNS = "掲示板|q&a|質問"
CORPORATE_SIGNS = "株式会社|corporate|コーポレート"
DATABASE_SIGNS = "/jobs?(/|$)|/companies?(/|$)|/reviews?(/|$)|/search(/|$)|/ranking(/|$)|business_categories|求人|企業一覧|口コミ"
LISTING_SIGNS = "/tag/|/category/|/page/[0-9]+|一覧"
TOOL_SIGNS = "診断|シミュレーション|calculator|checker"
ARTICLE_PATHS = "/articles?(/|$)|/columns?(/|$)|/blog(/|$)|/guide(/|$)|/news(/|$)|/media(/|$)|/qa(/|$)|/archives?/"
ARTICLE_TITLES = "解説|例文|方法|ポイント|とは"


def page_type(url: Column, title: Column) -> Column:
    """what a result page is, by its address and title; the first rule that holds decides. An address that is none is ``other``; a path that cannot be decoded stays as it is."""
    t = F.coalesce(title, F.lit(""))
    raw = part(url, 3)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    p = F.regexp_replace(decoded, "/+$", "")
    both = F.lower(F.concat(F.when(p == "", "/").otherwise(p), F.lit(" "), t))
    h = F.coalesce(F.regexp_replace(host(url), ":[0-9]*$", ""), F.lit(""))
    under = lambda hosts: reduce(lambda a, b: a | b, ((h == x) | h.endswith("." + x) for x in hosts))
    return first_rule(
        [
            (~F.coalesce(valid(url), F.lit(False)), "other"),
            (F.lower(p).endswith(".pdf"), "pdf"),
            (under(VIDEO_HOSTS), "video"),
            (under(SOCIAL_HOSTS), "social"),
            (under(QA_HOSTS) | both.rlike(QA_SIGNS), "qa_forum"),
            ((p == "") & t.rlike(CORPORATE_SIGNS), "corporate_home"),
            (p == "", "service_top"),
            (both.rlike(DATABASE_SIGNS), "database"),
            (both.rlike(LISTING_SIGNS), "category"),
            (both.rlike(TOOL_SIGNS), "tool"),
            (under(NEWS_HOSTS), "news"),
            (p.rlike(ARTICLE_PATHS) | t.rlike(ARTICLE_TITLES), "article"),
        ],
        "other",
    )


def difficulty_band(c: Column) -> Column:
    """outside 0 to 100 is an error."""
    return F.when(c.isNull(), "missing").when((c < 0) | (c > 100), F.raise_error(F.lit("difficulty out of range")).cast("string")).when(c == 0, "zero_observed").when(c <= 33, "low").when(c <= 66, "medium").otherwise("high")


def qa_source(domain: Column, sources: dict[str, str]) -> Column:
    """the source whose domain this is, or is under."""
    return F.coalesce(*(F.when((domain == d) | domain.endswith("." + d), name) for d, name in sources.items()), F.lit(None).cast("string"))


def split_display_name(name: Column, domain: Column, platforms: list[str]) -> tuple[Column, Column]:
    """(brand, publisher); only platform domains put both into one name."""
    parts = F.split(name, r"\s*[·•]\s*")
    is_platform = domain.isin(platforms)
    return F.when(is_platform, parts[0]).otherwise(name), F.when(is_platform & (F.size(parts) > 1), parts[1])


def category_path(keyword: Column, rules: list[tuple[str, str]], other: str = "uncategorised") -> Column:
    """the path of the first term that the keyword contains."""
    return first_rule([(F.contains(F.lower(keyword), F.lit(term)), path) for term, path in rules], other)


# Topics of claims and, for each class, the source that it needs.
CLAIM_FIGURES = "[0-9０-９]|年収|給料|費用|料金|時期|日程|締切|いつ|法律|違法|義務|資格"
CLAIM_DEFINITIONS = "業界|職種|仕事内容|企業|会社|違い|とは|種類|一覧"
CLAIM_SOURCES = {"P0": "primary_official_source_required", "P1": "authoritative_definition_or_entity_source_required", "P2": "independent_corroboration_required"}
# Topics and the endings that make questions of them.
QUESTION_ENDINGS = [
    ("違い|比較", "を比較すると何が違う？"),
    ("おすすめ|ランキング|選び方", "は何を基準に選ぶ？"),
    ("いつ|時期|何月", "はいつ確認・準備する？"),
    ("方法|やり方|対策|準備", "はどう進める？"),
    ("理由|原因|なぜ", "はなぜ重要？"),
]
QUESTION_ENDING = "について押さえるべきポイントは？"


def claim_class(topic: Column) -> Column:
    """figures, dates and law need a primary source; then definitions; then the rest."""
    return F.when(topic.rlike(CLAIM_FIGURES), "P0").when(topic.rlike(CLAIM_DEFINITIONS), "P1").otherwise("P2")


def claim_source(priority: Column) -> Column:
    """the kind of source that a class needs."""
    return first_rule([(priority == k, v) for k, v in CLAIM_SOURCES.items()], "unknown")


def derive_question(topic: Column, observed: Column) -> Column:
    """an observed question with one mark; for other topics a question by the first pattern that they hold. Null stays null."""
    bare = F.regexp_replace(F.trim(topic), "[？?]+$", "")
    ending = reduce(lambda c, r: c.when(bare.rlike(r[0]), r[1]), QUESTION_ENDINGS, F.when(observed, "？")).otherwise(QUESTION_ENDING)
    return F.concat(bare, ending)


def differing(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """names of the fields that are known on both sides and differ."""
    names = F.array(*(F.when(left[k].isNotNull() & right[k].isNotNull() & (left[k] != right[k]), F.lit(k)) for k in left))
    return F.array_compact(names)


def unknown(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """names of the fields that a side does not know."""
    return F.array_compact(F.array(*(F.when(left[k].isNull() | right[k].isNull(), F.lit(k)) for k in left)))
