"""Citations for claims: an inverted join with bounds, so that common bigrams bring no pairs that cannot win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quaystone.functions.text import evidence_key, grams
from quaystone.functions.urls import citation_url
from quaystone.plans.storage import materialise

#: What the two similarities and the best rank count; a rank from 99 on is none.
HEADING, QUERY, BONUS, NO_RANK = 0.72, 0.2, 0.12, 99
_SLACK = 2e-6


def with_grams(df: DataFrame, text: str, name: str, unicode: bool = True) -> DataFrame:
    """``df`` with the distinct bigrams of a text without punctuation, symbols and white space; one character is its own gram, an empty or null text has none."""
    df = df.withColumn("key_", evidence_key(F.coalesce(text, F.lit("")), unicode))
    return df.withColumn(name, F.when(F.char_length("key_") == 1, F.array("key_")).otherwise(grams(F.col("key_")))).drop("key_")


def _pages(citations: DataFrame) -> DataFrame:
    """Citations by canonical URL: the best occurrence's id and source, the best rank and its bonus."""
    none = F.lit(NO_RANK)
    order = F.struct(F.coalesce("url_rank", none), F.coalesce("domain_rank", none), "citation_id")
    g = citations.groupBy("page_").agg(
        F.min_by("citation_id", order).alias("citation_id"), F.min_by("source", order).alias("source"), F.min(F.coalesce("url_rank", "domain_rank", none)).cast("bigint").alias("rank_"), F.count(F.lit(1)).alias("occurrences")
    )
    seen = F.col("rank_") < NO_RANK
    return g.select("page_", "citation_id", "source", "occurrences", F.when(seen, F.col("rank_")).alias("organic_rank"), F.when(seen, F.least(F.lit(BONUS), BONUS / F.sqrt(F.greatest("rank_", F.lit(1))))).otherwise(0.0).alias("bonus"))


def _scored(found: DataFrame, claims: DataFrame, texts: DataFrame, pages: DataFrame, least: float) -> DataFrame:
    """Exact scores of (claim_id, page_) pairs, from ``least`` on."""
    shared = F.size(F.array_intersect("heading_", "grams"))
    dice = F.coalesce(F.try_divide(2.0 * shared, F.size("heading_") + F.size("grams")), F.lit(0.0))
    j = found.join(claims.select("claim_id", "heading_"), "claim_id").join(texts, "page_").select("claim_id", "page_", "is_source", dice.alias("dice"))
    g = j.groupBy("claim_id", "page_").agg(F.max(F.when(F.col("is_source"), F.col("dice"))).alias("heading_similarity"), F.max(F.when(~F.col("is_source"), F.col("dice"))).alias("query_similarity"))
    g = g.na.fill(0.0, ["heading_similarity", "query_similarity"]).where("heading_similarity > 0 OR query_similarity > 0").join(pages.select("page_", "organic_rank", "bonus"), "page_")
    score = F.round(F.least(F.lit(1.0), HEADING * F.col("heading_similarity") + QUERY * F.col("query_similarity") + F.col("bonus")), 6)
    return g.withColumn("score", score).where(F.col("score") >= least).select("claim_id", "page_", "heading_similarity", "query_similarity", "organic_rank", "score")


def claim_citations(claims: DataFrame, citations: DataFrame, k: int = 3, least: float = 0.08, unicode: bool = True, seed: int = 200) -> DataFrame:
    """The ``k`` best cited pages of a claim: .72 dice(heading, source) + .2 dice(heading, keyword) + min(.12, .12 / sqrt(rank)), at most 1, from ``least`` on.

    Claims are (claim_id, heading), citations (citation_id, url, source, keyword, url_rank, domain_rank). Citations of
    one canonical URL are one page: its source is that of the occurrence with the best URL rank, then domain rank, then
    id; its keyword similarity is the best of all occurrences; its rank is the best URL or else domain rank, below 99. A
    page that shares no bigram with the heading is no candidate, whatever its rank. Ties go to the better rank, then
    the smaller URL. Null headings and texts have no bigrams; citations without a URL are one page.

    No pair that counts is lost, and common bigrams are mostly not joined. A claim's bigrams stand in order of rarity. First
    its rarest ones are joined, as far as they lead to ``seed`` pages (at least one bigram); the k-th best score found is its bar.
    A page whose first shared bigram is the i-th has at most the rest of the list in common with the heading, which
    with the sizes of the page's texts bounds both similarities. Bigrams after which no page can reach the bar are not joined,
    and pages that cannot with their own sizes and bonus are no candidates.
    """
    cited = citations.withColumn("page_", F.coalesce(citation_url(F.col("url")), "url", F.lit("")))
    pages = materialise(_pages(cited), "cited_pages")
    said = pages.select("page_", F.lit(True).alias("is_source"), F.col("source").alias("text")).unionByName(cited.select("page_", F.lit(False).alias("is_source"), F.col("keyword").alias("text")).distinct())
    texts = materialise(with_grams(said, "text", "grams", unicode).drop("text").where(F.size("grams") > 0), "cited_texts")
    size = F.size("grams")
    sizes = texts.groupBy("page_").agg(F.coalesce(F.max(F.when(F.col("is_source"), size)), F.lit(0)).alias("ns"), F.coalesce(F.max(F.when(~F.col("is_source"), size)), F.lit(0)).alias("nk"))
    postings = texts.select("page_", F.explode("grams").alias("g")).distinct()
    c = with_grams(claims.select("claim_id", "heading").distinct(), "heading", "heading_", unicode)

    rarity = postings.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    in_order = Window.partitionBy("claim_id").orderBy("df", "g")
    listed = c.select("claim_id", F.size("heading_").alias("n"), F.explode("heading_").alias("g")).join(rarity, "g")
    listed = listed.withColumns({"i": F.row_number().over(in_order), "m": F.count(F.lit(1)).over(Window.partitionBy("claim_id")), "led": F.sum("df").over(in_order.rowsBetween(Window.unboundedPreceding, 0))})
    listed = materialise(listed.withColumn("is_seed", (F.col("i") == 1) | (F.col("led") <= seed)), "claim_grams")

    seeds = listed.where("is_seed").select("claim_id", "g").join(postings, "g").select("claim_id", "page_").distinct()
    first = materialise(_scored(seeds, c, texts, pages, least), "first_scores")
    best = Window.partitionBy("claim_id").orderBy(F.desc("score"), F.asc_nulls_last("organic_rank"), "page_")
    bars = first.withColumn("n_", F.row_number().over(best)).where(F.col("n_") == k).select("claim_id", F.col("score").alias("bar"))
    n, rest, ns, bar = F.col("n"), F.col("rest"), F.col("ns"), F.col("bar")
    open_ = listed.where("NOT is_seed").withColumn("rest", F.col("m") - F.col("i") + 1).join(bars, "claim_id", "left").withColumn("bar", F.coalesce("bar", F.lit(least)) - _SLACK)
    open_ = open_.where((HEADING + QUERY) * 2 * rest / (n + rest) + BONUS >= bar).select("claim_id", "g", "n", "rest", "bar")
    word = F.least(rest, F.col("nk"))
    reach = HEADING * 2 * F.least(rest, ns) / (n + ns) + QUERY * 2 * word / (n + word) + F.col("bonus")
    more = open_.join(postings.join(pages.select("page_", "bonus"), "page_").join(sizes, "page_"), "g").where(reach >= bar).select("claim_id", "page_").distinct()
    more = more.join(first.select("claim_id", "page_"), ["claim_id", "page_"], "left_anti")

    top = first.unionByName(_scored(more, c, texts, pages, least)).withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
    return top.join(pages.select("page_", "citation_id", "occurrences"), "page_").select("claim_id", "citation_id", F.nullif("page_", F.lit("")).alias("url"), "occurrences", "heading_similarity", "query_similarity", "organic_rank", "score", "position")
