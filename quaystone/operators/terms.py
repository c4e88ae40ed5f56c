"""Terms: tokens of documents, their associations, and coverage of keywords by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions.text import GENERIC, compact, tokens
from quaystone.plans.storage import materialise


def keyword_coverage(content: DataFrame, wanted: DataFrame, on: str, content_id: str, group_id: str, keyword: str, text_col: str) -> DataFrame:
    """how many of a group's keywords a content of its scope holds, spaces aside; pass if it holds all."""
    c = content.select(content_id, on, compact(F.col(text_col), unicode=False).alias("text_"))
    k = wanted.select(group_id, on, compact(F.col(keyword), unicode=False).alias("keyword_"))
    has = F.contains("text_", "keyword_")
    return c.join(k, on).groupBy(content_id, group_id).agg(F.count_if(has).alias("present"), F.count_if(~has).alias("missing"), F.bool_and(has).alias("pass"))


def document_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """X11: one row for each token of a document."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))


def page_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """X11: (id, term, count): how often an id has each token.

    The tokens of a text are sorted and counted within its row, so that no task holds the terms of many texts. Only ids with several rows are added up afterwards.
    """
    counted = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows_")).where("rows_ > 1").select(F.col(id_col).alias("repeated_"))
    repeated = materialise(counted, "repeated_ids")

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
        each = F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.element_at(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - i).cast("bigint").alias("count"))))[0]
        return F.when(F.size(t) > 0, each)

    def rows(d: DataFrame) -> DataFrame:
        return d.select(id_col, F.explode(F.transform(F.array(F.array_sort(tokens(F.col(text_col)))), runs)[0]).alias("x")).select(id_col, "x.term", "x.count")

    if repeated.isEmpty():
        return rows(docs)
    same = F.col(id_col).eqNullSafe(F.col("repeated_"))
    several = rows(docs.join(repeated, same, "left_semi")).groupBy(id_col, "term").agg(F.sum("count").alias("count"))
    return rows(docs.join(repeated, same, "left_anti")).unionByName(several)


def term_weights(pages: DataFrame, min_pages: int = 2) -> DataFrame:
    """A10: terms on at least ``min_pages`` pages, from (page_id, term, count, in_title, in_heading, rank), one row for a page and term.

    The score of a page is 1 + ln(1 + count) + 3 in the title + 2 in a heading + a quarter of the rank's distance below 4.
    """
    score = 1 + F.log1p("count") + 3 * F.col("in_title") + 2 * F.col("in_heading") + 0.25 * F.greatest(F.lit(0), 4 - F.col("rank"))
    return (
        pages.groupBy("term")
        .agg(F.count(F.lit(1)).alias("page_count"), F.sum("count").alias("total_count"), F.sum("in_title").alias("title_pages"), F.sum("in_heading").alias("heading_pages"), F.round(F.sum(score), 6).alias("weight"))
        .where(F.col("page_count") >= min_pages)
    )


def associations(doc_terms: DataFrame, id_col: str, min_df: int = 3, min_support: int = 3, k: int = 12) -> DataFrame:
    """For each term its ``k`` closest by cosine of co-occurrence: support / sqrt(df * df).

    Rare terms go before pairs are made, as they cannot reach the support. Ties go to the larger
    support, then to the term.
    """
    once = doc_terms.select(id_col, "term").distinct()
    df = once.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    kept = once.join(df, "term")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = (
        a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.term") < F.col("b.term")))
        .groupBy(F.col("a.term").alias("term"), F.col("b.term").alias("other"))
        .agg(F.count(F.lit(1)).alias("support"), F.first("a.df").alias("df_term"), F.first("b.df").alias("df_other"))
        .where(F.col("support") >= min_support)
        .withColumn("cosine", F.round(F.col("support") / F.sqrt(F.col("df_term") * F.col("df_other")), 6))
        .select("term", "other", "support", "cosine")
    )
    both = pairs.unionByName(pairs.select(F.col("other").alias("term"), F.col("term").alias("other"), "support", "cosine"))
    w = Window.partitionBy("term").orderBy(F.desc("cosine"), F.desc("support"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Abbreviations of a trade that are terms although they are in Latin letters.
ABBREVIATIONS = ("ai", "dx", "se", "ses", "sier", "web")


def association_term(term: Column) -> Column:
    """Whether a term can be associated: two characters or more, not generic, and with a Japanese letter unless it is an abbreviation."""
    return (F.char_length(term) >= 2) & ~term.isin(*GENERIC) & (term.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]") | term.isin(*ABBREVIATIONS))


def keyword_associations(doc_terms: DataFrame, id_col: str, min_df: int = 3, min_support: int = 3, k: int = 12, most_evidence: int = 20) -> DataFrame:
    """(term, other, support, df_term, df_other, cosine, rank, evidence) of keyword rows (id, term).

    Only terms that :func:`association_term` admits count, and only rows with two of them or more, for
    the document frequencies too. evidence has the smallest ids that hold both terms, at most
    ``most_evidence``; they are cut before the shuffle. Ranks are as in :func:`associations`.
    """
    valid = doc_terms.select(id_col, "term").where(F.col(id_col).isNotNull() & F.coalesce(association_term(F.col("term")), F.lit(False))).distinct()
    rows = valid.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    once = valid.join(rows, id_col)
    df = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    best = associations(once, id_col, min_df, min_support, k)
    kept = once.join(df.where(F.col("df") >= min_df).select("term"), "term")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.term") < F.col("b.term"))).select(F.col("a.term").alias("low"), F.col("b.term").alias("high"), F.col(f"a.{id_col}").alias("id_"))
    first = pairs.withColumn("n_", F.row_number().over(Window.partitionBy("low", "high").orderBy("id_"))).where(F.col("n_") <= most_evidence)
    evidence = first.groupBy("low", "high").agg(F.array_sort(F.collect_list("id_")).alias("evidence"))
    j = best.withColumn("low", F.least("term", "other")).withColumn("high", F.greatest("term", "other")).join(evidence, ["low", "high"])
    j = j.join(df.withColumnRenamed("df", "df_term"), "term").join(df.select(F.col("term").alias("other"), F.col("df").alias("df_other")), "other")
    return j.select("term", "other", "support", "df_term", "df_other", "cosine", "rank", "evidence")


def variants(keywords: DataFrame, keyword: str, key, by: list[str]) -> DataFrame:
    """Representatives that are spelt in more than one way."""
    return keywords.groupBy(key.alias("representative"), *by).agg(F.count_distinct(keyword).alias("forms"), F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set(keyword)), "|").alias("surface")).where("forms > 1")


def prefix_tree(keywords: DataFrame, id_col: str, keyword: str) -> DataFrame:
    """Each keyword's tokens by document frequency (then position, then token) as a path; the parent is the longest path that exists and is a proper prefix.

    Keywords with the same multiset of tokens share a path: the smallest id stands for it, the
    others are reordered aliases. Returns path, depth, parent_path, relation.
    """
    toks = keywords.select(id_col, F.posexplode(F.split(F.lower(F.trim(keyword)), r"\s+")).alias("pos", "token"))
    df = toks.groupBy("token").agg(F.count_distinct(id_col).alias("df"))
    paths = (
        toks.join(df, "token")
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("d"), "token"))).alias("t"))
        .select(id_col, F.transform("t", lambda x: x["token"]).alias("tokens"))
        .withColumn("path", F.array_join("tokens", "/"))
    )
    w = Window.partitionBy("path").orderBy(id_col)
    paths = paths.withColumn("n_", F.row_number().over(w))
    heads = paths.where("n_ = 1").select("path")
    up = (
        paths.where("n_ = 1 and size(tokens) > 1")
        .select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("tokens", 1, k), "/").alias("prefix")))).alias("p"))
        .select("path", "p.k", "p.prefix")
        .join(heads.withColumnRenamed("path", "prefix"), "prefix")
        .groupBy("path")
        .agg(F.max_by("prefix", "k").alias("parent_path"))
    )
    return paths.join(up, "path", "left").select(
        id_col, "path", F.size("tokens").alias("depth"), "parent_path", F.when(F.col("n_") > 1, "reordered_alias").when(F.col("parent_path").isNull(), "root").otherwise("child").alias("relation")
    )
