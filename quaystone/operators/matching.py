"""Matching of keywords, queries, articles and citations. Pairs always come from a join on tokens or grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quaystone.functions.text import GENERIC, grams, tokens


def token_sets(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, token) of distinct tokens, with the size of the set."""
    t = rows.select(id_col, F.array_distinct(tokens(F.col(text))).alias("t")).withColumn("size", F.size("t"))
    return t.select(id_col, "size", F.explode("t").alias("token"))


def containment(keywords: DataFrame, texts: DataFrame, keyword_id: str, text_id: str, keyword: str, text: str) -> DataFrame:
    """Pairs in which every token of the keyword is in the text: exact if the sets are equal, contains if the keyword has two tokens or more.

    Rows with equal sets of tokens stand in one row, 128 ids at most, as Spark holds all pairs of two such rows at once. A keyword's set meets the texts that have its rarest
    token and is compared there, so that no pair is shuffled.
    """
    k, t = _held(keywords, keyword_id, keyword, "k"), _held(texts, text_id, text, "t")
    common = t.select("t_set").distinct().select(F.explode("t_set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = k.select("k_set").distinct().select("k_set", F.explode("k_set").alias("token")).join(common, "token", "left")
    rare = each.groupBy("k_set").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    met = k.join(rare, "k_set").join(t.select("t_set", "t_ids", F.explode("t_set").alias("token")), "token").where(F.size(F.array_except("k_set", "t_set")) == 0)
    kind = F.when(F.size("k_set") == F.size("t_set"), "exact").when(F.size("k_set") >= 2, "contains")
    pairs = met.select(F.explode("k_ids").alias(keyword_id), "t_ids", kind.alias("kind")).where(F.col("kind").isNotNull())
    return pairs.select(keyword_id, F.explode("t_ids").alias(text_id), "kind")


def _held(rows: DataFrame, id_col: str, text: str, name: str, block: int = 128) -> DataFrame:
    """Ids by their sorted set of tokens, in arrays of at most ``block``."""
    r = rows.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens(F.col(text)))).alias(f"{name}_set")).where(F.size(f"{name}_set") > 0)
    part = F.floor((F.row_number().over(Window.partitionBy(f"{name}_set").orderBy("id")) - 1) / block)
    return r.withColumn("part", part).groupBy(f"{name}_set", "part").agg(F.collect_list("id").alias(f"{name}_ids")).drop("part")


def acquisition(plan: DataFrame, matches: DataFrame, keyword_id: str, group: str) -> DataFrame:
    """M2: per group how many planned keywords a query of it acquired, exactly or by containing them."""
    best = matches.groupBy(keyword_id).agg(F.max(F.when(F.col("kind") == "exact", 2).otherwise(1)).alias("k"))
    j = plan.join(best, keyword_id, "left")
    g = j.groupBy(group).agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("k") == 2).alias("exact"), F.count_if(F.col("k") == 1).alias("contained"))
    got = F.col("exact") + F.col("contained")
    return g.withColumn("coverage", F.round(got / F.col("planned"), 6)).withColumn("status", F.when(got == 0, "not_acquired").when(got == F.col("planned"), "acquired").otherwise("partial"))


def title_matches(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """M3, title evidence: all tokens of the main keyword in the title. A leading keyword has 1000, another 100, then 10 a character, less 3 for each character before it and 2 for each between its first and last token beyond its own length."""
    pairs = containment(groups, articles, "group_id", "article_id", "main_keyword", "title").select("group_id", "article_id")
    low, key = F.lower("title"), F.lower("main_keyword")
    positions = F.transform(tokens(F.col("main_keyword")), lambda t: F.struct(F.position(t, low).alias("at"), (F.position(t, low) + F.char_length(t)).alias("end")))
    j = pairs.join(groups, "group_id").join(articles, "article_id").withColumn("p", positions)
    start = F.array_min(F.transform("p", lambda x: x["at"])) - 1
    span = F.array_max(F.transform("p", lambda x: x["end"])) - 1 - start - F.char_length(key)
    score = F.when(low.startswith(key), 1000).otherwise(100) + 10 * F.char_length(key) - 3 * start - 2 * F.greatest(F.lit(0), span)
    return j.select("group_id", "article_id", score.alias("score"), low.startswith(key).alias("leading"))


def unique_winners(scored: DataFrame, key: str, candidate: str) -> DataFrame:
    """M3: the best candidate of a key if no other has its score; else the key stays unresolved. A row may stand for several candidates (``copies``)."""
    copies = F.col("copies") if "copies" in scored.columns else F.lit(1)
    same = scored.groupBy(key, "score").agg(F.sum(copies).alias("n"), F.min(candidate).alias("c"))
    g = same.groupBy(key).agg(F.max_by(F.struct("n", "c"), "score").alias("t"), F.max("score").alias("score")).select(key, "score", "t.n", "t.c")
    return g.select(key, F.when(F.col("n") == 1, F.col("c")).alias(candidate), "score", F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("state"))


def selection_ladder(tiers: list[tuple[str, DataFrame]], key: str, candidate: str) -> DataFrame:
    """M3: the first tier of evidence that has a unique winner decides."""
    keys = None
    for _, df in tiers:
        k = df.select(key).distinct()
        keys = k if keys is None else keys.union(k)
    out, names, picks = keys.distinct(), [], []
    for i, (name, df) in enumerate(tiers):
        won = unique_winners(df, key, candidate).where("state = 'matched'").select(key, F.col(candidate).alias(f"c{i}"))
        out = out.join(won, key, "left")
        picks.append(F.col(f"c{i}"))
        names.append(F.when(F.col(f"c{i}").isNotNull(), name))
    return out.select(key, F.coalesce(*picks).alias(candidate), F.coalesce(*names, F.lit("unresolved")).alias("evidence"))


def reconcile_assignments(matches: DataFrame) -> DataFrame:
    """M4: one group for each article: the highest score, then the smallest group; the others are demoted."""
    w = Window.partitionBy("article_id").orderBy(F.desc("score"), "group_id")
    return matches.withColumn("n_", F.row_number().over(w)).select("group_id", "article_id", "score", F.when(F.col("n_") == 1, "assigned").otherwise("demoted").alias("state"))


def topic_proposals(topics: DataFrame, groups: DataFrame) -> DataFrame:
    """M5: a topic's lexical overlap with every group that shares a token: in its own group, across, or unmatched; priority round(30 or 20 + 5 min(tasks, 10) + 100 own + 10 cross)."""
    t, g = token_sets(topics, "topic_id", "topic"), token_sets(groups, "group_id", "main_keyword")
    o = t.alias("t").join(g.alias("g"), F.col("t.token") == F.col("g.token")).groupBy("t.topic_id", F.col("g.group_id").alias("other_group")).agg((F.count(F.lit(1)) / F.least(F.first("t.size"), F.first("g.size"))).alias("overlap"))
    j = topics.join(o, "topic_id", "left")
    own = F.coalesce(F.max(F.when(F.col("other_group") == F.col("group_id"), F.col("overlap"))), F.lit(0.0))
    cross = F.coalesce(F.max(F.when(F.col("other_group") != F.col("group_id"), F.col("overlap"))), F.lit(0.0))
    r = j.groupBy("topic_id").agg(own.alias("own"), cross.alias("cross"), F.first("tasks").alias("tasks"), F.first("is_question").alias("q"))
    return r.select(
        "topic_id", F.round("own", 6).alias("own_overlap"), F.round("cross", 6).alias("cross_overlap"), F.when(F.col("own") >= F.greatest(F.col("cross"), F.lit(1e-9)), "same_group").when(F.col("cross") > 0, "cross_group").otherwise("unmatched").alias("match"),
        F.round(F.when(F.col("q"), 30).otherwise(20) + 5 * F.least(F.col("tasks"), F.lit(10)) + 100 * F.col("own") + 10 * F.col("cross")).alias("priority"),
    )


def topic_coverage(topics: DataFrame, assigned: DataFrame, titles: DataFrame, headings: DataFrame) -> DataFrame:
    """Whether the article of a topic's group covers it in its title, in a heading, or not; without an article it is unassigned. Only the group's own article is looked at."""
    j = topics.join(assigned, "group_id", "left")
    t = j.join(titles, "article_id", "left").join(headings, "article_id", "left")
    inside = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lower("topic")), F.lit(False))
    g = t.groupBy("topic_id").agg(F.max("article_id").alias("article_id"), F.bool_or(inside("title")).alias("t"), F.bool_or(inside("heading")).alias("h"))
    return g.select("topic_id", F.when(F.col("article_id").isNull(), "unassigned").when(F.col("t"), "covered_title").when(F.col("h"), "covered_heading").otherwise("missing").alias("coverage"))


def gram_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_l: str, text_r: str) -> DataFrame:
    """Dice of bigram sets for the pairs that share a bigram: others score 0, so the inverted join loses nothing.

    Each distinct text of the right side is compared once, however many rows have it.
    """
    said = F.lower(F.col(text_r))
    a = left.select(left_id, F.explode(grams(F.lower(F.col(text_l)))).alias("g"))
    b = right.select(said.alias("said_")).distinct().select("said_", F.explode(grams(F.col("said_"))).alias("g"))
    shared = a.join(b, "g").groupBy(left_id, "said_").agg(F.count(F.lit(1)).alias("both_"))
    sized = left.select(left_id, F.size(grams(F.lower(F.col(text_l)))).alias("na"))
    rows = right.select(right_id, said.alias("said_"), F.size(grams(said)).alias("nb"))
    return shared.join(sized, left_id).join(rows, "said_").select(left_id, right_id, (2 * F.col("both_") / (F.col("na") + F.col("nb"))).alias("dice"))


def citation_coverage(claims: DataFrame, recommended: DataFrame, citations: DataFrame, wanted: int = 3) -> DataFrame:
    """Claims with all, some or none of the citations wanted, and how many domains these are from."""
    j = claims.select("claim_id").join(recommended.select("claim_id", "citation_id"), "claim_id", "left").join(citations.select("citation_id", "domain"), "citation_id", "left")
    g = j.groupBy("claim_id").agg(F.count("citation_id").alias("citations"), F.count_distinct("domain").alias("domains"))
    return g.withColumn("coverage", F.when(F.col("citations") == 0, "none").when(F.col("citations") >= wanted, "complete").otherwise("partial"))


def evidence_resolution(claims: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Of a claim's evidence ids (evidence_type, evidence_id), how many are found in the table of their type."""
    found = None
    for kind, df in known.items():
        part = df.select(F.lit(kind).alias("evidence_type"), F.col("id").alias("evidence_id")).distinct().withColumn("found", F.lit(True))
        found = part if found is None else found.unionByName(part)
    g = claims.join(found, ["evidence_type", "evidence_id"], "left").groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"), F.count("found").alias("resolved"))
    return g.withColumn("rate", F.round(F.col("resolved") / F.col("evidence"), 6)).withColumn("state", F.when(F.col("resolved") == F.col("evidence"), "resolved").when(F.col("resolved") == 0, "unresolved").otherwise("partial"))


def claim_queue(claims: DataFrame, claim_class, size: int = 100) -> DataFrame:
    """Claims by class and id, in batches of ``size`` within their class."""
    c = claims.withColumn("priority", claim_class)
    return c.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("priority").orderBy("claim_id")) - 1) / size).cast("bigint"))


def content_gap_actions(coverage: DataFrame) -> DataFrame:
    """Groups with missing topics (group_id, article_id, coverage): P1 where there is an article, else P2."""
    g = coverage.where("coverage = 'missing'").groupBy("group_id").agg(F.max("article_id").alias("a_"))
    return g.select(F.concat(F.lit("content-gap:"), F.col("group_id").cast("string")).alias("action_id"), F.when(F.col("a_").isNull(), "P2").otherwise("P1").alias("band"), F.lit(0.0).alias("impact"))


def draft_actions(drafts: DataFrame) -> DataFrame:
    """Drafts (group_id, revision, publication_state) whose publication is blocked: P0."""
    i = F.concat(F.lit("draft-source:"), F.col("group_id").cast("string"), F.lit(":r"), F.col("revision").cast("string"))
    return drafts.where("publication_state = 'blocked'").select(i.alias("action_id"), F.lit("P0").alias("band"), F.lit(0.0).alias("impact"))


def topology_actions(topology: DataFrame) -> DataFrame:
    """Group pairs (left_group, right_group, decision, review_required): P1 to consolidate, else P2."""
    i = F.concat(F.lit("topology:"), F.col("left_group").cast("string"), F.lit(":"), F.col("right_group").cast("string"))
    return topology.where("review_required").select(i.alias("action_id"), F.when(F.col("decision") == "consolidation_review", "P1").otherwise("P2").alias("band"), F.lit(0.0).alias("impact"))


def link_actions(links: DataFrame) -> DataFrame:
    """Links that are missing between groups (source_group, target_group): P2."""
    i = F.concat(F.lit("internal-link:"), F.col("source_group").cast("string"), F.lit(":"), F.col("target_group").cast("string"))
    return links.select(i.alias("action_id"), F.lit("P2").alias("band"), F.lit(0.0).alias("impact"))


def format_actions(features: DataFrame) -> DataFrame:
    """Tasks with result features (task_id, rank): P1 with one in the first three places, else P2."""
    g = features.groupBy("task_id").agg(F.coalesce(F.min("rank") <= 3, F.lit(False)).alias("top_"))
    return g.select(F.concat(F.lit("serp-format:"), F.col("task_id").cast("string")).alias("action_id"), F.when(F.col("top_"), "P1").otherwise("P2").alias("band"), F.lit(0.0).alias("impact"))


def sense_actions(senses: DataFrame) -> DataFrame:
    """Open sense tasks (group_id, state, priority_band, priority_score, candidate_ids, readiness, samples) of a group: its highest band; impact = scores + 10 for each candidate affected + 25 for each sense without a unique path + samples."""
    open_ = senses.where(F.col("state").isin("unreviewed", "unresolved_deferred", "reviewer_disagreement"))
    n = open_.select("group_id", F.explode("candidate_ids").alias("c")).distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("n_"))
    vague = F.coalesce(F.col("readiness") != "unique_path_supported_sense", F.lit(True))
    g = open_.groupBy("group_id").agg(F.least(F.lit("P2"), F.min("priority_band")).alias("band"), (F.sum("priority_score") + 25 * F.count_if(vague) + F.sum("samples")).alias("s_")).join(n, "group_id", "left")
    return g.select(F.concat(F.lit("semantic-sense:"), F.col("group_id").cast("string")).alias("action_id"), "band", (F.col("s_") + 10 * F.coalesce("n_", F.lit(0))).cast("double").alias("impact"))


def monitor_actions(plan: DataFrame) -> DataFrame:
    """Sites with candidates for rank monitoring (site_id): P3."""
    return plan.select("site_id").distinct().select(F.concat(F.lit("rank-monitor:"), F.col("site_id").cast("string")).alias("action_id"), F.lit("P3").alias("band"), F.lit(0.0).alias("impact"))


def action_queue(producers: dict[str, DataFrame]) -> DataFrame:
    """The actions (action_id, band, impact) of several producers, by action type. The band belongs to the producer's rule. The queue's order: band, impact from the largest, type, id."""
    parts = [df.select(F.lit(kind).alias("action_type"), "action_id", "band", "impact") for kind, df in producers.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("band", F.desc("impact"), "action_type", "action_id")


def cannibalisation(rows: DataFrame) -> DataFrame:
    """Queries that land on more than one article."""
    return rows.groupBy("query").agg(F.count_distinct("article_id").alias("articles"), F.sum("impressions").alias("impressions"), F.max_by("article_id", F.struct("impressions", -F.col("article_id"))).alias("leading_article")).where("articles > 1")


def quality_join(candidates: DataFrame, verdicts: dict[str, DataFrame]) -> DataFrame:
    """Verdicts (candidate_id, state) of several reviews: blocked if one blocks, for the editor if one needs review or is missing, else ready; with the reasons."""
    j = candidates.select("candidate_id")
    for name, df in verdicts.items():
        j = j.join(df.select("candidate_id", F.col("state").alias(name)), "candidate_id", "left")
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(F.col(n), F.lit("missing")) != "ready", F.concat(F.lit(n + ":"), F.coalesce(F.col(n), F.lit("missing")))) for n in verdicts)))
    blocked = F.exists(F.array(*(F.coalesce(F.col(n), F.lit("missing")) for n in verdicts)), lambda x: x == "blocked")
    return j.select("candidate_id", F.when(blocked, "blocked").when(F.size(reasons) > 0, "editor_review").otherwise("ready").alias("state"), F.array_join(reasons, ",").alias("reasons"))


def readiness(gates: DataFrame, weakest: tuple[str, ...] = ("blocked", "review_required", "pass")) -> DataFrame:
    """Gate rows (group_id, gate, state) by group: the worst state decides; counts of each."""
    s = F.col("state")
    g = gates.groupBy("group_id").agg(F.count(F.lit(1)).alias("gates"), *(F.count_if(s == x).alias(x) for x in weakest))
    return g.withColumn("readiness", F.when(F.col("blocked") > 0, "blocked").when(F.col("review_required") > 0, "review_required").otherwise("pass"))


def two_sided(units: DataFrame, least: float = 90.0) -> DataFrame:
    """Percent of units on each side and on both; pass from ``least`` on."""
    p = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 6)
    a, b = F.col("target_observed"), F.col("page_agrees")
    return units.groupBy("packet_id").agg(p(a).alias("target_observed"), p(b).alias("page_agreement"), p(a & b).alias("both_sides")).withColumn("passed", F.col("both_sides") >= least)


def related_search(keywords: DataFrame, query: str) -> DataFrame:
    """G19, lexical part: min(60, 45 shared / query tokens + 15 if it contains the query), over keywords that share a token."""
    words = sorted(set(query.lower().split()))
    t = token_sets(keywords, "source_keyword_id", "raw_keyword").where(F.col("token").isin(words))
    n = t.groupBy("source_keyword_id").agg(F.count(F.lit(1)).alias("shared"))
    j = n.join(keywords, "source_keyword_id")
    return j.select("source_keyword_id", "raw_keyword", F.round(F.least(F.lit(60.0), 45 * F.col("shared") / len(words) + F.when(F.contains(F.lower("raw_keyword"), F.lit(query.lower())), 15).otherwise(0)), 6).alias("score"))


def related_proposals(groups: DataFrame, keywords: DataFrame, associations: DataFrame, k: int = 20, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """For each group the ``k`` best unacquired keywords that share a term with its seeds, or have one associated with them from .15 on: 100 (shared / the candidate's terms) + 30 association + min(20, 5 log10(volume + 1)).

    ``groups``: group_id, site_id, seed (one row a seed text), comparison (null, or a keyword that the group has already); ``keywords``: source_keyword_id, representative_id or null, site_id, raw_keyword, volume, state; ``associations``: term,
    associated_term, cosine. Generic terms do not count; of keywords with one representative the best is proposed. Seeds are spread along associations before keywords are met, so each (group, term) is joined once.
    """
    seeds = groups.select("group_id", "site_id", F.explode(F.array_distinct(tokens(F.col("seed")))).alias("token")).where(~F.col("token").isin(*generic)).distinct()
    near = seeds.join(associations.select(F.col("term").alias("token"), "associated_term", "cosine"), "token").select("group_id", "site_id", F.col("associated_term").alias("token"), F.lit(0).alias("own"), F.col("cosine").cast("double").alias("cosine"))
    reach = seeds.select("group_id", "site_id", "token", F.lit(1).alias("own"), F.lit(0.0).alias("cosine")).unionByName(near).groupBy("group_id", "site_id", "token").agg(F.max("own").alias("own"), F.max("cosine").alias("cosine"))
    terms = F.filter(F.array_distinct(tokens(F.col("raw_keyword"))), lambda t: ~t.isin(*generic))
    open_ = keywords.where("state = 'unacquired'").withColumn("t_", terms)
    w = open_.select("source_keyword_id", "site_id", F.size("t_").alias("size"), F.explode("t_").alias("token"))
    j = w.join(reach, ["site_id", "token"]).groupBy("group_id", "source_keyword_id").agg((F.sum("own") / F.first("size")).alias("overlap"), F.max("cosine").alias("association"))
    j = j.where((F.col("overlap") > 0) | (F.col("association") >= 0.15)).join(open_.select("source_keyword_id", "representative_id", "raw_keyword", "volume"), "source_keyword_id")
    had = groups.where("comparison IS NOT NULL").select("group_id", F.lower("comparison").alias("k_")).distinct()
    j = j.withColumn("k_", F.lower("raw_keyword")).join(had, ["group_id", "k_"], "left_anti")
    score = F.round(100 * F.col("overlap") + 30 * F.col("association") + F.least(F.lit(20.0), 5 * F.log10(F.coalesce("volume", F.lit(0)) + 1)), 6)
    order = [F.desc("score"), F.desc(F.coalesce("volume", F.lit(0))), "source_keyword_id"]
    one = Window.partitionBy("group_id", F.coalesce("representative_id", "source_keyword_id")).orderBy(*order)
    s = j.withColumn("score", score).withColumn("n_", F.row_number().over(one)).where("n_ = 1")
    return s.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where(F.col("position") <= k).select("group_id", "source_keyword_id", "score", "position")
