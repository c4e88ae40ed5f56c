"""Payloads whose items differ in type, read as VARIANT: feature items with links, and provider responses.

A payload is parsed once; what is asked for is taken from it by path, and a part that is missing or of
another type is null. Nothing is inferred, and no item is lost for its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quaystone.functions.text import normalize_keyword


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{path}", kind)


def _each(v: str, path: str) -> Column:
    """The members of an array, whatever their types."""
    return F.posexplode(_get(v, path, "array<variant>"))


def _text(v: Column) -> Column:
    """A member that is a string, as it is; null for any other."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def feature_payload_items(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, links) of features (feature_id, task_id, group_id, feature_type, payload as JSON text).

    Every member of the payload's ``items`` is a row in its order: a string is an item of type
    ``text``, an object without a type is ``unknown``, and so is a null. Links of an item are rows of the
    second table, with their feature. Ids are digests of the feature, the place, the type and the item. A payload that is no
    JSON, or has no items, has no rows.
    """
    at = features.select("feature_id", "task_id", "group_id", "feature_type", F.try_parse_json("payload").alias("p_")).select("feature_id", "task_id", "group_id", "feature_type", _each("p_", "items").alias("item_order", "v_"))
    kind = F.when(_text(F.col("v_")).isNotNull(), "text").otherwise(F.coalesce(_get("v_", "type"), F.lit("unknown")))
    body = F.coalesce(F.to_json("v_"), F.lit("null"))
    items = at.withColumn("item_type", kind).withColumn("payload", body)
    items = items.withColumn("feature_item_id", F.sha2(F.concat_ws("\n", "feature_id", "item_order", "item_type", "payload"), 256))
    fields = {"text": F.coalesce(_text(F.col("v_")), _get("v_", "text"))} | {n: _get("v_", n) for n in ("title", "alt", "source", "url", "image_url")} | {"published_at": _get("v_", "timestamp")}
    links = items.select("feature_id", "feature_item_id", _each("v_", "links").alias("link_order", "l_"))
    links = links.select("feature_id", "feature_item_id", "link_order", *(_get("l_", n).alias(n) for n in ("title", "url", "domain", "description")), F.to_json("l_").alias("payload"))
    links = links.withColumn("link_id", F.sha2(F.concat_ws("\n", "feature_item_id", "link_order", "payload"), 256))
    return items.select("feature_item_id", "feature_id", "task_id", "group_id", "feature_type", "item_order", "item_type", *(c.alias(n) for n, c in fields.items()), "payload"), links


def _results(responses: DataFrame, kind: str) -> DataFrame:
    """Each result of the tasks with status 20000, as ``r_``, with the identity of its response."""
    tasks = responses.where(F.col("kind") == kind).select("site_id", F.col("job_id").alias("source_job_id"), F.col("raw_digest").alias("source_digest"), F.try_parse_json("body").alias("b_"))
    tasks = tasks.select("site_id", "source_job_id", "source_digest", _each("b_", "tasks").alias("n_", "t_")).where(_get("t_", "status_code", "int") == 20000)
    return tasks.select("site_id", "source_job_id", "source_digest", _each("t_", "result").alias("n_", "r_")).drop("n_")


_SOURCE = ("site_id", "source_job_id", "source_digest")


def _keyword(v: str, path: str) -> list[Column]:
    return [_get(v, path).alias("keyword"), normalize_keyword(_get(v, path)).alias("normalized_keyword")]


def enrichment_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """Tables of provider responses (site_id, job_id, kind, raw_digest, body as JSON text).

    keyword_metrics and their monthly_searches, difficulties, ranked_summaries and ranked_keywords. Only
    tasks with status 20000 count; a number that is absent is null, not 0. Where an item has no
    location, language or type of its own, that of its result counts.
    """
    metrics = _results(responses, "keyword_metrics")
    difficulty = _results(responses, "keyword_difficulty").select(*_SOURCE, "r_", _each("r_", "items").alias("n_", "i_"))
    ranked = _results(responses, "ranked_keywords")
    rows = ranked.select(*_SOURCE, "r_", _each("r_", "items").alias("n_", "i_"))
    data, serp = "keyword_data", "ranked_serp_element.serp_item"
    return {
        "keyword_metrics": metrics.select(
            *_SOURCE, *_keyword("r_", "keyword"), _get("r_", "spell").alias("spell"), _get("r_", "location_code", "long").alias("location_code"), _get("r_", "language_code").alias("language_code"),
            F.coalesce(_get("r_", "search_partners", "boolean"), F.lit(False)).alias("search_partners"), _get("r_", "competition").alias("competition_level"), _get("r_", "competition_index", "long").alias("competition_index"),
            _get("r_", "search_volume", "long").alias("search_volume"), *(_get("r_", n, "double").alias(n) for n in ("low_top_of_page_bid", "high_top_of_page_bid", "cpc")),
        ),
        "monthly_searches": metrics.select(*_SOURCE, *_keyword("r_", "keyword"), _each("r_", "monthly_searches").alias("n_", "m_")).select(
            *_SOURCE, "keyword", "normalized_keyword", *(_get("m_", n, "long").alias(n) for n in ("year", "month", "search_volume"))
        ),
        "difficulties": difficulty.select(
            *_SOURCE, *_keyword("i_", "keyword"), _get("i_", "keyword_difficulty", "long").alias("keyword_difficulty"), F.coalesce(_get("i_", "se_type"), _get("r_", "se_type")).alias("se_type"),
            _get("r_", "location_code", "long").alias("location_code"), _get("r_", "language_code").alias("language_code"),
        ),
        "ranked_summaries": ranked.select(
            *_SOURCE, _get("r_", "target").alias("target"), _get("r_", "location_code", "long").alias("location_code"), _get("r_", "language_code").alias("language_code"), _get("r_", "total_count", "long").alias("total_count"),
            F.coalesce(_get("r_", "items_count", "long"), F.greatest(F.size(_get("r_", "items", "array<variant>")), F.lit(0)).cast("long")).alias("items_count"), F.to_json(_get("r_", "metrics", "variant")).alias("metrics"),
        ),
        "ranked_keywords": rows.select(
            *_SOURCE, *_keyword("i_", f"{data}.keyword"), F.coalesce(_get("i_", f"{data}.location_code", "long"), _get("r_", "location_code", "long")).alias("location_code"),
            F.coalesce(_get("i_", f"{data}.language_code"), _get("r_", "language_code")).alias("language_code"), _get("i_", f"{data}.keyword_info.search_volume", "long").alias("search_volume"),
            *(_get("i_", f"{data}.keyword_info.{n}", "double").alias(n) for n in ("cpc", "competition")), _get("i_", f"{data}.keyword_info.competition_level").alias("competition_level"),
            _get("i_", f"{data}.keyword_properties.keyword_difficulty", "long").alias("keyword_difficulty"), _get("i_", f"{data}.search_intent_info.main_intent").alias("main_intent"),
            F.coalesce(_get("i_", f"{data}.search_intent_info.foreign_intent", "array<string>"), F.array().cast("array<string>")).alias("foreign_intents"), _get("i_", f"{serp}.type").alias("serp_type"),
            *(_get("i_", f"{serp}.{n}", "long").alias(n) for n in ("rank_group", "rank_absolute")), *(_get("i_", f"{serp}.{n}").alias(n) for n in ("domain", "url", "relative_url", "title")),
            *(_get("i_", f"{serp}.{n}", "double").alias(n) for n in ("etv", "estimated_paid_traffic_cost")), *(F.to_json(_get("i_", f"{serp}.{n}", "variant")).alias(n) for n in ("rank_changes", "backlinks_info")),
        ),
    }


def enrichment_coverage(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, requested, returned, missing) of metrics and difficulties; requests are (kind, keyword).

    ``missing`` counts requested keywords of which no row came back under the same normalised form.
    """
    back = tables["keyword_metrics"].select(F.lit("keyword_metrics").alias("kind"), "normalized_keyword").unionByName(tables["difficulties"].select(F.lit("keyword_difficulty").alias("kind"), "normalized_keyword"))
    asked = requests.where(F.col("kind").isin("keyword_metrics", "keyword_difficulty")).select("kind", normalize_keyword(F.col("keyword")).alias("normalized_keyword"))
    lost = asked.join(back.distinct(), ["kind", "normalized_keyword"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("missing"))
    counts = asked.groupBy("kind").agg(F.count(F.lit(1)).alias("requested"))
    returned = back.groupBy("kind").agg(F.count(F.lit(1)).alias("returned"))
    return counts.join(returned, "kind", "left").join(lost, "kind", "left").na.fill(0, ["returned", "missing"])
