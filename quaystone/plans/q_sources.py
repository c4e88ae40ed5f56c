"""Queries of polymorphic payloads; the payloads are JSON texts made of rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.plans.catalog import Source, query
from quaystone.plans.storage import new_path
from quaystone.sources import payloads, readers


def _json(sql: str) -> str:
    """SQL whose braces are those of JSON, but for the table."""
    return sql.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")


#: A part is a feature with a text, a link element with one or two links, an item without a type, and every fifth has a null.
_FEATURES = """SELECT concat('f', CAST(p_partkey AS STRING)) AS feature_id, p_brand AS task_id, p_type AS group_id, CASE WHEN p_size % 2 = 0 THEN 'people_also_ask' ELSE 'images' END AS feature_type,
    concat('{"items":["', p_name, '",{"type":"link_element","title":"', p_brand, '","url":"https://x.example/', CAST(p_partkey AS STRING), '","links":[{"title":"', p_type, '","url":"https://y.example/', CAST(p_size AS STRING), '","domain":"y.example"}',
        CASE WHEN p_size % 3 = 0 THEN ',{"url":"https://z.example/"}' ELSE '' END, ']},{"text":"', p_type, '","alt":', CAST(p_size AS STRING), '}', CASE WHEN p_partkey % 5 = 0 THEN ',null' ELSE '' END, ']}') AS payload
    FROM {part}"""

_ITEM = "concat('f', CAST(p_partkey AS STRING)) AS feature_id, p_brand AS task_id, p_type AS group_id, CASE WHEN p_size % 2 = 0 THEN 'people_also_ask' ELSE 'images' END AS feature_type"


@query(
    "X3_feature_item_rows",
    f"""SELECT {_ITEM}, 0::BIGINT AS item_order, 'text' AS item_type, p_name AS text, NULL::VARCHAR AS title, NULL::VARCHAR AS alt, NULL::VARCHAR AS url FROM part
    UNION ALL SELECT {_ITEM}, 1, 'link_element', NULL, p_brand, NULL, concat('https://x.example/', CAST(p_partkey AS STRING)) FROM part
    UNION ALL SELECT {_ITEM}, 2, 'unknown', p_type, NULL, CAST(p_size AS STRING), NULL FROM part
    UNION ALL SELECT {_ITEM}, 3, 'unknown', NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0""",
)
def x3_items(s: Source):
    return payloads.feature_payload_items(s.sql(_json(_FEATURES)))[0].select("feature_id", "task_id", "group_id", "feature_type", "item_order", "item_type", "text", "title", "alt", "url")


@query(
    "X3_feature_links",
    """SELECT concat('f', CAST(p_partkey AS STRING)) AS feature_id, 0::BIGINT AS link_order, p_type AS title, concat('https://y.example/', CAST(p_size AS STRING)) AS url, 'y.example' AS domain FROM part
    UNION ALL SELECT concat('f', CAST(p_partkey AS STRING)), 1, NULL, 'https://z.example/', NULL FROM part WHERE p_size % 3 = 0""",
)
def x3_links(s: Source):
    return payloads.feature_payload_items(s.sql(_json(_FEATURES)))[1].select("feature_id", "link_order", "title", "url", "domain")


#: A part is the response of one job: metrics with two months, difficulties of two keywords, or ranked keywords; every eleventh failed.
_RESPONSES = """SELECT CAST(1 AS BIGINT) AS site_id, concat('j', CAST(p_partkey AS STRING)) AS job_id, CASE p_partkey % 3 WHEN 0 THEN 'keyword_metrics' WHEN 1 THEN 'keyword_difficulty' ELSE 'ranked_keywords' END AS kind, p_brand AS raw_digest,
    concat('{"tasks":[{"status_code":', CASE WHEN p_partkey % 11 = 0 THEN '40501' ELSE '20000' END, ',"result":[', CASE p_partkey % 3
        WHEN 0 THEN concat('{"keyword":"', p_name, ' ', CAST(p_partkey AS STRING), '","location_code":2392,"language_code":"ja","search_volume":', CASE WHEN p_size % 4 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END, ',"competition":"LOW","cpc":', CAST(p_size AS STRING), '.5,"monthly_searches":[{"year":2024,"month":1,"search_volume":', CAST(p_size AS STRING), '},{"year":2024,"month":2}]}')
        WHEN 1 THEN concat('{"se_type":"google","location_code":2392,"language_code":"ja","items":[{"keyword":"', p_name, ' ', CAST(p_partkey AS STRING), '","keyword_difficulty":', CAST(p_size AS STRING), '},{"keyword":"', p_type, '","se_type":"own"}]}')
        ELSE concat('{"target":"', p_brand, '","total_count":', CAST(p_size AS STRING), ',"location_code":2392,"language_code":"ja","items":[{"keyword_data":{"keyword":"', p_name, '","keyword_info":{"search_volume":', CAST(p_size AS STRING), '},"search_intent_info":{"main_intent":"commercial"}},"ranked_serp_element":{"serp_item":{"type":"organic","rank_group":', CAST(p_size % 10 + 1 AS STRING), ',"url":"https://x.example/', CAST(p_partkey AS STRING), '","etv":', CAST(p_size AS STRING), '.25}}},{"keyword_data":{"keyword":"', p_type, '","location_code":1}}]}')
    END, ']},{"status_code":40000,"result":null}]}') AS body
    FROM {part}"""

_FINE = "p_partkey % 11 <> 0"
_ROW = "CAST(1 AS BIGINT) AS site_id, concat('j', CAST(p_partkey AS STRING)) AS source_job_id"


def _enriched(s: Source, name: str):
    return payloads.enrichment_tables(s.sql(_json(_RESPONSES)))[name]


@query("S5_keyword_metrics", f"SELECT {_ROW}, lower(p_name) || ' ' || CAST(p_partkey AS STRING) AS normalized_keyword, 2392::BIGINT AS location_code, 'ja' AS language_code, 'LOW' AS competition_level, CASE WHEN p_size % 4 <> 0 THEN p_size::BIGINT END AS search_volume, p_size + 0.5::DOUBLE AS cpc, false AS search_partners FROM part WHERE p_partkey % 3 = 0 AND {_FINE}")
def s5_metrics(s: Source):
    return _enriched(s, "keyword_metrics").select("site_id", "source_job_id", "normalized_keyword", "location_code", "language_code", "competition_level", "search_volume", "cpc", "search_partners")


@query("S5_monthly_searches", f"SELECT {_ROW}, p_name || ' ' || CAST(p_partkey AS STRING) AS keyword, 2024::BIGINT AS year, m::BIGINT AS month, CASE m WHEN 1 THEN p_size::BIGINT END AS search_volume FROM part, (VALUES (1), (2)) v(m) WHERE p_partkey % 3 = 0 AND {_FINE}")
def s5_monthly(s: Source):
    return _enriched(s, "monthly_searches").select("site_id", "source_job_id", "keyword", "year", "month", "search_volume")


@query("S5_difficulties", f"SELECT {_ROW}, CASE i WHEN 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) ELSE p_type END AS keyword, CASE i WHEN 0 THEN p_size::BIGINT END AS keyword_difficulty, CASE i WHEN 0 THEN 'google' ELSE 'own' END AS se_type, 2392::BIGINT AS location_code FROM part, (VALUES (0), (1)) v(i) WHERE p_partkey % 3 = 1 AND {_FINE}")
def s5_difficulties(s: Source):
    return _enriched(s, "difficulties").select("site_id", "source_job_id", "keyword", "keyword_difficulty", "se_type", "location_code")


@query(
    "S5_ranked_keywords",
    f"""SELECT {_ROW}, CASE i WHEN 0 THEN p_name ELSE p_type END AS keyword, CASE i WHEN 0 THEN 2392 ELSE 1 END::BIGINT AS location_code, CASE i WHEN 0 THEN p_size::BIGINT END AS search_volume, CASE i WHEN 0 THEN 'commercial' END AS main_intent,
    CASE i WHEN 0 THEN p_size % 10 + 1 END::BIGINT AS rank_group, CASE i WHEN 0 THEN concat('https://x.example/', CAST(p_partkey AS STRING)) END AS url, CASE i WHEN 0 THEN p_size + 0.25::DOUBLE END AS etv FROM part, (VALUES (0), (1)) v(i) WHERE p_partkey % 3 = 2 AND {_FINE}""",
)
def s5_ranked(s: Source):
    return _enriched(s, "ranked_keywords").select("site_id", "source_job_id", "keyword", "location_code", "search_volume", "main_intent", "rank_group", "url", "etv")


@query("S5_ranked_summaries", f"SELECT {_ROW}, p_brand AS target, p_size::BIGINT AS total_count, 2::BIGINT AS items_count FROM part WHERE p_partkey % 3 = 2 AND {_FINE}")
def s5_summaries(s: Source):
    return _enriched(s, "ranked_summaries").select("site_id", "source_job_id", "target", "total_count", "items_count")


@query(
    "S5_coverage",
    f"""SELECT kind, count(*) AS requested, count(*) FILTER (ok) * CASE kind WHEN 'keyword_metrics' THEN 1 ELSE 2 END::BIGINT AS returned, count(*) FILTER (NOT ok) AS missing
    FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'keyword_metrics' ELSE 'keyword_difficulty' END AS kind, {_FINE} AS ok FROM part WHERE p_partkey % 3 < 2) p GROUP BY kind""",
)
def s5_coverage(s: Source):
    asked = s.part.where("p_partkey % 3 < 2").select(F.when(F.col("p_partkey") % 3 == 0, "keyword_metrics").otherwise("keyword_difficulty").alias("kind"), F.concat_ws(" ", "p_name", "p_partkey").alias("keyword"))
    return payloads.enrichment_coverage(asked, payloads.enrichment_tables(s.sql(_json(_RESPONSES))))


@query("S4_checked_table", "SELECT p_partkey, p_name, p_brand FROM part")
def s4_checked(s: Source):
    path, part = new_path(s.spark, "reference"), s.part.select("p_partkey", "p_name", "p_brand")
    part.write.option("sep", "\t").option("compression", "gzip").csv(path)
    told = part.agg(F.count(F.lit(1)).alias("n"), readers.row_digest(part.columns).alias("d")).first()
    return readers.checked_table(s.spark, path, "p_partkey long, p_name string, p_brand string", ["p_partkey"], told["n"], told["d"])
