"""Scans: snapshots, quoted CSV, compressed reference tables, sitemaps. Declared schemas, no inference."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from quaystone.functions import urls
from quaystone.plans.storage import materialise

RESULT = (
    "tasks array<struct<id:string,status_code:int,cost:double,data:struct<keyword:string,location_code:int,language_code:string,device:string,os:string,depth:int,tag:string>,"
    "result:array<struct<datetime:string,item_types:array<string>,items:array<struct<type:string,rank_group:int,rank_absolute:int,domain:string,title:string,url:string,description:string,timestamp:string,"
    "items:array<string>>>>>>>"
)


def raw_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Every ``raw/*.json`` under the root with its digest, size and dataset (the first folder); files without a task or a result are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).where(F.col("path").rlike("/raw/[^/]+\\.json$"))
    rel = F.substring_index("path", re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/") + "/", -1)
    return parse_snapshots(files.select("path", F.split(rel, "/")[0].alias("dataset"), "content"))


def parse_snapshots(texts: DataFrame) -> DataFrame:
    """S1 for (path, dataset, content) of any source: digest and size of the bytes, the first task and its first result."""
    parsed = texts.select("path", "dataset", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.octet_length(F.col("content").cast("binary")).alias("bytes"), F.from_json(F.col("content").cast("string"), RESULT).alias("j"))
    task = F.col("j.tasks")[0]
    return parsed.select("path", "dataset", "digest", "bytes", task["id"].alias("task_id"), task["status_code"].alias("status_code"), task["cost"].alias("cost"), task["data"].alias("data"), task["result"][0].alias("result")).where(F.col("task_id").isNotNull() & F.col("result").isNotNull())


def duplicate_tasks(snapshots: DataFrame) -> DataFrame:
    """Task ids that occur more than once; such a set of snapshots is refused."""
    return snapshots.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def organic(snapshots: DataFrame) -> DataFrame:
    """Organic items with a URL, and their canonical form."""
    i = snapshots.select("task_id", F.inline("result.items"))
    return i.where((F.col("type") == "organic") & F.col("url").isNotNull()).select("task_id", "rank_group", "rank_absolute", "domain", "title", "url", "description", "timestamp", urls.canonical_serp_url(F.col("url")).alias("canonical_url"))


def feature_items(snapshots: DataFrame) -> DataFrame:
    """Features other than organic, with their number of items; ids are digests."""
    i = snapshots.select("task_id", F.posexplode("result.items").alias("item_order", "item")).where("item.type <> 'organic'")
    return i.select("task_id", "item_order", F.col("item.type").alias("feature_type"), F.sha2(F.concat_ws(":", "task_id", "item_order"), 256).alias("feature_id"), F.coalesce(F.size("item.items"), F.lit(0)).alias("n_items"))


def demand_occurrences(snapshots: DataFrame) -> DataFrame:
    """Titles of questions and texts of related searches, in their order."""
    i = snapshots.select("task_id", F.col("data.keyword").alias("keyword"), F.posexplode("result.items").alias("parent", "item")).where("item.type in ('people_also_ask', 'related_searches')")
    v = i.select("task_id", "keyword", "parent", F.col("item.type").alias("demand_type"), F.posexplode("item.items").alias("occurrence_order", "raw"))
    value = F.coalesce(F.get_json_object("raw", "$.title"), F.when(~F.col("raw").startswith("{"), F.col("raw")))
    return v.withColumn("value", value).where(F.col("value").isNotNull()).drop("raw")


def paa_answers(rows: DataFrame) -> DataFrame:
    """Questions (question_id, requested, answer, pending) with the best state of their rows: resolved, async_pending, empty, not_requested_or_missing."""
    level = F.when(F.col("answer").isNotNull() & (F.col("answer") != ""), 3).when(F.col("pending"), 2).when(F.col("requested"), 1).otherwise(0)
    g = rows.groupBy("question_id").agg(F.max(level).alias("level"), F.max_by("answer", level).alias("answer"))
    names = F.array(*map(F.lit, ("not_requested_or_missing", "empty", "async_pending", "resolved")))
    return g.select("question_id", F.element_at(names, F.col("level") + 1).alias("response_state"), F.when(F.col("level") == 3, F.col("answer")).alias("answer"))


def element_sources(elements: DataFrame, references: DataFrame) -> DataFrame:
    """Overview elements (task_id, element_id, urls) against the overview's own references (task_id, url): referenced, link_only, unreferenced."""
    e = elements.select("task_id", "element_id", F.explode_outer("urls").alias("link")).withColumn("url", urls.canonical_serp_url(F.col("link")))
    r = references.select("task_id", urls.canonical_serp_url(F.col("url")).alias("url")).distinct().withColumn("ref", F.lit(True))
    g = e.join(r, ["task_id", "url"], "left").groupBy("task_id", "element_id").agg(F.count("link").alias("links"), F.count("ref").alias("references"))
    return g.withColumn("lineage", F.when(F.col("references") > 0, "referenced").when(F.col("links") > 0, "link_only").otherwise("unreferenced"))


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, doubled quotes, line breaks in cells and a BOM; all-empty rows go, missing cells are empty texts."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", True).csv(path)
    return df.dropna(how="all").na.fill("")


def export_number(c):
    """S3: 1,234 and 5% as numbers, percentages as fractions."""
    n = F.regexp_replace(c, "[,%]", "").try_cast("double")
    return F.when(c.endswith("%"), n / 100).otherwise(n)


def reference_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table, compressed or not; lines of another width fail."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def checked_table(spark: SparkSession, path: str, schema: str, key: list[str], rows: int | None = None, digest: str | None = None) -> DataFrame:
    """A tab-separated table as a stored one, refused as a whole if it is not what was announced.

    Width, number of rows and digest are observed in the pass that stores the table; then keys have to be
    unique and not null. The digest is :func:`row_digest`: it does not depend on order, files or compression. ValueError names
    every expectation that fails. ``rows`` and ``digest`` are not looked at where they are None.
    """
    bad = "corrupt_"
    read = spark.read.schema(f"{schema}, {bad} string").option("sep", "\t").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    names = [c for c in read.columns if c != bad]
    seen = Observation()
    stored = materialise(read.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(bad).alias("corrupt"), row_digest(names).alias("digest")), "checked").drop(bad)
    got = seen.get
    wrong = [f"{got['corrupt']} lines of another width or type"] if got["corrupt"] else []
    if rows is not None and got["rows"] != rows:
        wrong.append(f"{got['rows']} rows instead of {rows}")
    if digest is not None and got["digest"] != digest:
        wrong.append(f"digest {got['digest']} instead of {digest}")
    if stored.where(" or ".join(f"`{k}` is null" for k in key)).limit(1).count():
        wrong.append("a null key")
    if stored.groupBy(*key).count().where("count > 1").limit(1).count():
        wrong.append("a repeated key")
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return stored


def row_digest(names: list[str]) -> Column:
    """An aggregate: the number of rows and the sum of their hashes, as text; '0:0' for none. Nulls and empty strings differ."""
    row = F.xxhash64(*(F.struct(F.col(n).isNull(), F.col(n)) for n in names)).cast("decimal(38,0)")
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").cast("string"))


def missing_requests(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """What was asked for and not returned with status 20000."""
    return requested.select(key).distinct().join(returned.where("status_code = 20000").select(key).distinct(), key, "left_anti")


def sitemap(text: DataFrame, origin: str) -> DataFrame:
    """(sitemap_url, xml) to canonical URLs of the origin, the first entry of each, with its type."""
    locs = text.select("sitemap_url", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>.*?</url>"), F.lit(0))).alias("at", "entry"))
    u = locs.select("sitemap_url", "at", F.trim(F.regexp_extract("entry", r"(?s)<loc>(.*?)</loc>", 1)).alias("surface_url"), F.regexp_extract("entry", r"(?s)<lastmod>(.*?)</lastmod>", 1).alias("lastmod"))
    u = u.withColumn("canonical_url", urls.canonical_url(F.col("surface_url"))).where(F.col("surface_url").startswith(origin))
    path = urls.part(F.col("canonical_url"), 3)
    kind = F.when(path == "/", "home").when(path.rlike("sitemap"), "html_sitemap").when(F.col("sitemap_url").contains("post"), "post").when(F.col("sitemap_url").contains("page"), "page").otherwise("misc")
    first = Window.partitionBy("canonical_url").orderBy("sitemap_url", "at")
    return u.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select("surface_url", "canonical_url", "lastmod", "sitemap_url", kind.alias("surface_type"))


def postal_regions(rows: DataFrame) -> DataFrame:
    """Distinct prefectures and municipalities; a county before the municipality is its own column."""
    m = F.col("municipality")
    return rows.select("prefecture", F.regexp_extract(m, "^(.+?郡)", 1).alias("county"), F.regexp_replace(m, "^.+?郡", "").alias("municipality")).distinct()


def json_leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """For every leaf path of JSON texts how many are nonempty, empty, null, zero or false. Array positions are not part of the path."""
    import json

    def walk(value, path, out):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k, out)
        elif isinstance(value, list) and value:
            for v in value:
                walk(v, path + "[]", out)
        else:
            state = "null" if value is None else "false" if value is False else "empty" if value in ("", [], {}) and not isinstance(value, (int, float)) else "zero" if value == 0 and not isinstance(value, bool) else "nonempty"
            out.append((path, state))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["json_"]:
                if text is not None:
                    try:
                        walk(json.loads(text), "", out)
                    except ValueError:
                        out.append(("", "invalid"))
            yield pd.DataFrame(out, columns=["path", "state"])

    leaves = rows.select(F.col(json_col).alias("json_")).mapInPandas(run, "path string, state string")
    s = F.col("state")
    return leaves.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(s == x).alias(x) for x in ("nonempty", "empty", "null", "zero", "false", "invalid")))
