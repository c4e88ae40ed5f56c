"""Sinks: versioned tables behind a manifest, payload archives, TSV exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def publish(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write every table of a run to a folder of its own, then name the run in the manifest. Readers see the old run or the new one, never a mixture."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/runs/{run}/{name}")
    manifest = json.dumps({"run": run, "tables": sorted(tables)})
    spark.createDataFrame([(run, manifest)], "run string, manifest string").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table of the run that was published last."""
    last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("published_at"), F.desc("run")).first()
    return spark.read.parquet(f"{root}/runs/{last['run']}/{table}")


def archive_payloads(rows: DataFrame, path: str, key: str, payload: str, day: str) -> None:
    """Payloads with digest and size, partitioned by day, appended."""
    rows.select(key, F.col(payload).alias("payload"), F.sha2(F.col(payload).cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"), F.col(day).alias("day")).write.mode("append").partitionBy("day").parquet(path)


def tsv_cells(rows: DataFrame) -> DataFrame:
    """Cells of a tab-separated export: tabs and line breaks become a space."""
    return rows.select(*(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in rows.columns))


def export_tsv(rows: DataFrame, path: str) -> None:
    """Write the export."""
    tsv_cells(rows).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
