"""Contiguous shards of equal bytes, with DataFrame functions only.

Rows are range-partitioned by id; each partition's total and the totals of those before it give
every row its place in one global prefix sum, which is cut at equal targets. Only ids, sizes and
checksums are shuffled, never texts, and nothing but one total a partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quaystone.plans.storage import materialise


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, size long, text_crc32 long, law, shard int, slot long, grown_shard int) of every row.

    size: UTF-8 bytes of the text (null: none) plus ``overhead``. The law is ``bytes``: in id order a
    row goes to the shard in whose equal part of all bytes its first byte falls, so a shard is off
    its target by less than one row. slot is gapless from 0 within a shard. grown_shard is null, as
    only a law by key has it. Null ids come first; repeated ids and rows are separate rows, in the
    order in which they are read; a frequent id does not fill one partition, as the place in the
    input breaks ties. An empty table gives no rows; if
    no row has any size, all are in shard 0.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id_"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row_")
    )
    # A written table fixes which rows are in which partition, whatever is recomputed later.
    dealt = materialise(sized.repartitionByRange(parts, "id_", "row_").withColumn("part_", F.spark_partition_id()), "sized")
    totals = dealt.groupBy("part_").agg(F.sum("size").alias("bytes_"))
    # One row a partition, whatever the number of rows.
    before = totals.withColumn("before_", F.coalesce(F.sum("bytes_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_", F.sum("bytes_").over(Window.partitionBy()))
    order = Window.partitionBy("part_").orderBy(F.col("id_").asc_nulls_first(), "row_")
    placed = (
        dealt.join(F.broadcast(before.select("part_", "before_", "all_")), "part_")
        .withColumn("first_", F.col("before_") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("shard", F.when(F.col("all_") == 0, 0).otherwise(F.floor(F.col("first_").cast("decimal(30,0)") * shards / F.col("all_").cast("decimal(30,0)"))).cast("int"))
        .withColumn("in_part_", F.row_number().over(order))
    )
    # At most partitions + shards rows: where each shard's share of a partition begins.
    shares = placed.groupBy("part_", "shard").agg(F.count(F.lit(1)).alias("rows_"), F.min("in_part_").alias("from_"))
    shares = shares.withColumn("slots_", F.coalesce(F.sum("rows_").over(Window.partitionBy("shard").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "shard", "from_", "slots_")
    return placed.join(F.broadcast(shares), ["part_", "shard"]).select(
        F.col("id_").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("in_part_") - F.col("from_") + F.col("slots_")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
