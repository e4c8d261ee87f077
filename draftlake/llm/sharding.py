"""Contiguous shards of near-equal size by prefix sums (operator 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import cut, read, shuffle_parts, text_or_empty


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cut the rows, in the order of ``key``, into contiguous shards of near-equal bytes.

    Returns key, size, text_crc32, shard and slot. The rows are dealt out by ranges of the key and
    each range's total gives the bytes and rows before it; inside a range a running sum does the
    rest. A row goes to the shard in which the middle of its bytes lies, so a shard's size is off
    its target by no more than its two end rows.

    Null text counts as no bytes (size 1); null keys come first; rows that repeat a key, or are
    alike in all columns, each get a slot of their own (a row number splits even one hot key over
    ranges); an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty(text)).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["k", "crc", "row"]
    dealt = cut(slim.repartitionByRange(shuffle_parts(spark), *order).withColumn("range", F.spark_partition_id()))

    # One row for each range: as many as there are partitions, whatever the input's size.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.join(F.broadcast(ranges), "range").select(
        "k",
        "size",
        "crc",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("index"),
        start.alias("start"),
        "total",
    )
    placed = placed.withColumn("shard", F.expr(f"least(cast({shards} * (2 * start + size) div (2 * total) as int), {shards - 1})"))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("index") - F.col("first")).alias("slot"),
    )


def op9_sharding(spark, sf_dir):
    return shard_by_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
