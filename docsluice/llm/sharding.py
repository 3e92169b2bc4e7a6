"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm._common import saved

#: Bytes that every row costs besides its text.
OVERHEAD = 8


def placed(rows: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """rows, which have `size`, with shard and slot.

    The rows are range-partitioned by `order` and written with the number of their partition; totals of the
    partitions give where each begins, and only rows of one partition are sorted together. A row belongs to the
    shard in which the middle of its bytes lies, when all bytes are cut at equal targets.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    ranged = rows.withColumn("sh_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "sh_tie")
    kept = saved(ranged.withColumn("sh_part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("sh_of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = kept.groupBy(F.col("sh_part").alias("sh_of")).agg(F.sum("size").alias("sh_bytes"), F.count(F.lit(1)).alias("sh_rows"))
    totals = totals.select("sh_of", F.coalesce(F.sum("sh_bytes").over(earlier), F.lit(0)).alias("sh_bytes_before"), F.coalesce(F.sum("sh_rows").over(earlier), F.lit(0)).alias("sh_rows_before"), F.sum("sh_bytes").over(Window.partitionBy()).alias("sh_all"))
    inside = Window.partitionBy("sh_part").orderBy(*order, "sh_tie")
    running = kept.withColumn("sh_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("sh_rank", F.row_number().over(inside))
    full = running.join(F.broadcast(totals), F.col("sh_part") == F.col("sh_of"))  # as many rows as partitions
    doubled_middle = (F.col("sh_bytes_before") + F.col("sh_end")) * 2 - F.col("size")
    full = full.withColumn("shard", F.least(F.lit(shards - 1), F.floor(doubled_middle.cast("decimal(38,0)") * shards / (F.col("sh_all") * 2))).cast("int")).withColumn("sh_rank", F.col("sh_rank") + F.col("sh_rows_before"))
    begins = full.groupBy(F.col("shard").alias("sh_shard")).agg(F.min("sh_rank").alias("sh_first"))  # a row for each shard
    out = full.join(F.broadcast(begins), F.col("shard") == F.col("sh_shard")).withColumn("slot", F.col("sh_rank") - F.col("sh_first"))
    return out.drop(*[c for c in out.columns if c.startswith("sh_")])


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, contiguous by doc_id.

    size: UTF-8 bytes of the text plus OVERHEAD; a null text has none, and its text_crc32 is null. A null doc_id comes
    first. Repeated rows each get a slot; which of two equal rows gets which slot makes no difference. An empty table
    gives no rows. Only these few numbers of a row are shuffled, never its text; other columns are not read.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = placed(rows, shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
