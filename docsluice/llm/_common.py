"""What the operators of this subpackage share: text rules, scratch tables, checks of size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import operator
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java pattern of what separates words: space, tab and the line ends of ASCII.
BLANKS = r"[ \x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, separators: str = BLANKS) -> Column:
    """The words of a text; no word if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one of our own, which only a local session may have."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docsluice-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsluice-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of saved() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docsluice-" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives back to the system what the driver's Python has freed, which Arrow's pool and the C heap keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has been counted and has at most so many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows of texts that reach a Python worker at once: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def least_by_hash(rows: DataFrame, of: str, sizes: dict, most: int, key: str = "doc_id") -> DataFrame:
    """The `most` rows of least hash of key in each class of column `of`; sizes has each class and its rows.

    Hashes are even, so that a bound a little above most / size leaves few rows to sort, however large a class is. If
    keys repeat so much that the bound leaves too few, all rows are sorted: the result is the same.
    """
    if not sizes:
        return rows.limit(0)
    by = F.xxhash64(key)

    def below(size: int) -> Column:
        share = (most + 8 * most**0.5 + 50) / max(1, size)
        return F.lit(True) if share >= 1 else by < F.lit(int(share * 2**64) - 2**63)

    near = rows.where(reduce(operator.or_, [(F.col(of) == c) & below(n) for c, n in sizes.items()]))
    got = {r[of]: r["n"] for r in near.groupBy(of).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(got.get(c, 0) < min(most, n) for c, n in sizes.items()):
        near = rows
    place = F.row_number().over(Window.partitionBy(of).orderBy(by, key))
    return near.withColumn("hash_place", place).where(F.col("hash_place") <= most).drop("hash_place")
