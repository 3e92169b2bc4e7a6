"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm import decontamination, minhash, mixing, sharding, toxicity
from docsluice.llm._common import release, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, scored against all labelled documents of the stage's input.

    Null and empty texts get the rate of such examples; each row is judged by itself, repeated ones too. Without
    labels of both classes all documents get the one rate that is left.
    """
    index = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select(*COLUMNS), index).where("predicted = 0").select(*COLUMNS)
    del index  # the executors have it; the later stages need the driver's room
    release()
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by sets of five-word shingles, 80 percent alike: the least by doc_id and hash of the text.

    Rows that repeat a doc_id with other texts are judged by their own text. Rows without words stay, and so do rows
    without a doc_id, repeated ones too; any other row that stands there several times stays once. An empty table stays empty.
    """
    texts = docs.select(*COLUMNS).withColumn("np_hash", F.xxhash64("text"))
    out = minhash.near_duplicates(texts, width=5, percent=80, keys=("np_hash",))
    held = out.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("np_hash").alias("np_hash"), F.count(F.lit(1)).alias("np_rows"))
    held = saved(held, "held")
    gone = out.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "np_hash").distinct().join(held.select("doc_id", "np_hash"), ["doc_id", "np_hash"], "left_anti")
    kept = texts.join(gone, ["doc_id", "np_hash"], "left_anti")
    if held.where("np_rows > 1").limit(1).count():
        # equal rows of one document: only these are shuffled whole
        many, key = held.where("np_rows > 1").select("doc_id", "np_hash"), ["doc_id", "np_hash"]
        kept = kept.join(many, key, "left_anti").unionByName(kept.join(many, key, "left_semi").dropDuplicates(key))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; an empty benchmark drops nothing."""
    marked = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken. Documents without words count as size 0, a null source as one more source."""
    return mixing.emitted(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, repeated ones too."""
    return sharding.shard(docs.select(*COLUMNS), 24)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: MinHash links and nearest-example votes are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
