"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm._common import words

#: Weights of the sources by code point of their names, repeated in turn.
WEIGHTS = (5, 2, 1)
#: Documents above 1 / LARGE of their source's target are drawn first; the others make up for what that drew.
LARGE = 64
#: Documents that one cell of the prefix sums has, on average at most.
CELL = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources share `share` times all sizes by weight; no target exceeds `most` times its source's size, and the
    excess is shared again until none does. That fixed point is the level at which min(most * size, level * weight)
    adds up to the whole, found with prefix sums over the sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(whole))
    return ranked.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("w")), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def offset(source: Column, draw: int) -> Column:
    """The one random offset of a source: uniform in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{draw}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _ranked(docs: DataFrame, n: int, cells: DataFrame | None = None) -> DataFrame:
    """docs with mix_rank, from 1, within each source in the order (class, digest, doc_id).

    Cells are ranges of that order: a class of sizes and some leading digits of the digest. Their counts are summed
    on the map side, prefix sums run over the cells, and only the rows of one cell are ever sorted together.
    """
    cell = ["source", "mix_class", "mix_cell"]
    counts = docs.groupBy(*cell).agg(F.count(F.lit(1)).alias("mix_n"))
    above = Window.partitionBy("source").orderBy(F.col("mix_class").desc(), F.col("mix_cell")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(above), F.lit(0))).select(F.col("source").alias("mix_s"), F.col("mix_class").alias("mix_k"), F.col("mix_cell").alias("mix_c"), "mix_before")
    inside = Window.partitionBy(*cell).orderBy("mix_digest", "mix_id", "mix_size")
    ranked = docs.withColumn("mix_rank", F.row_number().over(inside))
    on = F.col("source").eqNullSafe(F.col("mix_s")) & (F.col("mix_class") == F.col("mix_k")) & (F.col("mix_cell") == F.col("mix_c"))
    return ranked.join(counts, on).withColumn("mix_rank", F.col("mix_rank") + F.col("mix_before")).drop("mix_s", "mix_k", "mix_c", "mix_before")


def _copies(rate: Column, u: Column, rank: Column) -> Column:
    """Integer boundaries that the prefix sum of expected copies crosses at a document."""
    return F.when(rate >= 2, F.lit(2)).otherwise(F.floor(u + rate * rank) - F.floor(u + rate * (rank - 1))).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, n: int | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken: how often the mix takes each document, and its words in it.

    A source's documents are in one order (large ones first, then by digest of doc_id), each expects target / size
    of its source as copies, and a document is emitted once for each integer that the prefix sum of these crosses,
    starting from one random offset of the source. Documents above 1 / LARGE of the target are drawn like that
    first; the expected copies of the others then make up for the words these took too many or too few.

    Null text: size 0. Null source: one more source, last in order. Sources without words: target 0, each copy count
    0. Repeated rows are separate documents. Other columns stay as they are; columns named like results are replaced, and columns whose names begin with mix_ are left out.
    No table grows into one task: see _ranked; the tables of sources have a row for each source.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    docs = docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(by_source, weights, share).withColumnRenamed("source", "mix_of")
    n = docs.select("source").count() if n is None else n
    digits = 0
    while 16**digits * CELL < n:
        digits += 1
    both = docs.join(goal, F.col("source").eqNullSafe(F.col("mix_of"))).drop("mix_of")
    bits = F.bin(F.col("size"))
    large = (F.col("size") * LARGE > F.col("target")) & (F.col("size") > 0)
    both = both.withColumns({
        "mix_size": F.col("size"), "mix_id": F.col("doc_id"), "mix_digest": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        # a code that grows with the size's bit length and its next two bits; large ones on top, so that they come first
        "mix_class": (F.when(large, 1000).otherwise(0) + F.length(bits) * 4 + F.coalesce(F.conv(F.substring(bits, 2, 2), 2, 10).cast("int"), F.lit(0))).cast("int"),
        "mix_large": large,
    }).withColumn("mix_cell", F.substring("mix_digest", 1, digits) if digits else F.lit(""))
    ranked = _ranked(both, n).withColumn("mix_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    first = ranked.withColumn("mix_first", F.when(F.col("mix_large"), _copies(F.col("mix_rate"), offset(F.col("source"), 1), F.col("mix_rank"))).otherwise(0))
    drawn = first.groupBy("source").agg(
        F.sum(F.col("mix_first") * F.col("size")).alias("mix_took"), F.sum(F.when(~F.col("mix_large"), F.col("size")).otherwise(0)).alias("mix_rest"), F.sum(F.when(F.col("mix_large"), 1).otherwise(0)).alias("mix_many"),
    ).withColumnRenamed("source", "mix_of")
    out = first.join(drawn, F.col("source").eqNullSafe(F.col("mix_of")))
    rest = F.when(F.col("mix_rate") >= 2, F.lit(2.0)).when(F.col("mix_rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("target") - F.col("mix_took")) / F.col("mix_rest")))).otherwise(0.0)
    copies = F.when(F.col("mix_large"), F.col("mix_first")).otherwise(_copies(rest, offset(F.col("source"), 2), F.col("mix_rank") - F.col("mix_many")))
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.when(F.col("mix_rate") > 0, F.least(copies, F.lit(2))).otherwise(0)).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop(*[c for c in out.columns if c.startswith("mix_")])


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("mix_copy")).drop("mix_copy")
