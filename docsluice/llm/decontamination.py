"""Benchmark decontamination: an exact join of item-sized windows, filtered by their rarest shingle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm._common import lower_ascii, saved, sent_if_small, words

#: Words are made of ASCII digits and letters and of all characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a window.
WINDOW = 10
#: Anchors (of about 1 kB) that are sent to every executor at most; beyond, both sides of the join are shuffled.
SENT = 100_000


def tokens(text: Column) -> Column:
    return words(lower_ascii(text), SEPARATORS)


def _shingle(at: Column, after: Column) -> Column:
    return F.xxhash64(at, F.coalesce(after, F.lit("")))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, i, shingle) for each word but an item's last; an item of one word has that."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    spots = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0)))).alias("i"))
    return spots.withColumn("shingle", _shingle(F.get("words", F.col("i")), F.get("words", F.col("i") + 1)))


def _spots(docs: DataFrame, pairs: bool) -> DataFrame:
    """(doc key, words, i, shingle) of every place in the documents; single words instead of pairs for items of one word.

    The words stay in the row only until the join that follows in the same stage, which keeps few places.
    """
    spots = docs.select("doc_id", "text_hash", "words", F.posexplode("words").alias("i", "word"))
    return spots.withColumn("shingle", _shingle(F.col("word"), F.get("words", F.col("i") + 1) if pairs else F.lit("")))


def anchors(benchmark: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shingle, single, item_id, before, after, width): the rarest shingle of each window, with the item's words around it.

    Rarity is the number of a shingle's occurrences in all documents. A window occurs only where this one shingle
    does, so the join on it loses none. Windows of one item that share their anchor share a row.
    """
    items = _items(benchmark)
    wanted = sent_if_small(items.select("shingle").distinct(), SENT * 20)
    seen = _spots(docs, True).select("shingle").join(wanted, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    rare = items.join(seen, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # shingles of a window of w words begin at w - 1 places; an item of fewer words is one window
    n = F.size("words")
    starts = F.greatest(n - window, F.lit(0))
    width = F.least(n, F.lit(window))
    of = rare.groupBy("item_id", "words").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("seen", "shingle")))).alias("rank"))
    best = F.transform(
        F.sequence(F.lit(0), starts),
        lambda s: F.array_min(F.transform(F.sequence(s, s + F.greatest(width - 2, F.lit(0))), lambda i: F.struct(F.element_at("rank", i)["seen"].alias("seen"), i.alias("i"), F.element_at("rank", i)["shingle"].alias("shingle")))),
    )
    chosen = of.select("item_id", "words", F.explode(F.array_distinct(best)).alias("b"))
    at, reach = F.col("b")["i"], window - 1
    return chosen.select(
        F.col("b")["shingle"].alias("shingle"), (F.size("words") == 1).alias("single"), "item_id",
        F.reverse(F.slice("words", F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))).alias("before"),
        F.slice("words", at + 1, F.lit(reach + 1)).alias("after"), F.least(F.size("words"), F.lit(window)).alias("width"),
    )


def _run(ours: Column, theirs: Column) -> Column:
    """How many words agree from the first on."""
    differs = F.array_position(F.zip_with(ours, theirs, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(ours), F.size(theirs))).cast("int")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, item_id, first, last): stretches of document words inside windows that occur.

    The join carries places of documents to anchors with the same shingle. Positional bounds on both sides (no window
    reaches more than window - 1 words from its anchor, nor beyond the text) cut the words that are compared; length
    bounds leave out places too near an end for the item's window. Then all of a window's words are compared.
    """
    known = saved(anchors(benchmark, docs, window), "anchors")
    single = bool(known.where("single").limit(1).count())
    known = sent_if_small(known, SENT)
    found = _spots(docs, True).join(known.where("NOT single"), "shingle")
    if single:
        found = found.unionByName(_spots(docs, False).join(known.where("single"), "shingle"))
    reach = window - 1
    near = F.struct(
        F.reverse(F.slice("words", F.greatest(F.col("i") - reach, F.lit(0)) + 1, F.least(F.col("i"), F.lit(reach)))).alias("ours_before"),
        F.slice("words", F.col("i") + 1, F.lit(reach + 1)).alias("ours_after"),
    )
    # inline() holds the comparison, which is not compiled, back until the rows are short: moved into the join, it
    # would have the words of the whole text copied for every place
    found = found.where(F.size("words") >= F.col("width")).select("doc_id", "text_hash", "item_id", "i", "width", "before", "after", F.inline(F.array(near)))
    found = found.select("doc_id", "text_hash", "item_id", "i", "width", _run(F.col("ours_before"), F.col("before")).alias("left"), _run(F.col("ours_after"), F.col("after")).alias("right"))
    found = found.where("right > 0 AND left + right >= width")
    return found.select("doc_id", "text_hash", "item_id", (F.col("i") - F.col("left")).alias("first"), (F.col("i") + F.col("right") - 1).alias("last"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is `window` consecutive words of an item, or the whole of an item of fewer words. A word of a document
    is hit if it lies in an occurrence of a window. A null or empty text has no words and no hits; items without words
    have no windows; an item that stands in the benchmark twice counts once. Rows with the same doc_id and text get the same numbers. An empty
    benchmark hits nothing. An item without an id hits words, but is not among the items that are counted and named.
    Columns named like results are replaced, columns named text_hash, dc_id, dc_hash or dc_items are left out, others stay.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_hash", "dc_id", "dc_hash", "dc_items")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = keyed.select("doc_id", "text_hash", tokens(F.col("text")).alias("words"))
    found = saved(hits(texts, benchmark, window), "hits")
    key = ["doc_id", "text_hash"]
    stretches = found.groupBy(*key, "first").agg(F.max("last").alias("last"))
    so_far = Window.partitionBy(*key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("last") - F.greatest(F.col("first"), F.coalesce(F.max("last").over(so_far), F.lit(-1)) + 1) + 1
    covered = stretches.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    items = found.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = covered.join(items, (covered.doc_id.eqNullSafe(items.doc_id)) & (covered.text_hash == items.text_hash)).select(
        covered.doc_id.alias("dc_id"), covered.text_hash.alias("dc_hash"), "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("dc_items"))
    out = keyed.withColumn("n_words", F.size(tokens(F.col("text"))).cast("long")).join(marks, F.col("doc_id").eqNullSafe(F.col("dc_id")) & (F.col("text_hash") == F.col("dc_hash")), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "items_sha256": F.sha2(F.coalesce("dc_items", F.lit("")).cast("binary"), 256)})
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("text_hash", "dc_id", "dc_hash", "dc_items")
