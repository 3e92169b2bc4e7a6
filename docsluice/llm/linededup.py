"""Line deduplication: an exact set-similarity join of lines with prefix, positional and length filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.native import named
from docsluice.llm._common import forget, saved, sent_if_small

#: Words of a token.
WIDTH = 5
#: Distinct lines that have a token in their prefixes from which on the token counts as frequent.
FREQUENT = 48
#: Tokens, or lines, of 16 bytes or so that are sent to every executor at most.
SENT = 1_000_000

LINE = ["doc_id", "text_hash", "line"]


def _blanks(text: Column) -> Column:
    """White space but line feeds as spaces."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, x) of every line with words; line counts from 0. White space in x is spaces."""
    return docs.select("doc_id", "text_hash", F.posexplode(F.split(_blanks(F.col("text")), "\n")).alias("line", "x")).where(F.trim("x") != "")


def _token_sets(lines: DataFrame, width: int) -> DataFrame:
    """lines (.., x) with tokens: sorted distinct hashes of `width` words in a row, or of all if there are fewer.

    One expression, so that the hashes of words stay what they are between its steps and are not packed into rows.
    """

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        rows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return F.when(n >= width, rows).otherwise(F.array(F.xxhash64(hashes)))

    cells = F.split("x", " ")
    # only lines with spaces in a row, or at an end, have empty cells
    gaps = F.contains("x", F.lit("  ")) | F.startswith("x", F.lit(" ")) | F.endswith("x", F.lit(" "))
    hashes = F.transform(F.when(gaps, F.filter(cells, lambda w: w != "")).otherwise(cells), lambda w: F.xxhash64(w))
    return lines.withColumn("tokens", F.array_distinct(F.sort_array(named(hashes, of)))).drop("x")


def _prefix(n: Column, percent: int) -> Column:
    """How many of a set's first tokens must hold one that any similar set shares."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _joins(n: Column, percent: int) -> Column:
    """Whether a set of n tokens can be similar to one that is not equal: at best that has one token more."""
    return n * (100 - percent) >= percent


def _bitmap(tokens: Column) -> dict[str, Column]:
    """Four words of 64 bits, in which each token of a set turns one bit over.

    Tokens that only one of two sets has turn over what differs between their bitmaps, so that no more bits differ
    than there are such tokens.
    """

    def word(k: int) -> Column:
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 2).bitwiseAND(F.lit(63)).cast("int"))
        mine = F.filter(tokens, lambda t: t.bitwiseAND(F.lit(3)) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(bit(t)))

    return {f"m{k}": word(k) for k in range(4)}


def _close(a: str, b: str, percent: int) -> Column:
    """What two postings (n, at, m0 to m3) of one token have to meet, if this is the first token that they share.

    By length, by position (enough is left of both sets behind it), and by bitmaps where both have them. Similar sets
    meet it for the first token they share, so that the same bound serves for all.
    """
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    length = F.greatest(n, m) * percent <= F.least(n, m) * 100
    left = F.least(n - F.col(f"{a}_at"), m - F.col(f"{b}_at"))
    position = left * (100 + percent) >= (n + m) * percent
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}_m{k}").bitwiseXOR(F.col(f"{b}_m{k}"))) for k in range(4)])
    # n + m - 2 * intersection tokens differ
    bits = differ * (100 + percent) <= (n + m) * (100 - percent)
    return length & position & F.coalesce(bits, F.lit(True))


def _sided(postings: DataFrame, side: str) -> DataFrame:
    return postings.select("token", "ranked", *[F.col(c).alias(f"{side}_{c}") for c in postings.columns if c not in ("token", "ranked")])


def _pairs(postings: DataFrame, percent: int, done: DataFrame) -> DataFrame:
    """(a, b) of postings (token, ranked, set_no, n, at, m0 to m3) that are close, but for pairs that are both in `done`."""
    marked = postings.join(sent_if_small(done.withColumn("settled", F.lit(True)), SENT), "set_no", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    a, b = (_sided(marked, k) for k in "ab")
    once = (F.col("a_set_no") != F.col("b_set_no")) & (F.col("b_settled") | (F.col("a_set_no") < F.col("b_set_no")))
    found = a.where("NOT a_settled").join(b, ["token", "ranked"]).where(once & _close("a", "b", percent))
    return found.select(F.least("a_set_no", "b_set_no").alias("a"), F.greatest("a_set_no", "b_set_no").alias("b")).distinct()


class _Join:
    """The similarity join of distinct sets (set_no, n, prefix, doc_id, text_hash, line of the first line)."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, percent: int):
        self.docs, self.sets, self.width, self.percent = docs, sets, width, percent

    def full(self, ids: DataFrame) -> DataFrame:
        """(set_no, tokens, place), built again from the text of each set's first line; as often as that text is repeated.

        Only the lines that are asked for leave their text.
        """
        at = saved(self.sets.join(sent_if_small(ids, SENT), "set_no").select("set_no", *LINE), "wanted")
        asked = at.groupBy(F.col("doc_id").alias("w_doc_id"), F.col("text_hash").alias("w_text_hash")).agg(F.collect_list(F.struct("set_no", "line")).alias("wanted"))
        asked = F.broadcast(asked) if at.limit(SENT + 1).count() <= SENT else asked
        texts = self.docs.join(asked, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("text_hash") == F.col("w_text_hash")))
        cut = named(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda w: F.struct(w["set_no"].alias("set_no"), w["line"].alias("line"), F.get(parts, w["line"]).alias("x"))))
        lines = texts.select("doc_id", "text_hash", F.inline(cut)).select("set_no", F.struct(*LINE).alias("place"), _blanks(F.col("x")).alias("x"))
        return _token_sets(lines, self.width)

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(token, ranked, set_no, n, at): what sets that can be similar have in common, in the order of their tokens; and (set_no, tokens) of the ranked.

        A token is frequent if more than FREQUENT sets have it in their prefix by hash. Rare tokens stand before the
        frequent ones, by hash, and the frequent ones by how many sets have them. Similar sets share a rare token of
        their prefixes by hash, or both have a frequent one there: these sets are put in order anew (ranked), and meet in the prefixes that this order gives them.
        """
        spread = self.sets.where(_joins(F.col("n"), self.percent)).select("set_no", "n", F.posexplode("prefix").alias("at", "token"))
        shared = saved(spread.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("many > 1"), "shared")
        frequent = saved(shared.where(F.col("many") > FREQUENT).select("token", "many").distinct(), "frequent")
        crowded = saved(shared.where(F.col("many") > FREQUENT).select("set_no").distinct(), "crowded")
        whole = saved(self.full(crowded).select("set_no", "tokens"), "crowded-sets")
        common = whole.select("set_no", F.explode("tokens").alias("token")).join(sent_if_small(frequent, SENT), "token")
        common = common.groupBy("set_no").agg(F.array_sort(F.collect_set(F.struct("many", "token"))).alias("common"))
        last = F.transform("common", lambda c: c["token"])
        n = F.size("tokens")
        turned = whole.join(common, "set_no").select("set_no", n.alias("n"), F.slice(F.concat(F.array_except("tokens", last), last), F.lit(1), _prefix(n, self.percent)).alias("first"))
        anew = turned.select("set_no", "n", F.posexplode_outer("first").alias("at", "token")).select("token", F.lit(True).alias("ranked"), "set_no", "n", "at")
        rare = shared.where(F.col("many") <= FREQUENT).select("token", F.lit(False).alias("ranked"), "set_no", "n", "at")
        out = saved(rare.unionByName(anew), "postings")
        for used in (shared, frequent, crowded):
            forget(used)
        return out, whole

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(set_no): the later of each of pairs (a, b) whose whole sets are similar, by place of their first lines."""
        pairs = saved(pairs, "pairs")
        whole = saved(self.full(pairs.select(F.col("a").alias("set_no")).union(pairs.select("b")).distinct()), "sets")
        a, b = (whole.select(F.col("set_no").alias(k), F.col("tokens").alias(f"{k}_t"), F.col("place").alias(f"{k}_f")) for k in "ab")
        both = F.size(F.array_intersect("a_t", "b_t"))
        found = pairs.join(a, "a").join(b, "b").where(both * (100 + self.percent) >= (F.size("a_t") + F.size("b_t")) * self.percent)
        out = saved(found.select(F.when(F.col("a_f") < F.col("b_f"), F.col("b")).otherwise(F.col("a")).alias("set_no")).distinct(), "later")
        forget(pairs)
        forget(whole)
        return out

    def later(self) -> DataFrame:
        """(set_no) of the sets that an earlier one is similar to.

        In long lists every set is compared with the earliest one first. Sets that this settles are not compared
        with each other any more, so that a large group of near copies costs its size and not its square.
        """
        plain, whole = self.postings()
        many = plain.where("ranked").groupBy("token").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > FREQUENT).select("token")
        long_ = saved(plain.where("ranked").join(many, "token"), "long")
        wanted = whole.join(long_.select("set_no").distinct(), "set_no").dropDuplicates(["set_no"])
        bits = saved(wanted.select("set_no", *[c.alias(k) for k, c in _bitmap(F.col("tokens")).items()]), "bits")
        postings = plain.join(sent_if_small(bits, SENT), "set_no", "left")
        places = self.sets.select("set_no", F.struct(*LINE).alias("place"))
        long_ = saved(long_.join(bits, "set_no").join(places, "set_no"), "long")
        fields = ["set_no", "n", "at", "m0", "m1", "m2", "m3"]
        first = long_.groupBy("token").agg(F.min(F.struct("place", *fields)).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"a_{c}") for c in fields])
        heads = _sided(long_.drop("place"), "b").join(first, "token").where((F.col("a_set_no") != F.col("b_set_no")) & _close("a", "b", self.percent))
        settled = self.similar(heads.select(F.col("a_set_no").alias("a"), F.col("b_set_no").alias("b")).distinct())
        forget(long_)
        out = settled.union(self.similar(_pairs(postings, self.percent, settled))).distinct()
        out = saved(out, "later")
        for used in (settled, plain, whole, bits):
            forget(used)
        return out


def repeated_lines(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_removed, removed) of every row of docs (doc_id, text).

    The tokens of a line are its distinct shingles of `width` words (as they stand, between white space), or all its
    words as one if there are fewer. A line is removed if an earlier one, by (doc_id, text_hash, line), has tokens
    with 100 * intersection >= percent * union, whether that one stays or not. Lines without words always stay. removed has
    the numbers, from 0, of a text's removed lines. Null and empty texts: no lines, nothing removed. Equal rows are
    one text: none of them makes the other a repetition. A null doc_id comes first in order. Other columns are left out.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    tokens = _token_sets(_lines(docs), width)
    n = F.size("tokens")
    # two hashes of 64 bits say which sets are equal
    ident = ["h1", "h2"]
    lines = tokens.select(*LINE, F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(width), "tokens").alias("h2"), n.cast("int").alias("n"), F.when(_joins(n, percent), F.slice("tokens", F.lit(1), _prefix(n, percent))).alias("prefix"))
    lines = saved(lines, "lines")
    first = lines.groupBy(*ident).agg(F.min(F.struct(*LINE)).alias("f"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
    # numbers of a table that is written: a task that runs again replaces all of its rows
    sets = saved(first.select(F.monotonically_increasing_id().alias("set_no"), *ident, "f.*", "n", "prefix", "copies"), "sets")
    later = _Join(docs, sets, width, percent).later().withColumn("later", F.lit(True))
    marks = sets.select("set_no", "copies", *ident, F.struct(*LINE).alias("f")).join(later, "set_no", "left").where("copies > 1 OR later").drop("set_no", "copies")
    gone = lines.select(*LINE, *ident).join(marks, ident).where(F.col("later").isNotNull() | ~F.struct(*LINE).eqNullSafe(F.col("f")))
    of = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "removed")
    rows = docs.select("doc_id", "text_hash", F.when(F.col("text") == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    out = rows.join(of, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left").drop("g_id", "g_hash")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "text_hash", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """docs with the removed lines taken out of text; a text that loses all its lines becomes empty, a null stays."""
    marks = repeated_lines(docs, width, percent).where("n_removed > 0").select(F.col("doc_id").alias("ld_id"), F.col("text_hash").alias("ld_hash"), F.col("removed").alias("ld_removed")).distinct()
    out = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("ld_id")) & (F.xxhash64("text") == F.col("ld_hash")), "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), F.array_contains("ld_removed", i).alias("gone"))), lambda s: ~s["gone"])
    text = F.when(F.col("ld_removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return out.withColumn("text", text).drop("ld_id", "ld_hash", "ld_removed")
