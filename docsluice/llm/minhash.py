"""Near-duplicate detection by circulant MinHash, with every link confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.llm._common import forget, saved, sent_if_small, small_batches
from docsluice.llm.components import components

#: Bands of coordinates that must agree. A pair of similarity 0.8 agrees in no band with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Shingles fall into so many places, which the second permutation puts in order.
PLACES = 1 << 20
#: Members of a bucket up to which members of different components are compared pair by pair; beyond, in blocks.
SMALL = 64
#: Rows of a bucket from which on it is hot, and dealt out to several tasks; at least a share of 1 / HOT_SHARE of all rows, so
#: that there are at most HOT_SHARE hot buckets.
HOT, HOT_SHARE = 1024, 10_000
#: Documents of a chunk, on average at most, when members of different components are compared in blocks.
CHUNK = 512
#: Documents whose ids are sent to every executor at most, when shingle sets are built again for some of them.
SENT = 2_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: `width` words in a row, or all words if there are fewer.

    A-Z count as lower case; words are what white space of ASCII separates. No words, no shingles.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    with np.errstate(over="ignore"):
        n, out = len(one) - width + 1, np.zeros(len(one) - width + 1, np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(31))) * _FACTORS[0] + one[k : k + n] * _FACTORS[1 + k % 4]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Circulant:
    """Two permutations give all coordinates.

    The first, the hash that puts a shingle in its place, breaks up whatever order the shingles have; coordinate k is
    the least value of the second permutation, shifted around by k, over the places of a set.
    """

    def __init__(self, coordinates: int = BANDS * ROWS):
        second = np.random.RandomState(20240229).permutation(PLACES).astype(np.uint32)
        self.second, self.shifts = np.concatenate([second, second[:coordinates]]), np.arange(coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        least = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(places), 4096):
            least = np.minimum(least, self.second[places[a : a + 4096, None] + self.shifts].min(axis=0))
        return least

    def bands(self, hashes: np.ndarray) -> list[int]:
        if not len(hashes):
            return []
        rows = self.signature(hashes).reshape(BANDS, ROWS)
        return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - (1 << 63) for k, r in enumerate(rows)]


def _signed(texts: DataFrame, width: int) -> DataFrame:
    """(.., id, n, fp1, fp2, bands) of texts (.., id, text): size, 128-bit fingerprint and bands of each document's set."""
    more = texts.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant()
        for b in batches:
            sets = [shingles(x, width) for x in b.column(len(more) + 1).to_pylist()]
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = 1 << 63
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(more) + 1], pa.array([len(s) for s in sets], pa.int64()), pa.array([(p >> 64) - half for p in prints], pa.int64()), pa.array([(p & (2 * half - 1)) - half for p in prints], pa.int64()), pa.array([circulant.bands(s) for s in sets], pa.list_(pa.int64()))],
                [*more, "id", "n", "fp1", "fp2", "bands"],
            )

    schema = T.StructType([*texts.schema.fields[: len(more) + 1], *T._parse_datatype_string("n long, fp1 long, fp2 long, bands array<long>").fields])
    return texts.mapInArrow(run, schema)


def _sets(texts: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, width).view(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "set"])

    return texts.join(sent_if_small(ids, SENT), "id", "left_semi").mapInArrow(run, "id long, set array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar enough."""
    first, second = (sets.select(F.col("id").alias(k), F.col("set").alias(f"{k}_set")) for k in "ab")
    sizes_fit = F.greatest(F.size("a_set"), F.size("b_set")) * percent <= F.least(F.size("a_set"), F.size("b_set")) * 100
    both = F.size(F.array_intersect("a_set", "b_set"))
    similar = both * 100 >= (F.size("a_set") + F.size("b_set") - both) * percent
    return pairs.join(first, "a").join(second, "b").where(sizes_fit & similar).select("a", "b")


def linked_components(reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component): the least id in the component of each document that is linked with another set.

    reps has (id, n, bands), a row for each distinct set. In each bucket the members are compared with the member of
    least id first. Components of the confirmed links are formed, and members of a bucket in different components
    are then compared too: pair by pair in buckets of up to SMALL members, and in blocks beyond. Pairs within a
    component are never listed. What these links join is found among components, not among documents again. Steps
    that no bucket is left for are not run: each query that the driver plans costs it memory.
    """
    buckets = saved(reps.select("id", "n", F.posexplode("bands").alias("band", "key")), "buckets")
    heads = buckets.groupBy("band", "key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("many"), F.min_by("n", "id").alias("a_n")).where("many > 1")
    most = max(HOT, buckets.count() // HOT_SHARE)
    first = saved(heads.withColumn("parts", F.ceil(F.col("many") / most).cast("int")), "heads")
    hot = F.broadcast(first.where("parts > 1").select("band", "key", F.col("parts").alias("hot_parts")))
    # a hot bucket's rows are dealt out, and its head goes to each of their tasks
    part = F.pmod(F.xxhash64("id"), F.coalesce("hot_parts", F.lit(1))).cast("int")
    dealt = buckets.join(hot, ["band", "key"], "left").withColumn("part", part).drop("hot_parts")
    heads = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["band", "key", "part"]
    fits = lambda x, y: F.greatest(x, y) * percent <= F.least(x, y) * 100
    met = saved(dealt.join(heads, key).where((F.col("id") != F.col("a")) & fits(F.col("n"), F.col("a_n"))).select("a", F.col("id").alias("b")).distinct(), "pairs")
    ids = met.select(F.col("a").alias("id")).union(met.select("b")).distinct()
    sets = saved(_sets(texts, width, ids), "sets")
    found = saved(_linked(met, sets, percent), "links")
    forget(sets)

    of = components(found)
    placed = dealt.join(heads.select(*key, "many"), key).join(of.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # what has one component only is settled; one row for each component of a bucket is enough to see that
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = saved(placed.join(mixed.select("band", "key").join(heads.select(*key), ["band", "key"]), key).drop("part"), "open")
    small, large = open_.where(F.col("many") <= SMALL), open_.where(F.col("many") > SMALL)
    left_open = {r["large"] for r in open_.select((F.col("many") > SMALL).alias("large")).distinct().collect()}
    further = []
    if False in left_open:
        further.append(_among(small, met, texts, width, percent))
    if True in left_open:
        further.append(_across(large, texts, width, percent))
    for used in (buckets, first, met, open_):
        forget(used)
    for extra in further:
        of = _joined(of, extra)
    return of


def _joined(of: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) with those joined that the links more (a, b) connect."""
    if not more.limit(1).count():
        return of
    ends = more
    for k in "ab":
        ends = ends.join(of.select(F.col("node").alias(k), F.col("component").alias(f"{k}_of")), k, "left").withColumn(f"{k}_of", F.coalesce(f"{k}_of", k))
    above = components(ends.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).where("a != b"))
    # an end that had no link before is a component of its own, and stands among the nodes of above
    alone = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(of, "node", "left_anti").withColumn("component", F.col("node"))
    top = above.select(F.col("node").alias("component"), F.col("component").alias("higher"))
    return saved(of.unionByName(alone).join(top, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "labels")


def _among(small: DataFrame, met: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between members of different components in buckets (band, key, id, n, component), but for pairs in met."""
    fits = lambda x, y: F.greatest(x, y) * percent <= F.least(x, y) * 100
    left, right = small.select("band", "key", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_c")), small.select("band", "key", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_c"))
    near = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & fits(F.col("a_n"), F.col("b_n"))).select("a", "b").distinct()
    near = near.join(met, ["a", "b"], "left_anti")
    pairs = saved(near, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    found = saved(_linked(pairs, _sets(texts, width, ids), percent), "links")
    forget(pairs)
    return found


def _across(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join different components among rows (band, key, id, component), as many as that takes.

    Members that hang together by buckets are a region. A region is cut into chunks, and each block of two chunks is
    compared in one task, which reports links only: pairs of different components whose signatures agree in as many
    coordinates as similar sets do but for a chance of less than 1e-6 are compared on their whole sets.
    """
    members = saved(open_.select("id", "component").distinct(), "members")
    heads = open_.groupBy("band", "key").agg(F.min("id").alias("a"))
    stars = open_.join(heads, ["band", "key"]).where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    region = components(stars).select(F.col("node").alias("id"), F.col("component").alias("region"))
    chunks = region.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = region.join(chunks, "region").join(members, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    sets = saved(_sets(texts, width, members.select("id")), "sets")
    blocks = dealt.select("id", "component", "region", "chunk", "low", "high").join(sets, "id")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = (rows["chunk"] == key[1]).to_numpy()
        found = block_links(rows["id"].to_numpy(), rows["component"].to_numpy(), [np.asarray(s, np.int64).view(np.uint64) for s in rows["set"]], left, key[1] == key[2], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    found = saved(blocks.groupBy("region", "low", "high").applyInPandas(compare, "a long, b long"), "links")
    for used in (sets, members):
        forget(used)
    return found


def block_links(ids: np.ndarray, of: np.ndarray, sets: list[np.ndarray], left: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between sets on the left and the others (or all, if both chunks are the same) that join components."""
    rows, columns = np.nonzero(left)[0], np.arange(len(ids)) if same else np.nonzero(~left)[0]
    if not len(rows) or not len(columns):
        return []
    circulant = Circulant()
    signatures = np.array([circulant.signature(s) for s in sets])
    # five standard deviations below what sets just similar enough have
    p, n = percent / 100, signatures.shape[1]
    least = n * p - 5.2 * (n * p * (1 - p)) ** 0.5
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.setdefault(x, x) != x:
            joined[x] = x = joined[joined[x]]
        return x

    out = []
    for r in rows:
        agree = (signatures[columns] == signatures[r]).sum(axis=1) >= least
        for c in columns[agree & (of[columns] != of[r])]:
            x, y = root(int(of[r])), root(int(of[c]))
            if x == y:
                continue
            both = len(np.intersect1d(sets[r], sets[c], assume_unique=True))
            if both * 100 >= (len(sets[r]) + len(sets[c]) - both) * percent:
                joined[max(x, y)] = min(x, y)
                out.append((int(ids[r]), int(ids[c])))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) of every row of docs (doc_id, text), behind the columns `keys` of docs.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked, components are those of
    all links, component_id is the least doc_id in one. class_id is the least doc_id with the very same set. A text
    that is null or has no words has no shingles, is linked with nothing and kept. Rows that repeat a doc_id are one
    document of the texts' sets: each row gets its own set's component, and kept is true for all rows whose doc_id
    is component_id. A null doc_id links nothing, has component_id null and is kept.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    mark = [F.col(k).alias(f"md_{k}") for k in keys]
    signed = saved(_signed(docs.select(*mark, F.col("doc_id").alias("id"), "text"), width), "signed")
    known = signed.where("n > 0 AND id IS NOT NULL")
    print_ = ["n", "fp1", "fp2"]
    reps = known.groupBy(*print_).agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    reps = saved(reps, "reps")
    of = linked_components(reps.select(F.col("rep").alias("id"), "n", "bands"), texts, width, percent)
    named = reps.select(*print_, "rep").join(of, F.col("rep") == F.col("node"), "left").select(*print_, "rep", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select(*[f"md_{k}" for k in keys], F.col("id").alias("doc_id"), *print_)
    out = rows.join(named, print_, "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("class_id", F.when(alone, F.col("doc_id")).otherwise(F.col("rep")))
    return out.select(*[F.col(f"md_{k}").alias(k) for k in keys], "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
