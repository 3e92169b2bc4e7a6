"""Approximate nearest neighbours by cross-polytope hashing with several probes, and exact scores of what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm._common import saved

#: Tables, and the least width of their pseudo-rotations: a table has twice as many signed axes, and as many buckets.
TABLES, WIDTH = 12, 1024
#: A query probes as many axes of each table as find this share of the nearest candidates of SAMPLE queries, those of least
#: hash, which are compared with all candidates to learn it.
RECALL, SAMPLE = 0.94, 128
#: Candidates that a task compares with the sample at once.
STEP = 4096
#: Where lengths differ, the share of the candidates, the longest, that every query is compared with.
LONG = 1 / 16
#: Vectors and queries that are compared in one block at most, on average.
CHUNK, BLOCK = 32_768, 2048
#: Up to so many dimensions a pseudo-rotation is applied as the matrix that it makes of the unit vectors.
MATRIX = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, whose length is a power of two, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class Polytope:
    """A pseudo-rotation for each table: three rounds of random signs and a Hadamard transform, in a wider space."""

    def __init__(self, dims: int, tables: int = TABLES, width: int = WIDTH):
        self.dims, self.width = dims, max(width, 1 << max(1, (dims - 1).bit_length()))
        self.signs = np.random.RandomState(5).choice([-1.0, 1.0], size=(tables, 3, self.width))
        self.matrices = [self.turned(np.eye(dims), t) for t in range(tables)] if dims <= MATRIX else None

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            out = hadamard(out * signs)
        return out

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.matrices[table] if self.matrices else self.turned(x, table)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """Number of the nearest signed axis: 2 * axis, and one more if its sign is negative."""
        turned = self.rotated(x, table)
        axis = np.abs(turned).argmax(axis=1)
        return 2 * axis + (turned[np.arange(len(x)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, many: int) -> np.ndarray:
        """The `many` nearest signed axes."""
        turned = self.rotated(x, table)
        signed = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
        return np.argpartition(-signed, min(many, signed.shape[1] - 1), axis=1)[:, :many]


def _plain(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, norm): vectors in double precision that are not null, not zero, and have finite components only."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).withColumn("most", F.array_max(F.transform("v", F.abs)))
    # squares of very long and very short vectors are out of range: components are taken as shares of the largest
    return rows.select("id", "v", (F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most"))))).alias("norm"))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Parts of batches (id, v, norm) with their vectors, norms, and vectors as bytes: of four bytes a component if none loses by that."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            b = whole.slice(start, 1000)
            x = np.asarray(b.column(1).flatten()).astype(float).reshape(-1, dims)
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
                fits = (short == x).all(axis=1)
            yield b, x, np.asarray(b.column(2)), pa.array([s.tobytes() if f else r.tobytes() for r, s, f in zip(x, short, fits.tolist(), strict=True)], pa.binary())


def _hashed(rows: DataFrame, dims: int, cut: float, parts: int) -> DataFrame:
    """(id, vec, tab, part, bucket): a row of each candidate for each table, by direction alone; a part has the buckets of one remainder.

    Candidates longer than `cut` are in no table but in bucket -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polytope = Polytope(dims)
        for b, x, norms, stored in _rows_of(batches, dims):
            long, hashed = np.nonzero(norms > cut)[0], np.nonzero(~(norms > cut))[0]
            found = [(long, 0, np.full(len(long), -1))]
            if len(hashed):
                unit = units(x[hashed])
                found += [(hashed, t, polytope.bucket(unit, t)) for t in range(TABLES)]
            for at, t, bucket in found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), stored.take(pa.array(at)), pa.array(np.full(len(at), t), pa.int32()), pa.array(bucket % parts, pa.int32()), pa.array(bucket, pa.int32())], ["id", "vec", "tab", "part", "bucket"])

    return rows.select("id", "v", "norm").mapInArrow(run, "id long, vec binary, tab int, part int, bucket int")


def _probed(rows: DataFrame, dims: int, parts: int, many: int, long: bool) -> DataFrame:
    """(id, vec, tab, part, buckets): a row of each query for each table and part, with the buckets it probes there.

    With `long`, each query probes bucket -1 too; without `many`, that alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polytope = Polytope(dims)
        for b, x, _, stored in _rows_of(batches, dims):
            unit = units(x)
            for t in range(TABLES if many else 1):
                probes = polytope.probes(unit, t, many) if many else np.zeros((len(x), 0), np.int64)
                if long and t == 0:
                    probes = np.concatenate([probes, np.full((len(x), 1), -1)], axis=1)
                owner, bucket = np.repeat(np.arange(len(x)), probes.shape[1]), probes.ravel()
                order = np.lexsort((bucket, bucket % parts, owner))
                owner, bucket = owner[order], bucket[order]
                group = owner * parts + bucket % parts
                starts = np.nonzero(np.diff(group, prepend=-1))[0]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), pa.array(bucket, pa.int32()))
                at = pa.array(owner[starts])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), stored.take(at), pa.array(np.full(len(starts), t), pa.int32()), pa.array(bucket[starts] % parts, pa.int32()), lists], ["id", "vec", "tab", "part", "buckets"])

    return rows.select("id", "v", "norm").mapInArrow(run, "id long, vec binary, tab int, part int, buckets array<int>")


def best_of_block(query_ids: np.ndarray, q: np.ndarray, probes: list[np.ndarray], ids: np.ndarray, c: np.ndarray, buckets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, candidate, score) of the k largest inner products of each query with candidates in its buckets, ties to smaller ids; and how many pairs were compared.

    Matrix products find what can be among them; the scores are then summed for each pair alike, so that equal
    vectors have equal scores.
    """
    order = np.argsort(buckets, kind="stable")
    ids, c, buckets = ids[order], c[order], buckets[order]
    asker = np.repeat(np.arange(len(q)), [len(p) for p in probes])
    asked = np.concatenate([np.zeros(0, np.int64), *probes])
    by = np.argsort(asked, kind="stable")
    asker, asked = asker[by], asked[by]
    who, what, rough = [], [], []
    with np.errstate(over="ignore", invalid="ignore"):
        for bucket in np.intersect1d(asked, buckets):
            a, z = np.searchsorted(asked, [bucket, bucket + 1])
            i, j = np.searchsorted(buckets, [bucket, bucket + 1])
            who.append(np.repeat(asker[a:z], j - i))
            what.append(np.tile(np.arange(i, j), z - a))
            rough.append((q[asker[a:z]] @ c[i:j].T).ravel())
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        who, what, rough = np.concatenate(who), np.concatenate(what), np.concatenate(rough)
        other = query_ids[who] != ids[what]
        who, what, rough = who[other], what[other], np.nan_to_num(rough[other], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        by = np.argsort(who, kind="stable")
        who, what, rough = who[by], what[by], rough[by]
        ends = np.searchsorted(who, np.arange(len(q) + 1))
        out = []
        for r in range(len(q)):
            a, z = ends[r], ends[r + 1]
            at, near = what[a:z], rough[a:z]
            if z - a > k and len(np.unique(ids[at])) == len(at):  # an id that is repeated is merged first
                least = np.partition(near, -k)[-k]
                at = at[near >= (least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else least)]
            scores = np.nan_to_num((c[at] * q[r]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            top = np.lexsort((ids[at], -scores))
            top = top[np.sort(np.unique(ids[at][top], return_index=True)[1])][:k]
            out.append((np.full(len(top), query_ids[r]), ids[at][top], scores[top]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), len(who)


def _vectors(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors from bytes: four or eight a component."""
    if all(len(x) == 4 * dims for x in column):
        return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims).astype(float)
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dims else float).astype(float) for x in column])


def _best(index: DataFrame, probes: DataFrame, dims: int, k: int, count: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of index in the buckets that each query probes.

    With `count`, (compared) instead: the pairs of each block that were compared.
    """
    of = ["tab", "part"]
    counts = index.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    asks = probes.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(counts.join(asks, of))  # a row for each table and part, of which there are as many as buckets at most
    spread = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, of).select("id", "vec", "bucket", *of, spread("id", "chunks").alias("chunk"), every("blocks").alias("block"))
    right = probes.join(plan, of).select("id", "vec", "buckets", *of, every("chunks").alias("chunk"), spread("id", "blocks").alias("block"))
    key = [*of, "chunk", "block"]

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = not len(c) or not len(q)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0) if empty else best_of_block(q["id"].to_numpy(), _vectors(q["vec"], dims), [np.asarray(b, np.int64) for b in q["buckets"]], c["id"].to_numpy(), _vectors(c["vec"], dims), c["bucket"].to_numpy(), k)
        return pd.DataFrame({"compared": [found[3]]}) if count else pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key))
    if count:
        return pairs.applyInPandas(compare, "compared long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = pairs.applyInPandas(compare, "query_id long, vec_id long, score double")
    # what several tables found is merged first, and then cut
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def needed_axes(q: np.ndarray, c: np.ndarray, polytope: Polytope) -> np.ndarray:
    """How many axes of each table a query has to probe to meet a candidate in one of them, for rows of unit vectors."""
    least = np.full(len(q), 2 * polytope.width)
    for t in range(TABLES):
        bucket = polytope.bucket(c, t)
        for a in range(0, len(q), 512):
            turned = polytope.rotated(q[a : a + 512], t)
            own = bucket[a : a + 512]
            value = turned[np.arange(len(own)), own // 2] * np.where(own % 2, -1, 1)
            # axes of either sign that are at least as near, its own one too
            nearer = (turned >= value[:, None]).sum(axis=1) + (-turned >= value[:, None]).sum(axis=1)
            least[a : a + 512] = np.minimum(least[a : a + 512], nearer)
    return least


def probed_axes(pool: DataFrame, asked: DataFrame, dims: int, cut: float, k: int, recall: float = RECALL) -> int:
    """How many signed axes of a table a query probes: the fewest that find the share `recall` of what the sample should find.

    The sample's k nearest are found by comparing it with every candidate, so what a query probes follows from how near
    the nearest are, and not from how many candidates there are.
    """
    rows = asked.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    sample = {r["id"]: r["v"] for r in reversed(rows)}
    if not sample:
        return 1
    ids, q = np.array(list(sample), np.int64), np.array(list(sample.values()), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_id, near, near_norm, found = np.zeros(0, np.int64), np.zeros((0, dims)), np.zeros(0), None

        def compared(parts: list) -> None:
            nonlocal near_id, near, near_norm, found
            c_id, c, norm = (np.concatenate([old, *new]) for old, new in zip((near_id, near, near_norm), zip(*parts, strict=True), strict=True))
            # rows instead of ids: an id can be repeated
            place = np.arange(len(c_id))
            who, what, score, _ = best_of_block(-1 - np.arange(len(q)), q, [np.zeros(1, np.int64)] * len(q), place, c, np.zeros(len(c), np.int64), 2 * k + 1)
            keep, at = np.unique(what, return_inverse=True)
            near_id, near, near_norm, found = c_id[keep], c[keep], norm[keep], (-1 - who, at, score)

        held, rows = [], 0
        for b, x, norms, _ in _rows_of(batches, dims):
            held.append((np.asarray(b.column(0)), x, norms))
            rows += len(x)
            if rows >= STEP:
                compared(held)
                held, rows = [], 0
        if held:
            compared(held)
        if found is None:
            return
        who, at, score = found
        other = ids[who] != near_id[at]
        who, at, score = who[other], at[other], score[other]
        # candidates longer than the cut are compared with every query
        need = np.where(near_norm[at] > cut, 0, needed_axes(units(q)[who], units(near)[at], Polytope(dims))) if len(who) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(near_id[at]), pa.array(score), pa.array(need, pa.int32())], ["query_id", "vec_id", "score", "need"])

    found = pool.select("id", "v", "norm").mapInArrow(run, "query_id long, vec_id long, score double, need int")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("need").alias("need"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    counts = merged.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).groupBy("need").agg(F.count(F.lit(1)).alias("n")).orderBy("need").collect()
    found_by = np.cumsum([r["n"] for r in counts])
    return max(1, counts[int(np.argmax(found_by >= recall * found_by[-1]))]["need"]) if counts else 1


def fixed_axes(dims: int, probed: float) -> int:
    """The share `probed` of a table's signed axes."""
    width = max(WIDTH, 1 << max(1, (dims - 1).bit_length()))
    return max(1, min(2 * width, round(2 * width * probed)))


def _of_length(pool: DataFrame, asked: DataFrame, size, k: int, probed: float | None) -> DataFrame:
    """What nearest() gives for vectors of one length; size has it, and the number and norms of the candidates."""
    dims, n, high, low = size["dims"], size["n"], size["high"], size["low"]
    cut = float("inf") if high - low <= 1e-3 * high or size["cut"] >= high else size["cut"]
    width = max(WIDTH, 1 << max(1, (dims - 1).bit_length()))
    parts = max(1, min(2 * width, -(-n // CHUNK)))
    index = _hashed(pool, dims, cut, parts)
    many = probed_axes(pool, asked, dims, cut, k) if probed is None else fixed_axes(dims, probed)
    probes = _probed(asked, dims, parts, many, cut < float("inf"))
    out = saved(_best(index, probes, dims, k), "neighbours")
    # queries whose list is short though there are candidates: these are compared with all of them
    got = out.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(got, "id", "left").where(F.coalesce("n", F.lit(0)) < k)
    if short.limit(1).count():
        few = [r["id"] for r in pool.select("id").distinct().limit(k + 1).collect()]
        if len(few) <= k:
            short = short.where(F.coalesce("n", F.lit(0)) < F.lit(len(few)) - F.col("id").isin(few).cast("int"))
        short = saved(short.select("id", "v", "norm"), "short")
        # lengths are above -1: bucket -1 has all candidates
        out = out.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_best(_hashed(pool, dims, -1.0, 1), _probed(short, dims, 1, 0, True), dims, k))
    return out.select("query_id", "rank", "vec_id", "score")


def _sizes(pool: DataFrame) -> list:
    return pool.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("high"), F.min("norm").alias("low"), F.percentile_approx("norm", 1 - LONG, 10_000).alias("cut")).orderBy("dims").collect()


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, probed: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by largest inner product of the original vectors.

    A candidate with the query's own id takes no part, nor do vectors that are null, zero, or hold null or non-finite
    components; a query meets candidates of its own length only. Ties go to the smaller id; an id that is
    repeated among the candidates counts once, with its best score, and repeated queries share one list. Products beyond the range of doubles are infinite, and
    last if they are no number. Every candidate is in each of TABLES tables; a query probes the nearest signed axes of each: as many as
    a sample of the queries takes to find RECALL of its nearest (see probed_axes), or the share `probed` of them if that is given. Tables know directions only: where lengths differ, every
    query is compared with the LONG longest candidates besides, as these can be best in any direction. A
    query that finds fewer than k although there are more is compared with all candidates. Buckets are dealt out in
    parts, and large parts cut into blocks of bounded size; each block reports k candidates of each query, so no pair of vectors is ever a row.
    """
    pool, asked = _plain(candidates, id_col, vector_col), _plain(queries, id_col, vector_col)
    # one run for each length that occurs, of which there is one in an index as a rule
    found = [_of_length(pool.where(F.size("v") == s["dims"]), asked.where(F.size("v") == s["dims"]), s, k, probed) for s in _sizes(pool)]
    if not found:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def share_examined(queries: DataFrame, candidates: DataFrame, probed: float | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Comparisons that nearest() makes in its tables, for each pair of a query and a candidate; a pair that meets in two tables counts twice."""
    pool, asked = _plain(candidates, id_col, vector_col), _plain(queries, id_col, vector_col)
    made = all_ = 0
    for s in _sizes(pool):
        mine, theirs = pool.where(F.size("v") == s["dims"]), asked.where(F.size("v") == s["dims"])
        width = max(WIDTH, 1 << max(1, (s["dims"] - 1).bit_length()))
        parts = max(1, min(2 * width, -(-s["n"] // CHUNK)))
        many = probed_axes(mine, theirs, s["dims"], float("inf"), k) if probed is None else fixed_axes(s["dims"], probed)
        blocks = _best(_hashed(mine, s["dims"], float("inf"), parts), _probed(theirs, s["dims"], parts, many, False), s["dims"], 1, True)
        made += blocks.agg(F.sum("compared")).first()[0] or 0
        all_ += s["n"] * theirs.count()
    return made / max(1, all_)
