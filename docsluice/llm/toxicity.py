"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found by rough cosines from a matrix of frequent words and an inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docsluice.llm._common import least_by_hash, sent_if_small, small_batches

#: Labelled examples of each class in the index, the least by hash of doc_id; their whole texts count.
EXAMPLES = 2000
NEAREST = 15
#: Words of most examples, whose weights stand in a matrix, and texts that are multiplied with it at once.
DENSE, TOGETHER = 512, 64
#: Rows of labels that are sent to every executor at most; beyond, documents and labels are shuffled.
SENT = 2_000_000
WORD = re.compile(r"[^\W_]+")


@cache
def letters() -> np.ndarray:
    """The units of UTF-16, with a space for each that stands in no word."""
    return np.array([c if WORD.match(chr(c)) else 32 for c in range(1 << 16)], "<u2")


def words(text: str) -> list[str]:
    """WORD.findall(text.lower()), by a table and a split where each character is one unit of UTF-16."""
    text = text.lower()
    units = text.encode("utf-16-le", "surrogatepass")
    if not text or len(units) > 2 * len(text):
        return WORD.findall(text)
    return letters()[np.frombuffer(units, "<u2")].tobytes().decode("utf-16-le").split()


#: Terms of a text by number, rising, and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def packed(counts: dict[int, int]) -> Counts:
    at = np.array(sorted(counts), np.int32)
    return at, np.array([counts[t] for t in at.tolist()], np.int32)


def counted(text: str | None, terms: dict[str, int]) -> Counts:
    found = words(text) if text else []
    code = np.fromiter(map(terms.get, found, repeat(-1)), np.int32, len(found))
    code = np.sort(code[code >= 0])
    first = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=first[1:])
    starts = np.nonzero(first)[0]
    ends = np.append(starts[1:], len(code))[: len(starts)]
    return code[starts], (ends - starts).astype(np.int32)


def spans(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from starts to ends, one after the other, and with each its range's value."""
    many = ends - starts
    offset = np.repeat(starts - (np.cumsum(many) - many), many)
    offset += np.arange(len(offset))
    return offset, np.repeat(values, many)


class Lists:
    """What finds the examples of a term: posting lists by term, and a matrix for the terms that most examples have."""

    def __init__(self, term: np.ndarray, held: np.ndarray, begin: np.ndarray, terms: int):
        owner = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))
        order = np.argsort(term, kind="stable")  # examples stand in order
        self.owner, self.held = owner[order], held[order]
        many = np.bincount(term, minlength=terms)
        self.of_term = np.append(0, np.cumsum(many))
        self.frequent = np.sort(np.argsort(-many, kind="stable")[:DENSE])
        self.column = np.full(terms, -1, np.int32)
        self.column[self.frequent] = np.arange(len(self.frequent))
        self.matrix = np.zeros((len(self.frequent), len(begin) - 1), np.float32)
        for c, t in enumerate(self.frequent.tolist()):
            here = slice(self.of_term[t], self.of_term[t + 1])
            self.matrix[c, self.owner[here]] = self.held[here]
        self.asked = np.zeros(terms)


class Index:
    """Unit TF-IDF vectors of the examples, and what finds those near a text; the latter is made where it is used."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, Counts]], weights: tuple[float, float]):
        self.terms, self.idf = {t: k for k, t in enumerate(terms)}, idf
        self.names, self.ids = terms, np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int8)
        self.weights = np.array(weights)[self.labels] if len(examples) else np.zeros(0)
        self.blank = np.array([not len(e[2][0]) for e in examples], bool)
        self.begin = np.cumsum([0, *[len(e[2][0]) for e in examples]])
        self.term = np.concatenate([np.zeros(0, np.int32), *[e[2][0] for e in examples]])
        self.held = np.concatenate([np.zeros(0), *[self.vector(e[2])[1] for e in examples]])
        w, y = self.weights[self.blank], self.labels[self.blank]
        total = float(self.weights.sum()) or 1.0
        self.base = float((self.weights * self.labels).sum()) / total
        self.blank_rate = (float((w * y).sum()) + self.base) / (float(w.sum()) + 1.0)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        self.lists: Lists | None = None
        self.known: dict = {}

    def vector(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        at, times = counts
        values = (1 + np.log(times)) * self.idf[at]
        norm = math.sqrt(float((values * values).sum()))
        return at, values / norm if norm else values

    def nearest(self, at: np.ndarray, values: np.ndarray, without: int = -1, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_all([(at, values)], [without], k))

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int], k: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Examples of largest cosine, exactly: those whose rough cosine may be among the k largest are compared with all their terms."""
        if self.lists is None:
            self.lists = Lists(self.term, self.held, self.begin, len(self.names))
        lists = self.lists
        # rough cosines are sums of at most DENSE products of single precision, and no sum is above 1
        error = 1.01 * (len(lists.frequent) + 4) * 2.0**-24
        for a in range(0, len(vectors), TOGETHER):
            some = vectors[a : a + TOGETHER]
            asked = np.zeros((len(some), len(lists.frequent)), np.float32)
            columns = [lists.column[at] for at, _ in some]
            for row, c, (_, values) in zip(asked, columns, some, strict=True):
                row[c[c >= 0]] = values[c >= 0]
            for rough, c, (at, values), but in zip(asked @ lists.matrix, columns, some, without[a : a + TOGETHER], strict=True):
                yield self.best(at, values, self.candidates(rough, at, values, c < 0, but, k, error), but, k)

    def candidates(self, rough: np.ndarray, at: np.ndarray, values: np.ndarray, rare: np.ndarray, but: int, k: int, error: float) -> np.ndarray | None:
        """Examples that may be among the k nearest; None if reading all lists of the terms takes less."""
        lists = self.lists
        if len(rough) <= k:
            return None
        postings, w = spans(lists.of_term[at[rare]], lists.of_term[at[rare] + 1], values[rare])
        rough = rough + np.bincount(lists.owner[postings], w * lists.held[postings], len(rough))
        if but >= 0:
            rough[but] = -1
        least = np.partition(rough, -k)[-k] - 2 * error
        found = np.nonzero(rough >= least)[0]
        whole = int((lists.of_term[at + 1] - lists.of_term[at]).sum())
        return found if least > 0 and int((self.begin[found + 1] - self.begin[found]).sum()) <= whole else None

    def best(self, at: np.ndarray, values: np.ndarray, among: np.ndarray | None, but: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest, among some examples or all. Either way a cosine is the sum over common terms in their order."""
        lists = self.lists
        if among is None:
            postings, w = spans(lists.of_term[at], lists.of_term[at + 1], values)
            sums = np.bincount(lists.owner[postings], w * lists.held[postings], len(self.ids))
            found = np.nonzero(sums)[0]
            found = found[found != but]
            sums = sums[found]
        else:
            terms, place = spans(self.begin[among], self.begin[among + 1], np.arange(len(among)))
            lists.asked[at] = values
            sums = np.bincount(place, lists.asked[self.term[terms]] * self.held[terms], len(among))
            lists.asked[at] = 0
            found = among
        top = np.lexsort((found, -sums))[:k]
        return found[top], sums[top]

    def votes(self, batch: list[Counts], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text its weighed vote, its nearest examples and their cosines; equal texts are judged once."""
        without = without or [-1] * len(batch)
        keys = [(blake2b(c[0].tobytes() + c[1].tobytes(), digest_size=16).digest(), b) if len(c[0]) else None for c, b in zip(batch, without, strict=True)]
        if len(self.known) > 20_000:
            self.known.clear()
        new = {key: c for key, c in zip(keys, batch, strict=True) if key and key not in self.known}
        near = self.nearest_all([self.vector(c) for c in new.values()], [key[1] for key in new])
        for key, (at, sims) in zip(new, near, strict=True):
            w = sims * sims * self.weights[at]
            total = float(w.sum())
            self.known[key] = float((w * self.labels[at]).sum()) / total if total else self.base, at, sims
        return [self.known[key] if key else (self.blank_rate, np.zeros(0, np.int64), np.zeros(0)) for key in keys]

    def calibrate(self, examples: list[tuple[int, int, Counts]]) -> None:
        """A rising step function from votes to toxic rates, from each example's vote without itself."""
        some = [k for k, e in enumerate(examples) if len(e[2][0])]
        parts = [some[a : a + TOGETHER] for a in range(0, len(some), TOGETHER)]
        votes = [v[0] for part in parts for v in self.votes([examples[k][2] for k in part], part)]
        rows = sorted((v, float(examples[k][1]), float(self.weights[k])) for k, v in zip(some, votes, strict=True))
        pools: list[list[float]] = []  # vote, toxic weight, weight
        for vote, y, w in rows:
            pools.append([vote * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.known.clear()
        self.lists = None  # workers make their own
        if len(pools) > 1:
            self.steps = np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * self.base) / (p[2] + 0.5) for p in pools])

    def score(self, batch: list[Counts]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        found = []
        for counts, (vote, at, sims) in zip(batch, self.votes(batch), strict=True):
            if len(counts[0]) and self.steps:
                vote = float(np.interp(vote, *self.steps))
            found.append((min(1.0, max(0.0, vote)), at, sims))
        return found


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """An index from documents (doc_id, text) and labels (doc_id, toxic).

    The index holds `examples` documents of each class at most, with all their words. A word weighs its inverse
    document frequency times the size of its correlation with the label toxic, both over all labelled documents, so
    that none is left out whatever the share of toxic ones. A label without a document, and a null label, say nothing.
    What reaches the driver: for 2 * examples documents their words with counts, and a row for each of these words.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("tx_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    train = docs.select("doc_id", "text").join(sent_if_small(known, SENT), F.col("doc_id") == F.col("tx_id")).drop("tx_id")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        out = Index([], np.zeros(0), [], (1.0, 1.0))
        out.blank_rate = out.base = 1.0 if n1 else 0.0
        return out
    picked = least_by_hash(train, "toxic", {0: n0, 1: n1}, examples).select("doc_id", "toxic", "text")
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(words(x)) if x else {} for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "t", "n"])

    rows = picked.mapInArrow(count, "doc_id long, toxic int, t array<string>, n array<int>").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    flat = pc.list_flatten(rows["t"]).combine_chunks().dictionary_encode()
    names, code, times = flat.dictionary, flat.indices.to_numpy().astype(np.int32), pc.list_flatten(rows["n"]).to_numpy().astype(np.int32)
    sizes, toxic, ids = pc.list_value_length(rows["t"]).to_numpy(), rows["toxic"].to_numpy(), rows["doc_id"].to_pylist()
    del rows, flat  # the driver has little room
    # of the examples alone, until the counts of all labelled documents are there
    df = np.bincount(code, minlength=len(names)).astype(float)
    a = np.bincount(code, np.repeat(toxic, sizes), minlength=len(names))
    wanted = sent_if_small(docs.sparkSession.createDataFrame(pa.table({"term": names})), SENT)
    has = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).where("term <> ''").join(wanted, "term", "left_semi")
    seen = has.groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("df")).toArrow()
    at = pc.index_in(seen["term"], names).to_numpy()
    a[at], df[at] = seen["a"].to_numpy(), seen["df"].to_numpy()
    all_ = float(n1 + n0)
    together = np.abs(a * all_ - df * n1) / np.sqrt(df * np.maximum(1, all_ - df) * n1 * n0)
    idf = (np.log((1 + all_) / (1 + df)) + 1) * together
    got = []
    for d, y, m, e in zip(ids, toxic.tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
        order = np.argsort(code[e - m : e])
        got.append((d, y, (code[e - m : e][order], times[e - m : e][order])))
    del code, times, seen, at
    names = names.to_pylist()
    have = Counter(g[1] for g in got)
    out = Index(names, idf, got, (n0 / max(1, have[0]), n1 / max(1, have[1])))
    out.calibrate(got)
    return out


EVIDENCE = ArrayType(StructType([StructField("doc_id", LongType()), StructField("toxic", IntegerType()), StructField("cosine", DoubleType())]))


def score(docs: DataFrame, index: Index, evidence: bool = False) -> DataFrame:
    """docs (with a column text) with score and predicted; with `evidence` also the nearest examples and the terms found.

    score is the calibrated share of toxic votes of the NEAREST examples, each weighing its squared cosine. A text
    without words of the index, an empty or a null one, gets the toxic rate of such examples. Ties in the cosine go to
    the example of smaller doc_id. Without examples of both classes the score is 1 or 0 like the only class, or 0.
    Whole texts are read. Columns named like results are replaced.
    """
    more = [("score", DoubleType()), ("predicted", IntegerType())] + ([("evidence", EVIDENCE), ("terms", ArrayType(StringType()))] if evidence else [])
    docs = docs.drop(*[m[0] for m in more])
    small_batches(docs.sparkSession)
    at_text = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            counts = [counted(x, index.terms) for x in b.column(at_text).to_pylist()]
            found = index.score(counts)
            columns = [pa.array([f[0] for f in found], pa.float64()), pa.array([int(f[0] >= 0.5) for f in found], pa.int32())]
            if evidence:
                near = [[{"doc_id": int(index.ids[k]), "toxic": int(index.labels[k]), "cosine": float(s)} for k, s in zip(f[1], f[2], strict=True)] for f in found]
                columns += [pa.array(near, pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))), pa.array([[index.names[t] for t in c[0].tolist()] for c in counts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(m[0] for m in more)])

    schema = StructType(list(docs.schema.fields))
    for name, kind in more:
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
