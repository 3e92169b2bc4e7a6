"""Language identification: unigram pieces of a fixed vocabulary, summed over all segmentations of a word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm._common import least_by_hash, small_batches

#: A public sentencepiece vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language, the least by hash of doc_id, whose whole texts the piece probabilities are fitted on.
SAMPLE = 1500
#: Rounds of expectation maximisation; the first starts from equal probabilities.
ROUNDS = 2
#: Words whose scores a worker keeps at once.
KEPT = 300_000
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Probability of a character that the vocabulary lacks, the same in every language.
UNKNOWN = 1e-7


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that stand for text inside a word, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({model.id_to_piece(i).lower() for i in ids})


def text_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Signs such as a half, a raised two or a Roman numeral of one character are none."""
    found = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


class Segmenter:
    """Sums over all segmentations of words into pieces. probs: pieces by languages."""

    def __init__(self, vocabulary: list[str], probs: np.ndarray):
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.none, self.other = len(vocabulary), len(vocabulary) + 1
        langs = probs.shape[1]
        self.probs = np.vstack([probs, np.zeros((1, langs)), np.full((1, langs), UNKNOWN)])
        self.longest = max(map(len, vocabulary), default=1)

    def _edges(self, group: list[str], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Piece of each word from i to j, in order of j; the words have one length."""
        get = self.ids.get
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                ids = np.fromiter((get(w[i:j], self.none) for w in group), np.int32, len(group))
                if j - i == 1:
                    ids[ids == self.none] = self.other
                elif (ids == self.none).all():
                    continue
                yield i, j, ids

    def _groups(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        by = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for length, at in by.items():
            step = max(1, 400_000 // (length * self.probs.shape[1]))
            for a in range(0, len(at), step):
                yield length, np.array(at[a : a + step]), [START + words[k] for k in at[a : a + step]]

    def _forward(self, edges, n: int, length: int, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha, each position scaled to a largest value of 1, and the logarithms of the scales up to each position."""
        alpha, log = np.zeros((length + 1, n, probs.shape[1])), np.zeros((length + 1, n))
        alpha[0] = 1
        at = 0
        for i, j, ids in edges:
            if j != at and at:
                self._scale(alpha, log, at)
            at = j
            shift = np.exp(log[i] - log[j - 1])[:, None] if i < j - 1 else 1.0
            alpha[j] += alpha[i] * shift * probs[ids]
        self._scale(alpha, log, at)
        return alpha, log

    @staticmethod
    def _scale(alpha: np.ndarray, log: np.ndarray, j: int) -> None:
        most = np.maximum(alpha[j].max(axis=1), 1e-300)
        alpha[j] /= most[:, None]
        log[j] = log[j - 1] + np.log(most)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), self.probs.shape[1]))
        with np.errstate(divide="ignore"):
            for length, at, group in self._groups(words):
                alpha, log = self._forward(self._edges(group, length), len(group), length, self.probs)
                out[at] = np.log(np.maximum(alpha[length], 1e-300)) + log[length][:, None]
        return out

    def expected(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of each piece by so many copies of the words, under one language's probabilities."""
        probs = self.probs[:, lang : lang + 1]
        total = np.zeros(len(probs))
        for length, at, group in self._groups(words):
            edges = list(self._edges(group, length))
            alpha, log = self._forward(edges, len(group), length, probs)
            beta, back = np.zeros_like(alpha), np.zeros_like(log)
            beta[length] = 1
            below = length
            for i, j, ids in sorted(edges, key=lambda e: -e[0]):
                if i != below and below < length:
                    self._scale_back(beta, back, below)
                below = i
                beta[i] += probs[ids] * beta[j] * np.exp(back[j] - back[i + 1])[:, None]
            self._scale_back(beta, back, below)
            whole = log[length] + np.log(np.maximum(alpha[length][:, 0], 1e-300))
            for i, j, ids in edges:
                use = alpha[i][:, 0] * probs[ids][:, 0] * beta[j][:, 0] * np.exp(np.minimum(log[i] + back[j] - whole, 50)) * counts[at]
                total += np.bincount(ids, use, len(total))
        return total[:-2]

    @staticmethod
    def _scale_back(beta: np.ndarray, back: np.ndarray, i: int) -> None:
        most = np.maximum(beta[i].max(axis=1), 1e-300)
        beta[i] /= most[:, None]
        back[i] = back[i + 1] + np.log(most)


class Model:
    def __init__(self, langs: list[str], priors: list[float], vocabulary: list[str], probs: np.ndarray):
        self.langs, self.priors, self.vocabulary, self.probs = langs, priors, vocabulary, probs


def fit(docs: DataFrame, vocabulary_path: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from rows (doc_id, text, lang) with a lang.

    Priors count all rows. Piece probabilities come from `sample` documents of each language at most, taken in order
    of a hash of doc_id, with their whole texts. What reaches the driver has a row for each piece and language.
    """
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = sorted((r["lang"], r["n"], r["texts"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts")).collect())
    langs, whole = [c[0] for c in counts], sum(c[1] for c in counts)
    vocabulary = pieces(vocabulary_path)
    picked = least_by_hash(known.where(F.col("text").isNotNull()), "lang", {c[0]: c[2] for c in counts}, sample)
    low = F.split(F.lower("text"), r"[^\p{L}]+")
    words = picked.select("lang", F.explode(low).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).repartition(F.col("word"))
    probs = np.full((len(vocabulary), len(langs)), 1.0 / max(1, len(vocabulary)))
    for _ in range(rounds if langs else 0):

        def expect(batches: Iterator[pa.RecordBatch], probs=probs) -> Iterator[pa.RecordBatch]:
            model = Segmenter(vocabulary, probs)
            total = np.zeros(probs.shape)
            for b in batches:
                lang, word, n = (b.column(k).to_pylist() for k in range(3))
                for k, name in enumerate(langs):
                    at = [i for i, x in enumerate(lang) if x == name]
                    if at:
                        total[:, k] += model.expected([word[i] for i in at], np.array([n[i] for i in at], float), k)
            at, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(total[at, k])], ["piece", "lang", "uses"])

        uses = words.mapInArrow(expect, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        total = np.zeros(probs.shape)
        for r in uses.collect():  # pieces x languages at most
            total[r["piece"], r["lang"]] = round(r["uses"], 6)
        total += 0.05
        probs = total / total.sum(axis=0)
    return Model(langs, [math.log(c[1] / whole) for c in counts], vocabulary, probs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a column text) with lang_pred and score, the probability of that language.

    A document's words are scored by the sum over all their segmentations. `und` and 0.0 where the text is null or
    has no letter, or where the model knows no language. Whole texts are read, whatever their length; repeated words
    are scored once a batch. Columns with the names of the results are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    langs, priors, at_text = model.langs, np.array(model.priors), docs.columns.index("text")
    vocabulary, probs = model.vocabulary, model.probs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, cache, scores = Segmenter(vocabulary, probs), {}, np.zeros((0, len(langs)))
        for b in batches:
            texts = [text_words(x) for x in b.column(at_text).to_pylist()]
            names, best = [], []
            if len(cache) > KEPT:
                cache, scores = {}, scores[:0]
            new = list(set().union(*texts) - cache.keys()) if langs else []
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            scores = np.vstack([scores, segmenter.scores(new)]) if new else scores
            for words in texts:
                if not words or not langs:
                    names.append("und")
                    best.append(0.0)
                    continue
                log = priors + scores[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))].sum(axis=0)
                p = np.exp(log - log.max())
                k = int(p.argmax())
                names.append(langs[k])
                best.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, _with(docs, "lang_pred string, score double"))


def _with(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields))
    for field in more.split(", "):
        schema = schema.add(*field.split())
    return schema
