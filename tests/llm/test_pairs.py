"""Line deduplication and nearest neighbours against brute force, with repeats, ties, extremes and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm import linededup, neighbours


def tokens(line, width=5):
    words = line.split(" ")
    words = [w for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def removed_by_hand(rows, percent):
    """Numbers of the removed lines of (doc_id, text) with distinct doc_ids, by comparing all lines."""
    seen, gone = [], {d: [] for d, _ in rows}
    for d, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if s := tokens(line):
                if any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                    gone[d].append(k)
                seen.append(s)
    return gone


@pytest.mark.parametrize("percent", [60, 75, 80, 95])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, percent):
    monkeypatch.setattr(linededup, "FREQUENT", 40)
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    lines = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60]))) for _ in range(60)]
    rows = []
    for d in range(150):
        own = []
        for _ in range(rng.randrange(5)):
            kind = rng.random()
            line = rng.choice(lines).split(" ") if kind < 0.7 else passage[: rng.randrange(5, 40)] + [word() for _ in range(rng.randrange(4))]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = word()
            own.append(rng.choice([" ", "  ", "\t", " \r"]).join(line))
        rows.append((d, "\n".join(own)))
    # more near copies of one line than make a token frequent
    base = [word() for _ in range(90)]
    for d in range(150, 230):
        line = list(base)
        line[rng.randrange(90)] = word()
        rows.append((d, " ".join(line)))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "long " * 20_000), (904, "Long " * 20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("other"))
    out = {r.doc_id: r for r in linededup.repeated_lines(table, percent=percent).collect()}
    assert {d: list(r.removed) for d, r in out.items()} == removed_by_hand(rows, percent)
    assert {d: r.n_lines for d, r in out.items()} == {d: len(t.split("\n")) if t else 0 for d, t in rows}


def test_line_dedup_of_repeated_rows_and_none(spark):
    rows = [(1, "a b c d e f\nx"), (1, "a b c d e f\nx"), (2, "a b c d e f"), (None, "x"), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, list(r.removed)) for r in linededup.repeated_lines(table).collect())
    assert out == [(0, []), (0, []), (1, [1]), (1, [1]), (2, [0])]
    texts = sorted((r.doc_id or 0, r.text) for r in linededup.without_repeated_lines(table).collect())
    assert texts == [(0, "x"), (0, "x"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "")]
    assert linededup.repeated_lines(table.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>")


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_share_examined(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((400, 48))
    x = centres[rng.integers(0, 400, 20_000)] + 0.8 * rng.standard_normal((20_000, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    table = vectors(spark, enumerate(x))
    queries = table.where("vec_id % 200 = 0")
    got = listed(neighbours.nearest(queries, table, 20, 0.009))
    assert set(got) == set(range(0, 20_000, 200))
    right = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        right += len(set(np.argsort(-scores)[:20]) & {i for _, i, _ in found})
        assert [n for n, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(x[q] @ x[i], rel=1e-12) for _, i, s in found)
    assert right >= 0.9 * 20 * len(got)
    assert neighbours.share_examined(queries, table, 0.009) <= 0.2


@pytest.mark.parametrize("times", [2, 4])
def test_repeated_candidates_leave_lists_whole(spark, times):
    rng = np.random.default_rng(times)
    table = vectors(spark, enumerate(rng.standard_normal((300, 16))))
    once = listed(neighbours.nearest(table.where("vec_id % 20 = 0"), table, 20))
    many = table
    for _ in range(times - 1):
        many = many.unionByName(table)
    got = listed(neighbours.nearest(table.where("vec_id % 20 = 0"), many, 20))
    assert all(len({i for _, i, _ in v}) == 20 for v in got.values())
    assert {q: v[0] for q, v in got.items()} == {q: v[0] for q, v in once.items()}


def test_very_long_and_very_short_vectors(spark):
    table = vectors(spark, [(1, [1, 0]), (2, [1e-200, 0]), (3, [1e151, 0]), (4, [0.5, 0]), (5, [0, 0]), (6, [1e308, 1e308])])
    got = listed(neighbours.nearest(table.where("vec_id = 1"), table, 20))
    assert [i for _, i, _ in got[1]] == [6, 3, 4, 2] and [s for _, _, s in got[1]] == [1e308, 1e151, 0.5, 1e-200]


def test_ties_nulls_and_other_lengths(spark):
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(30, 60)] + [(0, [1.0, 0.0, 0.0]), (1, [float("nan"), 1, 1]), (2, [float("inf"), 1, 1]), (100, [1.0, 1.0]), (101, [2.0, 1.0])]
    table = vectors(spark, rows).unionByName(spark.createDataFrame([(3, None), (4, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>"))
    got = listed(neighbours.nearest(table.where("vec_id IN (0, 1, 2, 3, 4, 100)"), table.withColumn("id", F.lit("x")), 5))
    assert [i for _, i, _ in got[0]] == [30, 31, 32, 33, 34] and set(got) == {0, 100}
    assert got[100] == [(1, 101, 3.0)]


def test_no_vectors(spark):
    table = vectors(spark, [(1, [1.0, 0.0])])
    assert neighbours.nearest(table, table.where("false")).count() == 0
    assert neighbours.nearest(table.where("false"), table).count() == 0
    assert neighbours.nearest(table, table).count() == 0


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_far_candidates_change_no_list(spark):
    rng = np.random.default_rng(5)
    along = np.eye(24)[0]
    near = unit(3 * along + 0.6 * rng.standard_normal((600, 24)))
    far = unit(-3 * along + 0.6 * rng.standard_normal((6000, 24)))
    table, more = vectors(spark, enumerate(near)), vectors(spark, ((1000 + k, v) for k, v in enumerate(far)))
    queries = table.where("vec_id % 10 = 0")
    # a list of five is full in either table, so none is completed by comparing all candidates
    assert listed(neighbours.nearest(queries, table.unionByName(more), 5)) == listed(neighbours.nearest(queries, table, 5))


def test_recall_of_vectors_without_structure(spark):
    x = unit(np.random.default_rng(6).standard_normal((6000, 128)))
    table = vectors(spark, enumerate(x))
    got = listed(neighbours.nearest(table.where("vec_id % 60 = 0"), table, 20))
    right = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        right += len(set(np.argsort(-scores)[:20]) & {i for _, i, _ in found})
    assert len(got) == 100 and right >= 0.9 * 20 * len(got)


def test_sets_are_built_again_from_the_lines_asked_for(spark, tmp_path):
    """Only these leave their text, once for each row that repeats it."""
    text = "  a b  c d e f\tg \n\nx\ny  z"
    docs = spark.createDataFrame([(1, text), (None, text), (None, text)], "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    lines = linededup._token_sets(linededup._lines(docs), 5)
    sets = lines.where("doc_id IS NULL").dropDuplicates(["line"]).select(F.col("line").cast("long").alias("set_no"), "doc_id", "text_hash", "line").localCheckpoint()
    found = linededup._Join(docs, sets, 5, 80).full(sets.where("set_no > 0").select("set_no"))
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    wanted = {(r.line, tuple(r.tokens)) for r in lines.where("line > 0").collect()}
    rows = [(r.set_no, tuple(r.tokens)) for r in found.collect()]
    assert set(rows) == wanted and len(rows) == 2 * len(wanted) == 4
