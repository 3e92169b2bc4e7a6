"""Stages of the pipeline on small tables with repeated rows, nulls and empty texts, and the whole of it."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], SCHEMA)


def text(k, n=40):
    return " ".join(f"t{k}w{i}" for i in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def held(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.select("doc_id", F.coalesce("text", F.lit("<null>")).alias("text")).collect())


def test_near_copies_leave_one_row_of_each_group(spark):
    x, y, z = text(1), text(2), text(3)
    rows = [(5, x), (9, x + " more"), (5, y), (3, y), (7, None), (7, None), (8, ""), (1, z), (1, z), (None, z), (20, text(4)), (21, "one two")]
    docs = docs_of(spark, [(d, t, "s") for d, t in rows]).withColumn("np_hash", F.lit(0))
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert held(out) == sorted([(5, x), (3, y), (7, "<null>"), (7, "<null>"), (8, ""), (1, z), (-1, z), (20, text(4)), (21, "one two")])
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_contaminated_documents_go(spark, folder):
    passage = " ".join(f"b{i}" for i in range(12))
    sf = folder(benchmark=spark.createDataFrame([(1, passage), (None, "z1 z2 z3"), (3, None)], "item_id long, text string"))
    rows = [(1, f"before {passage} after", "s"), (2, text(2), "s"), (3, None, "s"), (4, "", None), (2, text(2), "s"), (5, "only b0 b1 b2 b3 b4 b5 b6 b7 b8 here", "s")]
    assert held(corpus_pipeline.drop_contaminated(spark, docs_of(spark, rows), sf)) == sorted([(2, text(2)), (2, text(2)), (3, "<null>"), (4, ""), (5, rows[5][1])])


def test_toxic_documents_go(spark, folder):
    rows = [(k, f"{text(k % 9, 12)} " + ("vile foul filth" if k % 2 else "kind calm mild"), "s") for k in range(60)] + [(90, None, "s"), (91, "", "s")]
    sf = folder(labels=spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int"))
    kept = {d for d, _ in held(corpus_pipeline.drop_toxic(spark, docs_of(spark, rows), sf))}
    assert kept & set(range(60)) == set(range(0, 60, 2))


def test_the_mix_repeats_documents_by_source(spark):
    rows = [(k, text(k, 10 + k % 7), "abc"[k % 3]) for k in range(600)]
    out = corpus_pipeline.mix_sources(spark, docs_of(spark, rows), "").withColumn("n", F.size(F.split("text", " "))).groupBy("source").agg(F.sum("n").alias("n")).collect()
    size = {s: sum(len(t.split()) for _, t, of in rows if of == s) for s in "abc"}
    whole = 1.5 * sum(size.values())
    # a is cut at twice its size, the rest is shared 2 to 1 until b is cut too
    wanted = {"a": 2 * size["a"], "b": min(2 * size["b"], (whole - 2 * size["a"]) * 2 / 3)}
    wanted["c"] = whole - wanted["a"] - wanted["b"]
    for r in out:
        assert abs(r.n - wanted[r.source]) <= 0.02 * wanted[r.source]


def test_all_stages(spark, folder):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = folder(documents=base.limit(80), labels=spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), benchmark=spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in base.collect()} and len(out) > 40
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
