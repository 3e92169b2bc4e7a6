"""Nulls, repeats, empty tables and clashing columns: what each operator says it does with them."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from docsluice.llm import _common, chat, decontamination, langid, minhash, mixing, secretscan, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS)


def test_near_duplicates_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    table = docs_of(spark, (5, text), (5, text), (3, text + " x"), (None, text), (7, None), (8, "a")).withColumn("component_id", F.lit("own"))
    out = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table, width=4).collect())
    assert out == [(0, 27, None, True), (3, 28, 3, True), (5, 27, 3, False), (5, 27, 3, False), (7, 0, 7, True), (8, 1, 8, True)]
    keyed = minhash.near_duplicates(table, width=4, keys=("component_id",))
    assert keyed.columns[0] == "component_id" and keyed.count() == 6


def test_mixing_of_nothing_and_of_repeats(spark):
    table = docs_of(spark, (1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, "en", "s"), (None, "x y", "en", None)).withColumn("target", F.lit("own")).withColumn("more", F.lit(1))
    assert mixing.mix(table.where("false")).count() == 0
    out = mixing.mix(table).collect()
    assert sorted(r["size"] for r in out) == [0, 2, 3, 3] and {r.more for r in out} == {1}
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
    assert {r.source: r.source_size for r in out} == {"s": 6, None: 2}


def test_taken_words_come_near_the_targets(spark):
    rows = [(k, " ".join(["w"] * (3 + k % 40)), "en", ["a", "b", "c", None][k % 4]) for k in range(4000)] + [(9999, "w " * 3000, "en", "c")]
    out = mixing.mix(docs_of(spark, *rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in out) and len(out) == 4


def test_languages_of_nothing(spark):
    table = docs_of(spark, (1, "½ ² Ⅷ 12"), (2, "the house"), (2, "the house"), (3, None), (4, ""), (None, "one")).withColumn("score", F.lit("own"))
    none = langid.fit(table)
    assert {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}
    one = langid.fit(docs_of(spark, (1, "the house is there", "en"), (2, None, "xx"), (3, "das haus", "de")))
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(table, one).collect()}
    assert out[1, "½ ² Ⅷ 12"] == out[3, None] == out[4, ""] == ("und", 0.0) and out[2, "the house"][0] == "en"
    assert langid.predict(table.where("false"), one).count() == 0
    assert langid.text_words("aⅧb c½") == ["a", "b", "c"]


def test_shards_of_repeats_and_nothing(spark):
    table = docs_of(spark, *[(k % 50, "x" * (k % 13)) for k in range(400)], (None, "first"), (60, None)).withColumn("shard", F.lit("own"))
    out = sharding.shard(table, 24).orderBy("shard", "slot").collect()
    assert len(out) == 402 and out[0].doc_id is None and [r.doc_id for r in out[1:]] == sorted(r.doc_id for r in out[1:])
    sizes = [sum(r["size"] for r in out if r.shard == k) for k in range(24)]
    whole, largest = sum(sizes), max(r["size"] for r in out)
    assert all(abs(s - whole / 24) <= largest for s in sizes)
    assert [r.text_crc32 for r in out if r.doc_id == 60] == [None]
    assert sharding.shard(table.where("false"), 24).count() == 0


def test_chats_of_awkward_turns(spark):
    turns = [(1, 0, None, "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, "user", None), (2, 0, "assistant", "long " * 30_000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(table)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[1].loss_sha256 == sha256(b"bb").hexdigest()
    assert out[1].turns_sha256 == sha256(b"\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert out[2].loss_chars == 150_000
    assert chat.digests(chat.format_chats(table.where("false"))).count() == 0


def test_toxicity_without_classes(spark):
    table = docs_of(spark, (1, "vile"), (2, "kind"), (3, None)).select("doc_id", "text")
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, toxic int")
    for rows, rate in (((1, 1), (2, 1)), 1.0), (((1, 0), (1, 0)), 0.0), ((), 0.0), (((1, None),), 0.0):
        assert {r.score for r in toxicity.score(table, toxicity.fit(table, labels(*rows))).collect()} == {rate}
    index = toxicity.fit(table, labels((1, 1), (1, 0), (2, 0)))
    assert toxicity.score(table.where("false"), index).count() == 0


def test_toxicity_beats_the_larger_class(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    index = toxicity.fit(docs.where(~held(F.col("doc_id"))), labels.where(~held(F.col("doc_id"))))
    out = toxicity.score(docs.where(held(F.col("doc_id"))).select("doc_id", "text").join(labels, "doc_id"), index).select("score", "predicted", "toxic").collect()
    toxic = sum(r.toxic for r in out)
    hits, called = sum(r.toxic and r.predicted for r in out), sum(r.predicted for r in out)
    brier, constant = sum((r.score - r.toxic) ** 2 for r in out) / len(out), toxic / len(out) * (1 - toxic / len(out))
    assert hits >= 0.9 * toxic and hits >= 0.5 * called
    assert sum(r.predicted == r.toxic for r in out) > len(out) - toxic and brier < 0.6 * constant


def test_secrets_of_nothing_and_of_unnamed_rows(spark):
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    table = docs_of(spark, (None, f"a password= {token}"), (None, f"a password= {token}"), (1, None), (2, "x" * 100_000))
    out = secretscan.scan(table).where("secret").collect()
    assert [(r.doc_id, r.value) for r in out] == [(None, token)] * 2
    assert secretscan.scan(table.where("false")).count() == 0
    assert sorted(r.text for r in secretscan.redacted(table).where("doc_id IS NULL").collect()) == ["a password= <secret>"] * 2


def test_decontamination_by_awkward_items(spark):
    items = lambda *rows: spark.createDataFrame(list(rows), "item_id long, text string")
    table = docs_of(spark, (1, "a b c d"), (1, "a b c d"), (2, None), (None, "x a b y"), (3, "B")).withColumn("dc_id", F.lit("own"))
    out = decontamination.decontaminate(table, items((None, "a b"), (5, "b"), (5, "b"), (6, None), (7, "")))
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out.collect())
    assert got == [(0, 4, 2, 1, True), (1, 4, 2, 1, True), (1, 4, 2, 1, True), (2, 0, 0, 0, False), (3, 1, 1, 1, True)]
    assert not decontamination.decontaminate(table, items((6, None))).where("contaminated").count()
    assert decontamination.decontaminate(table.where("false"), items((5, "b"))).count() == 0


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        _common.shared_dir(Session())


def planned(spark):
    """How many queries the driver has planned so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_near_duplicates_skip_steps_that_nothing_is_left_for(spark):
    one = " ".join(f"a{k}" for k in range(60))
    table = docs_of(spark, (1, one), (2, one + " x"), (3, " ".join(f"b{k}" for k in range(60))))
    before = planned(spark)
    out = minhash.near_duplicates(table, width=4)
    many = planned(spark) - before
    assert many <= 28
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("small", [1, 64])
def test_links_found_late_join_components(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    # a chain of windows over one sequence: each is like the next few only, and none like the earliest of a whole bucket
    rows = [(k, " ".join(f"w{i}" for i in range(3 * k, 3 * k + 60))) for k in (*range(0, 40, 2), *range(1, 40, 2))]
    rows += [(100 + k, " ".join(f"v{i}" for i in range(30 * k, 30 * k + 60))) for k in range(6)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, *rows), width=4).collect()}
    assert out == {d: 0 if d < 100 else d for d, _ in rows}
