"""The corpus operators against brute force on small tables with nulls, empty texts, ties, repeats and extra columns."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm import chat, decontamination, langid, linededup, minhash, mixing, neighbours, secretscan, sharding, toxicity
from docsluice.llm._common import least_by_hash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the small table, with what is awkward."""
    few = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").where("doc_id < 120")
    odd = spark.createDataFrame([(9001, None, "en", "web"), (9002, "", "en", None), (9003, "one", "en", "web"), (9004, "one", "en", "web"), (9005, "A b c d e", "en", "web"), (9006, "a B c d e", "en", "web"), (9007, "word " * 30_000, "en", "web")], few.schema)
    return few.unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def shingles(text, width):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def test_minhash_equals_all_pairs(docs, rows):
    sets = {r.doc_id: shingles(r.text, 4) for r in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, width=4).collect()}
    assert len(found) == len(rows)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in found.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in ids}


def test_minhash_of_nothing(docs):
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90000, None), (90001, [0.0] * 4)], vectors.schema)
    table = vectors.collect()
    found = neighbours.nearest(vectors.unionByName(odd).where("vec_id % 20 = 0"), vectors.unionByName(odd), 20).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in table}
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12)
    right = 0
    for q in (k for k in x if k % 20 == 0):
        best = sorted((-float(x[q] @ v), k) for k, v in x.items() if k != q)[:20]
        right += len({k for _, k in best} & {v for v, _ in got[q].values()})
    assert 90000 not in got and right >= 0.9 * 20 * len(got)


def test_mixing_laws(docs, rows):
    found = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "lang").collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r["size"] for r in found} == {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    whole = sum(r["size"] for r in found)
    by = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(min(1.5 * whole, sum(2 * s for _, s, _ in by.values())))
    assert all(t <= 2 * s + 1e-6 for t, s, _ in by.values())
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in found}


def test_shards_balance(docs, rows):
    found = sharding.shard(docs, 24).collect()
    assert {r.doc_id: r["size"] for r in found} == {r.doc_id: len((r.text or "").encode()) + 8 for r in rows}
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in found if texts[r.doc_id] is not None)
    for k in {r.shard for r in found}:
        assert 0 <= k < 24
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|im_end|>\\|b"), (1, 1, "assistant", None), (1, 2, "assistant", "x\ny"), (2, 0, "assistant", "<\\|im_start|>"), (3, 0, "odd\nrole<|", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    found = {r.conv_id: r for r in chat.digests(chat.format_chats(table)).collect()}
    for conv in (1, 2, 3):
        mine = [t for t in turns if t[0] == conv]
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert found[conv].n_turns == len(mine)
        assert found[conv].turns_sha256 == sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_decontamination_equals_scan(spark, docs, rows):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    benchmark = benchmark.unionByName(spark.createDataFrame([(7000, None), (7001, ""), (7002, "one"), (7003, "C d e")], benchmark.schema))
    windows = {}
    for item in benchmark.collect():
        w = words(item.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item.item_id))
    wanted = {}
    for r in rows:
        w, hit, items = words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        wanted[r.doc_id] = (len(w), len(hit), len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    out = decontamination.decontaminate(docs.select("doc_id", "text"), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == wanted


def test_language_accuracy(docs):
    marked = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = langid.fit(marked.where("NOT held_out"))
    out = {r.doc_id: r for r in langid.predict(marked.select("doc_id", "held_out", "text", "lang"), model).collect()}
    assert out[9001].lang_pred == "und" and out[9002].lang_pred == "und"
    held = [r for r in out.values() if r.held_out and r.doc_id < 9000]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    index = toxicity.fit(docs.where(~held(F.col("doc_id"))), labels.where(~held(F.col("doc_id"))))
    out = toxicity.score(docs.where(held(F.col("doc_id"))).select("doc_id", "text"), index).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.9 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, index).collect())


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(5)
    examples = [(k, int(k % 2), toxicity.packed({int(t): int(rng.integers(1, 4)) for t in rng.choice(30, rng.integers(1, 8), replace=False)})) for k in range(400)]
    index = toxicity.Index([f"t{k}" for k in range(30)], rng.random(30) + 0.5, examples, (1.0, 1.0))
    dense = np.zeros((400, 30))
    for k, e in enumerate(examples):
        at, values = index.vector(e[2])
        dense[k, at] = values
    for k in range(0, 400, 7):
        _, scores = index.nearest(*index.vector(examples[k][2]), without=k)
        cosines = dense @ dense[k]
        cosines[k] = -1
        assert np.allclose(scores, np.sort(cosines)[::-1][: len(scores)])


def examples_of(rng, n, terms, words):
    """Labelled examples whose words are as unevenly frequent as those of texts, the last ones copies of the first."""
    share = 1 / np.arange(1, terms + 1)
    some = [rng.choice(terms, words, p=share / share.sum()).tolist() for _ in range(n)]
    some[-n // 10 :] = some[: n // 10]
    return [(k, k % 2, toxicity.packed(Counter(w))) for k, w in enumerate(some)]


def test_toxicity_reads_few_postings(monkeypatch):
    rng = np.random.default_rng(11)
    examples = examples_of(rng, 1500, 20_000, 300)
    index = toxicity.Index([f"t{k}" for k in range(20_000)], rng.random(20_000) + 0.1, examples, (1.0, 1.0))
    many, asked, read, count = np.bincount(np.concatenate([e[2][0] for e in examples])), examples[:200:4], [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *more, **named: read.append(len(x)) or count(x, *more, **named))
    index.nearest(*index.vector(asked[0][2]))
    read.clear()
    for e in asked:
        index.nearest(*index.vector(e[2]))
    assert sum(read) < 0.5 * sum(int(many[e[2][0]].sum()) for e in asked)


def test_toxicity_nearest_with_ties_and_tiny_weights():
    rng = np.random.default_rng(12)
    for n, terms, words, idf in ((1500, 20_000, 60, rng.random(20_000)), (300, 50, 5, 10.0 ** -rng.integers(0, 30, 50)), (10, 40, 9, np.ones(40)), (400, 700, 40, np.zeros(700))):
        examples = examples_of(rng, n, terms, words)
        index = toxicity.Index([f"t{k}" for k in range(terms)], idf, examples, (1.0, 1.0))
        vectors = [index.vector(e[2]) for e in examples]
        asked = [index.vector(e[2]) for e in examples_of(rng, 40, terms, words)] + vectors[:40]
        without = [-1] * 40 + list(range(len(vectors[:40])))
        for (at, values), but, (near, cosines) in zip(asked, without, index.nearest_all(asked, without), strict=True):
            whole = np.zeros(terms)
            whole[at] = values
            sums = [float(np.cumsum([0, *(whole[t] * v)])[-1]) if k != but else 0 for k, (t, v) in enumerate(vectors)]
            best = sorted((-x, k) for k, x in enumerate(sums) if x)[: toxicity.NEAREST]
            assert near.tolist() == [k for _, k in best]
            assert np.allclose(cosines, [-x for x, _ in best], rtol=1e-12, atol=0)


def test_toxicity_words_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x11000)))
    texts = [every, every[:0xD800], *every.split("0"), "", "A_b", "\u0130\u00df \U0001d400x", "a\ud800b", "\ud835\udc00 z", "Stra\u00dfe--caf\u00e9\x1cdos\u2028tres", "x" * 100_000]
    texts += [f"{c}a{c}1{c}" for c in every[:0x3100]]
    for text in texts:
        assert toxicity.words(text) == toxicity.WORD.findall(text.lower())
        terms = {w: k for k, w in enumerate(sorted(set(toxicity.words(text)))[::2])}
        at, times = toxicity.counted(text, terms)
        want = sorted((terms[w], n) for w, n in Counter(toxicity.WORD.findall(text.lower())).items() if w in terms)
        assert list(zip(at.tolist(), times.tolist(), strict=True)) == want
    assert [len(x) for x in toxicity.counted(None, {"a": 0})] == [0, 0]


def test_repeated_lines_go(spark):
    line = "the quick brown fox jumps over the lazy dog again and again today"
    table = spark.createDataFrame([(1, f"{line}\nfirst own line of this document here"), (2, f"other words stand in this line alone\n{line}"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in linededup.repeated_lines(table).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert [out[k].n_removed for k in (1, 2, 3, 4)] == [0, 1, 0, 0]


def test_least_by_hash_is_exact(spark):
    rows = [(k, "a" if k % 3 else "b") for k in range(6000)] + [(7, "c")] * 900 + [(None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, kind string")
    sizes = {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = least_by_hash(df, "kind", sizes, 20).withColumn("h", F.xxhash64("doc_id")).collect()
    hashed = df.withColumn("h", F.xxhash64("doc_id")).collect()
    for kind in "abcd":
        expected = sorted(r.h for r in hashed if r.kind == kind)[:20]
        assert sorted(r.h for r in got if r.kind == kind) == expected
    assert not least_by_hash(df, "kind", {}, 20).count()


def test_planted_secrets_are_found(spark):
    key, token = "AKIA" + "Q7ZX3M9KD2LW8RTB", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [(1, f"use aws_access_key_id={key} here"), (2, f"a password= {token}"), (3, f"at commit {token} it broke"), (4, "see /static/images/article-category-12.html now"), (5, None), (6, ""), (7, "plain words only " * 2000), (8, f"use aws_access_key_id={key} here")]
    out = secretscan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.secret} == {1, 2, 8}
    assert {r.value for r in out if r.secret} == {key, token}
    clean = secretscan.redacted(spark.createDataFrame(texts, "doc_id long, text string"))
    held = {r.doc_id: r.text for r in clean.collect()}
    assert key not in held[1] + held[8] and held[3] == texts[2][1] and held[5] is None


def test_secrets_inside_words_are_candidates(spark):
    token, key, bare = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "ghp_" + "Zk3Q9xLw7TbV2mNc8RfY5sHd1GjP6uKa4EoX", "AKIA" + "QBZXLMKDRDWLFRTB"
    texts = [
        (1, f'my token = "{token}"### next'),
        (2, f'{{"token":"{key}","user":"a"}}'),
        (3, f"see https://api.widgets.org/v1/list?api_key={token}&v=1 now"),
        (4, f"password={token};secret={key}|x"),
        (5, f"aws_access_key_id={bare}, the key"),
        (6, "a" * 17 + "," + ",".join(f"{k:020d}" for k in range(500)) + "-"),
    ]
    out = secretscan.candidates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.value) for r in out if r.doc_id < 6 and r.value in (token, key, bare)} == {(1, token), (2, key), (3, token), (4, token), (4, key), (5, bare)}
    assert sorted(r.value for r in out if r.doc_id == 6)[:500] == [f"{k:020d}" for k in range(499)] + [f"{499:020d}-"]
    assert all(r.before.endswith(("token = \"", "\"token\":\"", "api_key=", "password=", "secret=", "aws_access_key_id=")) for r in out if r.value in (token, key, bare))
    found = secretscan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.value) for r in found if r.secret and r.doc_id < 6} >= {(1, token), (2, key), (3, token), (4, token), (4, key), (5, bare)}


def unequal(spark, lengths):
    """(table, vectors by id) of the small table's directions with other lengths."""
    few = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = {r.vec_id: np.array(r.embedding, float) * lengths[k % len(lengths)] for k, r in enumerate(few)}
    return spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id long, embedding array<double>"), x


def recall(table, x, k=20):
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 20 = 0"), table, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wanted = {q: {i for _, i in sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:k]} for q in x if q % 20 == 0}
    return sum(len(wanted[q] & got.get(q, set())) for q in wanted) / sum(map(len, wanted.values()))


def test_neighbours_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(3)
    assert recall(*unequal(spark, [100.0] + [1.0] * 10_000)) >= 0.9
    assert recall(*unequal(spark, np.exp(rng.standard_normal(10_000)))) >= 0.9


def test_toxicity_of_even_labels_and_rare_words(spark):
    rng = np.random.default_rng(7)
    plain = lambda: " ".join(f"word{k}" for k in rng.integers(0, 40, 12))
    texts = [(k, plain() + (f" vile{k % 20} foul{k % 7}" if k % 2 else f" kind{k % 20} calm{k % 7}"), k % 2) for k in range(240)]
    texts += [(1000, "scoundrelry unheardof", 1), (1001, "meadow larksong", 0)]
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    index = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert set(index.names) == {w for _, t, _ in texts for w in t.split()}
    held = [(k, plain() + (f" vile{k % 20} foul{k % 7}" if k % 2 else f" kind{k % 20} calm{k % 7}"), k % 2) for k in range(2000, 2040)]
    held += [(3000, "such scoundrelry", 1), (3001, "a larksong", 0)]
    out = toxicity.score(spark.createDataFrame(held, "doc_id long, text string, toxic int"), index).collect()
    assert all(r.predicted == r.toxic for r in out)


def test_neighbours_of_repeated_ids(spark):
    table, x = unequal(spark, [1.0])
    near = neighbours.nearest(table.where("vec_id = 0"), table, 1).first().vec_id
    copies = table.where(f"vec_id = {near}").crossJoin(spark.range(70)).select("vec_id", F.transform("embedding", lambda v: v * (1 + F.col("id") / 1e6)).alias("embedding"))
    out = [r.vec_id for r in neighbours.nearest(table.where("vec_id = 0"), table.unionByName(copies), 20).collect()]
    assert len(out) == len(set(out)) == 20


def test_neighbours_of_small_tables_are_whole(spark):
    table, x = unequal(spark, [1.0])
    few = table.where("vec_id < 15")
    out = neighbours.nearest(table.where("vec_id in (0, 100)"), few, 20).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert got == {q: [i for _, i in sorted((-float(x[q] @ x[i]), i) for i in range(15) if i != q)] for q in (0, 100)}


def test_short_lines_match_at_lower_percent(spark):
    table = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t")], "doc_id long, text string")
    gone = lambda percent: {r.doc_id for r in linededup.repeated_lines(table, percent=percent).where("n_removed > 0").collect()}
    assert gone(75) == {2} and gone(80) == set()
