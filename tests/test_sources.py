"""Readers and writers over files: strict and recovering, one document a file and one record a line."""

import gzip

import pytest

from docsluice.sources.tables import decoded, encoded, gated, read_documents, read_records, write_records


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return put


def test_ndjson_strict_and_recovering(spark, folder):
    path = folder("a.ndjson", '{"v":1}\nnot-json\n\n{"v":2}\n')
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        read_records(spark, path, schema="v long").collect()
    assert sorted(r.v for r in read_records(spark, path, schema="v long", on_error="skip").collect()) == [1, 2]
    reported = read_records(spark, path, schema="v long", on_error="report").collect()
    assert sorted((r.v or 0, r.error is None) for r in reported) == [(0, False), (1, True), (2, True)]


def test_ndjson_keeps_numbers_and_order(spark, folder):
    path = folder("a.jsonl", '{"b":1.50,"a":12345678901234567890123}\n')
    assert [r.value for r in read_records(spark, path).collect()] == ['{"b":1.50,"a":12345678901234567890123}']


@pytest.mark.parametrize("name, text", [("a.csv", "name,age\nann,3\n\"b,c\",4\n"), ("a.tsv", "name\tage\nann\t3\nb,c\t4\n")])
def test_delimited(spark, folder, name, text):
    path, form = folder(name, text), name[2:]
    with_header = read_records(spark, path, f"{form}-header", "name string, age string")
    assert sorted(map(tuple, with_header.collect())) == [("ann", "3"), ("b,c", "4")]
    typed = read_records(spark, path, f"{form}-header", "name string, age long", "{name, age: (.age | tonumber)}")
    assert sorted(map(tuple, typed.collect())) == [("ann", 3), ("b,c", 4)]
    assert [r.value for r in read_records(spark, path, form, program=".[0]").collect()] == ["name", "ann", "b,c"]


@pytest.mark.parametrize(
    "name, text, program, wanted",
    [
        ("a.json", '[{"a":1},{"a":2}]', ".[].a", ["1", "2"]), ("a.jsonc", '{"a":1, /* x */ "b":[1,],}', ".b[0]", ["1"]), ("a.json5", "{a: 'x', b: +1}", ".a", ["x"]), ("a.yaml", "a: [1, x]\n---\na: [2]\n", ".a[0]", ["1", "2"]),
        ("a.toml", "[t]\nx = 1\n[[u]]\ny = 'z'\n", ".u[0].y", ["z"]), ("a.xml", "<r><a k='1'>x</a></r>", ".r.a[\"@k\"]", ["1"]), ("a.html", "<p>x<p>y", ".html.body.p[1]", ["y"]), ("a.ini", "[s]\nk=v\n", ".s.k", ["v"]),
        ("a.properties", "k=v\n", ".k", ["v"]), ("a.env", "K=v\n", ".K", ["v"]), ("a.json-seq", "\x1e[1]\n\x1e[2]\n", ".[0]", ["1", "2"]), ("a.cbor", b"\x82\x01\x02", ".[1]", ["2"]), ("a.msgpack", b"\x92\x01\x02", ".[1]", ["2"]),
    ],
)
def test_documents(spark, folder, name, text, program, wanted):
    out = read_documents(spark, folder(name, text), program=program).collect()
    assert [r.value for r in out] == wanted and all(r.path.endswith(name) for r in out)


def test_a_broken_document(spark, folder):
    path = folder("a.json", '{"a":')
    with pytest.raises(Exception, match="json"):
        read_documents(spark, path).collect()
    assert read_documents(spark, path, on_error="skip").count() == 0
    assert read_documents(spark, path, on_error="report").collect()[0].error


def test_lines_and_compressed_files(spark, folder):
    assert [r.value for r in read_records(spark, folder("a.txt", "x y\n\nz\n"), schema="value long", program="length").collect()] == [3, 0, 1]
    assert [r.v for r in read_records(spark, folder("a.ndjson.gz", gzip.compress(b'{"v":7}\n')), "ndjson", "v long").collect()] == [7]


@pytest.mark.parametrize("form", ["ndjson", "csv", "yaml"])
def test_written_and_read(spark, tmp_path, form):
    table = spark.createDataFrame([(1, "a,b\"c", "x"), (2, None, "y")], "id long, s string, k string")
    write_records(table, str(tmp_path / "out"), form)
    if form == "yaml":
        back = read_documents(spark, str(tmp_path / "out" / "part-*"), "yaml", "id long, s string, k string").drop("path")
        assert sorted((r.id, r.s, r.k) for r in back.collect()) == [(1, 'a,b"c', "x"), (2, None, "y")]
        return
    back = read_records(spark, str(tmp_path / "out"), "csv-header" if form == "csv" else form, "id string, s string, k string")
    assert sorted((str(r.id), r.s or "", r.k) for r in back.collect()) == [("1", 'a,b"c', "x"), ("2", "", "y")]
    with pytest.raises(Exception, match="already exists"):
        write_records(table, str(tmp_path / "out"), form)


def test_written_by_value(spark, tmp_path):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id long, k string")
    write_records(table, str(tmp_path / "out"), "ndjson", by="k")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["k=x", "k=y"]


def test_gate(spark):
    table = spark.createDataFrame([(1, "a"), (20, None)], "id long, s string")
    good, bad = gated(table, '{"type":"object","properties":{"id":{"maximum":9},"s":{"type":"string"}}}')
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert [(r.id, len(r.errors)) for r in bad.collect()] == [(20, 2)]


def test_nothing_to_read_or_write(spark):
    empty = spark.createDataFrame([], "id long, content string")
    assert encoded(empty, "json").count() == 0 and decoded(empty, "content", "json").count() == 0
    assert decoded(spark.createDataFrame([(1, None)], empty.schema), "content", "json").count() == 0
