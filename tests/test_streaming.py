"""Streams from files that arrive in a folder, batch by batch."""

import json
import os

import pytest

from docsluice import streaming
from docsluice.functions.native import Unsupported


def drained(df, tmp_path, name, mode="append"):
    """What a stream has put out when all files that lie there are read."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *records):
        (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
        os.utime(folder / name, (0, 1_700_000_000 + int(name[0])))  # files are taken in this order
        return str(folder)

    return put


def test_each_record_once_and_bad_lines_reported(spark, inbox, tmp_path):
    inbox("1.ndjson", {"v": 1}, "not-json", {"v": 2})
    path = inbox("2.ndjson", {"v": 3})
    out = drained(streaming.follow(spark, path, schema="v long", program="{v: (.v * 10)}", on_error="report"), tmp_path, "each")
    assert sorted((r.v or 0, r.error is None) for r in out) == [(0, False), (10, True), (20, True), (30, True)]


def test_programs_on_rows(spark, inbox, tmp_path):
    path = inbox("1.ndjson", {"v": 1, "s": "a1"}, {"v": 5, "s": "b2"})
    rows = spark.readStream.schema("v long, s string").json(path)
    out = drained(streaming.live(rows, '.[] | select(.v > 2) | {v, d: [.s | scan("([0-9])")[0]]}', schema="v long, d array<string>"), tmp_path, "rows")
    assert [(r.v, r.d) for r in out] == [(5, ["2"])]
    for refused in ("sort_by(.v) | .[]", ".[0:2] | .[]", "group_by(.s) | map(length) | .[]", "length"):
        with pytest.raises(Unsupported):
            streaming.live(rows, refused)


def test_folds_go_on_from_batch_to_batch(spark, inbox, tmp_path):
    inbox("1.ndjson", {"k": "a", "t": 1, "ms": 10}, {"k": "b", "t": 1, "ms": 7})
    path = inbox("2.ndjson", {"k": "a", "t": 2, "ms": 20}, {"k": "a", "t": 3, "ms": 30})
    rows = spark.readStream.schema("k string, t long, ms double").option("maxFilesPerTrigger", 1).json(path)
    ewma = ".row.ms as $x | (if .state == null then $x else 0.5 * $x + 0.5 * .state end) as $n | {state: $n, out: $n}"
    out = drained(streaming.folded(rows, ["k"], ["t"], None, ewma, "ewma double"), tmp_path, "folds")
    assert sorted((r.k, r.ewma) for r in out) == [("a", 10.0), ("a", 15.0), ("a", 22.5), ("b", 7.0)]


def test_windows_of_rows(spark, inbox, tmp_path):
    inbox("1.ndjson", {"k": "a", "t": 1, "v": 1}, {"k": "a", "t": 2, "v": 2}, {"k": "a", "t": 3, "v": 3})
    path = inbox("2.ndjson", {"k": "a", "t": 4, "v": 4}, {"k": "b", "t": 1, "v": 9})
    rows = spark.readStream.schema("k string, t long, v double").option("maxFilesPerTrigger", 1).json(path)
    out = drained(streaming.every(rows, ["k"], ["t"], 2, "v"), tmp_path, "counts")
    assert sorted((r.k, r.n, r.sum, r.min, r.max) for r in out) == [("a", 2, 3.0, 1.0, 2.0), ("a", 2, 7.0, 3.0, 4.0)]


def test_windows_of_time_leave_late_rows_out(spark, inbox, tmp_path):
    inbox("1.ndjson", {"k": "a", "ts": "2024-01-01T00:00:05", "v": 1}, {"k": "a", "ts": "2024-01-01T00:01:10", "v": 2}, {"k": "a", "ts": "2024-01-01T01:00:00", "v": 3})
    inbox("2.ndjson", {"k": "a", "ts": "2024-01-01T02:00:00", "v": 4})
    path = inbox("3.ndjson", {"k": "a", "ts": "2024-01-01T00:00:06", "v": 100}, {"k": "a", "ts": "2024-01-01T02:00:01", "v": 5})
    rows = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).json(path)
    out = drained(streaming.windowed(rows, "ts", "1 minute", "5 minutes", ["k"], "v"), tmp_path, "late")
    assert sorted((str(r.start)[11:16], r.n, r.sum) for r in out) == [("00:00", 1, 1.0), ("00:01", 1, 2.0), ("01:00", 1, 3.0)]
