"""Plans give what the evaluator gives, filters reach the scan, and errors are what the language says they are."""

import math

import pytest
from pyspark.sql import functions as F

from docsluice.families import FAMILIES
from docsluice.functions.native import Unsupported
from docsluice.lang.evaluate import Raised, evaluate
from docsluice.lang.parser import parse
from docsluice.plans.compiler import compile_program
from docsluice.plans.records import fields_read

#: A program on .x, the column as SQL, and the same value here.
SAME = [
    ('gsub("[0-9]+"; "$")', "'x12y'", "x12y"), ('gsub("[a-z]"; "\\\\")', "'x1'", "x1"), ("sort", "array(2D, double('NaN'), 1D)", [2.0, math.nan, 1.0]), ("unique", "array(2D, double('NaN'), 1D, 2D)", [2.0, math.nan, 1.0, 2.0]),
    ("max", "array(double('NaN'), 1D)", [math.nan, 1.0]), ("min", "array(double('NaN'), 1D)", [math.nan, 1.0]), ("flatten", "array(array(array(1, 2)), array(array(3)))", [[[1, 2]], [[3]]]),
    ('[scan("[a-c]")]', "'abcab'", "abcab"), ('[splits(", *")]', "'a, b,c'", "a, b,c"), ('test("a.b"; "m")', "'a\\nb'", "a\nb"), ('test("A"; "i")', "'a'", "a"), ('test("a b"; "x")', "'ab'", "ab"),
    ("tostring", "1D/3000000", 1 / 3000000), ("tostring", "1.5e8D", 1.5e8), ("tostring", "1.25e20D", 1.25e20), ("tostring", "0.00012D", 0.00012), ("tostring", "-123456789.125D", -123456789.125), ("tostring", "1.5D", 1.5), ("tostring", "-2e-7D", -2e-7),
    ("toboolean", "'true'", "true"), ("ascii_upcase", "'aé'", "aé"), ("length", "'aé'", "aé"), ("explode", "'ab'", "ab"), ('split("")', "'ab'", "ab"), ('split(",")', "''", ""), ('join("-")', "array('a', null, 'b')", ["a", None, "b"]),
    ("round", "2.5D", 2.5), ("round", "-2.5D", -2.5), ("floor", "-0.5D", -0.5), (". % 3", "-7", -7), ("not", "null", None), ("@html", "'<&>'", "<&>"), ("@uri", "'a b/~*'", "a b/~*"), ("indices(\"a\")", "'aba'", "aba"),
    (". > 1", "double('NaN')", math.nan), (". < 1", "double('NaN')", math.nan), (". == .", "double('NaN')", math.nan), (". >= .", "double('NaN')", math.nan), (". > null", "double('NaN')", math.nan), (". < 0", "cast(null as double)", None), (". // 7", "cast(null as int)", None), ("[.[] | select(. > 1)]", "array(1, 2, 3)", [1, 2, 3]),
    ("reverse", "array(1, 2)", [1, 2]), ("add", "array(1, 2)", [1, 2]), ("any(. > 1)", "array(1, 2)", [1, 2]), ('ltrimstr("a")', "'ab'", "ab"), ('rtrimstr("")', "'ab'", "ab"), (".[1:]", "'héy'", "héy"), (". * 3", "'ab'", "ab"), (". / \",\"", "'a,b'", "a,b"),
]


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    return "nan" if isinstance(v, float) and v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("program, sql, value", SAME)
def test_plan_is_the_language(spark, program, sql, value):
    found = compile_program(f".[] | {{x: (.x | {program})}}", spark.sql(f"SELECT {sql} AS x")).collect()[0].x
    assert plain(found) == plain(evaluate(program, value)[0])


@pytest.mark.parametrize("program, sql, value", [("ascii_upcase", "cast(null as string)", None), (". - 1", "cast(null as int)", None), ("toboolean", "'yes'", "yes"), ("floor", "cast(null as double)", None)])
def test_errors_are_errors(spark, program, sql, value):
    with pytest.raises(Raised):
        evaluate(program, value)
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        compile_program(f".[] | {{x: (.x | {program})}}", spark.sql(f"SELECT {sql} AS x")).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("a"), F.col("id").cast("double").alias("b"), F.col("id").cast("string").alias("c"), F.lit(1).alias("unread")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    pushed = plan_of(compile_program('.[] | select(.a > 3 and .a <= 7 and .c == "5") | {a}', table))
    assert "GreaterThan(a,3)" in pushed and "Or(LessThanOrEqual(a,7),IsNull(a))" in pushed and "EqualTo(c,5)" in pushed
    assert "unread" not in pushed.split("ReadSchema")[1]
    assert "LessThan(b" not in plan_of(compile_program(".[] | select(.b < 3) | {a}", table))
    assert "Or(LessThan(b,3.0),IsNull(b))" in plan_of(compile_program(".[] | select(.b < 3) | {a}", table, finite=True))
    assert sorted(r.a for r in compile_program('.[] | select(.a > 3 or .c == "1") | {a}', table).collect()) == [1, 4, 5, 6, 7, 8, 9]


def test_filters_of_nulls_and_nan(spark):
    table = spark.sql("SELECT * FROM VALUES (1, 1D), (2, double('NaN')), (3, null), (4, 5D) AS t(id, x)")
    rows = [{"id": 1, "x": 1.0}, {"id": 2, "x": math.nan}, {"id": 3, "x": None}, {"id": 4, "x": 5.0}]
    for test in ("< 3", "<= 1", "> 3", ">= 5", "== 5", "!= 5", "> 3 or .id == 2", "> 3 and .id != 4"):
        program = f".[] | select(.x {test}) | .id"
        assert sorted(r.value for r in compile_program(program, table).collect()) == evaluate(program, rows), test


def test_set_difference_has_no_repeats(spark):
    table = spark.createDataFrame([(3,), (1,), (3,)], "k long")
    other = spark.createDataFrame([(1,)], "k long")
    assert [r.value for r in compile_program("except(map(.k); $o | map(.k)) | .[]", table, tables={"o": other}).collect()] == [3]


def test_slice_without_order(spark):
    assert compile_program(".[0:1] | .[]", spark.range(3)).count() == 1


def test_records_run_what_has_no_plan(spark):
    table = spark.createDataFrame([(1, "a1b2"), (2, None), (3, "c")], "id long, s string")
    program = '.[] | select(.id != 9) | {id, m: [.s | strings | scan("([a-z])([0-9])") | join("-")]}'
    with pytest.raises(Unsupported):
        compile_program(program, table)
    out = compile_program(program, table, schema="id long, m array<string>")
    assert {r.id: r.m for r in out.collect()} == {1: ["a-1", "b-2"], 2: [], 3: []}
    assert "MapInArrow" in plan_of(out)


def test_what_becomes_of_errors(spark):
    table = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id long, s string")
    program = ".[] | {id, n: (.s | tonumber)}"
    with pytest.raises(Exception, match="Raised"):
        compile_program(".[] | {id, n: (.s | tonumber | frexp[1])}", table, schema="id long, n long").collect()
    assert [r.id for r in compile_program(program, table, schema="id long, n long", on_error="skip").collect()] == [1]
    reported = compile_program(program, table, schema="id long, n long", on_error="report").collect()
    assert [(r.n, r.error is None) for r in reported] == [(5, True), (None, False), (None, False)]


def test_groups_run_folds_in_order(spark):
    table = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 1, 7)], "k string, t long, v long")
    program = "group_by(.k) | map({k: .[0].k, steps: [foreach .[] as $r (0; . + $r.v)]}) | .[]"
    assert sorted((r.k, r.steps) for r in compile_program(program, table, ["t"], schema="k string, steps array<long>").collect()) == [("a", [5, 6]), ("b", [7])]
    assert compile_program(program, table.where("false"), ["t"], schema="k string, steps array<long>").count() == 0


@pytest.mark.parametrize("program, fields", [(".a.b", {"a"}), ("{a, b: (.c | length)}", {"a", "c"}), (". | keys", None), ("to_entries", None), ("if .a then .b else 1 end", {"a", "b"}), ('"\\(.a)"', {"a"}), (".a as $x | .b + $x", {"a", "b"}), ("[.a[] | . + 1]", {"a"}), ("reduce .a[] as $x (0; . + $x)", {"a"}), ("first(.a, .b)", {"a", "b"}), ('test("x")', None), (".a |= 1", None)])
def test_fields_read(program, fields):
    assert fields_read(parse(program)) == fields


def test_arguments(spark):
    table = spark.createDataFrame([(1, "a"), (5, "b")], "id long, s string")
    assert [r.id for r in compile_program(".[] | select(.id > $least) | {id}", table, arguments={"least": 3}).collect()] == [5]
    out = compile_program(".[] | select(.id > $least) | {id, t: (.s | in($names))}", table, schema="id long, t boolean", arguments={"least": 3, "names": {"b": 1}}).collect()
    assert [(r.id, r.t) for r in out] == [(5, True)]


def test_sums_by_key_and_joins_by_index(spark):
    table = spark.createDataFrame([("a", 1), ("b", 5), ("a", 2)], "k string, v long")
    other = spark.createDataFrame([("a", "first"), ("a", "last")], "k string, n string")
    assert compile_program("reduce .[] as $r ({}; .[$r.k] += $r.v)", table).collect()[0].value == {"a": 3, "b": 5}
    out = compile_program("INDEX($o[]; .k) as $ix | JOIN($ix; .[]; .k; {v: .[0].v, n: .[1].n})", table, tables={"o": other}, table_orders={"o": ["n"]})
    assert sorted((r.v, r.n) for r in out.collect()) == [(1, "last"), (2, "last"), (5, None)]


def test_arrays_of_groups_are_one_for_each(spark):
    table = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 1, 7)], "k string, t long, v long")
    for body, wanted in (("[counter(.[].v)]", ["[1,2]", "[1]"]), ("reduce .[] as $r (0; . + $r.v)", ["6", "7"]), ("length", ["2", "1"])):
        out = compile_program(f"group_by(.k) | .[] | {body}", table, ["t"], schema="value string")
        assert sorted(str(r.value) for r in out.collect()) == sorted(wanted), body


def test_windows_of_groups_are_windows(spark):
    table = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 1, 7), ("a", 3, 2)], "k string, t long, v long")
    rows = [{"k": "a", "t": 1, "v": 5}, {"k": "a", "t": 2, "v": 1}, {"k": "a", "t": 3, "v": 2}, {"k": "b", "t": 1, "v": 7}]
    for call in ("windows(2; .[].v)", "moving_sum(2; .[].v)", "moving_avg(2; .[].v)", "moving_min(2; .[].v)", "moving_max(9; .[].v)", "lag(.[].v)", "deltas(.[].v)", "counter(.[].v)"):
        out = compile_program(f"group_by(.k) | .[] | {call}", table, ["t"])
        assert "Window" in plan_of(out) and sorted(map(str, (plain(r.value) for r in out.collect()))) == sorted(map(str, map(plain, evaluate(f"group_by(.k) | .[] | {call}", rows)))), call


@pytest.mark.parametrize("program, sql, value", [("explode | implode", "'é😀a'", "é😀a"), ("explode | implode", "''", ""), ("implode", "array(65279, 97, 55296, -1, 1114112)", [65279, 97, 55296, -1, 1114112])])
def test_code_points_are_plans(spark, program, sql, value):
    out = compile_program(f".[] | {{x: (.x | {program})}}", spark.sql(f"SELECT {sql} AS x"))
    assert out.collect()[0].x == evaluate(program, value)[0]


def test_text_pieces_is_a_plan(spark):
    assert "MapInArrow" not in plan_of(FAMILIES["text_pieces"](spark, "/root/testdata/sf0.001"))
