"""What the evaluator does on records: on all cores, and in little time a record."""

import math
import time

from docsluice.functions import numeric
from docsluice.lang.evaluate import Run, evaluate
from docsluice.plans.compiler import compile_program


def test_bessel_functions_take_no_integrals():
    start = time.perf_counter()
    for k in range(1, 301):
        evaluate("[j0, j1, y0, y1, jn(3; .), yn(2; .)]", k / 50)
    assert time.perf_counter() - start < 3
    for name, order, kind in (("j0", 0, "j"), ("j1", 1, "j"), ("y0", 0, "y"), ("y1", 1, "y")):
        assert math.isclose(evaluate(name, 2.5)[0], numeric.series(2.5, order, kind), rel_tol=1e-10)
    assert evaluate("[y0, y1]", 0) == [[-math.inf, -math.inf]]
    assert evaluate("y0 | isnan", -1) == [True]


def test_records_of_a_small_file_reach_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = compile_program(".[] | {id, e: (.id | frexp[1])}", table, schema="id long, e long")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > table.rdd.getNumPartitions()
    assert sorted((r.id, r.e) for r in out.collect()) == [(k, math.frexp(k)[1]) for k in range(100)]


def test_objects_of_several_outputs_are_lazy_and_in_order():
    assert evaluate("{a: (1, 2), b: (3, 4)} | [.a, .b]", None) == [[1, 3], [1, 4], [2, 3], [2, 4]]
    assert evaluate("first({a: (1, error)})", None) == [{"a": 1}]
    assert evaluate("{a: 1, b: empty}, {}", None) == [{}]
    assert evaluate('{("a", "b"): 1, a: 2}', None) == [{"a": 2}, {"b": 1, "a": 2}]


def test_random_numbers_are_made_when_asked_for():
    run = Run(seed=7)
    assert "random" not in vars(run) and run.random.random() == Run(seed=7).random.random()


def test_while_and_until_are_deep_and_have_all_outputs():
    assert evaluate("until(. > 20000; . + 1)", 0) == [20001]
    assert evaluate("last(while(. < 20000; . + 1))", 0) == [19999]
    old = "def w(c; u): def w: if c then ., (u | w) else empty end; w; def n(c; u): def w: if c then . else (u | w) end; w; "
    for mine, theirs in (("while(. < 9; (. * 2, . + 5))", "w(. < 9; (. * 2, . + 5))"), ("until(. > 9, . > 20; (. * 2, . + 5))", "n(. > 9, . > 20; (. * 2, . + 5))"), ("[limit(3; until(. > 1; error), 1)]?", "[limit(3; n(. > 1; error), 1)]?")):
        assert evaluate(f"[{mine}]", 1) == evaluate(f"{old}[{theirs}]", 1)
    assert evaluate('[path(while(type == "object"; .a))]', {"a": {"a": 1}}) == [[[], ["a"]]]


def test_quoted_printable_keeps_letters_after_soft_line_ends():
    text = "A" * 200 + "=É" + "B" * 100
    assert evaluate("quoted_printable_encode | quoted_printable_decode", text) == [text]
    assert evaluate("quoted_printable_encode", "=É") == ["=3d=c3=89"]


def test_texts_of_many_matches_are_replaced_without_recursion():
    assert evaluate('gsub("a"; "b")', "a" * 20000) == ["b" * 20000]
    assert evaluate('[gsub("(?<x>[ab])"; .x + "1", .x + "2")]', "a-b") == [["a1-b1", "a1-b2", "a2-b1", "a2-b2"]]
    assert evaluate('[gsub("a"; empty)], [sub("z"; empty)], first(gsub("a"; "b", error))', "aa") == [[], ["aa"], "bb"]
    assert evaluate('[match("(a)(?<x>b)?"; "g")]', "aab") == [[{"offset": k, "length": n, "string": t, "captures": [{"offset": k, "length": 1, "string": "a", "name": None}, {"offset": 2 if k else -1, "length": k, "string": "b" if k else None, "name": "x"}]} for k, n, t in ((0, 1, "a"), (1, 2, "ab"))]]
