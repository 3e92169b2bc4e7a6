"""Dates after the year 9999, in plans and in the evaluator."""

import pytest

from docsluice.lang.evaluate import Raised, evaluate
from docsluice.plans.compiler import compile_program

#: The last second of 9999, the first of 10000, and one in 26614.
LATE = [253402300799, 253402300800, 777698913589]


@pytest.mark.parametrize("program", ["todate", "todate | fromdate", 'strftime("%Y/%m/%d %H:%M:%S %j")', 'strftime("%F")'])
def test_late_years_in_plans(spark, program):
    table = spark.createDataFrame([(t,) for t in LATE], "t long")
    assert [r.value for r in compile_program(f".[] | (.t | {program})", table).collect()] == [evaluate(program, t)[0] for t in LATE]


def test_late_years_in_the_evaluator():
    for t in [*LATE, -62167219201, 951782400]:
        assert evaluate("gmtime | mktime", t) == [t]
    for t in LATE:
        assert evaluate('[(strftime("%Y-%m-%d %H:%M:%S") | strptime("%Y-%m-%d %H:%M:%S") | mktime), (torfc3339 | fromrfc3339), (todate | fromdate)]', t) == [[t] * 3]
    assert evaluate("gmtime", LATE[1]) == [[10000, 0, 1, 0, 0, 0, 6, 0]]
    assert evaluate("fromrfc3339", "26614-04-19t21:59:49.5+02:00") == [LATE[2] + 0.5]
    with pytest.raises(Raised):
        evaluate('strptime("%Y%m")', "266141")


@pytest.mark.parametrize("program", ["gmtime | mktime", 'strftime("%Y-%m-%d %H:%M:%S") | strptime("%Y-%m-%d %T") | mktime', "torfc3339 | fromrfc3339", "localtime | length", 'strflocaltime("%Y")', "now > 1700000000"])
def test_times_are_plans(spark, program):
    table = spark.createDataFrame([(t,) for t in [*LATE, 0, -1, 951782400]], "t long")
    out = compile_program(f".[] | (.t | {program})", table)
    assert [r.value for r in out.collect()] == [evaluate(program, r.t)[0] for r in table.collect()]


@pytest.mark.parametrize("text, form", [("2024-2-29 7:05", "%Y-%m-%d %H:%M"), ("26614/4/ 9", "%Y/%m/%d"), ("20240131", "%Y%m%d"), ("1:2:3", "%H:%M:%S")])
def test_texts_of_times(spark, text, form):
    table = spark.createDataFrame([(text,)], "s string")
    assert compile_program(f'.[] | (.s | strptime("{form}"))', table).collect()[0].value == evaluate(f'strptime("{form}")', text)[0]


@pytest.mark.parametrize("program, value", [('strptime("%Y-%m-%d")', "2023-02-29"), ('strptime("%Y-%m-%d")', "2023-02-28x"), ("fromrfc3339", "2023-02-28"), ("gmtime", None)])
def test_texts_that_are_no_times(spark, program, value):
    with pytest.raises(Raised):
        evaluate(program, value)
    table = spark.createDataFrame([(value,)], "s string") if value else spark.sql("SELECT cast(null AS long) AS s")
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        compile_program(f".[] | (.s | {program})", table).collect()
