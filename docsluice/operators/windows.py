"""The window family over ordered rows: each function adds a column, partitioned so that no order spans all rows.

`by` are the columns of a sequence, `order` those that put its rows in order; without `by` Spark sorts all rows in one
task, which these functions leave to the caller to want. A frame's first rows have fewer elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _spec(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing(df: DataFrame, how: str, value: str, n: int, by: list[str], order: list[str], name: str) -> DataFrame:
    """windows, moving_sum, moving_avg, moving_min or moving_max over the trailing n rows; n below 1 is an error."""
    if n < 1:
        raise ValueError("a window has at least one row")
    run = {"windows": F.collect_list, "moving_sum": F.sum, "moving_avg": F.avg, "moving_min": F.min, "moving_max": F.max}[how]
    return df.withColumn(name, run(F.col(value)).over(_spec(by, order).rowsBetween(-(n - 1), 0)))


def lag(df: DataFrame, value: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """The value before; the first row of a sequence goes."""
    return _without_first(df, by, order, name, F.lag(value).over(_spec(by, order)))


def deltas(df: DataFrame, value: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """The difference to the value before; the first row of a sequence goes."""
    return _without_first(df, by, order, name, F.col(value) - F.lag(value).over(_spec(by, order)))


def _without_first(df: DataFrame, by: list[str], order: list[str], name: str, what: Column) -> DataFrame:
    place = f"{name}_place"
    return df.withColumns({name: what, place: F.row_number().over(_spec(by, order))}).where(F.col(place) > 1).drop(place)


def counter(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """1, 2, 3 and so on."""
    return df.withColumn(name, F.row_number().over(_spec(by, order)).cast("long"))


def fill_forward(df: DataFrame, value: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """The last value that is not null, so far."""
    return df.withColumn(name, F.last(value, True).over(_spec(by, order).rowsBetween(Window.unboundedPreceding, 0)))
