"""Wide to long and back, and what differs between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A row for each of the columns of each row: its name and its value. No shuffle."""
    return df.unpivot(ids, columns, name, value)


def pivot(df: DataFrame, ids: list[str], name: str, value: str, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """A column for each of `columns`: the value of the last row, in order, whose name it is; null where none has it."""
    last = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]) if order else None
    pick = (lambda c: F.max_by(F.when(F.col(name) == c, F.col(value)), F.when(F.col(name) == c, last))) if last is not None else (lambda c: F.last(F.when(F.col(name) == c, F.col(value)), ignorenulls=True))
    return df.groupBy(*ids).agg(*[pick(c).alias(c) for c in columns])


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, fields): what differs between two tables with one row for each key, by a full outer join.

    change is `removed` (left alone has the key), `added` (right alone) or `changed`, and fields the columns that both
    have and that are not equal, by name; null equals null. Equal rows are left out. Columns that one side lacks are not compared.
    """
    both = sorted(c for c in left.columns if c in right.columns and c not in keys)
    a = left.select(*[F.col(f"`{k}`").alias(f"df_{k}") for k in keys], F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`") for c in both]).alias("df_a"))
    b = right.select(*[F.col(f"`{k}`").alias(f"dg_{k}") for k in keys], F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`") for c in both]).alias("df_b"))
    same = [F.col(f"`df_{k}`").eqNullSafe(F.col(f"`dg_{k}`")) for k in keys]
    met = a.join(b, same, "full_outer")
    unequal = [F.when(~F.col(f"df_a.`{c}`").eqNullSafe(F.col(f"df_b.`{c}`")), F.lit(c)) for c in both]
    fields = F.filter(F.array(*unequal), lambda x: x.isNotNull()) if both else F.array().cast("array<string>")
    change = F.when(F.col("df_b").isNull(), "removed").when(F.col("df_a").isNull(), "added").when(F.size(fields) > 0, "changed")
    key = [F.when(F.col("df_a").isNull(), F.col(f"`dg_{k}`")).otherwise(F.col(f"`df_{k}`")).alias(k) for k in keys]
    out = met.select(*key, change.alias("change"), F.when(F.col("df_a").isNotNull() & F.col("df_b").isNotNull(), fields).otherwise(F.array().cast("array<string>")).alias("fields"))
    return out.where("change IS NOT NULL")
