"""Programs over records that keep coming: files that arrive in a folder, or any stream of rows, by Structured Streaming.

Each new record meets the program once. What needs all records (a sort, a slice, groups as one value) is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsluice.lang.evaluate import Program
from docsluice.lang.values import dumps, loads
from docsluice.plans.compiler import compile_program
from docsluice.plans.records import fitted
from docsluice.sources.tables import records_of


def follow(spark: SparkSession, path: str, form: str = "ndjson", schema: str = "value string", program: str = ".", on_error: str = "raise", files: int = 100) -> DataFrame:
    """A stream of the program's outputs on each record of the files that arrive in a folder, `files` a batch at most.

    A file counts once it stands there whole: writers move it in. Its last line may lack a line end. A file that is
    replaced under the same name is not read again.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    lines = lines.where(F.trim("value") != "") if form == "ndjson" else lines
    return records_of(lines, form, schema, program, on_error)


def live(df: DataFrame, program: str, schema: str | None = None, on_error: str = "raise") -> DataFrame:
    """The outputs of a program `.[] | ...` on each row of a stream; Unsupported for what needs all of its rows."""
    return compile_program(program, df, schema=schema, on_error=on_error)


def folded(df: DataFrame, by: list[str], order: list[str], start: Any, update: str, schema: str) -> DataFrame:
    """foreach for each key of a stream: (by, columns of schema), a row for each record.

    `update` gets {state, row} and answers {state, out}; `out` becomes the columns of schema. The state of a key is
    kept as JSON text from batch to batch; records of one batch are taken in the order of columns `order`, and a
    record that comes in a later batch than one it should precede is taken when it comes.
    """
    keys = T.StructType([df.schema[k] for k in by])
    fields = T._parse_datatype_string(schema)
    first, names = dumps(start), df.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step = Program(update)
        held = loads(state.get[0] if state.exists else first)
        rows = pd.concat([b for b in batches if len(b)]).sort_values(order, kind="stable")
        made = []
        for row in json.loads(rows.to_json(orient="records", date_format="iso")):
            got = next(step.outputs({"state": held, "row": {n: row.get(n) for n in names}}))
            held = got["state"]
            out = got["out"] if isinstance(got["out"], dict) else {fields.names[0]: got["out"]}
            made.append([*key, *[fitted(out.get(f.name), f.dataType) for f in fields]])
        state.update((dumps(held),))
        yield pd.DataFrame(made, columns=[*by, *fields.names])

    return df.groupBy(*by).applyInPandasWithState(run, T.StructType([*keys.fields, *fields.fields]), "state string", "append", GroupStateTimeout.NoTimeout)


def windowed(df: DataFrame, time: str, length: str, late: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """(start, end, by, n, sum, avg, min, max) of a value in windows of event time; records later than `late` are left out."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    stats = [F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")]
    return df.withWatermark(time, late).groupBy(span.alias("w"), *by).agg(*stats).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "sum", "avg", "min", "max")


def every(df: DataFrame, by: list[str], order: list[str], n: int, value: str, schema: str = "n long, sum double, avg double, min double, max double") -> DataFrame:
    """The same of each n records of a key, as they come: a row whenever n are there. What is left waits for more."""
    update = f"(.state + [.row.{value}]) as $v | if ($v | length) < {n} then {{state: $v, out: {{}}}} else {{state: [], out: {{n: ($v | length), sum: ($v | add), avg: ($v | add / length), min: ($v | min), max: ($v | max)}}}} end"
    return folded(df, by, order, [], update, schema).where("n IS NOT NULL")
