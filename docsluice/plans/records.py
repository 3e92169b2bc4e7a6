"""Programs over single records, or over the records of one key, in Python workers by Arrow batches.

What has no native form runs here: the evaluator of the language on each record. Only the columns that a program
reads reach the workers, a record's outputs leave as rows, and nothing is held but one batch, or one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsluice.lang.evaluate import KINDS, Program, Raised, build
from docsluice.lang.parser import Node
from docsluice.lang.values import dumps

#: What becomes of a record on which a program fails: the job ends, the record has no more outputs, or a row says why.
ON_ERROR = ("raise", "skip", "report")


#: Tasks for each core, where records are dealt out.
TASKS = 4

#: Calls with arguments that look at their input by these alone.
OF_ARGUMENTS = {"add", "counter", "deltas", "empty", "ewma", "first", "isempty", "lag", "last", "limit", "moving_avg", "moving_max", "moving_min", "moving_sum", "pow", "range", "running", "skip", "windows"}
#: Nodes that look at their input by their parts alone.
OF_PARTS = {"alternative", "and", "binary", "collect", "comma", "each", "if", "index", "literal", "negate", "object", "or", "slice", "text", "try", "var"}


def fields_read(node: Node) -> set[str] | None:
    """Members of its input that a program can read; None if it can read others, or all of them."""
    kind = node[0]
    if kind == "index" and node[1] == ("identity",) and node[2][0] == "literal" and isinstance(node[2][1], str):
        return {node[2][1]}
    if kind == "pipe":
        return fields_read(node[1])
    if kind in ("reduce", "foreach"):
        parts = [node[1], node[3]]
    elif kind == "bind" and all(p[0] == "name" for p in node[2]):
        parts = [node[1], node[3]]
    elif kind == "call" and node[1] in OF_ARGUMENTS and (node[2] or node[1] == "empty"):
        parts = list(node[2])
    elif kind in OF_PARTS:
        parts = [x for x in _nodes(node[1:])]
    else:
        return None
    out: set[str] = set()
    for p in parts:
        found = fields_read(p)
        if found is None:
            return None
        out |= found
    return out


def _nodes(parts: Any) -> Iterator[Node]:
    """The nodes among the parts of a node, which may stand in tuples and lists of their own."""
    for p in parts:
        if isinstance(p, tuple) and p and isinstance(p[0], str) and p[0] in KINDS:
            yield p
        elif isinstance(p, (tuple, list)):
            yield from _nodes(p)


def program_of(node: Node) -> Program:
    out = Program(".")
    out.step = build(node)
    return out


def fitted(v: Any, t: T.DataType) -> Any:
    """A value as one of a type: text of what is not a string, null where a number or an object does not fit."""
    if v is None:
        return None
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else dumps(v)
    if isinstance(t, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(t, T.IntegralType):
        return int(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and v == v and v == int(v) else None
    if isinstance(t, T.FractionalType):
        if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
            return None
        return Decimal(v) if isinstance(t, T.DecimalType) else float(v)
    if isinstance(t, T.ArrayType):
        return [fitted(x, t.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(t, T.MapType):
        return [(k, fitted(x, t.valueType)) for k, x in v.items()] if isinstance(v, dict) else None
    if isinstance(t, T.StructType):
        return {f.name: fitted(v.get(f.name), f.dataType) for f in t.fields} if isinstance(v, dict) else None
    return v


def _rows(outputs: Iterator[Any], schema: T.StructType, on_error: str) -> Iterator[dict]:
    single = [f.name for f in schema.fields if f.name != "error"] == ["value"]

    def row(v: Any, error: str | None) -> dict:
        of = {"value": v} if single else v if isinstance(v, dict) else {}
        out = {f.name: fitted(of.get(f.name), f.dataType) for f in schema.fields if f.name != "error"}
        return out | ({"error": error} if on_error == "report" else {})

    try:
        for v in outputs:
            yield row(v, None)
    except Raised as e:
        if on_error == "raise":
            raise
        if on_error == "report":
            yield row(None, str(e))


def _batches(rows: Iterator[dict], arrow: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _schema(schema: str, on_error: str) -> T.StructType:
    if on_error not in ON_ERROR:
        raise ValueError(on_error)
    out = T._parse_datatype_string(schema)
    return T.StructType([*out.fields, T.StructField("error", T.StringType())]) if on_error == "report" else out


def spread(df: DataFrame) -> DataFrame:
    """Rows of files dealt out to all cores: a file is read by as many tasks as it has row groups, which can be one."""
    if df.isStreaming or not df.inputFiles():
        return df
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def over_records(df: DataFrame, node: Node, schema: str = "value string", on_error: str = "raise", whole: str | None = None, dealt: bool = False) -> DataFrame:
    """The outputs of a program on each row of df as an object (or on its column `whole`), as rows of `schema`.

    With the one column `value`, that has each output; else an output is an object and columns are its members. Rows
    without outputs leave none. Empty tables give empty tables. `dealt`: rows of files go to all cores first, and lose the file's order.
    """
    read = None if whole else fields_read(node)
    df = df.select(whole) if whole else df if read is None else df.select(*[f"`{c}`" for c in df.columns if c in read] or df.columns[:1])
    df = spread(df) if dealt else df
    out = _schema(schema, on_error)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = program_of(node)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256).to_pylist()
                values = (r[whole] for r in part) if whole else iter(part)
                yield from _batches((r for v in values for r in _rows(program.outputs(v), out, on_error)), arrow)

    return df.mapInArrow(run, out)


def over_groups(df: DataFrame, by: list[str], order: list[str], node: Node, schema: str = "value string", on_error: str = "raise") -> DataFrame:
    """The outputs of a program on the array of each group's rows, in order. A group has to fit into one worker."""
    read = sorted({*by, *order, *df.columns})
    out = _schema(schema, on_error)
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(c, "ascending") for c in order]).to_pylist() if order else table.to_pylist()
        return pa.Table.from_pylist(list(_rows(program_of(node).outputs(rows), out, on_error)), schema=arrow)

    return df.select(*[f"`{c}`" for c in read]).groupBy(*[f"`{c}`" for c in by]).applyInArrow(run, out)
