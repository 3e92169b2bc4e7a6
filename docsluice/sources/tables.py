"""Sources and sinks: files of each format as rows, and rows as files.

Formats of one record a line are split and read by Spark itself where that follows the format's law; formats whose
files are one document are decoded whole, one file a task at least, in Python workers. The format is given or comes
from the file's name, never from its contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsluice.lang.evaluate import Raised, Run
from docsluice.lang.parser import parse
from docsluice.lang.values import loads
from docsluice.plans.records import _batches, _schema, fitted, over_records, program_of
from docsluice.sources.formats import decode, encode, format_of

#: Formats with a record in each line.
LINES = ("ndjson", "lines", "csv", "csv-header", "tsv", "tsv-header")


def decoded(df: DataFrame, column: str, form: str, schema: str = "value string", program: str = ".", on_error: str = "raise", keep: tuple[str, ...] = ()) -> DataFrame:
    """The outputs of a program on each value of the documents in a column (binary or text), as rows of `schema`.

    Columns named in `keep` come along, before those of `schema`. A document that is no such format, or that the program fails on, ends the job
    (`raise`), leaves no further rows (`skip`) or a row with an `error` (`report`). A null document has no values.
    """
    tree = parse(program)
    out = _schema(schema, on_error)
    single = [f.name for f in out.fields if f.name != "error"] == ["value"]
    whole = T.StructType([*[df.schema[k] for k in keep], *out.fields])
    arrow = to_arrow_schema(whole)

    def rows(run, row: dict) -> Iterator[dict]:
        kept = {k: row[k] for k in keep}

        def one(v, error: str | None) -> dict:
            of = {"value": v} if single else v if isinstance(v, dict) else {}
            made = {f.name: fitted(of.get(f.name), f.dataType) for f in out.fields if f.name != "error"}
            return kept | made | ({"error": error} if on_error == "report" else {})

        data = row[column]
        if data is None:
            return
        try:
            for v in decode(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass"), form):
                for x in run.outputs(v, Run(filename=kept.get("path"))):
                    yield one(x, None)
        except (Raised, ValueError) as e:
            if on_error == "raise":
                raise Raised(f"{form}: {e}") from None
            if on_error == "report":
                yield one(None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = program_of(tree)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                yield from _batches((r for row in b.slice(start, 64).to_pylist() for r in rows(made, row)), arrow)

    return df.select(*keep, column).mapInArrow(run, whole)


def encoded(df: DataFrame, form: str, name: str = "content", program: str = ".", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each output of a program on each row of df, as a document of a format in the binary column `name`."""
    tree = parse(program)
    whole = T.StructType([*[df.schema[k] for k in keep], T.StructField(name, T.BinaryType())])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = program_of(tree)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256).to_pylist()
                yield from _batches(({k: r[k] for k in keep} | {name: encode(v, form)} for r in part for v in made.outputs(r)), arrow)

    return df.mapInArrow(run, whole)


def read_documents(spark: SparkSession, path: str, form: str | None = None, schema: str = "value string", program: str = ".", on_error: str = "raise") -> DataFrame:
    """Files that are one document each: (path, columns of schema) of the program's outputs on their values.

    `input_filename` is the file's path. A file is read into one worker; a folder's files are dealt out. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decoded(files, "content", form or format_of(path), schema, program, on_error, ("path",))


def read_records(spark: SparkSession, path: str, form: str | None = None, schema: str = "value string", program: str = ".", on_error: str = "raise") -> DataFrame:
    """Files of a record a line, split between tasks: the program's outputs on each record, as rows of `schema`.

    With `skip` a line that is no record is left out, with `report` it leaves a row with an `error`; the lines after
    it are read all the same. Blank lines of NDJSON are no records.
    """
    form = form or format_of(path)
    if form not in LINES:
        raise Raised(f"{form} has no records in lines")
    if form.startswith(("csv", "tsv")):
        return _delimited(spark, path, form, schema, program, on_error)
    lines = spark.read.text(path).where(F.trim("value") != "") if form == "ndjson" else spark.read.text(path)
    return records_of(lines, form, schema, program, on_error)


def records_of(lines: DataFrame, form: str, schema: str, program: str, on_error: str) -> DataFrame:
    """The same of a table or a stream of lines (value)."""
    if form == "lines":
        return over_records(lines, parse(program), schema, on_error, "value")
    fields = T._parse_datatype_string(schema)
    plain = program == "." and all(isinstance(f.dataType, (T.StringType, T.LongType, T.IntegerType, T.BooleanType)) for f in fields) and fields.names != ["value"]
    if plain and on_error == "raise":
        # the JVM reads objects of plain members itself, and fails on what is none
        return lines.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return decoded(lines, "value", "ndjson", schema, program, on_error)


def _delimited(spark: SparkSession, path: str, form: str, schema: str, program: str, on_error: str) -> DataFrame:
    """CSV and TSV: with a header, records are objects of texts; without, arrays of texts. Quotes may hold line ends."""
    header, tab = form.endswith("header"), form.startswith("tsv")
    options = {"header": str(header).lower(), "sep": "\t" if tab else ",", "quote": "" if tab else '"', "escape": '"', "multiLine": str(not tab).lower(), "emptyValue": "", "nullValue": "\x00", "mode": "FAILFAST" if on_error == "raise" else "PERMISSIVE"}
    rows = spark.read.options(**options).csv(path)
    if header and program == "." and all(isinstance(f.dataType, T.StringType) for f in T._parse_datatype_string(schema)):
        return rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in T._parse_datatype_string(schema).names])
    if header:
        return over_records(rows, parse(program), schema, on_error)
    whole = rows.select(F.array(*[f"`{c}`" for c in rows.columns]).alias("value"))
    return over_records(whole, parse(program), schema, on_error, "value")


def write_records(df: DataFrame, path: str, form: str = "ndjson", by: str | None = None) -> None:
    """Rows as files of a record a line; `by` names a column whose values get a folder each. An existing path is an error.

    Spark commits a write as a whole: a job that fails leaves no files that a reader would take for the output.
    """
    writer = df.write.partitionBy(by) if by else df.write
    if form == "ndjson":
        writer.option("ignoreNullFields", "false").json(path)
    elif form in ("csv", "tsv"):
        writer.option("header", "true").option("sep", "\t" if form == "tsv" else ",").option("escape", '"').csv(path)
    elif form == "lines":
        writer.text(path)
    elif form in ("json", "json-seq", "yaml"):
        text = encoded(df, form, keep=(by,) if by else ())
        text = text.withColumn("content", F.concat(F.lit("---\n" if form == "yaml" else ""), F.col("content").cast("string")))
        (text.write.partitionBy(by) if by else text.write).option("lineSep", "\n").text(path)
    else:
        raise Raised(f"a file of {form} holds one document: see encoded()")


def gated(df: DataFrame, schema: str, errors: str = "schema_errors") -> tuple[DataFrame, DataFrame]:
    """(rows that a JSON Schema allows, the others with what is wrong in a column `errors`)."""
    document = loads(schema)
    tree = ("object", ((("literal", "row"), ("identity",)), (("literal", "errors"), ("call", errors, (("identity",), ("literal", document))))))
    # each row goes with its errors, so that rows keep their types
    shape = T.StructType([T.StructField("row", df.schema), T.StructField("errors", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = program_of(tree)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256).to_pylist()
                yield from _batches(({"row": r, "errors": fitted(next(made.outputs(r))["errors"], T.ArrayType(T.StringType()))} for r in part), arrow)

    marked = df.mapInArrow(run, shape)
    bad: Column = F.size("errors") > 0
    return marked.where(~bad).select("row.*"), marked.where(bad).select("row.*", "errors")
