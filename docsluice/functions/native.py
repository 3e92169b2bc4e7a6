"""Functions as Spark expressions over typed columns: what needs no Python stays in the JVM."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Unsupported(Exception):
    """What has no native form here; the caller runs it another way."""


class Val:
    """A column and its type; fields where it is an object whose members are known one by one."""

    def __init__(self, column: Column | None, type_: T.DataType, fields: dict[str, Val] | None = None):
        self._column, self.type, self.fields = column, type_, fields

    @property
    def column(self) -> Column:
        if self._column is None:
            if self.fields is None:
                raise Unsupported("an array of different kinds")
            self._column = F.struct(*[v.column.alias(k) for k, v in self.fields.items()])
        return self._column

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, NUMERIC)

    @property
    def float(self) -> bool:
        return isinstance(self.type, (T.DoubleType, T.FloatType))


def obj(fields: dict[str, Val]) -> Val:
    return Val(None, T.StructType([T.StructField(k, v.type) for k, v in fields.items()]), fields)


def lit(value) -> Val:
    if value is None:
        return Val(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return Val(F.lit(value).cast("long") if abs(value) < 1 << 63 else F.lit(value).cast("decimal(38,0)"), T.LongType())
    if isinstance(value, str):
        return Val(F.lit(value), T.StringType())
    return Val(F.lit(float(value)), T.DoubleType())


def truthy(v: Val) -> Column:
    """Only false and null are not."""
    if isinstance(v.type, T.NullType):
        return F.lit(False)
    return F.coalesce(v.column, F.lit(False)) if isinstance(v.type, T.BooleanType) else (v.column.isNotNull() if v._column is not None else F.lit(True))


def order_key(v: Val) -> Column:
    """What sorts as values do: null first, NaN below every other number."""
    c = v.column
    if v.float:
        return F.struct(F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2).alias("r"), F.when(~F.isnan(c), c).alias("v"))
    return F.struct(F.when(c.isNull(), 0).otherwise(2).alias("r"), c.alias("v"))


def sort_columns(v: Val, descending: bool = False) -> list[Column]:
    c = v.column
    parts = [F.isnan(c)] if v.float else []
    if descending:
        return [*[p.asc_nulls_last() for p in parts], c.desc_nulls_last()]
    return [*[F.when(c.isNull(), 0).when(p, 1).otherwise(2).asc() for p in parts], c.asc_nulls_first()]


def comparable(a: Val, b: Val) -> bool:
    if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
        return True
    return (a.numeric and b.numeric) or type(a.type) is type(b.type)


def compare(op: str, a: Val, b: Val) -> Val:
    """Comparisons never fail and are never null; null is below everything, NaN below numbers and equal to nothing."""
    x, y = a.column, b.column
    if not comparable(a, b):
        raise Unsupported("a comparison of different kinds")
    if isinstance(b.type, T.NullType):
        out = {"==": x.isNull(), "!=": x.isNotNull(), "<": F.lit(False), "<=": x.isNull(), ">": x.isNotNull(), ">=": F.lit(True)}[op]
        return Val(out, T.BooleanType())
    nan = [F.coalesce(F.isnan(v.column), F.lit(False)) for v in (a, b) if v.float]
    either = nan[0] if len(nan) == 1 else (nan[0] | nan[1]) if nan else None
    if op in ("==", "!="):
        same = x.eqNullSafe(y)
        same = same & ~either if either is not None else same
        return Val(same if op == "==" else ~same, T.BooleanType())
    if op in ("<", "<="):
        return compare({"<": ">", "<=": ">="}[op], b, a)
    # x > y: true with a null y, unless x is null too; a plain conjunct reaches the scan
    more = x > y if op == ">" else x >= y
    if a.float:
        more = more & ~F.isnan(x)
    if b.float:
        more = more | (F.isnan(y) & x.isNotNull() & (~F.isnan(x) if a.float else F.lit(True)))
    out = F.coalesce(more, (x.isNotNull() if op == ">" else F.lit(True)) & y.isNull())
    return Val(out, T.BooleanType())


def filtering(op: str, a: Val, b: Val, finite: bool = False) -> list[Column] | None:
    """The same comparison as conjuncts of a filter, which drops what is null: in the plain form that reaches a scan.

    One side has to be a literal that is a number, a string or a boolean; else there is no such form. `finite` says
    that columns hold no NaN, which is below all numbers here and above them in Spark.
    """
    if op not in ("==", "!=", "<", "<=", ">", ">=") or not comparable(a, b):
        return None
    if getattr(a, "literal", None) is not None:
        a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    value = getattr(b, "literal", None)
    if value is None or value != value or isinstance(a.type, T.NullType):
        return None
    x, y = a.column, b.column
    if op == "==":
        return [x == y]
    if op == "!=":
        return [~x.eqNullSafe(y)]
    nan = a.float and not finite
    if op in (">", ">="):
        return [x > y if op == ">" else x >= y, *([~F.isnan(x)] if nan else [])]
    less = (x < y if op == "<" else x <= y) | x.isNull()
    return [less | F.isnan(x) if nan else less]


def add(a: Val, b: Val) -> Val:
    if isinstance(a.type, T.NullType):
        return b
    if isinstance(b.type, T.NullType):
        return a
    x, y = a.column, b.column
    if a.fields and b.fields:
        return obj({**a.fields, **b.fields})
    if a.numeric and b.numeric:
        out, t = x + y, wider(a, b)
    elif isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
        out, t = F.concat(x, y), a.type
    elif isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType):
        out, t = F.concat(x, y), a.type
    else:
        raise Unsupported("+ of different kinds")
    return Val(F.coalesce(out, x, y), t)


def wider(a: Val, b: Val) -> T.DataType:
    if a.float or b.float:
        return T.DoubleType()
    if isinstance(a.type, T.DecimalType) or isinstance(b.type, T.DecimalType):
        return T.DecimalType(38, 6)
    return T.LongType()


def required(v: Val, what: str) -> Val:
    """v, or an error where it is null."""
    if getattr(v, "literal", None) is not None:
        return v
    out = Val(F.when(v.column.isNull(), F.raise_error(F.lit(f"null (null) {what}")).cast(v.type)).otherwise(v.column), v.type)
    out.items = getattr(v, "items", None)
    return out


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "+":
        return add(a, b)
    if a.numeric and b.numeric:
        what = {"-": "cannot be subtracted", "*": "cannot be multiplied", "/": "cannot be divided", "%": "cannot be divided"}[op]
        a, b = required(a, what), required(b, what)
        if op == "/":
            return Val(a.column.cast("double") / b.column.cast("double"), T.DoubleType())
        if op == "%":
            return Val(a.column.cast("long") % F.abs(b.column.cast("long")), T.LongType())
        return Val(a.column - b.column if op == "-" else a.column * b.column, wider(a, b))
    if op == "-" and isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType):
        return Val(F.filter(a.column, lambda x: ~F.exists(b.column, lambda y: y.eqNullSafe(x))), a.type)
    if op == "/" and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
        return Val(split(a.column, b.column), T.ArrayType(T.StringType()))
    if op == "*" and isinstance(a.type, T.StringType) and b.numeric:
        n = b.column.cast("double")
        return Val(F.when(n >= 0, F.repeat(a.column, F.when((n > 0) & (n < 1), 1).otherwise(F.floor(n)).cast("int"))), a.type)
    raise Unsupported(f"{op} of these kinds")


def quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def split(text: Column, by: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, F.when(by == "", F.lit("")).otherwise(quoted(by)), -1))


def text_of(v: Val) -> Column:
    if isinstance(v.type, T.StringType):
        return v.column
    if v.float:
        c = v.column
        return F.when(c.isNull() | F.isnan(c), "null").when((F.abs(c) < 1e15) & (c == F.floor(c)), F.floor(c).cast("string")).otherwise(double_text(c.cast("double")))
    if isinstance(v.type, T.NullType):
        return F.lit("null")
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(v.column, {"ignoreNullFields": "false"})
    if isinstance(v.type, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(v.column, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(v.column.cast("string"), F.lit("null"))


def double_text(c: Column) -> Column:
    """A double as the language writes it: its shortest digits, with an exponent below 1e-5 and from 1e17 on."""
    c = F.when(c == float("inf"), F.lit(1.7976931348623157e308)).when(c == float("-inf"), F.lit(-1.7976931348623157e308)).otherwise(c)
    text = c.cast("string")
    sign, plain = F.when(c < 0, "-").otherwise(""), F.replace(text, F.lit("-"), F.lit(""))
    # Java writes an exponent below 1e-3 and from 1e7 on
    power = F.when(F.contains(text, F.lit("E")), F.split_part(text, F.lit("E"), F.lit(2))).otherwise("0").cast("int")
    mantissa = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(F.substr(F.rpad(digits, 18, "0"), F.lit(1), power + 1), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substr(digits, power + 2))).otherwise(""))
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", "")).otherwise(F.concat(sign, F.when((power < 0) & (power >= -5), small).when((power >= 0) & (power < 17), whole).otherwise(exponent)))


DOUBLE, LONG, TEXT, BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _double(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        if not v.numeric:
            raise Unsupported("a number required")
        return Val(f(required(v, "number required").column.cast("double")), DOUBLE)

    return run


def _long(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        if not v.numeric:
            raise Unsupported("a number required")
        return Val(f(required(v, "number required").column).cast("long"), LONG)

    return run


def _text(f: Callable[..., Column], t: T.DataType = TEXT) -> Callable[..., Val]:
    def run(v: Val, *args: Val) -> Val:
        if not isinstance(v.type, T.StringType):
            raise Unsupported("a string required")
        v = required(v, "is not a string")
        return Val(f(v.column, *[a.column for a in args]), t)

    return run


def _log(f):
    return lambda c: F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(c))


def _gmtime(v: Val) -> Val:
    if not v.numeric:
        raise Unsupported("a number required")
    c = required(v, "gmtime() requires a number").column.cast("double")
    t = F.timestamp_seconds(F.floor(c))
    parts = [F.year(t), F.month(t) - 1, F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t) + (c - F.floor(c)), F.dayofweek(t) - 1, F.dayofyear(t) - 1]
    out = Val(F.array(*[p.cast("double") for p in parts]), T.ArrayType(DOUBLE))
    out.seconds = F.floor(c)
    return out


def named(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that it names more than once, which then is worked out, and written into the plan, once."""
    return F.get(F.transform(F.array(c), f), 0)


#: Days of 400 years, after which dates repeat.
CYCLE = 146097


def days_from(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a year, a month from 1 and a day, by the year from 2000 to 2399 with the same calendar."""
    alike = 2000 + F.pmod(year, F.lit(400))
    return F.unix_date(F.make_date(alike.cast("int"), month.cast("int"), F.lit(1))) + F.floor((year - alike) / 400) * CYCLE + day - 1


def _mktime(v: Val) -> Val:
    if not (isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, NUMERIC)):
        raise Unsupported("a broken-down time required")
    if (seconds := getattr(v, "seconds", None)) is not None:
        return Val(seconds.cast("long"), LONG)
    lacking = F.raise_error(F.lit("mktime requires parsed datetime inputs")).cast("long")
    y, mo, d, h, mi, s = (F.coalesce(F.floor(F.get(v.column, k)), F.when(F.size(v.column) > k, lacking).otherwise(F.lit(0).cast("long"))) for k in range(6))
    out = days_from(y + F.floor(mo / 12), F.pmod(mo, F.lit(12)) + 1, d) * 86400 + h * 3600 + mi * 60 + s
    return Val(out.cast("long"), LONG)


# fixed values: directives of strptime and what each matches
PARSED = {"%Y": r"(\d{4})", "%m": r"(1[0-2]|0[1-9]|[1-9])", "%d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])", "%H": r"(2[0-3]|[01]\d|\d)", "%M": r"([0-5]\d|\d)", "%S": r"([0-5]\d|\d)"}


def _strptime(v: Val, f: Val) -> Val:
    """A text by a literal format of digits, as a broken-down time."""
    form = literal_of(f).replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")
    if not isinstance(v.type, T.StringType):
        raise Unsupported("a string required")
    pattern, found = "", []
    for k, (directive, other) in enumerate(parts := re.findall(r"(%.?)|([^%]+)", form)):
        if not directive:
            if not re.fullmatch(r"[-/:.,_ T]+", other):
                raise Unsupported(f"{other} in a format")
            pattern += "".join(r"\s+" if w[0] == " " else re.escape(w) for w in re.findall(r" +|[^ ]+", other))
            continue
        if directive not in PARSED or directive in found:
            raise Unsupported(directive)
        found.append(directive)
        pattern += r"(\d{4,})" if directive == "%Y" and not (k + 1 < len(parts) and parts[k + 1][0]) else PARSED[directive]
    if not found:
        raise Unsupported("a format without directives")
    c = required(v, "strptime/1 requires string inputs and arguments").column
    whole = rf"^{pattern}\z"

    def seconds(c: Column) -> Column:
        none = F.raise_error(F.concat(F.lit('date "'), c, F.lit(f'" does not match format "{literal_of(f)}"'))).cast("long")

        def of(cells: Column) -> Column:
            at = {x: F.trim(F.get(cells, k)).cast("long") for k, x in enumerate(found)}
            y, mo, d = at.get("%Y", F.lit(1900)), at.get("%m", F.lit(1)), at.get("%d", F.lit(1))
            h, mi, s = (at.get(x, F.lit(0)) for x in ("%H", "%M", "%S"))
            last = F.dayofmonth(F.last_day(F.make_date((2000 + F.pmod(y, F.lit(400))).cast("int"), mo.cast("int"), F.lit(1))))
            return F.when(d <= last, days_from(y, mo, d) * 86400 + h * 3600 + mi * 60 + s).otherwise(none)

        cells = F.split(F.regexp_replace(c, whole, "|".join(f"${k + 1}" for k in range(len(found)))), r"\|")
        return F.when(F.rlike(c, F.lit(whole)), named(cells, of)).otherwise(none)

    return _gmtime(Val(named(c, seconds).cast("long"), LONG))


def _torfc3339(v: Val) -> Val:
    if not isinstance(v.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise Unsupported("a whole number required")
    return Val(dated(required(v, "requires a number").column, "yyyy-MM-dd'T'HH:mm:ss'Z'"), TEXT)


RFC3339 = r"^([0-9]{4,}-[0-9][0-9]-[0-9][0-9])[Tt ]([0-9][0-9]:[0-9][0-9]:[0-9][0-9])(\.[0-9]+)?([Zz]|[+-][0-9][0-9]:[0-9][0-9])\z"


def _fromrfc3339(text: Column) -> Column:
    def seconds(c: Column) -> Column:
        plain = F.concat(F.when(F.rlike(c, F.lit("^[0-9]{5,}-")), "+").otherwise(""), F.upper(F.regexp_replace(c, RFC3339, "$1T$2$4")))
        part = F.coalesce(F.nullif(F.regexp_extract(c, RFC3339, 3), F.lit("")).cast("double"), F.lit(0.0))
        none = F.raise_error(F.concat(c, F.lit(" is not an RFC 3339 time"))).cast("double")
        return F.when(F.rlike(c, F.lit(RFC3339)), F.unix_seconds(F.to_timestamp(plain, "yyyy-MM-dd'T'HH:mm:ssXXX")) + part).otherwise(none)

    return named(text, seconds)


def _local(f: Callable[..., Val]) -> Callable[..., Val]:
    """What looks at the local time, where that is UTC."""
    def run(v: Val, *args: Val) -> Val:
        if time.timezone or time.daylight:
            raise Unsupported("a local time")
        return f(v, *args)

    return run


def length(v: Val) -> Val:
    c = v.column
    if isinstance(v.type, T.StringType):
        return Val(F.coalesce(F.char_length(c), F.lit(0)).cast("long"), LONG)
    if v.numeric:
        return Val(F.coalesce(F.abs(c), F.lit(0)), v.type)
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return Val(F.greatest(F.size(c), F.lit(0)).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        return Val(F.lit(len(v.type.fields)).cast("long"), LONG)
    raise Unsupported("length of this kind")


def kind_of(t: T.DataType) -> str:
    for types, name in ((NUMERIC, "number"), (T.StringType, "string"), (T.BooleanType, "boolean"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), (T.BinaryType, "bytes"), (T.DateType, "localdate"), (T.TimestampNTZType, "localdatetime"), (T.TimestampType, "offsetdatetime"), (T.NullType, "null")):
        if isinstance(t, types):
            return name
    raise Unsupported(str(t))


def _ordered(v: Val) -> Column:
    """The elements of an array in the language's order."""
    t = v.type.elementType
    if not isinstance(t, (T.DoubleType, T.FloatType)):
        return F.sort_array(v.column)
    pairs = F.transform(v.column, lambda x: F.struct(order_key(Val(x, t)).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda s: s["x"])


def _of_array(f: Callable[[Val], Column], inner: bool = False) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        if not isinstance(v.type, T.ArrayType):
            raise Unsupported("an array required")
        return Val(f(v), v.type.elementType if inner else v.type)

    return run


def _unique(v: Val) -> Column:
    # NaN equals nothing, itself included
    t = v.type.elementType
    if not isinstance(t, (T.DoubleType, T.FloatType)):
        return F.sort_array(F.array_distinct(v.column))
    return _ordered(Val(F.concat(F.filter(v.column, lambda x: F.isnan(x)), F.array_distinct(F.filter(v.column, lambda x: ~F.coalesce(F.isnan(x), F.lit(False))))), v.type))


def _flat(v: Val) -> Val:
    while isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.ArrayType):
        v = Val(F.flatten(v.column), v.type.elementType)
    if not isinstance(v.type, T.ArrayType):
        raise Unsupported("an array required")
    return v


def _implode(v: Val) -> Val:
    """The text of code points: one decoding of all of them, behind a byte order mark that it takes off."""
    if not (isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))):
        raise Unsupported("an array of whole numbers required")

    def point(x: Column) -> Column:
        lacking = F.raise_error(F.lit("Unicode codepoint must be numeric")).cast("long")
        return F.when(x.isNull(), lacking).when(x.between(0, 0xD7FF) | x.between(0xE000, 0x10FFFF), x.cast("long")).otherwise(F.lit(0xFFFD).cast("long"))

    digits = F.transform(required(v, "cannot be imploded").column, lambda x: F.lpad(F.hex(point(x)), 8, "0"))
    return Val(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(digits, ""))), "UTF-32"), TEXT)


def _boolean(c: Column) -> Column:
    return F.when(c == "true", True).when(c == "false", False).otherwise(F.raise_error(F.concat(F.lit("cannot be parsed as a boolean: "), c)).cast("boolean"))


#: Functions without arguments, by name.
PLAIN: dict[str, Callable[[Val], Val]] = {
    "length": length, "not": lambda v: Val(~truthy(v), BOOL), "type": lambda v: Val(F.when(v.column.isNull(), "null").otherwise(kind_of(v.type)), TEXT), "tostring": lambda v: Val(text_of(v), TEXT),
    "floor": _long(F.floor), "ceil": _long(F.ceil), "round": _double(lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)), "trunc": _double(lambda c: F.signum(c) * F.floor(F.abs(c))), "rint": _double(F.rint), "nearbyint": _double(F.rint), "round_even": _double(F.rint),
    "fabs": _double(F.abs), "abs": lambda v: Val(F.abs(v.column), v.type), "sqrt": _double(F.sqrt), "cbrt": _double(F.cbrt), "exp": _double(F.exp), "expm1": _double(F.expm1), "exp2": _double(lambda c: F.pow(F.lit(2.0), c)),
    "exp10": _double(lambda c: F.pow(F.lit(10.0), c)), "pow10": _double(lambda c: F.pow(F.lit(10.0), c)), "log": _double(_log(F.ln)), "log2": _double(_log(F.log2)), "log10": _double(_log(F.log10)), "log1p": _double(F.log1p),
    "sin": _double(F.sin), "cos": _double(F.cos), "tan": _double(F.tan), "asin": _double(F.asin), "acos": _double(F.acos), "atan": _double(F.atan), "sinh": _double(F.sinh), "cosh": _double(F.cosh), "tanh": _double(F.tanh),
    "asinh": _double(F.asinh), "acosh": _double(F.acosh), "atanh": _double(F.atanh), "degrees": _double(F.degrees), "radians": _double(F.radians), "signum": _double(F.signum), "recip": _double(lambda c: F.lit(1.0) / c),
    "fract": _double(lambda c: c - F.signum(c) * F.floor(F.abs(c))), "isnan": lambda v: Val(F.isnan(v.column) if v.float else F.lit(False), BOOL), "isinfinite": lambda v: Val(F.abs(v.column) == float("inf"), BOOL),
    "isfinite": lambda v: Val(~F.isnan(v.column.cast("double")) & (F.abs(v.column.cast("double")) < float("inf")), BOOL), "isnormal": lambda v: Val((F.abs(v.column.cast("double")) >= 2.2250738585072014e-308) & (F.abs(v.column.cast("double")) < float("inf")), BOOL),
    "pi": lambda v: lit(math.pi), "e": lambda v: lit(math.e), "tau": lambda v: lit(math.tau), "infinite": lambda v: lit(float("inf")), "nan": lambda v: lit(float("nan")), "null": lambda v: lit(None),
    "ascii_downcase": _text(lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), "ascii_upcase": _text(lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "utf8bytelength": _text(lambda c: F.octet_length(c).cast("long"), LONG), "trim": _text(lambda c: F.regexp_replace(c, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")), "ltrim": _text(lambda c: F.regexp_replace(c, r"^[\p{IsWhite_Space}]+", "")),
    "rtrim": _text(lambda c: F.regexp_replace(c, r"[\p{IsWhite_Space}]+$", "")), "explode": _text(lambda c: F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), F.ascii)), T.ArrayType(T.IntegerType())),
    "implode": _implode, "md5": _text(F.md5), "sha1": _text(F.sha1), "sha256": _text(lambda c: F.sha2(c, 256)), "sha512": _text(lambda c: F.sha2(c, 512)), "crc32": _text(lambda c: F.lpad(F.lower(F.hex(F.crc32(c.cast("binary")))), 8, "0")),
    "hex_encode": _text(lambda c: F.lower(F.hex(c.cast("binary")))), "hex_decode": _text(lambda c: F.decode(F.unhex(c), "UTF-8")), "base64_encode": _text(lambda c: F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")),
    "base64_decode": _text(lambda c: F.decode(F.unbase64(c), "UTF-8")), "base64url_encode": _text(lambda c: F.translate(F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n=]", ""), "+/", "-_")),
    "base64url_decode": _text(lambda c: F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")),
    "todate": lambda v: Val(dated(v.column, "yyyy-MM-dd'T'HH:mm:ss'Z'"), TEXT), "todateiso8601": lambda v: PLAIN["todate"](v), "fromdate": _text(lambda c: F.unix_seconds(F.to_timestamp(F.when(c.rlike("^[0-9]{5,}-"), F.concat(F.lit("+"), c)).otherwise(c), "yyyy-MM-dd'T'HH:mm:ssX")), LONG),
    "fromdateiso8601": lambda v: PLAIN["fromdate"](v), "gmtime": _gmtime, "mktime": _mktime, "localtime": _local(_gmtime), "torfc3339": _torfc3339, "fromrfc3339": _text(_fromrfc3339, DOUBLE),
    "now": lambda v: Val(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE), "first": lambda v: Val(F.get(v.column, 0), v.type.elementType), "last": lambda v: Val(F.try_element_at(v.column, F.lit(-1)), v.type.elementType),
    "reverse": lambda v: Val(F.reverse(v.column), v.type), "sort": _of_array(_ordered), "unique": _of_array(_unique), "min": _of_array(lambda v: F.get(_ordered(v), 0), True),
    "max": _of_array(lambda v: F.try_element_at(_ordered(v), F.lit(-1)), True), "flatten": _flat, "add": lambda v: fold_array(v), "keys": lambda v: keys(v), "toboolean": lambda v: v if isinstance(v.type, T.BooleanType) else _text(_boolean, BOOL)(v),
    "tonumber": lambda v: v if v.numeric else Val(v.column.cast("double"), DOUBLE), "tojson": lambda v: Val(F.when(v.column.isNull(), "null").otherwise(F.to_json(F.struct(v.column.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.column.alias("v")))) - 6) if not isinstance(v.type, (T.StructType, T.ArrayType)) else F.to_json(v.column)), TEXT),
}


def keys(v: Val) -> Val:
    if isinstance(v.type, T.StructType):
        return Val(F.array(*[F.lit(n) for n in sorted(v.type.names)]), T.ArrayType(TEXT))
    if isinstance(v.type, T.MapType):
        return Val(F.sort_array(F.map_keys(v.column)), T.ArrayType(TEXT))
    return Val(F.when(F.size(v.column) > 0, F.sequence(F.lit(0), F.size(v.column) - 1)).otherwise(F.array().cast("array<int>")), T.ArrayType(T.IntegerType()))


def fold_array(v: Val) -> Val:
    t = v.type.elementType
    if isinstance(t, T.StringType):
        return Val(F.when(F.size(v.column) > 0, F.array_join(v.column, "")), t)
    if isinstance(t, T.ArrayType):
        return Val(F.flatten(v.column), t)
    wide = T.LongType() if isinstance(t, (T.IntegerType, T.LongType)) else DOUBLE
    return Val(F.when(F.size(v.column) > 0, F.aggregate(v.column, F.lit(0).cast(wide), lambda s, x: s + F.coalesce(x.cast(wide), F.lit(0).cast(wide)))), wide)


def _indices(c: Column, n: Column) -> Column:
    return F.when((F.length(n) > 0) & (F.length(c) >= F.length(n)), F.filter(F.sequence(F.lit(0), F.length(c) - F.length(n)), lambda i: F.substr(c, i + 1, F.length(n)) == n)).otherwise(F.array().cast("array<int>"))


def _two(f: Callable[[Column, Column], Column]) -> Callable[[Val, Val, Val], Val]:
    return lambda v, a, b: Val(f(a.column.cast("double"), b.column.cast("double")), DOUBLE)


def literal_of(v: Val) -> str:
    found = getattr(v, "literal", None)
    if not isinstance(found, str):
        raise Unsupported("an argument that isn't a literal")
    return found


# fixed values: flags of the language and the same in Java's patterns
FLAGS = {"g": "", "l": "", "s": "", "i": "i", "x": "x", "m": "s", "p": "s"}


def flagged(pattern: Val, flags: Val) -> Val:
    """A literal pattern with its flags written into it."""
    text, flags_text = literal_of(pattern), "" if isinstance(flags.type, T.NullType) else literal_of(flags)
    if any(f not in FLAGS for f in flags_text):
        raise Unsupported(f"flags {flags_text}")
    marks = "".join(sorted({FLAGS[f] for f in flags_text}))
    return lit(f"(?{marks}){text}" if marks else text)


#: Functions of evaluated arguments, by name and their number.
WITH: dict[tuple[str, int], Callable[..., Val]] = {
    ("startswith", 1): _text(F.startswith, BOOL), ("endswith", 1): _text(F.endswith, BOOL), ("contains", 1): _text(F.contains, BOOL), ("inside", 1): _text(lambda c, n: F.contains(n, c), BOOL),
    ("ltrimstr", 1): _text(lambda c, p: F.when(F.startswith(c, p), F.substr(c, F.length(p) + 1)).otherwise(c)), ("rtrimstr", 1): _text(lambda c, p: F.when(F.endswith(c, p), F.left(c, F.length(c) - F.length(p))).otherwise(c)),
    ("trimstr", 1): lambda v, p: WITH["rtrimstr", 1](WITH["ltrimstr", 1](v, p), p), ("split", 1): _text(split, T.ArrayType(TEXT)), ("index", 1): _text(lambda c, n: F.nullif(F.position(n, c), F.lit(0)) - 1, T.IntegerType()),
    ("rindex", 1): _text(lambda c, n: F.try_element_at(_indices(c, n), F.lit(-1)), T.IntegerType()), ("indices", 1): _text(_indices, T.ArrayType(T.IntegerType())), ("test", 1): _text(F.rlike, BOOL), ("test", 2): lambda v, p, f: _text(lambda c, q: F.rlike(c, q), BOOL)(v, flagged(p, f)),
    ("gsub", 2): lambda v, p, r: _text(lambda c, q: F.regexp_replace(c, q, F.lit(literal_of(r).replace("\\", "\\\\").replace("$", "\\$"))))(v, p), ("split", 2): lambda v, p, f: _text(lambda c, q: F.split(c, q, -1), T.ArrayType(TEXT))(v, flagged(p, f)),
    ("join", 1): lambda v, s: Val(F.aggregate(F.transform(v.column, lambda x: F.coalesce(text_of(Val(x, v.type.elementType)) if not isinstance(v.type.elementType, T.StringType) else x, F.lit(""))), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, s.column, x)), lambda a: F.coalesce(a, F.lit(""))), TEXT),
    ("pow", 2): _two(F.pow), ("atan2", 2): _two(F.atan2), ("hypot", 2): _two(F.hypot), ("fmod", 2): _two(lambda a, b: a % b), ("fmin", 2): _two(F.least), ("fmax", 2): _two(lambda a, b: F.greatest(F.nanvl(a, b), F.nanvl(b, a))), ("fdim", 2): _two(lambda a, b: F.greatest(a - b, F.lit(0.0))),
    ("copysign", 2): _two(lambda a, b: F.abs(a) * F.when(b < 0, -1.0).otherwise(1.0)), ("ldexp", 2): _two(lambda a, b: a * F.pow(F.lit(2.0), b)), ("scalb", 2): _two(lambda a, b: a * F.pow(F.lit(2.0), b)), ("scalbln", 2): _two(lambda a, b: a * F.pow(F.lit(2.0), b)),
    ("fma", 3): lambda v, a, b, c: Val(a.column.cast("double") * b.column.cast("double") + c.column.cast("double"), DOUBLE), ("log", 1): lambda v, b: Val(F.ln(v.column.cast("double")) / F.ln(b.column.cast("double")), DOUBLE),
    ("edit_distance", 1): _text(lambda a, b: F.levenshtein(F.lower(a), F.lower(b)).cast("long"), LONG), ("similarity", 1): _text(lambda a, b: F.when(F.greatest(F.length(a), F.length(b)) == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b))), DOUBLE),
    ("has", 1): lambda v, k: Val((k.column >= 0) & (k.column < F.size(v.column)) if isinstance(v.type, T.ArrayType) else F.map_contains_key(v.column, k.column), BOOL), ("redact", 1): _text(lambda c, p: F.regexp_replace(c, p, F.lit("[REDACTED]"))),
    ("strftime", 1): lambda v, f: strftime(v, f), ("strflocaltime", 1): _local(lambda v, f: strftime(v, f)), ("strptime", 1): _strptime, ("bsearch", 1): lambda v, x: Val(F.when(F.array_contains(v.column, x.column), F.array_position(v.column, x.column) - 1).otherwise(-1 - F.size(F.filter(v.column, lambda y: y < x.column))), LONG),
    ("union", 2): lambda v, a, b: Val(F.sort_array(F.array_union(a.column, b.column)), a.type), ("intersect", 2): lambda v, a, b: Val(F.sort_array(F.array_intersect(a.column, b.column)), a.type), ("except", 2): lambda v, a, b: Val(F.sort_array(F.array_except(a.column, b.column)), a.type),
    ("parse_url", 0): lambda v: obj({"scheme": Val(F.lower(F.parse_url(v.column, F.lit("PROTOCOL"))), TEXT), "host": Val(F.parse_url(v.column, F.lit("HOST")), TEXT), "path": Val(F.parse_url(v.column, F.lit("PATH")), TEXT), "query": Val(F.parse_url(v.column, F.lit("QUERY")), TEXT)}),
}

# fixed values: directives of C's strftime and the same in Spark's patterns
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%I": "hh", "%p": "a", "%y": "yy", "%Z": "'UTC'"}


def strftime(v: Val, f: Val) -> Val:
    pattern = getattr(f, "literal", None)
    if pattern is None:
        raise Unsupported("a format that isn't a literal")
    if not v.numeric:
        raise Unsupported("a number required")
    v = required(v, "strftime/1 requires parsed datetime inputs")
    out, k = "", 0
    while k < len(pattern):
        if pattern[k] == "%":
            code = pattern[k : k + 2]
            if code not in DIRECTIVES:
                raise Unsupported(code)
            out, k = out + DIRECTIVES[code], k + 2
        else:
            out, k = out + ("'" + pattern[k] + "'" if pattern[k].isalpha() else pattern[k]), k + 1
    return Val(dated(v.column, out), TEXT)


def dated(c: Column, pattern: str) -> Column:
    """Seconds as text; years of more than four digits have no sign, which Spark puts before them in `yyyy` alone."""
    t = F.timestamp_seconds(F.floor(c))
    return F.when(F.year(t) > 9999, F.date_format(t, pattern.replace("yyyy", "y"))).otherwise(F.date_format(t, pattern)) if "yyyy" in pattern else F.date_format(t, pattern)


def formatted(name: str, v: Val) -> Column:
    """The named formats."""
    text = text_of(v) if not isinstance(v.type, T.ArrayType) else None
    name = name.removeprefix("@")
    if name == "text":
        return text_of(v)
    if name == "json":
        return PLAIN["tojson"](v).column
    if name == "html":
        out = text
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out
    if name == "uri":
        return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    if name == "urid":
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    if name == "base64":
        return F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n]", "")
    if name == "base64d":
        return F.decode(F.unbase64(text), "UTF-8")
    cells = getattr(v, "items", None)
    if name == "sh" and text is not None:
        return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")) if isinstance(v.type, T.StringType) else text
    if cells is None:
        raise Unsupported(f"@{name} of this kind")
    if name == "csv":
        one = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c.column, F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(c.type, T.StringType) else F.when(c.column.isNotNull(), text_of(c)), F.lit(""))
        return F.concat_ws(",", *map(one, cells))
    if name == "tsv":
        esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        return F.concat_ws("\t", *[F.coalesce(esc(c.column) if isinstance(c.type, T.StringType) else F.when(c.column.isNotNull(), text_of(c)), F.lit("")) for c in cells])
    if name == "sh":
        return F.concat_ws(" ", *[formatted("sh", c) for c in cells])
    raise Unsupported(f"@{name}")
