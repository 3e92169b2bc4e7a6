"""Programs over tables as Spark plans.

A table is an array of objects; `.` is the main table and `$name` the others. A program's value is followed in one of
five forms: a table (one array of rows), a stream of rows, groups (an array of arrays, by key), a single value, or an
index of a table by key. Each step of the program turns one form into another as DataFrame operations, so that
filters and column selections reach the scan, group_by becomes a hash aggregate, nested iteration a join, and slices of
sorted tables a top-k. What has no such form raises Unsupported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.functions.native import BOOL, DOUBLE, LONG, PLAIN, TEXT, WITH, Unsupported, Val, add, arithmetic, compare, filtering, formatted, kind_of, lit, obj, order_key, required, sort_columns, text_of, truthy
from docsluice.lang.parser import Node, parse


#: The beginning of a group that captures, in a pattern.
GROUP = re.compile(r"(?<!\\)\((?!\?)|\(\?P?<(?![=!])")


@dataclass
class Rows:
    """Rows in an order: `order` are expressions that say which comes first. As a table they are one array."""

    df: DataFrame
    elem: Val
    order: list[Column] = field(default_factory=list)
    table: bool = True
    bound: tuple[int | None, int | None] | None = None
    renamed: int = 0


@dataclass
class Groups:
    """Rows by key: an array of arrays, or, as a stream, one array after the other."""

    rows: Rows
    keys: list[Val]
    nodes: list[Node]
    stream: bool = False


@dataclass
class Tally:
    """An object whose members are sums by key: rows {key, value}."""

    rows: Rows


@dataclass
class Single:
    df: DataFrame
    val: Val


@dataclass
class Index:
    rows: Rows
    key: Val


def rows_of(df: DataFrame, order: list[str] | None = None) -> Rows:
    fields = {f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return Rows(df, obj(fields), [F.col(c) for c in order or []])


def relabelled(r: Rows, tag: str) -> Rows:
    """The same rows with columns that clash with no others."""
    df = r.df.select(*[F.col(f"`{c}`").alias(f"{tag}{c}") for c in r.df.columns])
    return rows_of_names(df, {c: f"{tag}{c}" for c in r.df.columns}, r)


def rows_of_names(df: DataFrame, names: dict[str, str], r: Rows) -> Rows:
    fields = {k: Val(F.col(f"`{names[k]}`"), v.type) for k, v in (r.elem.fields or {}).items() if k in names}
    return Rows(df, obj(fields), [], table=r.table)


class Compiler:
    def __init__(self, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None, finite: bool = False, endless: bool = False):
        self.tables, self.order, self.count, self.finite, self.endless = tables, order or {}, 0, finite, endless

    def need_end(self) -> None:
        """Refuses what needs all records, where the main table is a stream."""
        if self.endless:
            raise Unsupported("a stream has no end: this needs all records")

    # -- forms ----------------------------------------------------------------------------------------------------
    def run(self, node: Node, at, env: dict):
        kind = node[0]
        step = getattr(self, f"do_{kind}", None)
        if isinstance(at, Single):
            return Single(at.df, self.expr(node, at.val, env, None))
        if isinstance(at, Tally) and kind == "pipe":
            return self.run(node[2], self.run(node[1], at, env), env)
        if isinstance(at, Tally):
            if node == ("call", "to_entries", ()):
                return at.rows
            if node == ("call", "length", ()):
                return self.single(at.rows, node, env)
            if node == ("identity",):
                return at
            raise Unsupported(f"{kind} of sums by key")
        if isinstance(at, Groups) and at.stream and kind not in ("identity", "pipe", "bind", "def", "each") and not (kind == "call" and node[1] in WINDOWS):
            return replace(self.grouped(at, node, env), table=False)
        if isinstance(at, Rows) and not at.table and kind not in ("pipe", "call", "bind", "def", "identity", "comma", "each", "var", "if_rows"):
            return self.mapped(at, node, env)
        if step is None:
            raise Unsupported(kind)
        return step(at, env, *node[1:])

    def do_identity(self, at, env):
        return at

    def do_pipe(self, at, env, left, right):
        if left[0] == "bind":
            return self.run(("bind", left[1], left[2], ("pipe", left[3], right)), at, env)
        if isinstance(at, Groups) and left == ("index", ("identity",), ("literal", 0)):
            raise Unsupported("one group")
        out = self.run(left, at, env)
        return self.run(right, out, env)

    def do_var(self, at, env, name):
        found = env.get(name)
        if isinstance(found, (Rows, Index, Single)):
            return found
        if name in self.tables:
            return self.source(name)
        if isinstance(at, Rows) and not at.table and isinstance(found, Val):
            return replace(at, elem=found)
        raise Unsupported(f"${name}")

    def source(self, name: str) -> Rows:
        return rows_of(self.tables[name], self.order.get(name))

    def do_each(self, at, env, of):
        inner = self.run(of, at, env) if of != ("identity",) else at
        if isinstance(inner, Rows) and inner.table:
            return replace(self.settled(inner), table=False)
        if isinstance(inner, Rows):
            return self.exploded(inner)
        if isinstance(inner, Groups) and not inner.stream:
            return replace(inner, stream=True)
        raise Unsupported(".[] of this")

    def exploded(self, r: Rows) -> Rows:
        t = r.elem.type
        self.count += 1
        at, name = f"_at{self.count}", f"_x{self.count}"
        if isinstance(t, T.ArrayType):
            df = r.df.select("*", F.posexplode(r.elem.column).alias(at, name))
            return Rows(df, self.opened(name, t.elementType), [*r.order, F.col(at)], False)
        if isinstance(t, T.MapType):
            df = r.df.select("*", F.posexplode(r.elem.column).alias(at, name + "k", name))
            return Rows(df, Val(F.col(name), t.valueType), [*r.order, F.col(at)], False)
        raise Unsupported("iteration over this kind")

    def opened(self, name: str, t: T.DataType) -> Val:
        if isinstance(t, T.StructType):
            return obj({f.name: Val(F.col(f"`{name}`.`{f.name}`"), f.dataType) for f in t.fields})
        return Val(F.col(f"`{name}`"), t)

    def mapped(self, r: Rows, node: Node, env: dict) -> Rows:
        holder = [r]
        val = self.expr(node, r.elem, env, holder)
        return replace(holder[0], elem=val)

    def do_comma(self, at, env, left, right):
        """Both outputs for each row: rows of one kind, in order."""
        if not (isinstance(at, Rows) and not at.table):
            raise Unsupported(", here")
        parts = self.commas(("comma", left, right))
        vals = [self.expr(p, at.elem, env, None) for p in parts]
        t = vals[0].type
        if any(kind_of(v.type) != kind_of(t) for v in vals):
            raise Unsupported(", of different kinds")
        return self.exploded(replace(at, elem=Val(F.array(*[v.column for v in vals]), T.ArrayType(t))))

    def commas(self, node: Node) -> list[Node]:
        return [*self.commas(node[1]), *self.commas(node[2])] if node[0] == "comma" else [node]

    def do_collect(self, at, env, inner):
        if inner is None:
            raise Unsupported("[]")
        if isinstance(at, Groups):
            raise Unsupported("an array for each group")
        out = self.run(inner, at, env)
        if isinstance(out, Rows) and not out.table:
            return replace(out, table=True)
        raise Unsupported("[...] of this")

    def do_def(self, at, env, definition, rest):
        name, params, body = definition
        return self.run(rest, at, {**env, f"{name}/{len(params)}": (params, body)})

    # -- iteration with names: joins --------------------------------------------------------------------------------
    def do_bind(self, at, env, source, patterns, body):
        if len(patterns) != 1:
            raise Unsupported("?//")
        if isinstance(at, Rows) and not at.table:
            if self.is_table(source):
                return self.product(at, source, patterns[0], body, env)
            val = self.expr(source, at.elem, env, None)
            inner = {**env, **self.names(patterns[0], val)}
            first, rest = self.split(body)
            if self.is_table(first):
                return self.product(at, first, None, rest, inner)
            return self.run(body, at, inner)
        if source[0] == "call" and source[1] == "INDEX":
            return self.run(body, at, {**env, patterns[0][1]: self.index(source[2], at, env)})
        found = self.run(source, at, env)
        if isinstance(found, Rows) and not found.table:
            inner = {**env, **self.names(patterns[0], found.elem)}
            # the rows of the source are the context from here on; what the body iterates is joined to them
            first, rest = self.split(body)
            if self.is_table(first) or first[0] == "bind" and self.is_table(first[1]):
                return self.product(found, first, None, rest, inner)
            return self.run(body, found, inner)
        if isinstance(found, (Rows, Single, Index)) and patterns[0][0] == "name":
            return self.run(body, at, {**env, patterns[0][1]: found})
        raise Unsupported("this binding")

    def split(self, body: Node) -> tuple[Node, Node]:
        if body[0] == "pipe":
            first, rest = self.split(body[1])
            return first, body[2] if rest == ("identity",) else ("pipe", rest, body[2])
        return body, ("identity",)

    def is_table(self, node: Node) -> bool:
        return node[0] == "each" and node[1][0] == "var" and node[1][1] in self.tables

    def names(self, pattern: Node, val: Val) -> dict[str, Val]:
        if pattern[0] == "name":
            return {pattern[1]: val}
        if pattern[0] == "map":
            out = {}
            for key, bind, inner in pattern[1]:
                part = self.member(val, key[1])
                out |= ({bind: part} if bind else {}) | (self.names(inner, part) if inner else {})
            return out
        return {k: v for i, p in enumerate(pattern[1]) for k, v in self.names(p, Val(F.get(val.column, i), val.type.elementType)).items()}

    def product(self, left: Rows, each: Node, pattern: Node | None, body: Node, env: dict):
        """left with every row of a table, joined where the program next selects."""
        self.count += 1
        right = relabelled(self.source(each[1][1]), f"_r{self.count}_")
        inner = {**env, **(self.names(pattern, right.elem) if pattern else {})}
        elem = left.elem if pattern else right.elem
        first, rest = self.split(body)
        if first[0] == "call" and first[1] == "select":
            condition = reduce(lambda a, b: a & b, self.conditions(first[2][0], elem, inner, None))
            df = left.df.join(right.df, condition, "inner")
        else:
            df, rest = left.df.crossJoin(right.df), body
        return self.run(rest, Rows(df, elem, [*left.order], False), inner)

    def index(self, args: tuple, at, env: dict) -> Index:
        source, key = (args[0], args[1]) if len(args) == 2 else (("each", ("identity",)), args[0])
        r = self.run(source, at, env) if source != ("each", ("identity",)) else self.run(source, at, env)
        if not isinstance(r, Rows):
            raise Unsupported("INDEX of this")
        return Index(r, Val(text_of(self.expr(key, r.elem, env, None)), TEXT))

    def looked_up(self, holder: list[Rows] | None, index: Index, key: Val) -> Val:
        """A left join to the last row of each key."""
        if holder is None:
            raise Unsupported("a lookup here")
        self.count += 1
        tag = f"_i{self.count}_"
        fields = index.rows.elem.fields or {"value": index.rows.elem}
        last = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(index.rows.order)]) if index.rows.order else None
        row = F.struct(*[v.column.alias(k) for k, v in fields.items()])
        best = (F.max_by(row, last) if last is not None else F.last(row)).alias(tag)
        side = index.rows.df.groupBy(index.key.column.alias(tag + "k")).agg(best)
        r = holder[0]
        holder[0] = replace(r, df=r.df.join(side, text_of(key) == F.col(tag + "k"), "left"))
        if index.rows.elem.fields:
            return obj({k: Val(F.col(f"`{tag}`.`{k}`"), v.type) for k, v in fields.items()})
        return Val(F.col(f"`{tag}`.`value`"), index.rows.elem.type)

    # -- calls on tables --------------------------------------------------------------------------------------------
    def do_call(self, at, env, name, args):
        if f"{name}/{len(args)}" in env:
            params, body = env[f"{name}/{len(args)}"]
            inner = dict(env)
            for p, a in zip(params, args, strict=True):
                if p.startswith("$"):
                    raise Unsupported("a value parameter here")
                inner[f"{p}/0"] = ((), a)
            return self.run(body, at, inner)
        if isinstance(at, Rows) and not at.table:
            special = getattr(self, f"stream_{name}_{len(args)}", None)
            return special(at, env, *args) if special else self.mapped(at, ("call", name, args), env)
        if name == "JOIN":
            return self.run(self.join_program(args), at, env)
        if isinstance(at, Groups):
            if name == "map":
                return self.grouped(at, args[0], env)
            if at.stream and (name, len(args)) in (*[(n, 2) for n in MOVING], ("lag", 1), ("deltas", 1), ("counter", 1)):
                return self.windowed(at, name, args, env)
            if name == "length" and not args:
                return self.summary(replace(at.rows, table=True), {"value": ("call", "count_groups", ())}, env, at)
            raise Unsupported(f"{name} of groups")
        special = getattr(self, f"table_{name}_{len(args)}", None)
        if special:
            return special(at, env, *args)
        return self.single(at, ("call", name, args), env)

    def join_program(self, args: tuple) -> Node:
        """JOIN as the iteration that it is short for; the index has to be bound to a name."""
        stream, key = (("each", ("identity",)), args[1]) if len(args) == 2 else (args[1], args[2])
        pair: Node = ("collect", ("comma", ("identity",), ("index", args[0], ("pipe", key, ("call", "tostring", ())))))
        out: Node = ("pipe", stream, pair if len(args) < 4 else ("pipe", pair, args[3]))
        return ("collect", out) if len(args) == 2 else out

    def windowed(self, g: Groups, name: str, args: tuple, env: dict) -> Rows:
        """A window function over the rows of each group, in order: a value for each row, or for all but the first."""
        inner = self.items_stream(args[-1], g.rows, env)
        if inner is None or not g.rows.order or len(args) == 2 and not (args[0][0] == "literal" and isinstance(args[0][1], int) and args[0][1] > 0):
            raise Unsupported("this window")
        val, kept = inner
        if val.float and name in ("moving_min", "moving_max") and not self.finite:
            raise Unsupported("windows of what can be NaN")
        if not val.numeric and name not in ("windows", "lag", "counter"):
            raise Unsupported("windows of what is no number")
        over = Window.partitionBy(*[order_key(k) for k in g.keys]).orderBy(*[Sorted.column(o) for o in g.rows.order])
        frame = over.rowsBetween(1 - args[0][1], 0) if len(args) == 2 else over
        self.count += 1
        name_, place = f"_w{self.count}", f"_p{self.count}"
        made, t = WINDOWS[name](val, frame)
        df = (g.rows.df if kept is None else g.rows.df.where(kept)).withColumns({name_: made, place: F.row_number().over(over)})
        df = df.where(F.col(place) > 1) if name in ("lag", "deltas") else df
        return Rows(df, Val(F.col(name_), t), [*[Sorted(k) for k in g.keys], F.col(place)], False)

    def single(self, at: Rows, node: Node, env: dict) -> Single:
        if not isinstance(at, Rows):
            raise Unsupported("one value for each group")
        self.need_end()
        val = self.aggregate(node, self.settled(at), env)
        return Single(self.settled(at).df.agg(val.column.alias("value")), Val(F.col("value"), val.type))

    def do_object(self, at, env, members):
        if isinstance(at, Rows) and at.table:
            self.need_end()
            r = self.settled(at)
            vals = {k[1]: self.aggregate(v, r, env) for k, v in members}
            return Single(r.df.agg(*[v.column.alias(k) for k, v in vals.items()]), obj({k: Val(F.col(f"`{k}`"), v.type) for k, v in vals.items()}))
        raise Unsupported("an object of groups")

    def do_binary(self, at, env, op, left, right):
        return self.single(at, ("binary", op, left, right), env)

    def tally(self, at, env, source, patterns, start, update) -> Tally | None:
        """reduce ... as $x ({}; .[key of $x] += number of $x): a sum for each key."""
        empty = start == ("object", ()) or start == ("literal", {})
        if not (isinstance(at, Rows) and at.table and empty and len(patterns) == 1 and update[0] == "assign" and update[1] == "+=" and update[2][0] == "index" and update[2][1] == ("identity",)):
            return None
        self.need_end()
        r = self.settled(at)
        inner = self.items_stream(source, r, env)
        if inner is None:
            return None
        names = {**env, **self.names(patterns[0], inner[0])}
        key, value = (self.expr(n, lit(None), names, None) for n in (update[2][2], update[3]))
        if not isinstance(key.type, T.StringType) or not value.numeric:
            raise Unsupported("keys that are no strings")
        df = r.df if inner[1] is None else r.df.where(inner[1])
        total = self.folded("add", (value, None))
        out = rows_of(df.groupBy(required(key, "cannot be a key").column.alias("key")).agg(total.column.alias("value")))
        return Tally(replace(out, order=[Sorted(out.elem.fields["key"])]))

    def do_reduce(self, at, env, source, patterns, start, update):
        found = self.tally(at, env, source, patterns, start, update)
        if found is not None:
            return found
        return self.single(at, ("reduce", source, patterns, start, update), env)

    def do_index(self, at, env, of, key):
        inner = self.run(of, at, env)
        if isinstance(inner, Rows) and inner.table and key[0] == "literal" and isinstance(key[1], int):
            n = key[1]
            r = self.run(("slice", ("identity",), ("literal", n), ("literal", n + 1) if n != -1 else None), inner, env)
            return replace(self.settled(r), table=False)
        raise Unsupported("an index here")

    def do_negate(self, at, env, inner):
        return self.single(at, ("negate", inner), env)

    def do_slice(self, at, env, of, start, end):
        r = self.run(of, at, env)
        if not (isinstance(r, Rows) and r.table):
            raise Unsupported("a slice here")
        a, b = (x[1] if x and x[0] == "literal" else -x[1][1] if x and x[0] == "negate" else None for x in (start, end))
        if (a or 0) < 0 or (b or 0) < 0:
            if a is not None and a < 0 and b is None and r.order:  # the last rows: the first of the reverse, turned around
                turned = replace(self.settled(r), order=self.reversed_order(r.order))
                return replace(self.settled(replace(turned, bound=(0, -a))), order=r.order)
            raise Unsupported("negative bounds")
        return replace(self.settled(r), bound=(a or 0, b))

    def reversed_order(self, order: list[Column]) -> list[Column]:
        return [Reverse.of(o) for o in order]

    def settled(self, r: Rows) -> Rows:
        """Rows with their slice taken: sorted and limited, which Spark runs as a top-k."""
        if r.bound is None:
            return r
        self.need_end()
        a, b = r.bound
        # rows without an order come as they are read
        df = r.df.orderBy(*[Sorted.column(o) for o in r.order]) if r.order else r.df
        if a:
            df = df.offset(a)
        if b is not None:
            df = df.limit(max(0, b - a))
        return replace(r, df=df, bound=None)

    def by(self, r: Rows, keys: list[Val], descending: bool = False) -> Rows:
        self.need_end()
        r = self.settled(r)
        return replace(r, order=[Sorted(v) for v in keys] + list(r.order))

    def keys(self, node: Node, r: Rows, env: dict) -> list[Val]:
        holder = [r]
        parts = self.commas(node[1]) if node[0] == "collect" else self.commas(node)
        out = [self.expr(p, r.elem, env, holder) for p in parts]
        r.df = holder[0].df
        return out

    def table_sort_by_1(self, at, env, key):
        r = self.settled(at)
        return self.by(r, self.keys(key, r, env))

    def table_sort_0(self, at, env):
        return self.by(at, [at.elem])

    def table_reverse_0(self, at, env):
        r = self.settled(at)
        return replace(r, order=self.reversed_order(r.order))

    def table_map_1(self, at, env, f):
        return replace(self.run(("pipe", ("each", ("identity",)), f), at, env), table=True)

    def table_group_by_1(self, at, env, key):
        self.need_end()
        r = self.settled(at)
        nodes = self.commas(key[1]) if key[0] == "collect" else self.commas(key)
        return Groups(r, self.keys(key, r, env), nodes)

    def table_unique_by_1(self, at, env, key):
        self.need_end()
        r = self.settled(at)
        keys = self.keys(key, r, env)
        if not r.order:
            raise Unsupported("unique_by needs an order")
        w = Window.partitionBy(*[order_key(k) for k in keys]).orderBy(*[Sorted.column(o) for o in r.order])
        self.count += 1
        name = f"_n{self.count}"
        df = r.df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1)
        return replace(r, df=df, order=[Sorted(k) for k in keys])

    def table_unique_0(self, at, env):
        self.need_end()
        r = self.settled(at)
        if r.elem.fields:
            names = list(r.elem.fields)
            df = r.df.select(*[v.column.alias(k) for k, v in r.elem.fields.items()]).distinct()
            out = rows_of(df)
            return replace(out, order=[Sorted(out.elem.fields[n]) for n in names])
        df = r.df.select(r.elem.column.alias("value")).distinct()
        val = Val(F.col("value"), r.elem.type)
        return Rows(df, val, [Sorted(val)])

    def table_top_k_1(self, at, env, n):
        return replace(self.table_sort_0(at, env), bound=(0, n[1]))

    def table_top_k_2(self, at, env, n, key):
        return replace(self.table_sort_by_1(at, env, key), bound=(0, n[1]))

    def _extreme(self, at, env, key, last: bool):
        r = self.table_sort_by_1(at, env, key)
        order = self.reversed_order(r.order) if last else r.order
        return replace(self.settled(replace(r, order=order, bound=(0, 1))), table=False)

    def table_min_by_1(self, at, env, key):
        return self._extreme(at, env, key, False)

    def table_max_by_1(self, at, env, key):
        return self._extreme(at, env, key, True)

    def table_first_0(self, at, env):
        return self.do_index(at, env, ("identity",), ("literal", 0))

    def table_last_0(self, at, env):
        return self.do_index(at, env, ("identity",), ("literal", -1))

    def table_first_1(self, at, env, f):
        return replace(self.settled(replace(self.run(f, at, env), bound=(0, 1))), table=False)

    def table_limit_2(self, at, env, n, f):
        return replace(self.settled(replace(self.run(f, at, env), bound=(0, n[1]))), table=False)

    def table_skip_2(self, at, env, n, f):
        return replace(self.settled(replace(self.run(f, at, env), bound=(n[1], None))), table=False)

    def table_nth_2(self, at, env, n, f):
        return replace(self.settled(replace(self.run(f, at, env), bound=(n[1], n[1] + 1))), table=False)

    def table_frequency_1(self, at, env, f):
        r = self.run(f, at, env)
        if not (isinstance(r, Rows) and r.table):
            raise Unsupported("frequency of this")
        df = r.df.groupBy(r.elem.column.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        out = rows_of(df)
        return replace(out, order=[F.col("count").desc(), Sorted(out.elem.fields["value"])])

    def _sets(self, env, at, f, g, how: str):
        a, b = (self.run(("pipe", x, ("call", "unique", ())) if x[0] != "identity" else x, at, env) for x in (f, g))
        left, right = a.df.select(a.elem.column.alias("value")), b.df.select(b.elem.column.alias("value"))
        df = {"union": lambda: left.union(right).distinct(), "intersect": lambda: left.intersect(right), "except": lambda: left.subtract(right)}[how]()
        val = Val(F.col("value"), a.elem.type)
        return Rows(df, val, [Sorted(val)])

    def table_union_2(self, at, env, f, g):
        return self._sets(env, at, f, g, "union")

    def table_intersect_2(self, at, env, f, g):
        return self._sets(env, at, f, g, "intersect")

    def table_except_2(self, at, env, f, g):
        return self._sets(env, at, f, g, "except")

    def table_melt_4(self, at, env, ids, keys, name, value):
        from docsluice.operators.reshape import melt

        names = lambda n: [p[1] for p in self.commas(n[1])]
        return rows_of(melt(self.plain(self.settled(at)), names(ids), names(keys), name[1], value[1]))

    def table_pivot_4(self, at, env, ids, name, value, columns):
        from docsluice.operators.reshape import pivot

        names = lambda n: [p[1] for p in self.commas(n[1])]
        return rows_of(pivot(self.plain(self.settled(at)), names(ids), name[1], value[1], names(columns), [Sorted.column(o) for o in at.order]))

    # -- calls on streams -------------------------------------------------------------------------------------------
    def stream_select_1(self, at, env, test):
        if test[0] == "call" and test[1] in ("any", "all") and len(test[2]) == 2 and self.is_table(test[2][0]):
            return self.matching(at, env, test)
        if test[0] == "call" and test[1] == "IN" and len(test[2]) == 1 and test[2][0][0] in ("index", "pipe"):
            return self.among(at, env, at.elem, test[2][0])
        if test[0] == "pipe" and test[2][0] == "call" and test[2][1] == "IN" and len(test[2][2]) == 1:
            return self.among(at, env, self.expr(test[1], at.elem, env, None), test[2][2][0])
        if test[0] == "call" and test[1] == "IN" and len(test[2]) == 2:
            return self.among(at, env, self.expr(test[2][0], at.elem, env, None), test[2][1])
        holder = [at]
        conditions = self.conditions(test, at.elem, env, holder)
        r = holder[0]
        return replace(r, df=reduce(lambda d, c: d.where(c), conditions, r.df))

    def conditions(self, test: Node, elem: Val, env: dict, holder) -> list[Column]:
        """The conjuncts of a filter: comparisons with literals in the form that a scan understands."""
        out = []
        for part in self.conjuncts(test):
            plain = None
            if part[0] == "binary":
                plain = filtering(part[1], *[self.expr(x, elem, env, holder) for x in part[2:]], self.finite)
            elif part[0] == "or":
                sides = [self.conditions(x, elem, env, holder) for x in part[1:]]
                plain = [reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, s) for s in sides])]
            out += plain if plain is not None else [truthy(self.expr(part, elem, env, holder))]
        return out

    def conjuncts(self, node: Node) -> list[Node]:
        return [*self.conjuncts(node[1]), *self.conjuncts(node[2])] if node[0] == "and" else [node]

    def among(self, at: Rows, env, val: Val, source: Node):
        """A semi join: null equals null."""
        if source[0] == "index":
            source = ("pipe", source[1], ("index", ("identity",), source[2]))
        inner = self.run(source, at, env) if not self.has_table(source) else self.run(source, Rows(at.df, at.elem), env)
        self.count += 1
        name = f"_s{self.count}"
        side = inner.df.select(inner.elem.column.alias(name)).distinct()
        return replace(at, df=at.df.join(side, val.column.eqNullSafe(F.col(name)), "left_semi"))

    def has_var(self, node) -> bool:
        """Whether a node names one of the tables."""
        return isinstance(node, (tuple, list)) and (len(node) == 2 and node[0] == "var" and node[1] in self.tables or any(self.has_var(x) for x in node))

    def has_table(self, node) -> bool:
        return isinstance(node, tuple) and (self.is_table(node) or any(self.has_table(x) for x in node))

    def matching(self, at: Rows, env, test: Node):
        """any over a table: a semi join; all over a table: an anti join on what breaks it."""
        _, which, (each, predicate) = test
        self.count += 1
        right = relabelled(self.source(each[1][1]), f"_m{self.count}_")
        holds = truthy(self.expr(predicate, right.elem, env, None))
        if which == "all":
            if predicate[0] == "binary" and predicate[1] == "!=":
                holds = truthy(self.expr(("binary", "==", predicate[2], predicate[3]), right.elem, env, None))
            else:
                holds = ~holds
        return replace(at, df=at.df.join(right.df, holds, "left_semi" if which == "any" else "left_anti"))

    def stream_values_0(self, at, env):
        return replace(at, df=at.df.where(at.elem.column.isNotNull()))

    def stream_nulls_0(self, at, env):
        return replace(at, df=at.df.where(at.elem.column.isNull()))

    def stream_empty_0(self, at, env):
        return replace(at, df=at.df.where(F.lit(False)))

    def _kinds(kinds):  # noqa: N805
        def run(self, at, env):
            return at if kind_of(at.elem.type) in kinds else replace(at, df=at.df.where(F.lit(False)))

        return run

    stream_numbers_0, stream_strings_0, stream_booleans_0 = _kinds({"number"}), _kinds({"string"}), _kinds({"boolean"})
    stream_arrays_0, stream_objects_0, stream_iterables_0 = _kinds({"array"}), _kinds({"object"}), _kinds({"array", "object"})

    # -- groups and summaries ---------------------------------------------------------------------------------------
    def grouped(self, g: Groups, node: Node, env: dict) -> Rows:
        """map over groups: a hash aggregate by the keys, in key order."""
        key_columns = {f"_k{i}": k for i, k in enumerate(g.keys)}
        inner = {**env, "*keys": list(zip(g.nodes, [Val(F.col(n), k.type) for n, k in key_columns.items()], strict=True))}
        parts = {k[1]: self.aggregate(v, g.rows, inner) for k, v in node[1]} if node[0] == "object" else {"value": self.aggregate(node, g.rows, inner)}
        keyed = g.rows.df.withColumns({n: k.column for n, k in key_columns.items()})
        keyed_rows = keyed.groupBy(*key_columns)
        plain = {n: v for n, v in parts.items() if getattr(v, "is_key", None) is None}
        df = keyed_rows.agg(*[v.column.alias(n) for n, v in plain.items()]) if plain else keyed.select(*key_columns).distinct()
        out = {n: Val(F.col(n if n in plain else v.is_key), v.type) for n, v in parts.items()}
        order = [Sorted(Val(F.col(n), k.type)) for n, k in key_columns.items()]
        return Rows(df, obj({n: Val(F.col(f"`{n if n in plain else parts[n].is_key}`"), parts[n].type) for n in out}) if node[0] == "object" else out["value"], order)

    def summary(self, r, members, env, groups=None):
        if groups is not None:
            return Single(groups.rows.df.select(*[k.column.alias(f"_k{i}") for i, k in enumerate(groups.keys)]).distinct().agg(F.count(F.lit(1)).alias("value")), Val(F.col("value"), LONG))
        raise Unsupported("this summary")

    def aggregate(self, node: Node, r: Rows, env: dict) -> Val:
        """A node whose `.` is an array of rows, as an aggregate expression over them."""
        kind = node[0]
        if kind == "literal":
            return lit(node[1])
        if kind == "binary":
            return (compare if node[1] in ("==", "!=", "<", "<=", ">", ">=") else arithmetic_of)(node[1], self.aggregate(node[2], r, env), self.aggregate(node[3], r, env))
        if kind == "negate":
            v = self.aggregate(node[1], r, env)
            return Val(-v.column, v.type)
        if kind == "if":
            return self.conditional(*[self.aggregate(x, r, env) for x in node[1:]])
        if kind == "alternative":
            a, b = (self.aggregate(x, r, env) for x in node[1:])
            return Val(F.coalesce(F.when(truthy(a), a.column), b.column), a.type)
        if kind == "index":
            return self.aggregate_index(node, r, env)
        if kind == "reduce":
            return self.reduced(node, r, env)
        if kind == "collect":
            return self.listed(r, node[1], env)
        if kind == "call" and node[1] in ("length", "count") and not node[2]:
            return Val(F.count(F.lit(1)), LONG)
        if kind == "call" and node[1] in ("any", "all"):
            test = node[2][-1] if node[2] else ("identity",)
            cond = truthy(self.expr(test, r.elem, env, None))
            return Val(F.coalesce((F.bool_or if node[1] == "any" else F.bool_and)(cond), F.lit(node[1] == "all")), BOOL)
        if kind == "call" and node[1] in STATS and node[2]:
            inner = self.items(node[2][0], r, env)
            if inner is not None:
                extra = [a[1] for a in node[2][1:]]
                return STATS[node[1]](inner[0], inner[1], *extra)
        if kind == "call" and node[1] == "add" and len(node[2]) == 1:
            inner = self.items(("collect", node[2][0]), r, env)
            return self.folded("add", inner)
        if kind == "call" and node[1] == "map":
            return self.listed(r, ("pipe", ("each", ("identity",)), node[2][0]), env)
        if kind == "pipe":
            inner = self.items(node[1], r, env)
            if inner is not None:
                return self.after(inner, node[2], r, env)
            v = self.aggregate(node[1], r, env)
            return self.expr(node[2], v, env, None)
        if kind == "call" and node[1] in ("min", "max", "add", "unique", "sort", "first", "last", "min_by", "max_by"):
            return self.after((r.elem, None), node, r, env)
        raise Unsupported(f"{kind} of an array")

    def items(self, node: Node, r: Rows, env: dict) -> tuple[Val, Column | None] | None:
        """The elements that a node makes of the rows, one each, and which rows it keeps."""
        if node == ("identity",):
            return r.elem, None
        if node[0] == "call" and node[1] == "map":
            return self.chain(node[2][0], r.elem, None, env)
        if node[0] == "collect" and node[1]:
            return self.items_stream(node[1], r, env)
        if node[0] == "pipe":
            first = self.items(node[1], r, env)
            if first is not None and node[2][0] == "call" and node[2][1] == "map":
                return self.chain(node[2][2][0], first[0], first[1], env)
        return None

    def items_stream(self, node: Node, r: Rows, env: dict):
        first, rest = self.split(node)
        if first == ("each", ("identity",)):
            return self.chain(rest, r.elem, None, env)
        if first[0] == "index":
            base, keys = first, []
            while base[0] == "index":
                keys.append(base[2])
                base = base[1]
            if base == ("each", ("identity",)):
                path: Node = ("identity",)
                for k in reversed(keys):
                    path = ("index", path, k)
                return self.chain(("pipe", path, rest), r.elem, None, env)
        return None

    def chain(self, node: Node, val: Val, kept: Column | None, env: dict):
        if node[0] == "pipe":
            first = self.chain(node[1], val, kept, env)
            return None if first is None else self.chain(node[2], first[0], first[1], env)
        if node[0] == "call" and node[1] == "select":
            c = truthy(self.expr(node[2][0], val, env, None))
            return val, c if kept is None else kept & c
        if node[0] in ("each", "comma"):
            return None
        return self.expr(node, val, env, None), kept

    def after(self, inner: tuple[Val, Column | None], node: Node, r: Rows, env: dict) -> Val:
        val, kept = inner
        if node[0] == "pipe":
            if node[1][0] == "call" and node[1][1] == "unique" and node[2] == ("call", "length", ()):
                return Val(F.count_distinct(F.when(kept, val.column) if kept is not None else val.column), LONG)
            return self.expr(node[2], self.after(inner, node[1], r, env), env, None)
        if node[0] == "call":
            name, args = node[1], node[2]
            if name == "length":
                return Val(F.count_if(kept) if kept is not None else F.count(F.lit(1)), LONG)
            if name in ("add", "min", "max") and not args:
                return self.folded(name, inner)
            if name == "unique":
                c = F.when(kept, val.column) if kept is not None else val.column
                return Val(F.sort_array(F.collect_set(c)), T.ArrayType(val.type))
            if name == "sort":
                c = F.when(kept, val.column) if kept is not None else val.column
                return Val(F.sort_array(F.collect_list(c)), T.ArrayType(val.type))
            if name == "join":
                return WITH["join", 1](self.gathered(val, kept, r), self.expr(args[0], val, env, None))
            if name in ("any", "all") and len(args) <= 1:
                cond = truthy(self.expr(args[0], val, env, None) if args else val)
                cond = cond if kept is None else F.when(kept, cond)
                return Val(F.coalesce((F.bool_or if name == "any" else F.bool_and)(cond), F.lit(name == "all")), BOOL)
            if name in ("min_by", "max_by", "first", "last"):
                key = [order_key(self.expr(args[0], val, env, None))] if args else []
                place = [Sorted.key(o) for o in r.order]
                by = F.struct(*[c.alias(f"b{i}") for i, c in enumerate([*key, *place])])
                pick = F.min_by if name in ("min_by", "first") else F.max_by
                self.need_order([*key, *place])
                row = val.column if kept is None else F.when(kept, val.column)
                return Val(pick(row, by if kept is None else F.when(kept, by)), val.type)
        if node[0] == "index":
            return self.member(self.after(inner, node[1], r, env), node[2][1])
        raise Unsupported("this aggregate")

    def need_order(self, order):
        if not order:
            raise Unsupported("an order is needed")

    def folded(self, name: str, inner) -> Val:
        if inner is None:
            raise Unsupported("this aggregate")
        val, kept = inner
        c = F.when(kept, val.column) if kept is not None else val.column
        if name in ("min", "max"):
            if val.float:  # NaN is below every number
                best = F.struct((~F.isnan(c)).alias("n"), c.alias("v"))
                best = F.when(c.isNotNull(), best)
                return Val((F.min if name == "min" else F.max)(best)["v"], val.type)
            return Val((F.min if name == "min" else F.max)(c), val.type)
        if isinstance(val.type, T.StringType):
            raise Unsupported("add of strings")
        if not val.numeric:
            raise Unsupported("add of this kind")
        return Val(F.sum(c), DOUBLE if val.float else LONG if not isinstance(val.type, T.DecimalType) else val.type)

    def gathered(self, val: Val, kept: Column | None, r: Rows) -> Val:
        """The elements as an array, in the rows' order."""
        if not r.order:
            raise Unsupported("an order is needed")
        x = F.struct(*[Sorted.key(o).alias(f"b{i}") for i, o in enumerate(r.order)], val.column.alias("x"))
        c = F.collect_list(F.when(kept, x) if kept is not None else x)
        return Val(F.transform(F.array_sort(c), lambda s: s["x"]), T.ArrayType(val.type))

    def listed(self, r: Rows, node: Node, env: dict) -> Val:
        inner = self.items_stream(node, r, env)
        if inner is None:
            raise Unsupported("this array")
        return self.gathered(inner[0], inner[1], r)

    def aggregate_index(self, node: Node, r: Rows, env: dict) -> Val:
        of, key = node[1], node[2]
        for written, val in env.get("*keys", []):
            if self.names_key(node, written):
                out = Val(val.column, val.type)
                out.is_key = f"_k{[w for w, _ in env['*keys']].index(written)}"
                return out
        if of == ("identity",) and key == ("literal", 0):
            return self.after((r.elem, None), ("call", "first", ()), r, env)
        if of == ("identity",) and key[0] in ("negate",):
            return self.after((r.elem, None), ("call", "last", ()), r, env)
        inner = self.aggregate(of, r, env)
        return self.member(inner, key[1])

    def names_key(self, node: Node, written: Node) -> bool:
        """Whether node is .[0] followed by the path that the group key is."""
        def swap(n):
            return ("index", ("identity",), ("literal", 0)) if n == ("identity",) else (n[0], swap(n[1]), *n[2:]) if n[0] == "index" else None

        return node == swap(written)

    def reduced(self, node: Node, r: Rows, env: dict) -> Val:
        """reduce .[] as $x (start; . + expression of $x), and counts: sums."""
        _, source, patterns, start, update = node
        inner = self.items_stream(source, r, env)
        if inner is None or len(patterns) != 1 or not (update[0] == "binary" and update[1] == "+" and update[2] == ("identity",)) or start[0] != "literal":
            raise Unsupported("this reduce")
        val = self.expr(update[3], lit(None), {**env, **self.names(patterns[0], inner[0])}, None)
        total = self.folded("add", (val, inner[1]))
        return arithmetic_of("+", lit(start[1]), Val(F.coalesce(total.column, F.lit(0).cast(total.type)), total.type))

    # -- rows: expressions ------------------------------------------------------------------------------------------
    def member(self, v: Val, key) -> Val:
        if isinstance(key, str):
            if v.fields is not None:
                return v.fields.get(key, lit(None))
            if isinstance(v.type, T.StructType):
                found = next((f for f in v.type.fields if f.name == key), None)
                return Val(v.column.getField(key), found.dataType) if found else lit(None)
            if isinstance(v.type, T.MapType):
                return Val(F.try_element_at(v.column, F.lit(key)), v.type.valueType)
            if isinstance(v.type, T.NullType):
                return v
        if isinstance(key, int) and getattr(v, "items", None) is not None:
            return v.items[key] if -len(v.items) <= key < len(v.items) else lit(None)
        if isinstance(key, int) and isinstance(v.type, T.ArrayType):
            return Val(F.get(v.column, key) if key >= 0 else F.try_element_at(v.column, F.lit(key)), v.type.elementType)
        raise Unsupported(f"index {key!r}")

    def conditional(self, test: Val, yes: Val, no: Val) -> Val:
        t = no.type if isinstance(yes.type, T.NullType) else yes.type
        if not isinstance(yes.type, T.NullType) and not isinstance(no.type, T.NullType):
            if kind_of(yes.type) != kind_of(no.type):
                raise Unsupported("branches of different kinds")
            if yes.numeric and (yes.float or no.float):
                t = DOUBLE
        return Val(F.when(truthy(test), yes.column).otherwise(no.column), t)

    def expr(self, node: Node, v: Val, env: dict, holder: list[Rows] | None) -> Val:
        kind, e = node[0], lambda n, x=v: self.expr(n, x, env, holder)
        if kind == "identity":
            return v
        if kind == "literal":
            out = lit(node[1])
            out.literal = node[1]
            return out
        if kind == "index":
            if node[1][0] == "var" and isinstance(env.get(node[1][1]), Index):
                return self.looked_up(holder, env[node[1][1]], e(node[2]))
            base, key = e(node[1]), node[2]
            if key[0] == "negate" and key[1][0] == "literal":
                key = ("literal", -key[1][1])
            if key[0] == "literal":
                return self.member(base, key[1])
            at = e(key)
            if isinstance(base.type, T.ArrayType) and at.numeric:
                n = at.column.cast("int")
                return Val(F.get(base.column, F.when(n < 0, F.size(base.column) + n).otherwise(n)), base.type.elementType)
            if isinstance(base.type, T.MapType):
                return Val(F.try_element_at(base.column, at.column), base.type.valueType)
            raise Unsupported("this index")
        if kind == "slice":
            base = e(node[1])
            size = F.char_length(base.column) if isinstance(base.type, T.StringType) else F.size(base.column)
            fix = lambda n, default: default if n is None else (lambda c: F.greatest(F.lit(0), F.least(size, F.when(c < 0, c + size).otherwise(c))))(e(n).column.cast("int"))
            a, b = fix(node[2], F.lit(0)), fix(node[3], size)
            n = F.greatest(F.lit(0), b - a)
            return Val(F.substr(base.column, a + 1, n) if isinstance(base.type, T.StringType) else F.slice(base.column, a + 1, n), base.type)
        if kind == "pipe":
            return self.expr(node[2], e(node[1]), env, holder)
        if kind == "binary":
            a, b = e(node[2]), e(node[3])
            return compare(node[1], a, b) if node[1] in ("==", "!=", "<", "<=", ">", ">=") else arithmetic_of(node[1], a, b)
        if kind in ("and", "or"):
            a, b = truthy(e(node[1])), truthy(e(node[2]))
            return Val(a & b if kind == "and" else a | b, BOOL)
        if kind == "if":
            return self.conditional(e(node[1]), e(node[2]), e(node[3]))
        if kind == "alternative":
            a, b = e(node[1]), e(node[2])
            return Val(F.coalesce(F.when(truthy(a), a.column), b.column), b.type if isinstance(a.type, T.NullType) else a.type)
        if kind == "negate":
            a = e(node[1])
            return Val(-a.column, a.type)
        if kind == "try" and node[2] is None:
            if not self.is_path(node[1]):
                raise Unsupported("errors that are caught")
            return e(node[1])
        if kind == "object":
            return obj({self.key_text(k): e(x) for k, x in node[1]})
        if kind == "collect":
            if node[1] is None:
                return Val(F.array(), T.ArrayType(T.NullType()))
            return self.array(node[1], v, env, holder)
        if kind == "text":
            return Val(F.concat(*[F.lit(p) if isinstance(p, str) else (formatted(node[1], e(p)) if node[1] else text_of(e(p))) for p in node[2] if p != ""]), TEXT)
        if kind == "format":
            return Val(formatted(node[1], v), TEXT)
        if kind == "var":
            found = env.get(node[1])
            if isinstance(found, Val):
                return found
            raise Unsupported(f"${node[1]}")
        if kind == "bind" and len(node[2]) == 1:
            return self.expr(node[3], v, {**env, **self.names(node[2][0], e(node[1]))}, holder)
        if kind == "def":
            name, params, body = node[1]
            return self.expr(node[2], v, {**env, f"{name}/{len(params)}": (params, body)}, holder)
        if kind == "assign":
            return self.assigned(node, v, env, holder)
        if kind == "reduce":
            return self.row_reduce(node, v, env, holder)
        if kind == "call":
            return self.called(node[1], node[2], v, env, holder)
        raise Unsupported(kind)

    def is_path(self, node: Node) -> bool:
        """Whether a node only looks up members of typed columns, which cannot fail."""
        return node[0] in ("identity", "var") or node[0] == "index" and node[2][0] == "literal" and self.is_path(node[1])

    def key_text(self, k: Node) -> str:
        if k[0] != "literal":
            raise Unsupported("a key that isn't a literal")
        return k[1]

    def array(self, node: Node, v: Val, env: dict, holder) -> Val:
        parts = self.commas(node)
        if len(parts) == 1 and parts[0][0] in ("each", "pipe", "index"):
            steps = [step for whole in _steps(parts[0]) for step in _unfolded(whole)]
            at = next((k for k, step in enumerate(steps) if step[0] == "each"), None)
            if at is not None:
                base = self.expr(_piped([*steps[:at], steps[at][1]]), v, env, holder)
                return self.transformed(base, _piped(steps[at + 1 :]), env)
        if len(parts) == 1 and (found := self.matches(parts[0], v, env, holder)) is not None:
            return found
        vals = [self.expr(p, v, env, holder) for p in parts]
        out = Val(F.array(*[x.column for x in vals]) if len({kind_of(x.type) for x in vals}) == 1 else None, T.ArrayType(vals[0].type))
        out.items = vals
        return out

    def matches(self, node: Node, v: Val, env: dict, holder) -> Val | None:
        """All outputs of scan and splits as an array, where these are the last step."""
        if node[0] == "pipe":
            inner = self.matches(node[2], self.expr(node[1], v, env, holder), env, holder) if node[2][0] in ("call", "pipe") else None
            return inner
        if node[0] != "call" or node[1] not in ("scan", "splits") or len(node[2]) != 1 or node[2][0][0] != "literal":
            return None
        pattern = node[2][0][1]
        if not isinstance(v.type, T.StringType) or not isinstance(pattern, str):
            raise Unsupported("a string required")
        if node[1] == "splits":
            return Val(F.split(v.column, pattern, -1), T.ArrayType(TEXT))
        if GROUP.search(pattern):
            raise Unsupported("matches with groups")
        return Val(F.regexp_extract_all(v.column, F.lit(pattern), F.lit(0)), T.ArrayType(TEXT))

    def transformed(self, base: Val, node: Node, env: dict) -> Val:
        """Each element of an array column, through steps with one output or none."""
        if not isinstance(base.type, T.ArrayType):
            raise Unsupported("iteration over this kind")
        if node == ("identity",):
            return base
        first, rest = self.split(node)
        if first[0] == "call" and first[1] == "select":
            kept = F.filter(base.column, lambda x: truthy(self.expr(first[2][0], Val(x, base.type.elementType), env, None)))
            return self.transformed(Val(kept, base.type), rest, env)
        kind: list[T.DataType] = []

        def one(x: Column) -> Column:
            out = self.expr(first, Val(x, base.type.elementType), env, None)
            kind.append(out.type)
            return out.column

        mapped = F.transform(base.column, one)
        return self.transformed(Val(mapped, T.ArrayType(kind[0])), rest, env)

    def row_reduce(self, node: Node, v: Val, env: dict, holder) -> Val:
        """reduce over an array column: an aggregate() of the row."""
        _, source, patterns, start, update = node
        first, rest = self.split(source)
        if first[0] != "each" or len(patterns) != 1:
            raise Unsupported("this reduce")
        base = self.transformed(self.expr(first[1], v, env, holder), rest, env)
        init = self.expr(start, v, env, holder)
        t = DOUBLE if init.numeric and isinstance(base.type.elementType, T.DoubleType) else init.type

        def step(s: Column, x: Column) -> Column:
            out = self.expr(update, Val(s, t), {**env, **self.names(patterns[0], Val(x, base.type.elementType))}, None)
            return out.column.cast(t)

        return Val(F.aggregate(base.column, init.column.cast(t), step), t)

    def assigned(self, node: Node, v: Val, env: dict, holder) -> Val:
        _, op, target, value = node
        path = []
        while target[0] == "index" and target[2][0] == "literal":
            path.append(target[2][1])
            target = target[1]
        if target != ("identity",) or not path:
            raise Unsupported("this target")

        def put(base: Val, keys: list) -> Val:
            if not keys:
                if op == "|=":
                    return self.expr(value, base, env, holder)
                new = self.expr(value, v, env, holder)
                if op == "=":
                    return new
                if op == "//=":
                    return Val(F.coalesce(F.when(truthy(base), base.column), new.column), new.type)
                return arithmetic_of(op[:-1], base, new)
            if base.fields is None:
                raise Unsupported("assignment here")
            return obj({**base.fields, keys[0]: put(base.fields.get(keys[0], lit(None)), keys[1:])})

        return put(v, path[::-1])

    def called(self, name: str, args: tuple, v: Val, env: dict, holder) -> Val:
        if f"{name}/{len(args)}" in env:
            params, body = env[f"{name}/{len(args)}"]
            inner = dict(env)
            for p, a in zip(params, args, strict=True):
                if p.startswith("$"):
                    inner[p[1:]] = self.expr(a, v, env, holder)
                else:
                    inner[f"{p}/0"] = ((), a)
            return self.expr(body, v, inner, holder)
        if not args and name in PLAIN:
            return PLAIN[name](v)
        if (name, len(args)) in WITH:
            if name == "gsub" and args[1][0] != "literal":
                raise Unsupported("a replacement that isn't a literal")
            return WITH[name, len(args)](v, *[self.expr(a, v, env, holder) for a in args])
        if name == "map" and isinstance(v.type, T.ArrayType):
            return self.transformed(v, args[0], env)
        if name in ("any", "all") and isinstance(v.type, T.ArrayType) and len(args) <= 1:
            test = args[0] if args else ("identity",)
            over = F.exists if name == "any" else F.forall
            return Val(over(v.column, lambda x: truthy(self.expr(test, Val(x, v.type.elementType), env, None))), BOOL)
        if name == "sort_by" and isinstance(v.type, T.ArrayType):
            pairs = F.transform(v.column, lambda x, i: F.struct(order_key(self.expr(args[0], Val(x, v.type.elementType), env, None)).alias("k"), i.alias("i"), x.alias("x")))
            return Val(F.transform(F.array_sort(pairs), lambda s: s["x"]), v.type)
        if name == "format" and args[0][0] == "literal":
            return Val(formatted(args[0][1], v), TEXT)
        if name == "del" and args[0][0] == "index" and args[0][1] == ("identity",) and v.fields:
            return obj({k: x for k, x in v.fields.items() if k != args[0][2][1]})
        if name == "pick" and v.fields:
            return obj({p[2][1]: self.member(v, p[2][1]) for p in self.commas(args[0])})
        if name == "to_entries" and v.fields:
            if len({kind_of(x.type) for x in v.fields.values()}) > 1:
                raise Unsupported("entries of different kinds")
            t = next(iter(v.fields.values())).type
            return Val(F.array(*[F.struct(F.lit(k).alias("key"), x.column.alias("value")) for k, x in v.fields.items()]), T.ArrayType(T.StructType([T.StructField("key", TEXT), T.StructField("value", t)])))
        if name == "with_entries" and v.fields and args[0][0] == "assign" and args[0][1] == "|=" and args[0][2] == ("index", ("identity",), ("literal", "value")):
            return obj({k: self.expr(args[0][3], x, env, holder) for k, x in v.fields.items()})
        if name == "map_values" and v.fields:
            return obj({k: self.expr(args[0], x, env, holder) for k, x in v.fields.items()})
        if name == "getpath" and args[0][0] == "collect":
            for p in self.commas(args[0][1]):
                v = self.member(v, p[1])
            return v
        if name == "IN" and len(args) == 1:
            vals = [self.expr(p, v, env, holder) for p in self.commas(args[0])]
            return Val(reduce(lambda a, b: a | b, [v.column.eqNullSafe(x.column) for x in vals]), BOOL)
        if name == "range" and len(args) == 1:
            raise Unsupported("a stream here")
        raise Unsupported(f"{name}/{len(args)}")

    # -- results ----------------------------------------------------------------------------------------------------
    def plain(self, r: Rows) -> DataFrame:
        if r.elem.fields is not None:
            return r.df.select(*[v.column.alias(k) for k, v in r.elem.fields.items()])
        return r.df.select(r.elem.column.alias("value"))

    def result(self, out, sort: bool = False) -> DataFrame:
        if isinstance(out, Tally):
            return out.rows.df.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("value"))
        if isinstance(out, Single):
            fields = out.val.fields
            return out.df.select(*[v.column.alias(k) for k, v in fields.items()]) if fields else out.df.select(out.val.column.alias("value"))
        if isinstance(out, Rows):
            r = self.settled(out)
            if sort and r.order:
                r = replace(r, df=r.df.orderBy(*[Sorted.column(o) for o in r.order]))
            return self.plain(r)
        raise Unsupported("this result")


class Sorted:
    """A key of an order, that can be turned around."""

    def __init__(self, val: Val, descending: bool = False):
        self.val, self.descending = val, descending

    @staticmethod
    def column(o) -> Column:
        if isinstance(o, Sorted):
            k = order_key(o.val)
            return k.desc() if o.descending else k.asc()
        return o

    @staticmethod
    def key(o) -> Column:
        if isinstance(o, Sorted):
            if o.descending:
                raise Unsupported("a reversed order here")
            return order_key(o.val)
        return o


class Reverse:
    @staticmethod
    def of(o):
        return Sorted(o.val, not o.descending) if isinstance(o, Sorted) else o.desc()


def arithmetic_of(op: str, a: Val, b: Val) -> Val:
    return add(a, b) if op == "+" else arithmetic(op, a, b)


def _stat(f, t=DOUBLE):
    def run(val: Val, kept: Column | None, *extra) -> Val:
        c = val.column.cast("double")
        return Val(f(F.when(kept, c) if kept is not None else c, *extra), t)

    return run


#: Window functions of programs: what each is over a frame, and of which kind.
MOVING = ("windows", "moving_sum", "moving_avg", "moving_min", "moving_max")
WINDOWS = {
    "windows": lambda v, w: (F.collect_list(v.column).over(w), T.ArrayType(v.type)), "moving_sum": lambda v, w: (F.sum(v.column).over(w), DOUBLE if v.float else LONG), "moving_avg": lambda v, w: (F.sum(v.column.cast("double")).over(w) / F.count(F.lit(1)).over(w), DOUBLE),
    "moving_min": lambda v, w: (F.min(v.column).over(w), v.type), "moving_max": lambda v, w: (F.max(v.column).over(w), v.type), "lag": lambda v, w: (F.lag(v.column).over(w), v.type),
    "deltas": lambda v, w: (v.column - F.lag(v.column).over(w), v.type), "counter": lambda v, w: (F.row_number().over(w).cast("long"), LONG),
}

#: Statistics over arrays, as aggregates.
STATS = {
    "sum": _stat(F.sum), "avg": _stat(F.avg), "median": _stat(F.median), "stddev": _stat(F.stddev_pop), "variance": _stat(F.var_pop), "quantile": _stat(lambda c, q: F.percentile(c, float(q))),
    "count": lambda val, kept: Val(F.count_if(kept) if kept is not None else F.count(F.lit(1)), LONG),
}

__all__ = ["Compiler", "Unsupported", "compile_program", "sort_columns"]


def _steps(node: Node) -> list[Node]:
    return [*_steps(node[1]), *_steps(node[2])] if node[0] == "pipe" else [node]


def _piped(steps: list[Node]) -> Node:
    return reduce(lambda a, b: ("pipe", a, b), steps) if steps else ("identity",)


def _lane(compiler: Compiler, tree: Node, at, schema: str, on_error: str, arguments: dict) -> DataFrame:
    """The longest beginning of a program that has a plan, and the rest by the evaluator on each record or group."""
    from docsluice.plans.records import over_groups, over_records

    definitions = []
    while tree[0] == "def":
        definitions.append(tree[1])
        tree = tree[2]
    steps = _steps(tree)
    # an iteration inside a path, as in .[].a, is a step of its own
    steps = [part for s in steps for part in _unfolded(s)]
    env = _constants(arguments) | {f"{name}/{len(params)}": (params, body) for name, params, body in definitions}

    def whole(body: Node) -> Node:
        """A rest of the program with the definitions and arguments that it can name."""
        for d in reversed(definitions):
            body = ("def", d, body)
        for name, value in arguments.items():
            body = ("bind", ("literal", value), [("name", name)], body)
        return body

    def rest_of(cut: int) -> Node:
        return whole(_piped(steps[cut:]))

    for cut in range(len(steps) - 1, 0, -1):
        if any(compiler.has_var(s) for s in steps[cut:]):
            continue
        try:
            out = compiler.run(_piped(steps[:cut]), at, env)
        except Unsupported:
            continue
        if isinstance(out, Rows) and not out.table:
            r = compiler.settled(out)
            return over_records(compiler.plain(r), rest_of(cut), schema, on_error, None if r.elem.fields is not None else "value", dealt=True)
        first = steps[cut]
        each = first == ("each", ("identity",))
        if isinstance(out, Groups) and not out.stream and (each or first[0] == "call" and first[1] == "map"):
            plain = out.rows.elem.fields
            names = {k: n for k in range(len(out.keys)) for n, v in (plain or {}).items() if v is out.keys[k]}
            order = [next((n for n, v in (plain or {}).items() if v.column is o or str(v.column) == str(o)), None) for o in out.rows.order]
            if plain is None or len(names) < len(out.keys) or None in order:
                raise Unsupported("groups by what is no column, or in another order")
            inside = rest_of(cut + 1) if each else whole(("pipe", first[2][0], _piped(steps[cut + 2 :])))
            if not each and steps[cut + 1 : cut + 2] != [("each", ("identity",))]:
                raise Unsupported("groups as one value")
            return over_groups(compiler.plain(out.rows), list(names.values()), order, inside, schema, on_error)
    raise Unsupported("no records to run this on")


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """A plan's columns in the types of a schema: numbers that do not fit are null, as they are from the evaluator."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

    def fitted(c: Column, given: T.DataType, t: T.DataType) -> Column:
        if given == t or isinstance(given, T.NullType):
            return c if given == t else c.cast(t)
        if isinstance(given, whole) and isinstance(t, (T.LongType, T.DoubleType)):
            return c.cast(t)
        if isinstance(given, (T.FloatType, T.DoubleType)) and isinstance(t, T.LongType):
            return F.when((c == F.floor(c)) & (F.abs(c) < float(1 << 63)), c.cast("long"))
        if isinstance(given, T.ArrayType) and isinstance(t, T.ArrayType):
            return c.cast(t) if given.elementType == t.elementType else F.transform(c, lambda x: fitted(x, given.elementType, t.elementType))
        raise Unsupported(f"{given.simpleString()} as {t.simpleString()}")

    given = {f.name: f.dataType for f in df.schema.fields}
    wanted = T._parse_datatype_string(schema).fields
    return df.select(*[(fitted(F.col(f"`{f.name}`"), given[f.name], f.dataType) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def _constants(arguments: dict) -> dict[str, Val]:
    """The arguments that are single values, as columns."""
    out = {k: lit(v) for k, v in arguments.items() if v is None or isinstance(v, (bool, int, float, str))}
    for k, v in out.items():
        v.literal = arguments[k]
    return out


def _unfolded(step: Node) -> list[Node]:
    """.[].a.b as .[] | .a.b"""
    path, of = [], step
    while of[0] == "index" and of[2][0] == "literal":
        path.append(of[2])
        of = of[1]
    if of[0] == "each" and path:
        return [of, reduce(lambda base, k: ("index", base, k), reversed(path), ("identity",))]
    return [step]


def compile_program(
    text: str, main: DataFrame | None = None, order: list[str] | None = None, sort: bool = False, tables: dict[str, DataFrame] | None = None, table_orders: dict[str, list[str]] | None = None,
    schema: str | None = None, on_error: str = "raise", finite: bool = False, arguments: dict | None = None,
) -> DataFrame:
    """The outputs of a program over tables, as a DataFrame: an object's members are its columns, anything else is `value`.

    `order` names the columns that put the main table in order, where the program depends on one; `table_orders`
    likewise for the other tables, which `tables` holds by name. With sort, the result is sorted as the program's output is; else its rows come as they do.
    Where a program has no plan, the evaluator runs what is left of it on each record, or on the records of each
    group, and its outputs become rows of `schema` (columns in DDL); without a schema that raises Unsupported.
    `arguments` are values that the program names as variables.
    `on_error` says what becomes of a record that it fails on: `raise`, `skip`, or `report` in a column `error`.
    Where the main table is a stream, what needs all of its records raises Unsupported.
    `finite` says that no column holds NaN, so that filters of doubles by `<` reach the scan too.
    """
    tables = tables or {}
    compiler = Compiler(tables, table_orders, finite, main is not None and main.isStreaming)
    at = rows_of(main, order) if main is not None else Rows(next(iter(tables.values())).limit(0), lit(None))
    tree = parse(text)
    if schema is None or on_error == "raise":
        try:
            out = compiler.result(compiler.run(tree, at, _constants(arguments or {})), sort)
            return out if schema is None else _typed(out, schema)
        except Unsupported:
            if schema is None:
                raise
    return _lane(compiler, tree, at, schema, on_error, arguments or {})
