"""Control, kinds, generators, paths, streams of events, and what a run has besides its input."""

from __future__ import annotations

import math
import os
import re
import sys
from decimal import Decimal

from docsluice.functions import define, names, steps, values
from docsluice.lang import evaluate as ev
from docsluice.lang.values import Raised, as_float, described, dumps, is_nan, kind, loads, order_key, truthy


def mark(path):
    return None if path is None else (ev._NOWHERE,)


@steps("empty")
def _(env, v, path):
    return iter(())


@steps("not")
def _(env, v, path):
    yield not truthy(v), mark(path)


@steps("error")
def _(env, v, path):
    raise Raised(v)
    yield


@steps("error", arity=1)
def _(env, v, path, f):
    for x, _ in f(env, v, None):
        raise Raised(x)
        yield


values("type")(kind)
values("tag")(lambda v: None)
values("have_decnum", "have_literal_numbers")(lambda v: True)
values("builtins")(lambda v: names())


@values("length")
def length(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        raise Raised(f"{described(v)} has no length")
    if kind(v) == "number":
        return abs(v)
    if isinstance(v, (str, list, dict, bytes)):
        return len(v)
    raise Raised(f"{described(v)} has no length")


@values("keys")
def keys(v):
    if isinstance(v, dict):
        return sorted(v)
    if isinstance(v, list):
        return list(range(len(v)))
    raise Raised(f"{described(v)} has no keys")


@values("keys_unsorted")
def keys_unsorted(v):
    return list(v) if isinstance(v, dict) else keys(v)


def _only(name, test):
    @steps(name)
    def run(env, v, path):
        if test(v):
            yield v, path


for _name, _test in {
    "booleans": lambda v: isinstance(v, bool), "numbers": lambda v: kind(v) == "number", "strings": lambda v: isinstance(v, str), "arrays": lambda v: isinstance(v, list),
    "objects": lambda v: isinstance(v, dict), "iterables": lambda v: isinstance(v, (list, dict)), "scalars": lambda v: not isinstance(v, (list, dict)),
    "values": lambda v: v is not None, "nulls": lambda v: v is None, "finites": lambda v: kind(v) == "number" and not (math.isinf(v) or is_nan(v)),
    "normals": lambda v: kind(v) == "number" and normal(v),
}.items():
    _only(_name, _test)


def normal(v) -> bool:
    f = as_float(v)
    return math.isfinite(f) and abs(f) >= sys.float_info.min


@steps("select", arity=1)
def _(env, v, path, f):
    for x, _ in f(env, v, None):
        if truthy(x):
            yield v, path


@steps("recurse")
def recurse(env, v, path):
    yield v, path
    if isinstance(v, (list, dict)):
        for k, x in ev.children(v):
            yield from recurse(env, x, None if path is None else (*path, k))


@steps("recurse", arity=1)
def recurse_by(env, v, path, f):
    yield v, path
    for x, p in f(env, v, path):
        yield from recurse_by(env, x, p, f)


@steps("recurse", arity=2)
def recurse_while(env, v, path, f, test):
    yield v, path
    for x, p in f(env, v, path):
        for t, _ in test(env, x, None):
            if truthy(t):
                yield from recurse_while(env, x, p, f, test)


@steps("range", arity=1)
def _(env, v, path, f):
    for n, _ in f(env, v, None):
        for x in ranged(0, n, 1):
            yield x, mark(path)


def ranged(a, b, by):
    if any(kind(x) != "number" for x in (a, b, by)):
        raise Raised("Range bounds must be numeric")
    if is_nan(b) or is_nan(a):
        return
    while (a < b if by > 0 else a > b) if by != 0 else False:
        yield a
        a = ev.binary("+", a, by)


@steps("range", arity=2)
def _(env, v, path, f, g):
    for a, _ in f(env, v, None):
        for b, _ in g(env, v, None):
            for x in ranged(a, b, 1):
                yield x, mark(path)


@steps("range", arity=3)
def _(env, v, path, f, g, h):
    for a, _ in f(env, v, None):
        for b, _ in g(env, v, None):
            for s, _ in h(env, v, None):
                for x in ranged(a, b, s):
                    yield x, mark(path)


@steps("first", arity=1)
def _(env, v, path, f):
    for out in f(env, v, path):
        yield out
        return


@steps("last", arity=1)
def _(env, v, path, f):
    out = None
    for out in f(env, v, path):  # noqa: B007
        pass
    if out is not None:
        yield out


def counted(n, what):
    if kind(n) != "number":
        raise Raised(f"{what} count must be a number")
    if n < 0:
        raise Raised(f"{what} doesn't support negative count")
    return math.ceil(n)


@steps("limit", arity=2)
def _(env, v, path, n, f):
    for count, _ in n(env, v, None):
        left = counted(count, "limit")
        if left:
            for out in f(env, v, path):
                yield out
                left -= 1
                if not left:
                    break


@steps("skip", arity=2)
def _(env, v, path, n, f):
    for count, _ in n(env, v, None):
        left = counted(count, "skip")
        for out in f(env, v, path):
            if left:
                left -= 1
            else:
                yield out


@steps("nth", arity=1)
def _(env, v, path, n):
    for k, _ in n(env, v, None):
        yield ev.step(v, path, k)


@steps("nth", arity=2)
def _(env, v, path, n, f):
    for count, _ in n(env, v, None):
        left = counted(count, "nth")
        for out in f(env, v, path):
            if not left:
                yield out
                break
            left -= 1


@steps("isempty", arity=1)
def _(env, v, path, f):
    yield next(iter(f(env, v, None)), None) is None, mark(path)


@steps("repeat", arity=1)
def _(env, v, path, f):
    while True:
        yield from f(env, v, path)


def _descended(level, v, path):
    """Outputs of a step that goes on from what it makes, the deepest first; no recursion, however deep it gets."""
    waiting = [level(v, path)]
    while waiting:
        found = next(waiting[-1], None)
        if found is None:
            waiting.pop()
        elif found[0]:
            yield found[1:]
        else:
            waiting.append(level(*found[1:]))


@steps("while", arity=2)
def _(env, v, path, c, u):
    def level(x, p):
        for t, _ in c(env, x, None):
            if truthy(t):
                yield True, x, p
                for y, q in u(env, x, p):
                    yield False, y, q

    yield from _descended(level, v, path)


@steps("until", arity=2)
def _(env, v, path, c, u):
    def level(x, p):
        for t, _ in c(env, x, None):
            if truthy(t):
                yield True, x, p
            else:
                for y, q in u(env, x, p):
                    yield False, y, q

    yield from _descended(level, v, path)


@steps("debug")
def _(env, v, path):
    env.run.said.append(["DEBUG:", v])
    yield v, path


@steps("debug", arity=1)
def _(env, v, path, f):
    for x, _ in f(env, v, None):
        env.run.said.append(["DEBUG:", x])
    yield v, path


@steps("stderr")
def _(env, v, path):
    env.run.said.append(v)
    yield v, path


@steps("input")
def _(env, v, path):
    for x in env.run.inputs:
        env.run.line += 1
        yield x, mark(path)
        return
    raise Raised("No more inputs")


@steps("inputs")
def _(env, v, path):
    for x in env.run.inputs:
        env.run.line += 1
        yield x, mark(path)


@steps("input_filename")
def _(env, v, path):
    yield env.run.filename, mark(path)


@steps("input_line_number")
def _(env, v, path):
    yield env.run.line, mark(path)


values("env")(lambda v: dict(os.environ))
values("get_search_list")(lambda v: [])
values("get_prog_origin", "get_jq_origin")(lambda v: None)


@values("modulemeta")
def _(v):
    raise Raised("modulemeta needs a search path")


@steps("halt")
def _(env, v, path):
    raise ev.Halt(None, 0)
    yield


@steps("halt_error")
def _(env, v, path):
    raise ev.Halt(v, 5)
    yield


@steps("halt_error", arity=1)
def _(env, v, path, f):
    for x, _ in f(env, v, None):
        if kind(x) != "number":
            raise Raised("halt_error/1: number required")
        raise ev.Halt(v, int(x))
        yield


# -- paths --------------------------------------------------------------------------------------------------------


@steps("path", arity=1)
def _(env, v, path, f):
    for x, p in f(env, v, ()):
        if p[:1] == (ev._NOWHERE,):
            raise Raised(f"Invalid path expression with result {ev.short(x)}")
        yield list(p), mark(path)


def every_path(v, so_far=()):
    for k, x in ev.children(v) if isinstance(v, (list, dict)) else ():
        yield [*so_far, k], x
        yield from every_path(x, (*so_far, k))


@steps("paths")
def _(env, v, path):
    for p, _ in every_path(v):
        yield p, mark(path)


@steps("paths", arity=1)
def _(env, v, path, f):
    for p, x in every_path(v):
        for t, _ in f(env, x, None):
            if truthy(t):
                yield p, mark(path)


@steps("getpath", arity=1)
def _(env, v, path, f):
    for p, _ in f(env, v, None):
        if not isinstance(p, list):
            raise Raised("Path must be specified as an array")
        try:
            found = ev.at_path(v, p)
        except Raised:
            if path is None:
                raise
            found = None
        yield found, None if path is None else (*path, *p)


@values("setpath", arity=2)
def _(v, p, x):
    if not isinstance(p, list):
        raise Raised("Path must be specified as an array")
    return ev.put(v, p, x)


@values("delpaths", arity=1)
def delpaths(v, ps):
    if not isinstance(ps, list) or not all(isinstance(p, list) for p in ps):
        raise Raised("Paths must be specified as an array")
    return ev.without(v, ps)


@steps("del", arity=1)
def _(env, v, path, f):
    yield ev.without(v, [list(p) for _, p in f(env, v, ())]), mark(path)


@steps("pick", arity=1)
def _(env, v, path, f):
    out = None
    for _, p in f(env, v, ()):
        out = ev.put(out, p, ev.at_path(v, p))
    yield out, mark(path)


# -- events -------------------------------------------------------------------------------------------------------


def events(v, path=(), top=True):
    if isinstance(v, (list, dict)) and v:
        last = None
        for k, x in ev.children(v):
            yield from events(x, (*path, k), False)
            last = k
        yield [[*path, last]]
    else:
        yield [list(path), v]


@steps("tostream")
def _(env, v, path):
    for e in events(v):
        yield e, mark(path)


@steps("fromstream", arity=1)
def _(env, v, path, f):
    state, some = None, False
    for e, _ in f(env, v, None):
        at = e[0]
        if len(e) == 2:
            state, some = ev.put(state, at, e[1]), True
            done = not at
        else:
            done = len(at) == 1
        if done and some:
            yield state, mark(path)
            state, some = None, False


@steps("truncate_stream", arity=1)
def _(env, v, path, f):
    for e, _ in f(env, v, None):
        if len(e[0]) > v:
            yield [e[0][int(v) :], *e[1:]], mark(path)


@values("tojson")
def _(v):
    return dumps(v)


@values("fromjson")
def _(v):
    if not isinstance(v, str):
        raise Raised(f"{described(v)} cannot be parsed as JSON")
    try:
        text = v.strip()
        if text.lower() in ("nan", "-nan"):
            return math.nan
        return loads(text)
    except ValueError as e:
        if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?", text):  # numbers may have a plus and zeros ahead
            return int(text) if re.fullmatch(r"[+-]?\d+", text) else Decimal(text)
        raise Raised(f"{e} (while parsing '{v}')") from None


@values("json_facts")
def _(v):
    return v


@steps("INDEX", arity=1)
def _(env, v, path, f):
    yield from _index(env, path, ((x, v) for _, x in ev.children(v)), f)


@steps("INDEX", arity=2)
def _(env, v, path, source, f):
    yield from _index(env, path, ((x, v) for x, _ in source(env, v, None)), f)


def _index(env, path, rows, f):
    from docsluice.lang.values import to_text

    out = {}
    for x, _ in rows:
        for k, _ in f(env, x, None):
            out[to_text(k)] = x
    yield out, mark(path)


@steps("declare_index", arity=2)
def _(env, v, path, f, g):
    yield v, path


@values("has", arity=1)
def has(v, k):
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and kind(k) == "number":
        return not is_nan(k) and 0 <= k < len(v)
    raise Raised(f"Cannot check whether {kind(v)} has a {'string' if isinstance(k, str) else kind(k)} key")


@values("in", arity=1)
def _(v, c):
    return has(c, v)


@steps("IN", arity=1)
def _(env, v, path, f):
    me = order_key(v)
    yield (not is_nan(v) and any(order_key(x) == me for x, _ in f(env, v, None))), mark(path)


@steps("IN", arity=2)
def _(env, v, path, source, f):
    yield any(not is_nan(x) and any(order_key(y) == order_key(x) for y, _ in f(env, v, None)) for x, _ in source(env, v, None)), mark(path)


define(
    """
    def map(f): [.[] | f];
    def map_values(f): .[] |= f;
    def to_entries: [keys_unsorted[] as $k | {key: $k, value: .[$k]}];
    def from_entries: reduce .[] as $e ({};
        . + {($e | if type == "object" then (if has("key") then .key elif has("k") then .k elif has("name") then .name elif has("Name") then .Name elif has("Key") then .Key elif has("K") then .K else null end) else .[0] end
            | if type == "string" then . elif type == "null" then "null" else tojson end):
          ($e | if type == "object" then (if has("value") then .value elif has("v") then .v elif has("Value") then .Value elif has("V") then .V else null end) else .[1] end)});
    def with_entries(f): to_entries | map(f) | from_entries;
    def walk(f): def w: if type == "object" then map_values(w) elif type == "array" then map(w) else . end | f; w;
    def all(g; c): isempty(first(g | c | select(. | not)));
    def any(g; c): isempty(first(g | c | select(.))) | not;
    def all(c): all(.[]; c);
    def any(c): any(.[]; c);
    def all: all(.[]; .);
    def any: any(.[]; .);
    def first: .[0];
    def last: .[-1];
    def combinations: if length == 0 then [] else .[0][] as $x | (.[1:] | combinations) as $w | [$x] + $w end;
    def combinations(n): . as $d | [range(n)] | map($d) | combinations;
    def todate: todateiso8601;
    def JOIN($idx; f): [.[] | [., $idx[f | tostring]]];
    def JOIN($idx; s; f): s | [., $idx[f | tostring]];
    def JOIN($idx; s; f; j): s | [., $idx[f | tostring]] | j;
    def windows($n; f): foreach f as $x ([]; (. + [$x])[-$n:]; .);
    def moving_sum($n; f): windows($n; f) | add;
    def moving_avg($n; f): windows($n; f) | add / length;
    def moving_min($n; f): windows($n; f) | min;
    def moving_max($n; f): windows($n; f) | max;
    def ewma($a; f): foreach f as $x (null; if . == null then $x else $a * $x + (1 - $a) * . end; .);
    def deltas(f): foreach f as $x ([null, null]; [.[1], $x]; select(.[0] != null) | .[1] - .[0]);
    def lag(f): foreach f as $x ({n: 0}; {n: (.n + 1), was: .now, now: $x}; select(.n > 1) | .was);
    def running(f; g): foreach g as $x (null; f; .);
    def counter(f): foreach f as $x (0; . + 1; .);
    def fromdate: fromdateiso8601;
    """
)
