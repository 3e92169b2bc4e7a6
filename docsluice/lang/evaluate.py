"""Running a program on one value: every node becomes a function from a value to the stream of its outputs.

An output is a pair (value, path); path is a tuple of steps while a path is being followed, else None.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import cached_property
from typing import Any

from docsluice.lang.parser import Node, parse, parse_module
from docsluice.lang.values import Raised, binary, described, dumps, is_nan, kind, number_text, to_text, truthy, whole

Out = Iterator[tuple[Any, tuple | None]]
Step = Callable[["Env", Any, tuple | None], Out]


class Break(Exception):
    def __init__(self, label: object):
        self.label = label


class Halt(Exception):
    def __init__(self, value: Any, status: int):
        self.value, self.status = value, status


class Env:
    """Names in scope: variables, definitions, labels; and the run they belong to."""

    __slots__ = ("names", "up", "run")

    def __init__(self, names: dict, up: Env | None, run: Run):
        self.names, self.up, self.run = names, up, run

    def find(self, name: str) -> Any:
        e: Env | None = self
        while e is not None:
            if name in e.names:
                return e.names[name]
            e = e.up
        raise KeyError(name)


class Run:
    """What a run has besides its input: further inputs, the name of its file, its random numbers, what it says."""

    def __init__(self, inputs: Iterator | None = None, filename: str | None = None, seed: int | None = None, arguments: dict | None = None):
        self.inputs, self.filename, self.seed, self.said = inputs or iter(()), filename, seed, []
        self.arguments, self.line = arguments or {}, 0

    @cached_property
    def random(self):
        """Made when it is first asked for: most records of a table ask for none."""
        from docsluice.functions.stats import Xoshiro

        return Xoshiro(self.seed)


def number_index(v: Any, i: Any) -> Any:
    if is_nan(i):
        return None
    import math

    at = math.floor(i) if not isinstance(i, int) else i
    if at < 0:
        at += len(v)
    return v[at] if 0 <= at < len(v) else None


def bounds(v: Any, start: Any, end: Any) -> tuple[int, int]:
    import math

    n = len(v)
    for b in (start, end):
        if b is not None and kind(b) != "number":
            raise Raised("Start and end indices of an array slice must be numbers")
    fix = lambda x: max(0, min(n, x + n if x < 0 else x))
    a = 0 if start is None else fix(math.floor(start) if not is_nan(start) else 0)
    b = n if end is None else fix(math.ceil(end) if not is_nan(end) else n)
    return a, max(a, b)


def look(v: Any, key: Any) -> Any:
    """v at a key, an index or a slice."""
    if isinstance(key, str):
        if isinstance(v, dict):
            return v.get(key)
        if v is None:
            return None
    elif isinstance(key, dict):
        return cut(v, key.get("start"), key.get("end"))
    elif kind(key) == "number":
        if isinstance(v, list):
            return number_index(v, key)
        if v is None:
            return None
    elif isinstance(key, list) and isinstance(v, list):
        from docsluice.functions.text import positions

        return positions(v, key)
    elif key is None and v is None:
        return None
    if isinstance(key, str):
        raise Raised(f'Cannot index {kind(v)} with "{key}"')
    raise Raised(f"Cannot index {kind(v)} with {kind(key)}" + (f" ({dumps(key)})" if False else ""))


def cut(v: Any, start: Any, end: Any) -> Any:
    if v is None:
        return None
    if not isinstance(v, (list, str)):
        raise Raised(f"Cannot index {kind(v)} with object")
    a, b = bounds(v, start, end)
    return v[a:b]


def children(v: Any) -> Iterator[tuple[Any, Any]]:
    if isinstance(v, list):
        return iter(list(enumerate(v)))
    if isinstance(v, dict):
        return iter(list(v.items()))
    raise Raised(f"Cannot iterate over {kind(v)}" + (f" ({short(v)})" if v is not None else ""))


def short(v: Any) -> str:
    text = dumps(v)
    return text if len(text) < 12 else text[:10] + "..."


def put(v: Any, path: tuple | list, new: Any) -> Any:
    """v with `new` at a path; what is missing is made."""
    if not path:
        return new
    return changed(v, path, lambda _: new)


def changed(v: Any, path: tuple | list, to: Callable[[Any], Any]) -> Any:
    if not path:
        return to(v)
    key, rest = path[0], path[1:]
    if isinstance(key, str):
        if v is not None and not isinstance(v, dict):
            raise Raised(f'Cannot index {kind(v)} with "{key}"')
        out = dict(v or {})
        out[key] = changed(out.get(key), rest, to)
        return out
    if isinstance(key, dict):
        if v is not None and not isinstance(v, list):
            raise Raised("Cannot update field at object index of " + kind(v))
        base = v or []
        a, b = bounds(base, key.get("start"), key.get("end"))
        part = changed(base[a:b] if v is not None else None, rest, to)
        if not isinstance(part, list):
            raise Raised("A slice of an array can only be assigned another array")
        return base[:a] + part + base[b:]
    if kind(key) == "number":
        if v is not None and not isinstance(v, list):
            raise Raised(f"Cannot index {kind(v)} with number")
        out = list(v or [])
        at = whole(key)
        if at < 0:
            if at + len(out) < 0:
                raise Raised("Out of bounds negative array index")
            at += len(out)
        if at > 536870911:
            raise Raised("Array index too large")
        out.extend([None] * (at + 1 - len(out)))
        out[at] = changed(out[at], rest, to)
        return out
    raise Raised(f"Invalid path component {short(key)}")


def at_path(v: Any, path: list | tuple) -> Any:
    for k in path:
        if v is None:
            return None
        v = look(v, k)
    return v


def without(v: Any, paths: list) -> Any:
    """v without the paths, all taken at once: the last goes first, so that none moves another."""
    from docsluice.lang.values import order_key

    # what lies below a path that goes, goes with it
    paths = [p for p in paths if not any(len(q) < len(p) and list(p[: len(q)]) == list(q) for q in paths)]
    for p in sorted(paths, key=order_key, reverse=True):
        v = _without(v, p)
    return v


def _without(v: Any, path: list | tuple) -> Any:
    if not path:
        return None
    if v is None:
        return None
    key, rest = path[0], path[1:]
    if rest:
        inner = look(v, key)
        return v if inner is None else changed(v, [key], lambda x: _without(x, rest))
    if isinstance(key, str) and isinstance(v, dict):
        return {k: x for k, x in v.items() if k != key}
    if isinstance(key, dict) and isinstance(v, list):
        a, b = bounds(v, key.get("start"), key.get("end"))
        return v[:a] + v[b:]
    if kind(key) == "number" and isinstance(v, list):
        at = whole(key)
        at = at + len(v) if at < 0 else at
        return v[:at] + v[at + 1 :] if 0 <= at < len(v) else v
    raise Raised(f"Cannot delete field at {'object' if isinstance(key, str) else 'array'} index of {kind(v)}")


# -- compiling ----------------------------------------------------------------------------------------------------


def need_path(path: tuple | None, v: Any) -> None:
    if path is not None:
        raise Raised(f"Invalid path expression with result {short(v)}")


def build(node: Node) -> Step:
    return _BUILD[node[0]](*node[1:])


def _identity() -> Step:
    def run(env, v, path):
        yield v, path

    return run


def constant(value: Any) -> Step:
    def run(env, v, path):
        yield value, None if path is None else (_NOWHERE,)

    return run


_NOWHERE = object()


def step(v: Any, path: tuple | None, key: Any) -> tuple[Any, tuple | None]:
    if path is not None and path[:1] == (_NOWHERE,):
        if v is None or True:
            raise Raised(f"Invalid path expression with result {short(v)}")
    return look(v, key), None if path is None else (*path, key)


def _index(of: Node, key: Node) -> Step:
    base, at = build(of), build(key)

    def run(env, v, path):
        for b, p in base(env, v, path):
            for k, _ in at(env, v, None):
                yield step(b, p, k)

    return run


def _slice(of: Node, start: Node | None, end: Node | None) -> Step:
    base = build(of)
    first, last = build(start or ("literal", None)), build(end or ("literal", None))

    def run(env, v, path):
        for b, p in base(env, v, path):
            for z, _ in last(env, v, None):
                for a, _ in first(env, v, None):
                    yield cut(b, a, z), None if p is None else (*p, {"start": a, "end": z})

    return run


def _each(of: Node) -> Step:
    base = build(of)

    def run(env, v, path):
        for b, p in base(env, v, path):
            if p is not None and p[:1] == (_NOWHERE,):
                raise Raised(f"Invalid path expression with result {short(b)}")
            if b is None and p is not None:
                continue
            for k, x in children(b):
                yield x, None if p is None else (*p, k)

    return run


def _fact(of: Node, name: str) -> Step:
    base = build(of)

    def run(env, v, path):
        for b, _ in base(env, v, None):
            yield (b.get(name) if name[0] == "@" and isinstance(b, dict) else b.get("@" + name[1:]) if isinstance(b, dict) else None), None

    return run


def _pipe(left: Node, right: Node) -> Step:
    a, b = build(left), build(right)

    def run(env, v, path):
        for x, p in a(env, v, path):
            yield from b(env, x, p)

    return run


def _comma(left: Node, right: Node) -> Step:
    a, b = build(left), build(right)

    def run(env, v, path):
        yield from a(env, v, path)
        yield from b(env, v, path)

    return run


def _collect(inner: Node | None) -> Step:
    if inner is None:
        return lambda env, v, path: constant([])(env, v, path)
    f = build(inner)

    def run(env, v, path):
        yield [x for x, _ in f(env, v, None)], None if path is None else (_NOWHERE,)

    return run


def _object(members: tuple) -> Step:
    built = [(build(k), build(x)) for k, x in members]

    def run(env, v, path):
        mark = None if path is None else (_NOWHERE,)

        def outputs(i):
            for k, _ in built[i][0](env, v, None):
                if not isinstance(k, str):
                    raise Raised(f"Object keys must be strings, not {described(k)}")
                for x, _ in built[i][1](env, v, None):
                    yield k, x

        if not built:
            yield {}, mark
            return
        # the members' outputs, the last varying fastest; each is asked for when the ones before it have theirs
        got: list = [None] * len(built)
        waiting = [outputs(0)]
        while waiting:
            i = len(waiting) - 1
            got[i] = next(waiting[i], None)
            if got[i] is None:
                waiting.pop()
            elif i + 1 < len(built):
                waiting.append(outputs(i + 1))
            else:
                yield dict(got), mark

    return run


def _negate(inner: Node) -> Step:
    f = build(inner)

    def run(env, v, path):
        for x, _ in f(env, v, None):
            if kind(x) != "number":
                raise Raised(f"{described(x)} cannot be negated")
            yield (-x if x else 0 if not isinstance(x, float) else 0.0), None if path is None else (_NOWHERE,)

    return run


def _binary(op: str, left: Node, right: Node) -> Step:
    a, b = build(left), build(right)

    def run(env, v, path):
        for y, _ in b(env, v, None):
            for x, _ in a(env, v, None):
                yield binary(op, x, y), None if path is None else (_NOWHERE,)

    return run


def _text(style: str | None, parts: tuple) -> Step:
    from docsluice.functions.text import formatted

    built = [p if isinstance(p, str) else build(p) for p in parts]

    def run(env, v, path):
        def fill(i):
            if i < 0:
                yield ""
                return
            p = built[i]
            for so_far in fill(i - 1):
                if isinstance(p, str):
                    yield so_far + p
                else:
                    for x, _ in p(env, v, None):
                        yield so_far + (formatted(style, x) if style else to_text(x))

        for s in fill(len(built) - 1):
            yield s, None if path is None else (_NOWHERE,)

    return run


def _format(name: str) -> Step:
    from docsluice.functions.text import formatted

    def run(env, v, path):
        yield formatted(name, v), None if path is None else (_NOWHERE,)

    return run


def _if(test: Node, yes: Node, no: Node) -> Step:
    t, a, b = build(test), build(yes), build(no)

    def run(env, v, path):
        for x, _ in t(env, v, None):
            yield from (a if truthy(x) else b)(env, v, path)

    return run


def _alternative(left: Node, right: Node) -> Step:
    a, b = build(left), build(right)

    def run(env, v, path):
        some = False
        try:
            for x, p in a(env, v, path):
                if truthy(x):
                    some = True
                    yield x, p
        except Raised:
            pass
        if not some:
            yield from b(env, v, path)

    return run


def _both(op: str):
    def make(left: Node, right: Node) -> Step:
        a, b = build(left), build(right)

        def run(env, v, path):
            mark = None if path is None else (_NOWHERE,)
            for x, _ in a(env, v, None):
                if truthy(x) == (op == "or"):
                    yield op == "or", mark
                else:
                    for y, _ in b(env, v, None):
                        yield truthy(y), mark

        return run

    return make


def _try(inner: Node, handler: Node | None) -> Step:
    f, h = build(inner), build(handler) if handler else None

    def run(env, v, path):
        source = f(env, v, path)
        while True:
            try:
                out = next(source)
            except StopIteration:
                return
            except Raised as e:
                if isinstance(e.value, dict) and "__break__" in e.value:
                    raise
                if h is not None:
                    yield from h(env, e.value, None)
                return
            yield out

    return run


def _var(name: str) -> Step:
    def run(env, v, path):
        mark = None if path is None else (_NOWHERE,)
        if name == "ENV":
            yield dict(os.environ), mark
            return
        try:
            yield env.find("$" + name), mark
        except KeyError:
            if name == "__prog_args":
                yield [], mark
                return
            if name in env.run.arguments:
                yield env.run.arguments[name], mark
            elif name == "named":
                yield env.run.arguments, mark
            else:
                raise Raised(f"${name} is not defined") from None

    return run


def names_of(pattern: Node) -> list[str]:
    if pattern[0] == "name":
        return [pattern[1]]
    if pattern[0] == "list":
        return [n for p in pattern[1] for n in names_of(p)]
    return [n for _, bind, p in pattern[1] for n in ([bind] if bind else []) + (names_of(p) if p else [])]


def matched(pattern: Node, env: Env, v: Any) -> Iterator[dict]:
    """Variables that a value gives a pattern; several, where a key has several outputs."""
    if pattern[0] == "name":
        yield {"$" + pattern[1]: v}
    elif pattern[0] == "list":
        if v is not None and not isinstance(v, list):
            raise Raised(f"Cannot index {kind(v)} with number")

        def go(i):
            if i < 0:
                yield {}
                return
            for found in go(i - 1):
                for more in matched(pattern[1][i], Env(found, env, env.run), look(v, i)):
                    yield {**found, **more}

        yield from go(len(pattern[1]) - 1)
    else:

        def fields(i):
            if i < 0:
                yield {}
                return
            key, bind, inner = pattern[1][i]
            for found in fields(i - 1):
                scope = Env(found, env, env.run)
                for k, _ in build(key)(scope, v, None):
                    if not isinstance(k, str):
                        raise Raised(f"Cannot index {kind(v)} with {kind(k)}")
                    x = look(v, k)
                    own = {**found, **({"$" + bind: x} if bind else {})}
                    if inner is None:
                        yield own
                    else:
                        for more in matched(inner, Env(own, env, env.run), x):
                            yield {**own, **more}

        yield from fields(len(pattern[1]) - 1)


def bound(patterns: list[Node], env: Env, v: Any, then: Callable[[Env], Iterator]) -> Iterator:
    """then() for each way to bind; the next pattern is tried where one, or what follows it, raises."""
    blank = {"$" + n: None for p in patterns for n in names_of(p)} if len(patterns) > 1 else {}
    for i, pattern in enumerate(patterns):
        try:
            for found in matched(pattern, env, v):
                yield from then(Env({**blank, **found}, env, env.run))
            return
        except Raised:
            if i == len(patterns) - 1:
                raise


def _bind(source: Node, patterns: list[Node], body: Node) -> Step:
    s, b = build(source), build(body)

    def run(env, v, path):
        for x, _ in s(env, v, None):
            yield from bound(patterns, env, x, lambda e: b(e, v, path))

    return run


def _reduce(source: Node, patterns: list[Node], start: Node, update: Node) -> Step:
    s, i, u = build(source), build(start), build(update)

    def run(env, v, path):
        for state, p in i(env, v, path):
            for x, _ in s(env, v, None):
                last = (None, None if p is None else (_NOWHERE,))
                for out in bound(patterns, env, x, lambda e, st=state, pp=p: u(e, st, pp)):
                    last = out
                state, p = last
            yield state, p

    return run


def _foreach(source: Node, patterns: list[Node], start: Node, update: Node, extract: Node = ("identity",)) -> Step:
    s, i, u, x_ = build(source), build(start), build(update), build(extract)

    def run(env, v, path):
        for state, p in i(env, v, path):
            box = [state, p]

            def each(e, box=box):
                for out in u(e, box[0], box[1]):
                    box[0], box[1] = out
                    yield from x_(e, out[0], out[1])

            for x, _ in s(env, v, None):
                yield from bound(patterns, env, x, each)

    return run


def _label(name: str, body: Node) -> Step:
    b = build(body)

    def run(env, v, path):
        mark = object()
        try:
            yield from b(Env({"*" + name: mark}, env, env.run), v, path)
        except Break as e:
            if e.label is not mark:
                raise

    return run


def _break(name: str) -> Step:
    def run(env, v, path):
        try:
            raise Break(env.find("*" + name))
        except KeyError:
            raise Raised(f"$*label-{name} is not defined") from None
        yield

    return run


def _def(definition: tuple, rest: Node) -> Step:
    name, params, body = definition
    step_, r = build(body), build(rest)

    def run(env, v, path):
        scope = Env({}, env, env.run)
        scope.names[f"{name}/{len(params)}"] = (params, step_, scope)
        yield from r(scope, v, path)

    return run


def _call(name: str, args: tuple) -> Step:
    built = [build(a) for a in args]
    from docsluice.functions import builtin

    native = builtin(name, len(args))
    key = f"{name}/{len(args)}"
    plain_name = name.rpartition("::")[2]

    def run(env, v, path):
        e, found = env, None
        while e is not None and (found := e.names.get(key)) is None:
            e = e.up
        if found is None:
            if native is None:
                raise Raised(f"{plain_name}/{len(args)} is not defined") from None
            yield from native(env, v, path, *built)
            return
        if callable(found[1]) and len(found) == 2:  # a filter given as an argument: runs where it was written
            yield from found[1](found[0], v, path)
            return
        params, body, home = found
        values = [(i, p[1:]) for i, p in enumerate(params) if p.startswith("$")]

        def go(i, names):
            if i == len(values):
                yield from body(Env(names, home, env.run), v, path)
                return
            at, p = values[i]
            for x, _ in built[at](env, v, None):
                yield from go(i + 1, {**names, "$" + p: x, f"{p}/0": (env, constant(x))})

        yield from go(0, {f"{p}/0": (env, built[i]) for i, p in enumerate(params) if not p.startswith("$")})

    return run


def _assign(op: str, left: Node, right: Node) -> Step:
    target, value = build(left), build(right)

    def paths(env, v):
        for _, p in target(env, v, ()):
            if p[:1] == (_NOWHERE,):
                raise Raised(f"Invalid path expression with result {short(_)}")
            yield p

    def run(env, v, path):
        mark = None if path is None else (_NOWHERE,)
        if op == "=":
            for x, _ in value(env, v, None):
                out = v
                for p in paths(env, v):
                    out = put(out, p, x)
                yield out, mark
        elif op == "|=":
            out, gone = v, []
            for p in list(paths(env, v)):
                for x, _ in value(env, at_path(out, p), None):
                    out = put(out, p, x)
                    break
                else:
                    gone.append(list(p))
            yield without(out, gone) if gone else out, mark
        else:
            for x, _ in value(env, v, None):
                out = v
                for p in paths(env, v):
                    old = at_path(out, p)
                    new = (old if truthy(old) else x) if op == "//=" else binary(op[:-1], old, x)
                    out = put(out, p, new)
                yield out, mark

    return run


_BUILD: dict[str, Callable[..., Step]] = {
    "identity": _identity, "literal": constant, "index": _index, "slice": _slice, "each": _each, "fact": _fact, "pipe": _pipe, "comma": _comma,
    "collect": _collect, "object": _object, "negate": _negate, "binary": _binary, "text": _text, "format": _format, "if": _if,
    "alternative": _alternative, "and": _both("and"), "or": _both("or"), "try": _try, "var": _var, "bind": _bind, "reduce": _reduce, "foreach": _foreach,
    "label": _label, "break": _break, "def": _def, "call": _call, "assign": _assign,
}

#: Kinds of nodes.
KINDS = frozenset(_BUILD)


class Program:
    """A program that can be run on many values. `search` names folders of modules."""

    def __init__(self, text: str, search: tuple[str, ...] = ()):
        imports, tree = parse_module(text)
        self.text, self.step = text, build(_with_modules(imports, tree, search))

    def outputs(self, value: Any, run: Run | None = None) -> Iterator[Any]:
        """Outputs on one value, in order; raises Raised where the program does."""
        run = run or Run()
        try:
            for out, _ in self.step(Env({}, None, run), value, None):
                yield out
        except Break as e:
            raise Raised("break") from e

    def paths(self, value: Any) -> Iterator[list]:
        for _, p in self.step(Env({}, None, Run()), value, ()):
            yield list(p)


def _with_modules(imports: list[Node], tree: Node, search: tuple[str, ...]) -> Node:
    for item in reversed(imports):
        if item[0] == "module":
            continue
        kind_, name, alias, _ = item
        found = next((p for folder in search for p in (os.path.join(folder, name + ".jq"), os.path.join(folder, name, os.path.basename(name) + ".jq"), os.path.join(folder, name + ".json")) if os.path.exists(p)), None)
        if found is None:
            raise Raised(f"module not found: {name}")
        with open(found, encoding="utf-8") as f:
            text = f.read()
        if found.endswith(".json"):
            from docsluice.lang.values import many

            tree = ("bind", ("literal", many(text)), [("name", alias.removeprefix("$"))], tree)
            continue
        inner, body = parse_module(text)
        definitions = []
        while body[0] == "def":
            definitions.append(body[1])
            body = body[2]
        for d in reversed(definitions):
            tree = ("def", (f"{alias}::{d[0]}" if kind_ == "import" else d[0], d[1], d[2]), tree)
            if kind_ == "import":
                tree = ("def", d, tree)
        tree = _with_modules(inner, tree, search)
    return tree


def evaluate(text: str, value: Any, **arguments: Any) -> list:
    return list(Program(text).outputs(value, Run(arguments=arguments)))


__all__ = ["KINDS", "Env", "Halt", "Program", "Raised", "Run", "build", "evaluate", "parse", "number_text", "Decimal"]
