"""Functions of the filter language. A function is registered by name and number of arguments.

`values` functions get the input and one value for each argument, for every combination of the arguments' outputs, the
last argument varying fastest. `steps` get the environment, the input, the path, and the arguments as filters.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

_MODULES = ("core", "arrays", "text", "regexes", "times", "numeric", "coding", "stats", "network", "parsers", "schema", "selectors")
_KNOWN: dict[tuple[str, int], Callable] = {}
_DEFINED: dict[str, str] = {}
_loaded = False


def values(*names: str, arity: int = 0) -> Callable:
    def keep(f: Callable[..., Any]) -> Callable[..., Any]:
        def run(env, v, path, *args):
            mark = None if path is None else _nowhere()
            if not args:
                yield f(v), mark
                return
            if len(args) == 1:
                for x, _ in args[0](env, v, None):
                    yield f(v, x), mark
                return

            def go(i, got):
                if i == len(args):
                    yield f(v, *got), mark
                    return
                for x, _ in args[i](env, v, None):
                    yield from go(i + 1, (*got, x))

            yield from go(0, ())

        for n in names:
            _KNOWN[n, arity] = run
        return f

    return keep


def steps(*names: str, arity: int = 0) -> Callable:
    def keep(f: Callable) -> Callable:
        for n in names:
            _KNOWN[n, arity] = f
        return f

    return keep


def define(text: str) -> None:
    """Functions written in the filter language itself: `name/arity = definition`."""
    from docsluice.lang.parser import Parser

    p = Parser(text)
    while p.tokens[p.k][0] != "end":
        name, params, body = p.definition()
        _DEFINED[f"{name}/{len(params)}"] = (name, params, body)


def _nowhere() -> tuple:
    from docsluice.lang.evaluate import _NOWHERE

    return (_NOWHERE,)


def _load() -> None:
    global _loaded
    if not _loaded:
        _loaded = True
        for m in _MODULES:
            importlib.import_module(f"docsluice.functions.{m}")


def builtin(name: str, arity: int) -> Callable | None:
    _load()
    if (found := _KNOWN.get((name, arity))) is not None:
        return found
    if (text := _DEFINED.get(f"{name}/{arity}")) is None:
        return None
    made: list = []

    def run(env, v, path, *args):
        from docsluice.lang.evaluate import Env, _call, _def

        if not made:  # built when first called: a definition may call itself
            made.append(_def(text, ("call", text[0], tuple(("call", f"argument {i}", ()) for i in range(arity)))))
        names = {f"argument {i}/0": (env, a) for i, a in enumerate(args)}
        yield from made[0](Env(names, None, env.run), v, path)

    return run


def names() -> list[str]:
    """Every name/arity, sorted."""
    _load()
    hidden = {f"{n}/{a}" for n, a in _KNOWN if n.startswith("argument ")}
    return sorted(({f"{n}/{a}" for n, a in _KNOWN} | set(_DEFINED)) - hidden)
