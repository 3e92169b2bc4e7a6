"""Regular expressions."""

from __future__ import annotations

from functools import lru_cache

import regex

from docsluice.functions import steps, values
from docsluice.functions.core import mark
from docsluice.lang.values import Raised, described, kind


@lru_cache(512)
def compiled(pattern: str, flags: str) -> tuple[regex.Pattern, bool, bool]:
    """The pattern, whether all matches are wanted, and whether empty ones are left out."""
    bits = regex.V1 if False else 0
    for f in flags:
        if f == "i":
            bits |= regex.IGNORECASE
        elif f == "x":
            bits |= regex.VERBOSE
        elif f in "mp":
            bits |= regex.DOTALL
        elif f not in "gnls":
            raise Raised(f"{flags} is not a valid modifier string")
    try:
        return regex.compile(pattern, bits), "g" in flags, "n" in flags
    except regex.error as e:
        raise Raised(f"{pattern} (at offset 0) is not a valid regex: {e}") from None


def arguments(pattern, flags):
    if isinstance(pattern, list):
        pattern, flags = pattern[0], (pattern[1] if len(pattern) > 1 else None)
    if not isinstance(pattern, str):
        raise Raised(f"{described(pattern)} cannot be matched, as it is not a string")
    if flags is not None and not isinstance(flags, str):
        raise Raised(f"{described(flags)} is not a string")
    return pattern, flags or ""


def found(v, pattern, flags, all_=False):
    pattern, flags = arguments(pattern, flags)
    if not isinstance(v, str):
        raise Raised(f"{described(v)} cannot be matched, as it is not a string")
    r, every, nonempty = compiled(pattern, flags)
    for m in r.finditer(v):
        if nonempty and not m.group():
            continue
        yield m, r
        if not (every or all_):
            return


@lru_cache(512)
def names_by_group(r) -> dict[int, str]:
    """Names of groups, in the order of these."""
    return dict(sorted((i, n) for n, i in r.groupindex.items()))


def described_match(m, r):
    names = names_by_group(r)
    captures = [{"offset": m.start(i) if x is not None else -1, "length": len(x or ""), "string": x, "name": names.get(i)} for i, x in enumerate(m.groups(), 1)]
    text = m.group()
    return {"offset": m.start(), "length": len(text), "string": text, "captures": captures}


def captured(m, r):
    return {n: m.group(i) for i, n in names_by_group(r).items()}


def _each(name, make, all_=False):
    """name/1 and name/2: a stream of what is made of each match."""

    def run(env, v, path, pattern, flags=None):
        for p, _ in pattern(env, v, None):
            for f, _ in flags(env, v, None) if flags else [(None, None)]:
                for m, r in found(v, p, f, all_):
                    yield make(m, r), mark(path)

    steps(name, arity=1)(run)
    steps(name, arity=2)(run)


_each("match", described_match)
_each("capture", captured)
_each("scan", lambda m, r: list(m.groups()) if r.groups else m.group(), True)

values("test", arity=1)(lambda v, p: any(True for _ in found(v, p, None)))
values("test", arity=2)(lambda v, p, f: any(True for _ in found(v, p, f)))


def pieces(v, pattern, flags):
    out, at = [], 0
    for m, _ in found(v, pattern, flags, True):
        out.append(v[at : m.start()])
        at = m.end()
    return [*out, v[at:]]


values("split", arity=2)(pieces)


def _splits(env, v, path, pattern, flags=None):
    for p, _ in pattern(env, v, None):
        for f, _ in flags(env, v, None) if flags else [(None, None)]:
            for x in pieces(v, p, f):
                yield x, mark(path)


steps("splits", arity=1)(_splits)
steps("splits", arity=2)(_splits)


def _filled(env, v, matches, replacement):
    """v with each match replaced, for every combination of the replacements' outputs, those of the last match varying fastest."""

    def outputs(m, r):
        for x, _ in replacement(env, captured(m, r), None):
            if not isinstance(x, str):
                raise Raised(f"{described(captured(m, r))} cannot be added to a string" if kind(x) == "null" else f"{described(x)} cannot be added to a string")
            yield x

    if not matches:
        yield v
        return
    # what stands between the matches, and places for what replaces them
    parts, at = [], 0
    for m, _ in matches:
        parts += [v[at : m.start()], ""]
        at = m.end()
    parts.append(v[at:])
    waiting = [outputs(*matches[0])]
    while waiting:
        k = len(waiting)
        x = next(waiting[-1], None)
        if x is None:
            waiting.pop()
            continue
        parts[2 * k - 1] = x
        if k < len(matches):
            waiting.append(outputs(*matches[k]))
        else:
            yield "".join(parts)


def _sub(every):
    def run(env, v, path, pattern, replacement, flags=None):
        for p, _ in pattern(env, v, None):
            for f, _ in flags(env, v, None) if flags else [(None, None)]:
                for out in _filled(env, v, list(found(v, p, f, every)), replacement):
                    yield out, mark(path)

    return run


for _n, _g in (("sub", False), ("gsub", True)):
    steps(_n, arity=2)(_sub(_g))
    steps(_n, arity=3)(_sub(_g))
