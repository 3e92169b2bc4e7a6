"""Strings: conversion, case, search, cutting, and the named formats."""

from __future__ import annotations

import base64
import re
import urllib.parse
from decimal import Decimal

from docsluice.functions import values
from docsluice.lang.values import Raised, described, dumps, equal, kind, split_text, to_text

#: White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def need(v, what):
    if not isinstance(v, str):
        raise Raised(f"{described(v)} {what}")
    return v


values("tostring")(to_text)


@values("tonumber")
def _(v):
    if kind(v) == "number":
        return v
    if isinstance(v, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
        return int(v) if re.fullmatch(r"[+-]?\d+", v) else Decimal(v)
    if isinstance(v, str) and v in ("nan", "-nan", "NaN"):
        return float("nan")
    raise Raised(f"{described(v)} cannot be parsed as a number")


@values("toboolean")
def _(v):
    if isinstance(v, bool):
        return v
    if v in ("true", "false"):
        return v == "true"
    raise Raised(f"{described(v)} cannot be parsed as a boolean")


@values("explode")
def _(v):
    return [ord(c) for c in need(v, "cannot be exploded")]


@values("implode")
def _(v):
    if not isinstance(v, list):
        raise Raised("implode input must be an array")
    try:
        return "".join(chr(int(c)) if not 0xD800 <= c < 0xE000 and 0 <= c < 0x110000 else "\ufffd" for c in v)
    except (TypeError, ValueError):
        raise Raised("Unicode codepoint must be numeric") from None


_DOWN, _UP = {c: c + 32 for c in range(65, 91)}, {c: c - 32 for c in range(97, 123)}
values("ascii_downcase")(lambda v: need(v, "cannot be lowercased").translate(_DOWN))
values("ascii_upcase")(lambda v: need(v, "cannot be uppercased").translate(_UP))
values("utf8bytelength")(lambda v: len(need(v, "only strings have UTF-8 byte length").encode("utf-8", "surrogatepass")))
values("trim")(lambda v: need(v, "cannot be trimmed").strip(WHITE))
values("ltrim")(lambda v: need(v, "cannot be trimmed").lstrip(WHITE))
values("rtrim")(lambda v: need(v, "cannot be trimmed").rstrip(WHITE))


@values("startswith", arity=1)
def _(v, p):
    if not isinstance(v, str) or not isinstance(p, str):
        raise Raised("startswith() requires string inputs")
    return v.startswith(p)


@values("endswith", arity=1)
def _(v, p):
    if not isinstance(v, str) or not isinstance(p, str):
        raise Raised("endswith() requires string inputs")
    return v.endswith(p)


values("ltrimstr", arity=1)(lambda v, p: v.removeprefix(p) if isinstance(v, str) and isinstance(p, str) else v)
values("rtrimstr", arity=1)(lambda v, p: v.removesuffix(p) if isinstance(v, str) and isinstance(p, str) and p else v)
values("trimstr", arity=1)(lambda v, p: v.removeprefix(p).removesuffix(p) if isinstance(v, str) and isinstance(p, str) and p else v)


def positions(v, x):
    """Where x occurs, overlapping; in arrays also a single element."""
    if v is None:
        return None
    if isinstance(v, str):
        if not isinstance(x, str):
            raise Raised(f"Cannot determine indices of {described(x)} in a string")
        return [i for i in range(len(v) - len(x) + 1) if v.startswith(x, i)] if x else []
    if isinstance(v, list):
        if isinstance(x, list):
            return [i for i in range(len(v) - len(x) + 1) if equal(v[i : i + len(x)], x)] if x else []
        return [i for i, y in enumerate(v) if equal(y, x)]
    raise Raised(f"Cannot index {kind(v)} with {kind(x)}")


values("indices", arity=1)(positions)
values("index", arity=1)(lambda v, x: (positions(v, x) or [None])[0])
values("rindex", arity=1)(lambda v, x: (positions(v, x) or [None])[-1])


@values("_strindices", arity=1)
def _(v, x):
    return positions(need(v, "is not a string"), need(x, "is not a string"))


@values("split", arity=1)
def _(v, by):
    if not isinstance(v, str) or not isinstance(by, str):
        raise Raised("split input and separator must be strings")
    return split_text(v, by)


_HTML = {"<": "&lt;", ">": "&gt;", "&": "&amp;", "'": "&#39;", '"': "&quot;"}


def _cell(x, style):
    if isinstance(x, (list, dict)):
        raise Raised(f"{described(x)} is not valid in a {style} row")
    return x


def formatted(name: str, v) -> str:
    """v in a format; name with or without its @."""
    name = name.removeprefix("@")
    if name == "text":
        return to_text(v)
    if name == "json":
        return dumps(v)
    if name == "html":
        return "".join(_HTML.get(c, c) for c in to_text(v))
    if name == "uri":
        return urllib.parse.quote(to_text(v).encode(), safe="-_.~")
    if name == "urid":
        try:
            return urllib.parse.unquote(to_text(v), errors="strict")
        except UnicodeDecodeError:
            raise Raised(f"{described(v)} is not a valid uri encoding") from None
    if name in ("csv", "tsv"):
        if not isinstance(v, list):
            raise Raised(f"{described(v)} cannot be {name}-formatted, only an array can be")
        if name == "csv":
            return ",".join('"' + x.replace('"', '""') + '"' if isinstance(x, str) else "" if x is None else to_text(x) for x in (_cell(x, "csv") for x in v))
        return "\t".join("" if x is None else to_text(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r") for x in (_cell(x, "tsv") for x in v))
    if name == "sh":
        words = v if isinstance(v, list) else [v]
        if any(isinstance(x, (list, dict)) for x in words):
            raise Raised(f"{described(v)} can not be escaped for shell")
        return " ".join("'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else to_text(x) for x in words)
    if name == "base64":
        return base64.b64encode(to_text(v).encode()).decode()
    if name == "base64d":
        text = to_text(v).rstrip("=")
        try:
            data = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
        except ValueError:
            raise Raised(f"{described(v)} is not valid base64 data") from None
        if text and not data:
            raise Raised(f"{described(v)} is not valid base64 data")
        return data.decode("utf-8", "replace")
    raise Raised(f"{name} is not a valid format")


@values("format", arity=1)
def _(v, name):
    return formatted(need(name, "is not a valid format"), v)
