"""Documents of each format to values, and values to documents."""

from __future__ import annotations

import csv
import io
import math
import re
import tomllib
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from docsluice.lang.values import Raised, as_float, dumps, kind, loads, many, plain, pretty, to_text
from docsluice.sources.binary import cbor_values, msgpack_values, to_cbor, to_msgpack

#: Formats by the ending of a file's name. Contents are never guessed.
EXTENSIONS = {
    "json": "json", "jsonc": "jsonc", "json5": "json5", "ndjson": "ndjson", "jsonl": "ndjson", "json-seq": "json-seq", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "tsv": "tsv",
    "cbor": "cbor", "msgpack": "msgpack", "xml": "xml", "html": "html", "htm": "html", "properties": "properties", "ini": "ini", "env": "dotenv", "txt": "lines",
}


def format_of(path: str) -> str:
    ending = path.rpartition("/")[2].rpartition(".")[2].lower()
    if ending not in EXTENSIONS:
        raise Raised(f"no format for {path}")
    return EXTENSIONS[ending]


def without_comments(text: str, more_strings: str = '"') -> str:
    """JSON text without comments and without commas before a closing bracket."""
    quoted = "|".join(rf"{q}(?:[^{q}\\]|\\.)*{q}" for q in more_strings)
    text = re.sub(rf"({quoted})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(rf"({quoted})|,(?=\s*[\]}}])", lambda m: m[1] or "", text, flags=re.S)


def json5(text: str) -> Any:
    text = without_comments(text, "\"'")
    out = []
    token = re.compile(r"""\s+|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[{}\[\],:]|[+-]?(?:0[xX][0-9A-Fa-f]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$])|[A-Za-z_$][\w$]*""", re.S)
    at = 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise Raised(f"JSON5: unexpected {text[at]!r}")
        t, at = m[0], m.end()
        if t[0] in "\"'":
            body = re.sub(r"\\\r?\n", "", t[1:-1])
            body = re.sub(r"\\x([0-9A-Fa-f]{2})", lambda x: f"\\u00{x[1]}", body)
            body = re.sub(r"\\([^\"\\/bfnrtu])", lambda x: {"v": "\\u000b", "0": "\\u0000"}.get(x[1], x[1]), body)
            out.append('"' + re.sub(r'(?<!\\)"', '\\"', body).replace("\n", "\\n") + '"')
        elif re.match(r"[+-]?[\dI.N]", t) and not re.match(r"[A-Za-z_$]", t.lstrip("+-")) or t.lstrip("+-") in ("Infinity", "NaN"):
            sign, n = (t[0], t[1:]) if t[0] in "+-" else ("", t)
            sign = "-" if sign == "-" else ""
            if n == "NaN":
                out.append("NaN")
            elif n == "Infinity":
                out.append(sign + "1e999")
            elif n[:2].lower() == "0x":
                out.append(sign + str(int(n, 16)))
            else:
                out.append(sign + ("0" if n[0] == "." else "") + re.sub(r"\.(?=$|[eE])", "", n))
        elif re.match(r"[A-Za-z_$]", t) and t not in ("true", "false", "null"):
            out.append(dumps(t))
        else:
            out.append(t)
    return loads("".join(out))


def _yaml_loader():
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

    # fixed values: the scalars of YAML 1.2's core schema
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")), ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")), ("merge", r"^(?:<<)$", ["<"]),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)

    def integer(loader, node):
        text = node.value
        return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)

    def number(loader, node):
        text = node.value.lower()
        if text.endswith("inf"):
            return -math.inf if text[0] == "-" else math.inf
        return math.nan if text.endswith("nan") else Decimal(text)

    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:float", number)
    return Loader


def _plain_keys(v: Any) -> Any:
    if isinstance(v, dict):
        return {k if isinstance(k, str) else to_text(k): _plain_keys(x) for k, x in v.items()}
    return [_plain_keys(x) for x in v] if isinstance(v, (list, tuple)) else v


def yaml_values(text: str) -> list:
    import yaml

    try:
        return [_plain_keys(x) for x in yaml.load_all(text, _yaml_loader())]
    except yaml.YAMLError as e:
        raise Raised(f"YAML: {e}") from None


def flat_lines(text: str, dialect: str) -> dict:
    """properties, ini and dotenv: strings by name; sections of an INI are objects."""
    out: dict = {}
    into = out
    if dialect == "properties":
        text = re.sub(r"\\\r?\n[ \t]*", "", text)
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in ("#;" if dialect == "ini" else "#!" if dialect == "properties" else "#"):
            continue
        if dialect == "ini" and (m := re.fullmatch(r"\[([^\]]+)\]", line)):
            into = out.setdefault(m[1].strip(), {})
            continue
        if dialect == "dotenv":
            line = line.removeprefix("export ")
            k, _, v = line.partition("=")
            v = v.strip()
            if v[:1] in "\"'" and len(v) > 1 and (end := v.rfind(v[0])) > 0:
                v = v[1:end].replace("\\n", "\n").replace('\\"', '"') if v[0] == '"' else v[1:end]
            else:
                v = re.sub(r"\s+#.*", "", v)
        else:
            m = re.match(r"((?:[^=:\\\s]|\\.)+)\s*[=:\s]\s*(.*)" if dialect == "properties" else r"([^=:]+?)\s*[=:]\s*(.*)", line)
            k, v = (m[1], m[2]) if m else (line, "")
            if dialect == "properties":
                undo = lambda s: re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), s)
                k, v = undo(k), undo(v)
        into[k.strip()] = v
    return out


def table_rows(text: str, header: bool = False, delimiter: str = ",", quoted: bool = True) -> list:
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True)) if quoted else [r.split(delimiter) for r in text.splitlines()]
    rows = [r for r in rows if r]
    if not header:
        return rows
    names: list[str] = []
    for n in rows[0] if rows else []:
        k = 2
        own = n
        while own in names:
            own, k = f"{n}_{k}", k + 1
        names.append(own)
    for r in rows[1:]:
        if len(r) != len(names):
            raise Raised(f"a row of {len(r)} fields under a header of {len(names)}")
    return [dict(zip(names, r, strict=True)) for r in rows[1:]]


def element(e) -> Any:
    from docsluice.functions.selectors import element_value

    return {e.tag: element_value(e)}


def _markup(which: str) -> Callable[[str], list]:
    def read(text: str) -> list:
        from docsluice.sources.markup import html_tree, xml_tree

        return [element((html_tree if which == "html" else xml_tree)(text))]

    return read


def _toml(text: str) -> list:
    try:
        return [tomllib.loads(text, parse_float=Decimal)]
    except tomllib.TOMLDecodeError as e:
        raise Raised(f"TOML: {e}") from None


def _json(text: str) -> list:
    try:
        return many(text)
    except ValueError as e:
        raise Raised(f"JSON: {e}") from None


TEXTS: dict[str, Callable[[str], list]] = {
    "json": _json, "ndjson": _json, "json-seq": _json, "jsonc": lambda t: [loads(without_comments(t))], "json5": lambda t: [json5(t)], "yaml": yaml_values, "toml": _toml,
    "csv": table_rows, "csv-header": lambda t: table_rows(t, True), "tsv": lambda t: table_rows(t, False, "\t", False), "tsv-header": lambda t: table_rows(t, True, "\t", False), "xml": _markup("xml"), "html": _markup("html"),
    "properties": lambda t: [flat_lines(t, "properties")], "ini": lambda t: [flat_lines(t, "ini")], "dotenv": lambda t: [flat_lines(t, "dotenv")], "lines": str.splitlines,
}


def decode(data: bytes, form: str) -> list:
    """The values of a document."""
    if form in ("cbor", "msgpack"):
        return cbor_values(data) if form == "cbor" else msgpack_values(data)
    try:
        return TEXTS[form](data.decode("utf-8"))
    except UnicodeDecodeError:
        raise Raised("not valid UTF-8") from None


# -- writing --------------------------------------------------------------------------------------------------------


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else dumps(k)


def _toml_value(v: Any) -> str:
    k = kind(v)
    if k == "null":
        raise Raised("TOML has no null")
    if k == "array":
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    if k == "object":
        return "{" + ", ".join(f"{_toml_key(a)} = {_toml_value(b)}" for a, b in v.items()) + "}"
    if k == "number" and isinstance(v, float) and not math.isfinite(v):
        return "nan" if v != v else "inf" if v > 0 else "-inf"
    return dumps(v) if k in ("string", "boolean", "number") else plain(v)


def to_toml(v: Any, at: tuple = ()) -> str:
    if not isinstance(v, dict):
        raise Raised("TOML needs an object")
    out = [f"{_toml_key(k)} = {_toml_value(x)}\n" for k, x in v.items() if not isinstance(x, dict)]
    for k, x in v.items():
        if isinstance(x, dict):
            out.append(f"\n[{'.'.join(map(_toml_key, (*at, k)))}]\n" + to_toml(x, (*at, k)))
    return "".join(out).lstrip("\n") if not at else "".join(out)


def to_yaml(v: Any, level: int = 0) -> str:
    pad = "  " * level
    if isinstance(v, dict) and v:
        return "".join(f"{pad}{_yaml_text(k)}:" + (f"\n{to_yaml(x, level + 1)}" if isinstance(x, (dict, list)) and x else f" {_yaml_scalar(x)}\n") for k, x in v.items())
    if isinstance(v, list) and v:
        return "".join(f"{pad}- " + (to_yaml(x, level + 1).lstrip(" ") if isinstance(x, (dict, list)) and x else _yaml_scalar(x) + "\n") for x in v)
    return pad + _yaml_scalar(v) + "\n"


def _yaml_text(s: str) -> str:
    safe = re.fullmatch(r"[A-Za-z_][\w ./-]*", s) and s == s.strip() and s.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return s if safe else dumps(s)


def _yaml_scalar(v: Any) -> str:
    if isinstance(v, str):
        return _yaml_text(v)
    if isinstance(v, float) and not math.isfinite(v):
        return ".nan" if v != v else ".inf" if v > 0 else "-.inf"
    return plain(v) if kind(v) not in ("null", "boolean", "number", "array", "object") else dumps(v)


def to_xml(v: Any) -> str:
    from xml.sax.saxutils import escape, quoteattr

    def one(name: str, x: Any) -> str:
        if isinstance(x, list):
            return "".join(one(name, y) for y in x)
        if not isinstance(x, dict):
            return f"<{name}>{escape('' if x is None else to_text(x))}</{name}>"
        attributes = "".join(f" {k[1:]}={quoteattr(to_text(y))}" for k, y in x.items() if k.startswith("@"))
        return f"<{name}{attributes}>{escape(to_text(x.get('#text', '')))}{''.join(one(k, y) for k, y in x.items() if k[:1] not in '@#')}</{name}>"

    if not isinstance(v, dict) or len(v) != 1:
        raise Raised("XML needs an object with one member")
    return "".join(one(k, x) for k, x in v.items())


def to_ini(v: Any) -> str:
    flat = {k: x for k, x in v.items() if not isinstance(x, dict)}
    return "".join(f"{k}={to_text(x)}\n" for k, x in flat.items()) + "".join(f"[{s}]\n" + "".join(f"{k}={to_text(x)}\n" for k, x in v[s].items()) for s in v if s not in flat)


def table_text(rows: list, form: str) -> str:
    """Objects under a header of the first one's keys, or arrays as they are."""
    from docsluice.functions.text import formatted

    name = "@tsv" if form == "tsv" else "@csv"
    if not rows or isinstance(rows[0], list):
        return "".join(formatted(name, r) + "\n" for r in rows)
    keys = list(rows[0])
    return "".join(formatted(name, r) + "\n" for r in [keys, *[[r.get(k) for k in keys] for r in rows]])


def render(v: Any, style: str = "plain") -> str:
    """Tables and trees for people."""
    rows = v if isinstance(v, list) else [v]
    if style == "tree":
        return _tree(v)
    if style == "hist":
        xs = [as_float(x) for x in rows if kind(x) == "number"]
        low, high = min(xs), max(xs)
        width = (high - low) / 10 or 1
        counts = [0] * 10
        for x in xs:
            counts[min(9, int((x - low) / width))] += 1
        return "".join(f"{low + k * width:.6g}\t{n}\t{'#' * math.ceil(40 * n / max(counts))}\n" for k, n in enumerate(counts))
    objects = [r if isinstance(r, dict) else {"value": r} for r in rows]
    keys = list(dict.fromkeys(k for r in objects for k in r))
    cells = [keys, *[["" if r.get(k) is None else to_text(r[k]) for k in keys] for r in objects]]
    if style == "html":
        from html import escape

        return "<table>" + "".join("<tr>" + "".join(f"<{t}>{escape(c)}</{t}>" for c in r) + "</tr>" for t, r in [("th", cells[0]), *[("td", r) for r in cells[1:]]]) + "</table>\n"
    if style == "gfm":
        line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |\n"
        return line(cells[0]) + "|" + " --- |" * len(keys) + "\n" + "".join(map(line, cells[1:]))
    if style == "shell":
        return "".join(f"{k}={_shell(x)}\n" for r in objects for k, x in r.items())
    widths = [max(len(r[k]) for r in cells) for k in range(len(keys))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+\n" if style == "grid" else ""
    side = "|" if style == "grid" else ""
    body = [side + side.join((f" {c:<{w}} " if style == "grid" else f"{c:<{w}}  ") for c, w in zip(r, widths, strict=True)).rstrip() + side + "\n" for r in cells]
    return rule + body[0] + rule + "".join(body[1:]) + rule


def _shell(x: Any) -> str:
    from docsluice.functions.text import formatted

    return formatted("@sh", x if not isinstance(x, (dict, list)) else dumps(x))


def _tree(v: Any, pad: str = "") -> str:
    if isinstance(v, (dict, list)):
        return "".join(f"{pad}{k}\n{_tree(x, pad + '  ')}" if isinstance(x, (dict, list)) and x else f"{pad}{k}: {dumps(x)}\n" for k, x in (v.items() if isinstance(v, dict) else enumerate(v)))
    return f"{pad}{dumps(v)}\n"


def encode(v: Any, form: str) -> bytes:
    """A value as a document."""
    if form in ("cbor", "msgpack"):
        return to_cbor(v) if form == "cbor" else to_msgpack(v)
    if form in ("csv", "tsv"):
        return table_text(v if isinstance(v, list) and v and isinstance(v[0], (dict, list)) else [v], form).encode()
    if form.startswith("render-"):
        return render(v, form[7:]).encode()
    writers = {"json": lambda x: pretty(x) + "\n", "ndjson": lambda x: dumps(x) + "\n", "json-seq": lambda x: "\x1e" + dumps(x) + "\n", "yaml": to_yaml, "toml": to_toml, "xml": to_xml, "html": to_xml, "ini": to_ini, "properties": to_ini, "dotenv": to_ini, "lines": lambda x: to_text(x) + "\n"}
    if form not in writers:
        raise Raised(f"no format {form}")
    return writers[form](v).encode("utf-8", "surrogatepass")
