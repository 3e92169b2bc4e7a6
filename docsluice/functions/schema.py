"""JSON Schema 2020-12: inference, validation, drift."""

from __future__ import annotations

import re

from docsluice.functions import values
from docsluice.lang.values import as_float, equal, kind, order_key

DRAFT = "https://json-schema.org/draft/2020-12/schema"


def type_of(v) -> str:
    k = kind(v)
    if k == "number":
        return "integer" if as_float(v) == int(as_float(v)) else "number"
    return k if k in ("null", "boolean", "string", "array", "object") else "string"


def shape(v) -> dict:
    t = type_of(v)
    if t == "object":
        return {"type": "object", "properties": {k: shape(x) for k, x in v.items()}, "required": sorted(v)}
    if t == "array":
        items = None
        for x in v:
            items = shape(x) if items is None else joined(items, shape(x))
        return {"type": "array", **({"items": items} if items is not None else {})}
    return {"type": t}


def types(s) -> list[str]:
    t = s.get("type", [])
    return [t] if isinstance(t, str) else list(t)


def joined(a: dict, b: dict) -> dict:
    """The least schema of this kind that admits what either does."""
    both = sorted(set(types(a)) | set(types(b)))
    if "number" in both and "integer" in both:
        both.remove("integer")
    out: dict = {"type": both[0] if len(both) == 1 else both}
    objects = [s for s in (a, b) if "object" in types(s)]
    if objects:
        names = list(dict.fromkeys(k for s in objects for k in s["properties"]))
        out["properties"] = {k: _both([s["properties"][k] for s in objects if k in s["properties"]]) for k in names}
        out["required"] = sorted(set.intersection(*(set(s["required"]) for s in objects)))
    items = [s["items"] for s in (a, b) if "items" in s]
    if items:
        out["items"] = _both(items)
    return out


def _both(found: list[dict]) -> dict:
    out = found[0]
    for s in found[1:]:
        out = joined(out, s)
    return out


@values("schema_infer", arity=1)
def infer(_, v):
    return {"$schema": DRAFT, **shape(v)}


@values("schema_infer", arity=2)
def _(_v, v, options):
    out = infer(None, v)
    if isinstance(options, dict) and options.get("required") is False:
        drop = lambda s: {k: ({n: drop(p) for n, p in x.items()} if k == "properties" else drop(x) if k == "items" else x) for k, x in s.items() if k != "required"}
        return drop(out)
    return out


def admits(t: str, v) -> bool:
    return type_of(v) == t or t == "number" and type_of(v) == "integer"


def errors(v, s, at: str = "", whole: dict | None = None):
    """(place, keyword, message) of what breaks the schema, in the order of its keywords."""
    whole = s if whole is None else whole
    if s is True or s == {}:
        return
    if s is False:
        yield at, "false", "nothing is allowed here"
        return
    if (ref := s.get("$ref")) is not None:
        target = whole
        for k in ref.removeprefix("#").strip("/").split("/") if ref not in ("#", "") else []:
            target = target[k.replace("~1", "/").replace("~0", "~")]
        yield from errors(v, target, at, whole)
    ts = types(s)
    if ts and not any(admits(t, v) for t in ts):
        yield at, "type", f"{type_of(v)} is not {' or '.join(ts)}"
    if "enum" in s and not any(equal(v, x) for x in s["enum"]):
        yield at, "enum", "not one of the values"
    if "const" in s and not equal(v, s["const"]):
        yield at, "const", "not the value"
    if kind(v) == "number":
        for key, bad in (("minimum", lambda b: v < b), ("maximum", lambda b: v > b), ("exclusiveMinimum", lambda b: v <= b), ("exclusiveMaximum", lambda b: v >= b), ("multipleOf", lambda b: v % b != 0)):
            if key in s and bad(s[key]):
                yield at, key, f"{key} {s[key]}"
    if isinstance(v, str):
        if len(v) < s.get("minLength", 0):
            yield at, "minLength", f"shorter than {s['minLength']}"
        if len(v) > s.get("maxLength", len(v)):
            yield at, "maxLength", f"longer than {s['maxLength']}"
        if "pattern" in s and not re.search(s["pattern"], v):
            yield at, "pattern", f"does not match {s['pattern']}"
    if isinstance(v, list):
        if len(v) < s.get("minItems", 0):
            yield at, "minItems", f"fewer than {s['minItems']}"
        if len(v) > s.get("maxItems", len(v)):
            yield at, "maxItems", f"more than {s['maxItems']}"
        if s.get("uniqueItems") and len({order_key(x) for x in v}) < len(v):
            yield at, "uniqueItems", "items repeat"
        first = s.get("prefixItems", [])
        for i, x in enumerate(v):
            if i < len(first):
                yield from errors(x, first[i], f"{at}/{i}", whole)
            elif "items" in s:
                yield from errors(x, s["items"], f"{at}/{i}", whole)
        if "contains" in s and not any(not list(errors(x, s["contains"], at, whole)) for x in v):
            yield at, "contains", "no item fits"
    if isinstance(v, dict):
        for k in s.get("required", []):
            if k not in v:
                yield at, "required", f"{k} is missing"
        if len(v) < s.get("minProperties", 0):
            yield at, "minProperties", f"fewer than {s['minProperties']}"
        if len(v) > s.get("maxProperties", len(v)):
            yield at, "maxProperties", f"more than {s['maxProperties']}"
        for k, x in v.items():
            place = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
            known = False
            if k in s.get("properties", {}):
                known = True
                yield from errors(x, s["properties"][k], place, whole)
            for p, sub in s.get("patternProperties", {}).items():
                if re.search(p, k):
                    known = True
                    yield from errors(x, sub, place, whole)
            if not known and "additionalProperties" in s:
                yield from errors(x, s["additionalProperties"], place, whole)
            if "propertyNames" in s:
                yield from errors(k, s["propertyNames"], place, whole)
    fits = lambda sub: not list(errors(v, sub, at, whole))
    for sub in s.get("allOf", []):
        yield from errors(v, sub, at, whole)
    if "anyOf" in s and not any(map(fits, s["anyOf"])):
        yield at, "anyOf", "fits none"
    if "oneOf" in s and sum(map(fits, s["oneOf"])) != 1:
        yield at, "oneOf", "does not fit exactly one"
    if "not" in s and fits(s["not"]):
        yield at, "not", "fits what it must not"
    if "if" in s:
        branch = s.get("then" if fits(s["if"]) else "else")
        if branch is not None:
            yield from errors(v, branch, at, whole)


values("schema_validate", arity=2)(lambda _, v, s: not any(True for _ in errors(v, s)))
values("schema_errors", arity=2)(lambda _, v, s: [{"path": p, "keyword": k, "message": m} for p, k, m in errors(v, s)])


@values("schema_diff", arity=2)
def _(_, a, b):
    old = a if isinstance(a, dict) and ("$schema" in a or "type" in a) else shape(a)
    return list(_drift(old, b, ""))


def _drift(a, b, at):
    if sorted(types(a)) != sorted(types(b)):
        yield {"path": at, "change": "type", "old": a.get("type"), "new": b.get("type")}
    pa, pb = a.get("properties", {}), b.get("properties", {})
    for k in [*pa, *(k for k in pb if k not in pa)]:
        if k not in pb:
            yield {"path": f"{at}/{k}", "change": "removed"}
        elif k not in pa:
            yield {"path": f"{at}/{k}", "change": "added"}
        else:
            yield from _drift(pa[k], pb[k], f"{at}/{k}")
    if "items" in a and "items" in b:
        yield from _drift(a["items"], b["items"], at + "/items")
