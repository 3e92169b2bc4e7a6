"""Addresses, fuzzy comparison, redaction."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

from docsluice.functions import values
from docsluice.lang.values import Raised, described, dumps, kind


def address(v):
    if not isinstance(v, str):
        raise Raised(f"{described(v)} is not an address")
    try:
        return ipaddress.ip_address(v)
    except ValueError:
        raise Raised(f"{described(v)} is not an IP address") from None


@values("ip_valid")
def _(v):
    try:
        address(v)
        return True
    except Raised:
        return False


values("ip_version")(lambda v: address(v).version)
values("ip_canonical")(lambda v: str(address(v)))


@values("ip_class")
def _(v):
    a = address(v)
    for name, is_ in (("unspecified", a.is_unspecified), ("loopback", a.is_loopback), ("multicast", a.is_multicast), ("link_local", a.is_link_local), ("private", a.is_private), ("reserved", a.is_reserved)):
        if is_:
            return name
    return "public"


@values("ip_in_cidr", arity=1)
def _(v, block):
    try:
        net = ipaddress.ip_network(block, strict=False)
    except ValueError:
        raise Raised(f"{described(block)} is not a CIDR block") from None
    a = address(v)
    return a.version == net.version and a in net


def folded(v) -> str:
    if not isinstance(v, str):
        raise Raised(f"{described(v)} cannot be compared, as it is not a string")
    return unicodedata.normalize("NFC", v.casefold())


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


values("edit_distance", arity=1)(lambda v, w: distance(folded(v), folded(w)))


@values("similarity", arity=1)
def similarity(v, w):
    a, b = folded(v), folded(w)
    n = max(len(a), len(b))
    out = 1 - distance(a, b) / n if n else 1.0
    return int(out) if out == int(out) else out


values("fuzzy_match", arity=2)(lambda v, w, least: similarity(v, w) >= least)

MARKER = "[REDACTED]"


@values("redact")
def _(v):
    return MARKER


def _redacted(v, pattern, marker):
    if not isinstance(v, str):
        return marker
    return re.sub(pattern, lambda _: marker, v)


@values("redact", arity=1)
def _(v, pattern):
    return _redacted(v, pattern, MARKER)


values("redact", arity=2)(_redacted)


@values("redact_keyed", arity=1)
def _(v, key):
    said = v if isinstance(v, str) else dumps(v)
    if kind(key) != "string":
        raise Raised("redact_keyed needs a key that is a string")
    return f"[REDACTED:{hmac.new(key.encode(), said.encode(), hashlib.sha256).hexdigest()[:16]}]"
