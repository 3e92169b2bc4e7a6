"""CBOR and MessagePack, after RFC 8949 and the published specification of MessagePack."""

from __future__ import annotations

import datetime as dt
import math
import struct
from decimal import Decimal
from typing import Any

from docsluice.lang.values import Raised, kind

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


class Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Raised("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")


def _name(k: Any) -> str:
    if not isinstance(k, str):
        raise Raised("a key of a map is not a text")
    return k


_BREAK = object()


def _cbor(b: Bytes) -> Any:
    first = b.uint(1)
    major, low = first >> 5, first & 31
    if major == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True}.get(low)
        if low == 25:
            return _half(b.take(2))
        if low in (26, 27):
            return struct.unpack(">f" if low == 26 else ">d", b.take(4 if low == 26 else 8))[0]
        if low == 31:
            return _BREAK
        if low == 24:
            b.take(1)
        return None
    endless = low == 31
    n = low if low < 24 else 0 if endless else b.uint(1 << (low - 24)) if low < 28 else None
    if n is None:
        raise Raised("CBOR: a reserved length")
    if major == 0:
        return n
    if major == 1:
        return -1 - n
    if major in (2, 3):
        data = b"".join(iter(lambda: _part(b), None)) if endless else b.take(n)
        return data if major == 2 else data.decode()
    if major == 4:
        return list(_until(b)) if endless else [_cbor(b) for _ in range(n)]
    if major == 5:
        out = {}
        for _ in iter(int, 1) if endless else range(n):
            k = _cbor(b)
            if k is _BREAK:
                break
            out[_name(k)] = _cbor(b)
        return out
    return _tagged(n, _cbor(b))


def _part(b: Bytes) -> bytes | None:
    x = _cbor(b)
    return None if x is _BREAK else x.encode() if isinstance(x, str) else x


def _until(b: Bytes):
    while (x := _cbor(b)) is not _BREAK:
        yield x


def _half(data: bytes) -> float:
    return struct.unpack(">e", data)[0]


def _tagged(tag: int, v: Any) -> Any:
    if tag == 0:
        return dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    if tag == 1:
        return EPOCH + dt.timedelta(seconds=float(v))
    if tag in (2, 3):
        n = int.from_bytes(v, "big")
        return n if tag == 2 else -1 - n
    if tag == 4:
        return Decimal(v[1]).scaleb(v[0])
    if tag == 5:
        return Decimal(v[1]) * Decimal(2) ** v[0]
    return v


def cbor_values(data: bytes) -> list:
    b, out = Bytes(data), []
    while b.at < len(data):
        out.append(_cbor(b))
    return out


def _head(major: int, n: int) -> bytes:
    for size, code in ((0, 24), (1, 24), (2, 25), (4, 26), (8, 27)):
        if size == 0 and n < 24:
            return bytes([major << 5 | n])
        if size and n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise Raised("CBOR: too long")


def to_cbor(v: Any) -> bytes:
    k = kind(v)
    if k == "null":
        return b"\xf6"
    if k == "boolean":
        return b"\xf5" if v else b"\xf4"
    if isinstance(v, int):
        if -(1 << 64) <= v < 1 << 64:
            return _head(0, v) if v >= 0 else _head(1, -1 - v)
        n = v if v >= 0 else -1 - v
        return _head(6, 2 if v >= 0 else 3) + to_cbor(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    if isinstance(v, Decimal):
        sign, digits, e = v.as_tuple()
        m = int("".join(map(str, digits))) * (-1 if sign else 1)
        return _head(6, 4) + to_cbor([e, m])
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, (str, bytes)):
        data = v.encode() if isinstance(v, str) else v
        return _head(3 if isinstance(v, str) else 2, len(data)) + data
    if k == "array":
        return _head(4, len(v)) + b"".join(map(to_cbor, v))
    if k == "object":
        return _head(5, len(v)) + b"".join(to_cbor(a) + to_cbor(b) for a, b in v.items())
    return (_head(6, 0) if k == "offsetdatetime" else b"") + to_cbor(v.isoformat())


# -- MessagePack ----------------------------------------------------------------------------------------------------


def _pack(b: Bytes) -> Any:
    c = b.uint(1)
    if c < 0x80:
        return c
    if c >= 0xE0:
        return c - 256
    if c < 0x90:
        return {_name(_pack(b)): _pack(b) for _ in range(c & 15)}
    if c < 0xA0:
        return [_pack(b) for _ in range(c & 15)]
    if c < 0xC0:
        return b.take(c & 31).decode()
    if c in (0xC0, 0xC2, 0xC3):
        return None if c == 0xC0 else c == 0xC3
    if c in (0xC4, 0xC5, 0xC6):
        return b.take(b.uint(1 << (c - 0xC4)))
    if c in (0xC7, 0xC8, 0xC9, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8):
        n = b.uint(1 << (c - 0xC7)) if c < 0xD0 else 1 << (c - 0xD4)
        code = struct.unpack("b", b.take(1))[0]
        return _extension(code, b.take(n))
    if c in (0xCA, 0xCB):
        return struct.unpack(">f" if c == 0xCA else ">d", b.take(4 if c == 0xCA else 8))[0]
    if 0xCC <= c <= 0xCF:
        return b.uint(1 << (c - 0xCC))
    if 0xD0 <= c <= 0xD3:
        return int.from_bytes(b.take(1 << (c - 0xD0)), "big", signed=True)
    if c in (0xD9, 0xDA, 0xDB):
        return b.take(b.uint(1 << (c - 0xD9))).decode()
    if c in (0xDC, 0xDD):
        return [_pack(b) for _ in range(b.uint(2 << (c - 0xDC)))]
    if c in (0xDE, 0xDF):
        return {_name(_pack(b)): _pack(b) for _ in range(b.uint(2 << (c - 0xDE)))}
    raise Raised("MessagePack: a code that is never used")


def _extension(code: int, data: bytes) -> Any:
    if code != -1:
        return data
    if len(data) == 4:
        return EPOCH + dt.timedelta(seconds=int.from_bytes(data, "big"))
    if len(data) == 8:
        n = int.from_bytes(data, "big")
        return EPOCH + dt.timedelta(seconds=n & (1 << 34) - 1, microseconds=(n >> 34) // 1000)
    return EPOCH + dt.timedelta(seconds=int.from_bytes(data[4:], "big", signed=True), microseconds=int.from_bytes(data[:4], "big") // 1000)


def msgpack_values(data: bytes) -> list:
    b, out = Bytes(data), []
    while b.at < len(data):
        out.append(_pack(b))
    return out


def to_msgpack(v: Any) -> bytes:
    k = kind(v)
    if k == "null":
        return b"\xc0"
    if k == "boolean":
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            return bytes([v & 255])
        for size in range(4):
            if v >= 0 and v < 1 << (8 << size):
                return bytes([0xCC + size]) + v.to_bytes(1 << size, "big")
            if v < 0 and v >= -(1 << ((8 << size) - 1)):
                return bytes([0xD0 + size]) + v.to_bytes(1 << size, "big", signed=True)
        raise Raised("MessagePack: an integer of more than 64 bits")
    if k == "number":
        return b"\xcb" + struct.pack(">d", float(v) if math.isfinite(v) or isinstance(v, float) else math.nan)
    sized = lambda n, short, limit, codes: bytes([short | n]) if n < limit else next(bytes([c]) + n.to_bytes(w, "big") for c, w in codes if n < 1 << (8 * w))
    if isinstance(v, bytes):
        return sized(len(v), 0, 0, ((0xC4, 1), (0xC5, 2), (0xC6, 4))) + v
    if k == "array":
        return sized(len(v), 0x90, 16, ((0xDC, 2), (0xDD, 4))) + b"".join(map(to_msgpack, v))
    if k == "object":
        return sized(len(v), 0x80, 16, ((0xDE, 2), (0xDF, 4))) + b"".join(to_msgpack(a) + to_msgpack(b) for a, b in v.items())
    data = (v if isinstance(v, str) else v.isoformat()).encode()
    return sized(len(data), 0xA0, 32, ((0xD9, 1), (0xDA, 2), (0xDB, 4))) + data
