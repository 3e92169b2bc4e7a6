"""Digests, encodings, compression, identifiers."""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import hmac
import quopri
import re
import secrets
import time
import urllib.parse
import uuid
import zlib

from docsluice.functions import values
from docsluice.lang.values import Raised, described


def data(v, name) -> bytes:
    if not isinstance(v, str):
        raise Raised(f"{name} input must be a string, not {described(v)}")
    return v.encode("utf-8", "surrogatepass")


def text(b: bytes, name: str) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError:
        raise Raised(f"{name}: the result is not valid UTF-8") from None


def coded(name, f):
    values(name)(lambda v: f(data(v, name)))


def decoded(name, f):
    @values(name)
    def run(v):
        try:
            return text(f(data(v, name)), name)
        except (ValueError, binascii.Error, zlib.error, OSError, EOFError) as e:
            raise Raised(f"{name}: {e}") from None


for _n in ("md5", "sha1", "sha256", "sha512"):
    coded(_n, lambda b, h=getattr(hashlib, _n): h(b).hexdigest())


def _xx(b: bytes) -> str:
    import xxhash

    return xxhash.xxh3_64_hexdigest(b)


coded("xxhash", _xx)
coded("crc32", lambda b: f"{zlib.crc32(b):08x}")
coded("hex_encode", bytes.hex)
decoded("hex_decode", lambda b: bytes.fromhex(b.decode()))
coded("base64_encode", lambda b: base64.b64encode(b).decode())
decoded("base64_decode", lambda b: base64.b64decode(b, validate=True))
coded("base64url_encode", lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="))
decoded("base64url_decode", lambda b: base64.urlsafe_b64decode(b + b"=" * (-len(b) % 4)))
coded("base32_encode", lambda b: base64.b32encode(b).decode())
decoded("base32_decode", base64.b32decode)
#: What each byte is percent-encoded as.
PERCENT = [chr(c) if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~" else f"%{c:02x}" for c in range(256)]
coded("percent_encode", lambda b: "".join([PERCENT[c] for c in b]))
decoded("percent_decode", urllib.parse.unquote_to_bytes)


def _quoted(b: bytes) -> str:
    """Quoted-printable text with its digits in lower case; what is quoted is `=` and two of them, or a line's end."""
    return re.sub("=..", lambda m: m.group().lower(), quopri.encodestring(b).decode())


coded("quoted_printable_encode", _quoted)
decoded("quoted_printable_decode", quopri.decodestring)
coded("gzip_compress", lambda b: base64.b64encode(gzip.compress(b, 6, mtime=0)).decode())
decoded("gzip_decompress", lambda b: gzip.decompress(base64.b64decode(b)))
coded("zlib_compress", lambda b: base64.b64encode(zlib.compress(b)).decode())
decoded("zlib_decompress", lambda b: zlib.decompress(base64.b64decode(b)))


def _deflate(b: bytes) -> str:
    c = zlib.compressobj(wbits=-15)
    return base64.b64encode(c.compress(b) + c.flush()).decode()


coded("deflate_compress", _deflate)
decoded("deflate_decompress", lambda b: zlib.decompress(base64.b64decode(b), wbits=-15))

for _h in ("sha1", "sha256", "sha512"):
    values(f"hmac_{_h}", arity=1)(lambda v, k, h=_h: hmac.new(data(k, "hmac"), data(v, "hmac"), h).hexdigest())
    values(f"hmac_{_h}_base64url", arity=1)(lambda v, k, h=_h: base64.urlsafe_b64encode(hmac.new(data(k, "hmac"), data(v, "hmac"), h).digest()).decode().rstrip("="))
values("hmac", arity=1)(lambda v, k: hmac.new(data(k, "hmac"), data(v, "hmac"), "sha256").hexdigest())


@values("uuid")
def _(v):
    try:
        return str(uuid.UUID(v))
    except (ValueError, AttributeError, TypeError):
        raise Raised(f"{described(v)} is not a UUID") from None


values("uuid_v4")(lambda v: str(uuid.uuid4()))


@values("uuid_v7")
def _(v):
    bits = int(time.time() * 1000) << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
    return str(uuid.UUID(int=bits))


# -- BLAKE3, after its published specification ----------------------------------------------------------------------

# fixed values: the initial words and the message order of BLAKE3
START = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
MASK = 0xFFFFFFFF
FIRST, LAST, PARENT, ROOT = 1, 2, 4, 8


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & MASK


def _squeeze(chain, words, counter: int, length: int, flags: int) -> list[int]:
    s = [*chain, *START[:4], counter & MASK, counter >> 32, length, flags]
    for r in range(7):
        for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            for m, first, second in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                s[a] = (s[a] + s[b] + m) & MASK
                s[d] = _turn(s[d] ^ s[a], first)
                s[c] = (s[c] + s[d]) & MASK
                s[b] = _turn(s[b] ^ s[c], second)
        if r < 6:
            words = [words[k] for k in ORDER]
    return [s[k] ^ s[k + 8] for k in range(8)]


def _words(block: bytes) -> list[int]:
    block = block.ljust(64, b"\0")
    return [int.from_bytes(block[k : k + 4], "little") for k in range(0, 64, 4)]


def _chunk(b: bytes, counter: int, root: int) -> list[int]:
    chain, blocks = list(START), [b[k : k + 64] for k in range(0, len(b), 64)] or [b""]
    for k, block in enumerate(blocks):
        end = k == len(blocks) - 1
        chain = _squeeze(chain, _words(block), counter, len(block), (FIRST if k == 0 else 0) | ((LAST | root) if end else 0))
    return chain


def blake3(b: bytes) -> str:
    def node(start: int, chunks: int, root: int) -> list[int]:
        if chunks == 1:
            return _chunk(b[start * 1024 : (start + 1) * 1024], start, root)
        left = 1 << (chunks - 1).bit_length() - 1
        return _squeeze(START, node(start, left, 0) + node(start + left, chunks - left, 0), 0, 64, PARENT | root)

    return b"".join(w.to_bytes(4, "little") for w in node(0, max(1, -(-len(b) // 1024)), ROOT)).hex()


coded("blake3", blake3)
