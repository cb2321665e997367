"""Readings of text that hides other text: escapes, lists of bytes, compressed runs.

Each reading is one more text to look at; what cannot be read is named opaque, never taken as clean.  Output is bounded for
each text (``BUDGET`` characters, ``DEPTH`` rounds), and what the bound cuts off is opaque.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of all readings of a text, and rounds of unwrapping.
BUDGET, DEPTH = 4 << 20, 4
# How containers begin that are not opened here.
CONTAINERS = (b"PK\x03\x04", b"BZh", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"\x28\xb5\x2f\xfd")
_ESCAPES = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%u([0-9a-fA-F]{4})|\\([0-3][0-7]{2})|\\([0-9a-fA-F]{2,6})[ \t]|\\([/\"'\\])")
_QUOTED = re.compile(r"=\r?\n|(?:=[0-9A-F]{2}){2,}")
_PAIRS = re.compile(r"(?<![0-9A-Za-z])(?:0x)?[0-9a-fA-F]{2}(?:(?:, ?|[ :;-]|\\x)(?:0x)?[0-9a-fA-F]{2}){7,4096}(?![0-9A-Za-z])")
_DECIMALS = re.compile(r"\[\s*(\d{1,3}(?:\s*,\s*\d{1,3}){7,65535})\s*\]")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")


def unescaped(text: str) -> str:
    """``text`` with one level of escapes read: JSON, JavaScript, CSS, octal, ``%u``, HTML, quoted-printable."""

    def one(m: re.Match) -> str:
        if m[7]:
            return m[7]
        code = int(m[5], 8) if m[5] else int(next(g for g in m.groups() if g), 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    def quoted(m: re.Match) -> str:
        raw = bytes.fromhex(m[0].replace("=", "")) if m[0][1] not in "\r\n" else b""
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return m[0]

    joined = re.sub(r"\\ud([89ab][0-9a-f]{2})\\ud([c-f][0-9a-f]{2})", lambda m: chr(0x10000 + ((int("d" + m[1], 16) & 0x3FF) << 10) + (int("d" + m[2], 16) & 0x3FF)), text, flags=re.I)
    return _QUOTED.sub(quoted, html.unescape(_ESCAPES.sub(one, joined)))


def inflated(data: bytes, most: int = BUDGET) -> tuple[bytes | None, bool]:
    """(bytes, opaque): gzip, zlib or raw deflate; opaque where a signed stream is broken, too long or of another container."""
    if data.startswith(CONTAINERS):
        return None, True
    signed = data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2]) % 31 == 0)
    for wbits in ((31,) if data[:2] == b"\x1f\x8b" else (15, -15)):
        z = zlib.decompressobj(wbits)
        try:
            out = z.decompress(data, most + 1)
        except zlib.error:
            continue
        if z.eof and len(out) <= most and (wbits > 0 or not z.unused_data):
            return out, bool(z.unused_data)
        if wbits > 0:
            return out[:most] or None, True
    return None, signed


def _text(raw: bytes) -> str | None:
    try:
        t = raw.decode()
    except UnicodeDecodeError:
        return None
    return t if t and sum(c.isprintable() or c in "\r\n\t" for c in t) == len(t) else None


def readings(text: str) -> list[tuple[str, str | None]]:
    """(form, reading) one level down: ESCAPES, BYTE_PAIRS, DECIMAL_BYTES, COMPRESSED; OPAQUE has no reading."""
    out = []
    plain = unescaped(text)
    if plain != text:
        out.append(("ESCAPES", plain))
    out += [("BYTE_PAIRS", _text(bytes.fromhex(re.sub(r"0x|[^0-9a-fA-F]", "", m[0].replace("\\x", " "))))) for m in _PAIRS.finditer(text)]
    for m in _DECIMALS.finditer(text):
        values = [int(v) for v in m[1].split(",")]
        if max(values) < 256:
            out.append(("DECIMAL_BYTES", _text(bytes(values))))
    for m in _RUN.finditer(text):
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        data, opaque = inflated(raw)
        out += [("COMPRESSED", _text(data))] if data else []
        out += [("OPAQUE", None)] if opaque else []
    return [(f, t) for f, t in out if t is not None or f == "OPAQUE"]


def unwrapped(text: str | None) -> list[tuple[int, str, str | None]]:
    """(depth, form, reading) of all distinct readings of a text, to ``DEPTH`` rounds; a null has none."""
    level, seen, out, left = [text or ""], {text or ""}, [], BUDGET
    for depth in range(1, DEPTH + 1):
        found, below = [x for t in level for x in readings(t)], []
        for form, t in dict.fromkeys(found):
            if t in seen:
                continue
            if t is not None and len(t) > left:
                form, t = "OPAQUE", None
            if (depth, form, t) in out:
                continue
            out.append((depth, form, t))
            if t is not None:
                seen.add(t)
                below.append(t)
                left -= len(t)
        level = below
    if any(readings(t) for t in level):
        out.append((DEPTH + 1, "OPAQUE", None))
    return out


def unwrappings(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, depth, form, reading) of ``texts(key, text)``: rows stay where they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *r) for i, t in enumerate(f.text) for r in unwrapped(t)]
            keys = f[key].iloc[[r[0] for r in rows]].reset_index(drop=True)
            yield pd.DataFrame({key: keys, "depth": [r[1] for r in rows], "form": pd.Series([r[2] for r in rows], dtype=object), "reading": pd.Series([r[3] for r in rows], dtype=object)})

    return texts.select(key, "text").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, depth int, form string, reading string")
