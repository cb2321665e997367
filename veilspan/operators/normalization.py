"""Views of a text: content type, encoded runs and their decoding, folding for detection.

Content type, runs and strict decoding are expressions; the folding map and bounded recursive decoding keep state inside one
text and are Python table functions over Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches

#: Depth, views of a text and decoded characters before inspection stops and says so.
DEPTH, VIEWS, DECODED, RUN = 3, 256, 1 << 20, 65536
# Shapes of encoded runs.
RUNS = {
    "PERCENT": r"(?:%[0-9A-Fa-f]{2}){3,}",
    "HEX": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])",
    "BASE64": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{12,}={0,2}(?![A-Za-z0-9+/=])",
    "BASE64URL": r"(?<![\w-])(?=[\w-]*[_-])[A-Za-z0-9_-]{12,}={0,2}(?![\w-])",
}
#: Base64 broken into lines: full lines and a last one.
WRAPPED = r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,4096}\r?\n[ \t]*){1,4096}[A-Za-z0-9+/]{4,4096}={0,2}(?![A-Za-z0-9+/=])"
#: Characters of a printable string, the share of zeros that marks UTF-16, and spans of one decoded text that are kept apart.
STRING, ZEROS, OCCURRENCES = 8, 0.8, 1024
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff]")


def content_type(text: str = "text") -> Column:
    """BINARY_LIKE, JSON, XML, URL, INI, DOTENV, LOG or TEXT, asked in that order over the first 65,536 characters.

    The prefix is the feature: a type is sniffed, the text itself is never cut."""
    head = f"substring({text}, 1, 65536)"
    lines = f"filter(split({head}, r'\\r?\\n'), l -> trim(l) <> '')".replace("\\\\", "\\")

    def share(pattern: str) -> str:
        return f"size(filter({lines}, l -> l rlike r'{pattern}')) / greatest(size({lines}), 1)"

    section, setting = r"^\s*(?:\[[^\]]+\]|[;#].*|[^=:\[\]]+[=:].*)\s*$", r"^\s*(?:#.*|(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*=.*)$"
    cases = (
        ("BINARY_LIKE", f"length(regexp_replace({head}, r'[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '')) * 100 > length({head})".replace("\\\\", "\\")),
        ("JSON", f"{head} rlike r'^\\s*[{{\\[]' and try_parse_json({head}) is not null".replace("\\\\", "\\")),
        ("XML", head + r" rlike r'^\s*<[?!A-Za-z][\s\S]*>\s*$'"),
        ("URL", head + r" rlike r'^\s*[A-Za-z][A-Za-z0-9+.-]{0,31}://\S+\s*$'"),
        ("INI", head + r" rlike r'(?m)^\s*\[[^\]\n]+\]\s*$' and " + share(section) + " >= 0.8"),
        ("DOTENV", share(setting) + " >= 0.8"),
        ("LOG", share(r"^\s*\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") + " >= 0.5"),
    )
    return F.expr("case " + " ".join(f"when {c} then '{k}'" for k, c in cases) + " else 'TEXT' end")


def runs(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, encoding, start, end, value, decoded): encoded runs and their strict decoding; null where it is not text."""
    each = [f"transform({matches(p)}, m -> struct('{e}' as encoding, m.s as start, m.e as end, m.v as value))" for e, p in RUNS.items()]
    out = texts.select(key, F.explode(F.expr(f"concat({', '.join(each)})")).alias("r")).select(key, "r.*")
    b64 = "rpad(rtrim('=', translate(value, '-_', '+/')), cast(ceil(length(rtrim('=', value)) / 4.0) * 4 as int), '=')"
    raw = F.expr(
        f"""case encoding when 'PERCENT' then try_url_decode(replace(value, '+', '%2B'))
        when 'HEX' then if(length(value) % 2 = 0, try_validate_utf8(cast(unhex(value) as string)), null)
        else if(length(rtrim('=', value)) % 4 <> 1, try_validate_utf8(cast(try_to_binary({b64}, 'base64') as string)), null) end"""
    )
    text = F.when(raw.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.lit(None)).otherwise(raw)
    return out.withColumn("decoded", text)


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """NFKC by cluster without ignorable characters, dashes as ``-``; where each folded character begins and ends."""
    out, origin, ends, i = [], [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        for c in unicodedata.normalize("NFKC", IGNORABLE.sub("", text[i:j])):
            out.append("-" if unicodedata.category(c) == "Pd" else c)
            origin.append(i)
            ends.append(j)
        i = j
    return "".join(out), origin, ends


def fold(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, origin, origin_end) of the folded texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [folded(t or "") for t in f.text]
            yield pd.DataFrame({key: f[key], "text": [g[0] for g in got], "origin": [g[1] for g in got], "origin_end": [g[2] for g in got]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, text string, origin array<int>, origin_end array<int>")


def mapped(start: str, end: str) -> tuple[Column, Column]:
    """A folded span in the offsets of the original."""
    return F.expr(f"origin[{start}]"), F.expr(f"origin_end[{end} - 1]")


def text_of(raw: bytes) -> str | None:
    """Strict text: UTF-8, or UTF-16 where every other byte is mostly zero, without controls."""
    for encoding in ("utf-8", "utf-16-le"):
        if encoding == "utf-16-le" and (len(raw) < 2 * STRING or len(raw) % 2 or raw[1::2].count(0) < ZEROS * len(raw) / 2):
            continue
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text and not CONTROL.search(text):
            return text
    return None


def strings_of(raw: bytes) -> list[str]:
    """Printable strings of bytes: of lenient UTF-8, and ASCII ones of UTF-16 in both orders from both parities."""
    out = [x for x in re.split(r"[\x00-\x1f\x7f-\x9f\ufffd]+", raw.decode("utf-8", "replace")) if len(x) >= STRING]
    if len(raw) >= 2 * STRING:
        for encoding in ("utf-16-le", "utf-16-be"):
            for skip in (0, 1):
                out += re.findall(rf"[\x20-\x7e]{{{STRING},}}", raw[skip : skip + (len(raw) - skip) // 2 * 2].decode(encoding, "replace"))
    return out


def _unpadded(body: str) -> bytes | None:
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def decodings(kind: str, value: str) -> Iterator[bytes | None]:
    """Every reading of a run: base64 from its first four characters on, hex of odd length from both ends."""
    if kind == "PERCENT":
        yield unquote_to_bytes(value)
    elif kind == "HEX":
        for skip in range(1 + len(value) % 2):
            yield binascii.unhexlify(value[skip : skip + len(value) // 2 * 2])
    else:
        body = re.sub(r"\s", "", value).rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):
            yield _unpadded(body[skip:])


def _decoded(kind: str, value: str) -> tuple[str, str] | None:
    """(text, form): TEXT where the first reading is text, else the union of what all readings hold, as STRINGS."""
    pieces: dict[str, None] = {}
    for k, raw in enumerate(decodings(kind, value)):
        whole = text_of(raw) if raw else None
        if whole and k == 0:
            return whole, "TEXT"
        if raw:
            pieces |= dict.fromkeys([whole] if whole else strings_of(raw))
    return ("\n".join(pieces), "STRINGS") if pieces else None


_PATTERNS = [(k, re.compile(p)) for k, p in (*RUNS.items(), ("BASE64", WRAPPED))]


def views_of(text: str, depth: int = DEPTH, most: int = VIEWS, budget: int = DECODED) -> tuple[list[tuple], list[tuple]]:
    """(view, parent, encoding, form, depth, start, end, text, occurrences) breadth first, and (view, start, end, reason) not inspected.

    The same decoded text from runs of one view that do not overlap is one view with several occurrences."""
    views: list[tuple] = [(0, None, "ROOT", "TEXT", 0, 0, len(text), text, [(0, len(text))])]
    closed: list[tuple] = []
    seen: dict[tuple[int, str], int] = {}
    at = 0
    while at < len(views):
        view, _, _, _, level, _, _, body, _ = views[at]
        at += 1
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(body):
                if len(m[0]) > RUN:
                    closed.append((view, m.start(), m.end(), "RUN_TOO_LONG"))
                    continue
                found = _decoded(kind, m[0])
                if found is None or len(found[0]) < 4:
                    continue
                inner, form = found
                if (view, inner) in seen:
                    spans = views[seen[view, inner]][8]
                    if all(m.end() <= a or b <= m.start() for a, b in spans) and len(spans) < OCCURRENCES:
                        spans.append(m.span())
                elif level >= depth:
                    closed.append((view, m.start(), m.end(), "DEPTH_LIMIT"))
                elif len(views) >= most:
                    closed.append((view, m.start(), m.end(), "VIEW_LIMIT"))
                elif len(inner) > budget:
                    closed.append((view, m.start(), m.end(), "EXPANSION_LIMIT"))
                else:
                    budget -= len(inner)
                    seen[view, inner] = len(views)
                    views.append((len(views), view, kind, form, level + 1, m.start(), m.end(), inner, [m.span()]))
    return views, closed


def origins(views: list[tuple]) -> list[list[tuple[int, int]]]:
    """For each view, the spans of the root text that it comes from: its own, or those of its ancestor right below the root."""
    out: list[list[tuple[int, int]]] = []
    for v in views:
        out.append(v[8] if v[1] in (None, 0) else out[v[1]])
    return out


VIEW_COLUMNS = "view int, parent long, encoding string, form string, depth int, start int, end int, text string, origins array<struct<start: int, end: int>>, status string, reasons string, closed array<struct<view: int, start: int, end: int, reason: string>>"


def normalized(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key and VIEW_COLUMNS): every view, where in the root text it comes from, and whether its text was seen whole; ``closed``:
    the parts that were not inspected, at most 1024 of them, with the root view."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f.text, strict=True):
                views, closed = views_of(t or "")
                why = ",".join(sorted({c[3] for c in closed} | ({"UNINSPECTED_TRUNCATED"} if len(closed) > OCCURRENCES else set())))
                shut = [dict(zip(("view", "start", "end", "reason"), c, strict=True)) for c in closed[:OCCURRENCES]]
                for v, spans in zip(views, origins(views), strict=True):
                    rows.append((k, *v[:8], [{"start": a, "end": b} for a, b in spans], "PARTIAL" if closed else "COMPLETE", why, shut if v[0] == 0 else []))
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in re.sub(r"<.*?>+", "", VIEW_COLUMNS).split(", "))]).astype({"parent": "Int64"})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, {VIEW_COLUMNS}")


def folded_views(views: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, view, text, origin, origin_end) of the views that folding changes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, v, *folded(t)) for k, v, t in zip(f[key], f["view"], f.text, strict=True) if not (t.isascii() and t.isprintable()) and folded(t)[0] != t]
            yield pd.DataFrame(rows, columns=[key, "view", "text", "origin", "origin_end"])

    kind = views.schema[key].dataType.simpleString()
    return views.select(key, "view", "text").mapInPandas(run, f"{key} {kind}, view int, text string, origin array<int>, origin_end array<int>")
