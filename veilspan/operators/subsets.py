"""Subsets of YAML, TOML and XML with value offsets, connection strings, and rewriting of field values.

What is outside a subset is UNSUPPORTED as a whole, what is broken is FAILURE as a whole; a text never gives half its fields
as if they were all.  Each reader keeps its place in one text and runs over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .parsers import read_json

Field = tuple[list[str], str, int, int]
Result = tuple[str, list[str], list[Field]]
DEPTH, FIELDS = 64, 4096


class Refused(Exception):
    """(status, reason)"""


def _value(raw: str, at: int, comment: str = "#") -> tuple[str, int, int]:
    """A scalar's text and where it stands: quoted, or plain up to a comment."""
    lead = len(raw) - len(raw.lstrip())
    body, start = raw.strip(), at + lead
    if body[:1] in "\"'" and body:
        q = body[0]
        m = re.match(rf"{q}((?:[^{q}\\]|\\.)*){q}\s*(?:{comment}.*)?$" if q == '"' else r"'((?:[^']|'')*)'\s*(?:#.*)?$", body)
        if not m:
            raise Refused("FAILURE", "MALFORMED")
        return m[1], start + 1, start + 1 + len(m[1])
    m = re.match(rf"(.*?)(?:\s+{comment}.*)?$", body)
    return m[1], start, start + len(m[1])


def read_yaml(text: str) -> Result:
    """Maps and sequences by indentation, plain and quoted scalars."""
    out: list[Field] = []
    stack: list[tuple[int, str, int]] = []  # indentation, key, next item
    seen: set[tuple[str, ...]] = set()
    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        body = line.strip()
        if not body or body[0] == "#" or body == "---":
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise Refused("FAILURE", "TAB_INDENTATION")
        indent = len(line) - len(line.lstrip(" "))
        rest, off = line[indent:], start + indent
        while True:
            while stack and stack[-1][0] > indent or stack and stack[-1][0] == indent and not (rest.startswith("- ") and stack[-1][1].isdigit()):
                stack.pop()
            if not rest.startswith("- "):
                break
            n = stack.pop()[2] if stack and stack[-1][0] == indent else 0
            stack.append((indent, str(n), n + 1))
            skip = len(rest) - len(rest[2:].lstrip(" "))
            rest, off, indent = rest[skip:], off + skip, indent + skip
        if len(stack) > DEPTH or len(out) >= FIELDS:
            raise Refused("FAILURE", "LIMIT")
        m = re.match(r"""([A-Za-z_][\w.-]*|"[^"]*"|'[^']*')\s*:(?:\s+|$)""", rest)
        path = [k for _, k, _ in stack]
        if m:
            key = m[1].strip("\"'")
            path, rest, off = [*path, key], rest[m.end() :], off + m.end()
            if tuple(path) in seen:
                raise Refused("FAILURE", "DUPLICATE_KEY")
            seen.add(tuple(path))
            if not rest.strip() or rest.strip()[0] == "#":
                stack.append((indent, key, 0))
                continue
        elif not (path and path[-1].isdigit()):
            raise Refused("FAILURE", "MALFORMED")
        if rest.strip()[:1] in "&*!|>{[%@`":
            raise Refused("UNSUPPORTED", "OUTSIDE_SUBSET")
        out.append((path, *_value(rest, off)))
    return "COMPLETE", [], out


def read_toml(text: str) -> Result:
    """Tables, dotted keys, strings and primitives on one line."""
    out: list[Field] = []
    table: list[str] = []
    seen: set[tuple[str, ...]] = set()
    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        body = line.strip()
        if not body or body[0] == "#":
            continue
        if m := re.match(r"\[\s*([A-Za-z0-9_.-]+)\s*\]\s*(?:#.*)?$", body):
            table = m[1].split(".")
            if tuple(table) in seen:
                raise Refused("FAILURE", "DUPLICATE_KEY")
            seen.add(tuple(table))
            continue
        m = re.match(r"""\s*([A-Za-z0-9_-]+(?:\s*\.\s*[A-Za-z0-9_-]+)*|"[^"]*")\s*=\s*""", line)
        if body[0] == "[" or m and line[m.end() :][:3] in ('"""', "'''") or m and line[m.end() :][:1] in "[{" and m.end() < len(line):
            raise Refused("UNSUPPORTED", "OUTSIDE_SUBSET")
        if not m or m.end() >= len(line.rstrip()):
            raise Refused("FAILURE", "MALFORMED")
        path = table + ([m[1].strip('"')] if m[1][0] == '"' else [k.strip() for k in m[1].split(".")])
        if tuple(path) in seen:
            raise Refused("FAILURE", "DUPLICATE_KEY")
        seen.add(tuple(path))
        if len(out) >= FIELDS or len(path) > DEPTH:
            raise Refused("FAILURE", "LIMIT")
        out.append((path, *_value(line[m.end() :], start + m.end())))
    return "COMPLETE", [], out


def read_xml(text: str) -> Result:
    """Elements, attributes as ``@name``, text; no DTD, namespaces or mixed content."""
    out: list[Field] = []
    stack: list[tuple[str, bool]] = []
    at = 0
    done = False
    for m in re.finditer(r"""<(\?[^>]*\?|!--.*?--|/?[A-Za-z_][\w.-]*)((?:\s+[A-Za-z_][\w.:-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>""", text, re.S):
        between = text[at : m.start()]
        if "<" in between or ">" in between:
            raise Refused("UNSUPPORTED" if re.search(r"<!|<[\w.-]+:", between) else "FAILURE", "OUTSIDE_SUBSET" if re.search(r"<!|<[\w.-]+:", between) else "MALFORMED")
        name = m[1]
        if between.strip():
            if not stack or stack[-1][1]:
                raise Refused("UNSUPPORTED", "MIXED_CONTENT")
            if not name.startswith("/"):
                raise Refused("UNSUPPORTED", "MIXED_CONTENT")
            lead = len(between) - len(between.lstrip())
            out.append(([n for n, _ in stack], between.strip(), at + lead, at + lead + len(between.strip())))
        at = m.end()
        if name[0] in "?!":
            continue
        if name[0] == "/":
            if not stack or stack.pop()[0] != name[1:]:
                raise Refused("FAILURE", "MALFORMED")
            done = not stack
            continue
        if done or len(stack) >= DEPTH:
            raise Refused("FAILURE", "MALFORMED" if done else "LIMIT")
        if stack:
            stack[-1] = (stack[-1][0], True)
        for a in re.finditer(r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""", m[2]):
            k = 2 if a[2] is not None else 3
            out.append(([n for n, _ in stack] + [name, f"@{a[1]}"], a[k], m.start(2) + a.start(k), m.start(2) + a.end(k)))
        if not m[3]:
            stack.append((name, False))
        else:
            done = not stack
    if stack or text[at:].strip() or not done:
        raise Refused("UNSUPPORTED" if "<!" in text else "FAILURE", "OUTSIDE_SUBSET" if "<!" in text else "MALFORMED")
    return "COMPLETE", [], out


def read_connection(text: str) -> Result:
    """``key=value;`` with quotes or braces, doubled inside."""
    out: list[Field] = []
    i = 0
    while i < len(text):
        if text[i] in "; \t\n":
            i += 1
            continue
        m = re.compile(r"([A-Za-z][\w .-]*?)\s*=\s*").match(text, i)
        if not m:
            raise Refused("FAILURE", "MALFORMED")
        v = re.compile(r"""\{((?:[^}]|\}\})*)\}|"((?:[^"]|"")*)"|'((?:[^']|'')*)'|([^;]*)""").match(text, m.end())
        k = v.lastindex or 4
        value = v[k].rstrip() if k == 4 else v[k]
        out.append(([m[1]], value, v.start(k), v.start(k) + len(value)))
        i = v.end()
        if i < len(text) and text[i] != ";" and text[i:].strip():
            raise Refused("FAILURE", "MALFORMED")
    return "COMPLETE", [], out


READERS: dict[str, Callable[[str], Result]] = {"YAML": read_yaml, "TOML": read_toml, "XML": read_xml, "CONNECTION_STRING": read_connection, "JSON": read_json}


def read(text: str | None, format_: str) -> Result:
    if text is None or len(text) > 1 << 20:
        return "FAILURE", ["INVALID_INPUT" if text is None else "INPUT_LIMIT"], []
    try:
        return READERS[format_](text)
    except Refused as e:
        return e.args[0], [e.args[1]], []


def fields(texts: DataFrame, format_: str, key: str = "doc_id") -> DataFrame:
    """(key, status, reasons, path, value, start, end); a text without fields is one row with its status."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f.text, strict=True):
                status, why, got = read(t, format_)
                rows += [(k, status, why, *x) for x in got] or [(k, status, why, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[key, "status", "reasons", "path", "value", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, status string, reasons array<string>, path array<string>, value string, start int, end int")


def _encoded(value: str, format_: str, quote: str) -> str | None:
    """A replacement as it stands in the text at this place; None where it cannot."""
    if format_ == "JSON":
        return json.dumps(value, ensure_ascii=False)[1:-1] if quote == '"' else (value if re.fullmatch(r"-?\d+|true|false|null", value) else None)
    if format_ == "XML":
        return value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("'", "&apos;")
    if "\n" in value or quote and quote in value or not quote and re.search(r"[#:;={}\[\]\"']|^\s|\s$|^[-?&*!|>%@`]", value):
        return None
    return value


def rewritten(text: str, format_: str, edits: dict[tuple[str, ...], str]) -> tuple[str, str | None]:
    """(status, text) with field values replaced.  The result is read again: the same fields, with only the edited values changed."""
    status, why, got = read(text, format_)
    if status != "COMPLETE" or why:
        return status if status != "COMPLETE" else "FAILURE", None
    known = {tuple(f[0]): f for f in got}
    if not set(edits) <= set(known):
        return "FAILURE", None
    out = text
    for path, value in sorted(edits.items(), key=lambda e: -known[e[0]][2]):
        _, _, start, end = known[path]
        quote = text[start - 1] if start and text[start - 1] in "\"'" and text[end : end + 1] == text[start - 1] else ""
        put = _encoded(value, format_, quote)
        if put is None:
            return "UNSUPPORTED", None
        out = out[:start] + put + out[end:]
    again = read(out, format_)
    same = again[0] == "COMPLETE" and [f[0] for f in again[2]] == [f[0] for f in got] and all(b[1] == a[1] for a, b in zip(got, again[2], strict=True) if tuple(a[0]) not in edits)
    return ("COMPLETE", out) if same else ("FAILURE", None)


def rewrite(texts: DataFrame, format_: str, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, text) of ``texts(key, text)`` with ``edits(key, path array, replacement)``; texts without edits stay as they are."""
    from pyspark.sql import functions as F

    each = edits.groupBy(key).agg(F.collect_list(F.struct("path", "replacement")).alias("edits"))
    joined = texts.select(key, "text").join(each, key, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [rewritten(t or "", format_, {tuple(x["path"]): x["replacement"] for x in e}) if e is not None else ("COMPLETE", t) for t, e in zip(f.text, f.edits, strict=True)]
            yield pd.DataFrame({key: f[key], "status": [g[0] for g in got], "text": [g[1] for g in got]})

    kind = texts.schema[key].dataType.simpleString()
    return joined.mapInPandas(run, f"{key} {kind}, status string, text string")
