"""Match offsets in built-in functions, and conversions between offset units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(s: str) -> str:
    """A raw SQL string literal."""
    if "'" not in s:
        return f"r'{s}'"
    if '"' not in s:
        return f'r"{s}"'
    return " || ".join(f'r"{part}"' if "'" in part else f"r'{part}'" for part in _alternate(s))


def _alternate(s: str) -> list[str]:
    out, now, mark = [], "", ""
    for c in s:
        if c in "'\"" and mark and c != mark:
            out.append(now)
            now, mark = "", ""
        if c in "'\"":
            mark = c
        now += c
    return [*out, now]


def matches(pattern: str, groups: int = 0, text: str = "text", gate: str = "") -> str:
    """SQL for array<struct<s, e, v, g1..>>: code-point start and end, text and groups of every match.

    Spark has no function for positions: the lengths of the matches and of the pieces between them (split) give them, summed
    in blocks of the square root of their number.  ``gate``: a cheap condition that a text with a match meets."""
    p = quoted(pattern)
    more = "".join(f", regexp_extract_all({text}, {p}, {g}) as g{g}" for g in range(1, groups + 1))
    keep = "".join(f", x.g{g} as g{g}" for g in range(1, groups + 1))
    gs = "".join(f", y.g{g}[i] as g{g}" for g in range(1, groups + 1))
    kinds = "".join(f", g{g}: string" for g in range(1, groups + 1))
    empty = f"cast(array() as array<struct<s: int, e: int, v: string{kinds}>>)"
    sums = "transform(sequence(0, cast((size(x.m) - 1) div x.b as int)), k -> aggregate(slice(x.w, k * x.b + 1, x.b), 0, (a, n) -> a + n))"
    before = "aggregate(slice(y.sums, 1, cast(i div y.b as int)), 0, (a, n) -> a + n) + aggregate(slice(y.w, cast(i div y.b as int) * y.b + 1, cast(i % y.b as int)), 0, (a, n) -> a + n) + length(y.c[i])"
    return f"""if({f"not ({gate}) or " if gate else ""}not ({text} rlike {p}), {empty}, transform(transform(transform(
      array(struct(regexp_extract_all({text}, {p}, 0) as m, split({text}, {p}, -1) as c{more})), x -> struct(x.m as m, x.c as c, transform(x.m, (v, i) -> length(v) + length(x.c[i])) as w, cast(ceil(sqrt(size(x.m))) as int) as b{keep})),
      x -> struct(x.m as m, x.c as c, x.w as w, x.b as b, {sums} as sums{keep})),
      y -> transform(y.m, (v, i) -> transform(array({before}), at -> struct(at as s, at + length(v) as e, v as v{gs}))[0]))[0])"""


def utf16(text: str, at: str) -> Column:
    """UTF-16 offset of a code-point offset."""
    before = F.expr(f"substring({text}, 1, cast({at} as int))")
    return F.length(before) + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf8(text: str, at: str) -> Column:
    """UTF-8 byte offset of a code-point offset."""
    return F.octet_length(F.expr(f"substring({text}, 1, cast({at} as int))"))
