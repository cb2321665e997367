"""Structured text to fields: (key, path, value, start, end, high_risk).

Line formats and URLs are expressions.  JSON with value offsets needs a reader that keeps its place and is a Python table
function; values and paths alone come from variants.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of keys that name credentials.
EXACT = ("pwd", "pass", "auth", "key", "pin", "sid", "jwt", "dsn")
INSIDE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "credential", "authorization", "cookie", "signature", "connectionstring", "clientsecret", "bearer")


def credential_key(key: str | Column) -> Column:
    """Whether a key names a credential; a key outside ASCII counts as one."""
    key = F.col(key) if isinstance(key, str) else key
    compact = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    inside = F.lit(False)
    for part in INSIDE:
        inside = inside | F.contains(compact, F.lit(part))
    return F.coalesce(key.rlike(r"[^\x00-\x7F]") | compact.isin(*EXACT) | inside, F.lit(False))


def lines(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, at): lines and where they begin."""
    cut = texts.select(key, F.split("text", "\n", -1).alias("l"))
    at = F.expr("aggregate(l, struct(0 as at, cast(array() as array<int>) as out), (a, x) -> struct(a.at + length(x) + 1 as at, concat(a.out, array(a.at)) as out), a -> a.out)")
    return cut.select(key, F.posexplode(F.arrays_zip("l", at.alias("at"))).alias("line_no", "z")).select(key, "line_no", F.rtrim(F.col("z.l")).alias("line"), F.col("z.at").alias("at"))


def dotenv(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields of ``export K=V`` lines; quotes are taken off."""
    shape = r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)=(?:"([^"]*)"|'([^']*)'|([^#\s][^#]*?)?)\s*(?:#.*)?$"""
    rows = lines(texts, key).where(F.col("line").rlike(shape) & ~F.col("line").rlike(r"^\s*#"))
    name = F.regexp_extract("line", shape, 1)
    value = F.concat(F.regexp_extract("line", shape, 2), F.regexp_extract("line", shape, 3), F.regexp_extract("line", shape, 4))
    return rows.select(key, "line_no", name.alias("path"), value.alias("value"), credential_key(name).alias("high_risk"))


def ini(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields of ``key = value`` lines under the section that was named last."""
    section = F.when(F.col("line").rlike(r"^\s*\[[^\]]+\]\s*$"), F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    shape = r"^\s*([^=:\[\];#\s][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    rows = lines(texts, key).withColumn("section", F.last(section, ignorenulls=True).over(order)).where(F.col("line").rlike(shape))
    name = F.regexp_extract("line", shape, 1)
    return rows.select(key, "line_no", F.concat_ws(".", "section", name).alias("path"), F.regexp_extract("line", shape, 2).alias("value"), credential_key(name).alias("high_risk"))


def log_fields(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key=value`` tokens of log lines."""
    shape = r"""(?:^|[\s,;])([A-Za-z_][\w.-]{0,63})=("[^"]*"|[^\s,;"]+)"""
    rows = lines(texts, key).where(F.contains("line", F.lit("=")))
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(shape), F.lit(1)).alias("k"), F.regexp_extract_all("line", F.lit(shape), F.lit(2)).alias("v"))
    out = rows.select(key, "line_no", F.explode(pairs).alias("p"))
    return out.select(key, "line_no", F.col("p.k").alias("path"), F.trim(F.col("p.v"), F.lit('"')).alias("value"), credential_key(F.col("p.k")).alias("high_risk"))


URL_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]{0,31})://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d{1,5}))?([^?#;]*)(?:;([^?#]*))?(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(urls: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Scheme, user information, host, port, path, parameters, query and fragment; status UNSUPPORTED where it is no URL."""
    names = ("scheme", "userinfo", "host", "port", "path", "params", "query", "fragment")
    part = {n: F.nullif(F.regexp_extract(url, URL_SHAPE, k + 1), F.lit("")) for k, n in enumerate(names)}
    good = F.col(url).rlike(URL_SHAPE) & (F.coalesce(part["port"].cast("int"), F.lit(0)) <= 65535)
    return urls.select(key, F.when(good, "COMPLETE").otherwise("UNSUPPORTED").alias("status"), *(F.when(good, part[n]).alias(n) for n in names), F.coalesce(part["userinfo"].isNotNull() & good, F.lit(False)).alias("high_risk"))


def query_pairs(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, name, value, high_risk): decoded pairs of the query; a pair that does not decode has a null value."""
    rows = parts.where("query is not null").select(key, F.posexplode(F.split("query", "[&;]")).alias("place", "pair")).where("pair <> ''")
    name, value = F.substring_index("pair", "=", 1), F.when(F.contains("pair", F.lit("=")), F.expr("substring(pair, locate('=', pair) + 1)")).otherwise("")
    clear = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return rows.select(key, "place", clear(name).alias("name"), clear(value).alias("value"), credential_key(name).alias("high_risk"))


def json_pairs(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the scalars of an object's top level, by variant."""
    v = rows.select(key, F.try_parse_json(column).alias("v")).where("v is not null")
    from_variant = "variant_explode(v)"
    v.createOrReplaceTempView("_veilspan_json")
    return rows.sparkSession.sql(f"select {key}, e.key as path, cast(e.value as string) as value from _veilspan_json, lateral {from_variant} e")


_STRING, _SPACE = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"'), re.compile(r"[ \t\r\n]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def read_json(text: str, depth: int = 64, fields: int = 4096) -> tuple[str, list[str], list[tuple]]:
    """(status, reasons, [(path, value, start, end)]) of one text."""
    out: list[tuple] = []
    reasons: set[str] = set()

    class Bad(Exception):
        pass

    def space(i: int) -> int:
        return _SPACE.match(text, i).end()

    def value(i: int, path: tuple[str, ...]) -> int:
        if len(path) > depth:
            raise Bad("DEPTH_LIMIT")
        i = space(i)
        c = text[i : i + 1]
        if c in "{[" and c:
            close, n, seen = ("}" if c == "{" else "]"), 0, set()
            i = space(i + 1)
            if text[i : i + 1] == close:
                return i + 1
            while True:
                step = str(n)
                if c == "{":
                    m = _STRING.match(text, space(i))
                    if not m:
                        raise Bad("MALFORMED")
                    step = json.loads(m[0])
                    if step in seen:
                        reasons.add("DUPLICATE_KEY")
                    seen.add(step)
                    i = space(m.end())
                    if text[i : i + 1] != ":":
                        raise Bad("MALFORMED")
                    i += 1
                i = space(value(i, (*path, step)))
                n += 1
                if text[i : i + 1] == close:
                    return i + 1
                if text[i : i + 1] != ",":
                    raise Bad("MALFORMED")
                i += 1
        m = _STRING.match(text, i) or _SCALAR.match(text, i)
        if not m:
            raise Bad("MALFORMED")
        if len(out) >= fields:
            raise Bad("FIELD_LIMIT")
        quoted = m[0][0] == '"'
        out.append((list(path), json.loads(m[0]) if quoted else m[0], i + quoted, m.end() - quoted))
        return m.end()

    try:
        if space(value(0, ())) != len(text):
            raise Bad("MALFORMED")
    except (Bad, RecursionError) as e:
        return "FAILURE", [str(e) or "DEPTH_LIMIT"], []
    return "COMPLETE", sorted(reasons), out


def json_fields(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, reasons, path, value, start, end) of JSON texts; a malformed text is one row with FAILURE and no field."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f.text, strict=True):
                status, why, fields = read_json(t or "")
                rows += [(k, status, why, *x) for x in fields] or [(k, status, why, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[key, "status", "reasons", "path", "value", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, status string, reasons array<string>, path array<string>, value string, start int, end int")


def named_values(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """``fields`` with ``high_risk``: the key names a credential, or a sibling ``name`` or ``key`` does."""
    last, parent = F.element_at("path", -1), F.array_join(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), "/")
    named = F.max(F.when(last.isin("name", "key") & credential_key(F.col("value")), F.lit(True))).over(Window.partitionBy(key, parent))
    return fields.withColumn("high_risk", credential_key(last) | (last == "value") & F.coalesce(named, F.lit(False)))
