"""Check of outgoing messages: known values, encoded or not, high-risk patterns, destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from . import normalization
from .detectors import ASSIGNMENT, HIGH_RISK

GRAM = 8
#: A password before the host of a URL, with an empty user name too; a whole placeholder is none.
URL_PASSWORD = (
    r"""(?i)[a-z][a-z0-9+.-]{1,31}://[^\s:/@"']{0,256}:"""
    r"""(?!(?:\$\{[^}]*\}|\{\{[^}]*\}\}|\$[a-z_][a-z0-9_]*|%s|<[\w -]{1,40}>)@)[^\s/@"']{3,256}@"""
)
#: Values that stand for something else: references and masks where quoted; names, types and members too where not.
REFERENCE = r"^(?:\$\{[^}]*\}|\{\{[^}]*\}\}|<[\w -]{1,40}>|\*{3,}|\[[a-z]+:protected:[A-Z0-9_]+\])$"
NOT_A_VALUE = (
    r"(?i)^(?:[$<*{\[]|(?:string|number|boolean|bigint|object|any|unknown|undefined|null|none|true|false|nil|str|int|bool|bytes)$"
    r"|[A-Za-z_$][\w$]*(?:(?:\.|\?\.)[A-Za-z_$][\w$]*|\[[^\]]*\])++$)"
)
#: A name that is a whole quoted branch of a condition: ``? 'SECRET' : 'INTERNAL'``.
BRANCH = r"""(?i)\?\s{0,6}(["'`])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?token|auth[_-]?token)\1"""


#: Most known values that are broadcast to the heads of the messages.
MOST_BROADCAST = 500_000
#: Most words, and characters of them together, of a short value.
WINDOW = GRAM - 1


def compact(text: str | Column) -> Column:
    """Letters and digits in lower case: separators and case do not hide a value."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def _head(characters: str, at: str, size: int = GRAM) -> str:
    """Hash of ``size`` characters (null beyond the end) of an array."""
    return f"xxhash64({', '.join(f'get({characters}, {at} + {k})' for k in range(size))})"


def keyed(known: DataFrame, key: bytes) -> DataFrame:
    """``known(tenant_id, ref, kind, value)`` as hashes: (tenant_id, ref, kind, size, head, mac); values of 4 to 1024 characters."""
    out = known.withColumn("_c", compact("value")).where(F.length("_c").between(4, 1024)).withColumn("_a", F.expr("filter(split(_c, ''), x -> x <> '')"))
    return out.select("tenant_id", "ref", "kind", F.length("_c").alias("size"), F.expr(_head("_a", "0")).alias("head"), hmac_sha256(key, F.col("_c")).alias("mac"))


def matched(messages: DataFrame, known: DataFrame, key: bytes, id_: str = "message_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, ref, kind, at): known values in ``messages(id, tenant_id, text)``.

    Eight-character heads of the messages meet those of the values in a join on (tenant, hash), as rows without text; the text
    joins the hits once, and length and keyed hash decide.  Values under eight characters are whole words, or words one after
    another."""
    values = keyed(known, key)
    small = values.count() <= most_broadcast
    mark = F.broadcast if small else (lambda df: df)
    text = messages.select(id_, "tenant_id", compact("text").alias("c"))
    cut = text.where(F.length("c") >= GRAM).withColumn("a", F.expr("filter(split(c, ''), x -> x <> '')"))
    heads = cut.select(id_, "tenant_id", F.posexplode(F.expr(f"transform(sequence(0, size(a) - {GRAM}), i -> {_head('a', 'i')})")).alias("at", "head"))
    hits = heads.join(mark(values.where(F.col("size") >= GRAM)), ["tenant_id", "head"]).groupBy(id_).agg(F.collect_list(F.struct("at", "size", "mac", "ref", "kind")).alias("hits"))
    met = text.join(hits, id_).select(id_, "c", F.explode("hits").alias("h")).where("h.at + h.size <= length(c)").where(hmac_sha256(key, F.expr("substring(c, h.at + 1, h.size)")) == F.col("h.mac"))
    words = messages.select(id_, "tenant_id", F.expr(r"filter(split(lower(text), r'[^\p{L}\p{N}]+', -1), w -> w <> '')").alias("w")).where("size(w) > 0")
    runs = f"flatten(transform(w, (x, i) -> filter(transform(sequence(1, {WINDOW}), k -> if(i + k <= size(w), array_join(slice(w, i + 1, k), ''), '')), s -> length(s) between 4 and {WINDOW})))"
    short = words.select(id_, "tenant_id", F.explode(F.array_distinct(F.expr(runs))).alias("s")).withColumn("head", F.expr(f"transform(array(filter(split(s, ''), x -> x <> '')), a -> {_head('a', '0')})[0]"))
    short = short.join(mark(values.where(F.col("size") < GRAM)), ["tenant_id", "head"]).where(hmac_sha256(key, F.col("s")) == F.col("mac"))
    return met.select(id_, "h.ref", "h.kind", F.expr("h.at + 1 as at")).union(short.select(id_, "ref", "kind", F.lit(0))).distinct()


def assigned(text: str) -> Column:
    """Whether a literal value is given to a name of a credential in a column; references, types and echoes of the name are none."""
    kept = F.regexp_replace(text, BRANCH, "?")
    key, quoted, bare = (F.regexp_extract_all(kept, F.lit(ASSIGNMENT), F.lit(g)) for g in (1, 3, 4))

    def value(m: Column) -> Column:
        word = F.regexp_replace(m["bare"], r"[}\]]+$", "")
        same = F.lower(F.regexp_replace(word, "[_-]", "")) == F.lower(F.regexp_replace(m["key"], "[_-]", ""))
        folder = (F.lower(m["key"]) == "pwd") & F.concat(m["quoted"], m["bare"]).rlike("^[/~]")
        literal = F.when(m["bare"] == "", ~m["quoted"].rlike(REFERENCE)).otherwise((F.length(word) >= 4) & ~word.rlike(NOT_A_VALUE) & ~same)
        return ~folder & literal

    return F.exists(F.arrays_zip(key.alias("key"), quoted.alias("quoted"), bare.alias("bare")), value)


def risky(text: str) -> Column:
    """Whether a column holds any of the high-risk patterns, a password in a URL or a credential assignment."""
    out = assigned(text)
    for p in (*HIGH_RISK.values(), URL_PASSWORD):
        out = out | F.col(text).rlike(p)
    return out


def checked(messages: DataFrame, known: DataFrame, key: bytes, id_: str = "message_id") -> DataFrame:
    """(id, decision, reasons) of ``messages(id, tenant_id, text, destination, authorized_destination)``.

    Every decoded view is checked; what could not be inspected blocks, and so does a message of which no view was inspected."""
    views = normalization.normalized(messages.select(id_, "text"), id_)
    return decided(messages, views, known, key, id_)


def decided(messages: DataFrame, views: DataFrame, known: DataFrame, key: bytes, id_: str = "message_id") -> DataFrame:
    """As ``checked``, from ``views(id, view, text, status)`` made elsewhere; a message without a view is an outage and blocks."""
    own = views.join(messages.select(id_, "tenant_id"), id_).select(F.struct(id_, "view").alias("of"), "tenant_id", "text", "status")
    hits = matched(own.select("of", "tenant_id", "text"), known, key, "of")
    found = hits.select(f"of.{id_}", F.when(F.col("kind") == "CANARY", "CANARY_FOUND").otherwise("KNOWN_VALUE_FOUND").alias("reason"))
    found = found.union(own.where(risky("text")).select(f"of.{id_}", F.lit("HIGH_RISK_PATTERN"))).union(own.where("status = 'PARTIAL'").select(f"of.{id_}", F.lit("UNINSPECTED")))
    wrong = messages.where(~F.col("destination").eqNullSafe(F.col("authorized_destination"))).select(id_, F.lit("DESTINATION_MISMATCH"))
    invalid = messages.where("text is null").select(id_, F.lit("INVALID_INPUT"))
    why = found.union(wrong).union(invalid).groupBy(id_).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    seen = views.groupBy(id_).agg(F.count("*").alias("_views"))
    out = messages.select(id_).join(why, id_, "left").join(seen, id_, "left")
    reasons = F.when(F.col("_views").isNull(), F.array_sort(F.array_union(F.coalesce("reasons", F.expr("cast(array() as array<string>)")), F.array(F.lit("INSPECTION_UNAVAILABLE"))))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", reasons).select(id_, F.when(F.col("reasons").isNull(), "ALLOW").otherwise("BLOCK").alias("decision"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))
