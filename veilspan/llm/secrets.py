"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query (an OR of ANDs) from its own syntax tree.  The trigrams
that any query needs are the index's vocabulary: one scan of the lower-cased texts emits the postings (trigram, text
key), the queries intersect them in one hash aggregation, and only texts that satisfy a rule's query are searched with
its expression.  Rules without mandatory trigrams (a bare hex run) scan every text.  A text key is a 64-bit hash of the
text: two texts under one key only make more candidates, never fewer, and verification decides.

Defined cases: a null text is empty; repeated rows and null ids each give their own row; an empty table gives no rows;
extra columns are ignored; texts of any length are searched whole; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Alternatives kept apart while a query is derived, and the largest character class that is spelled out.
MOST_ALTERNATIVES, MOST_CLASS = 96, 4


@dataclass(frozen=True)
class Rule:
    """``pattern`` with matches kept when ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in the order of their report.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a maximal run of 16 or more is a run that has 16
)
#: A key block with its body: to the END line, or where that is missing over header fields and base64 lines.  Loops over lines
#: of any width are bounded (50 times 8 lines) since Java's regular expressions recurse on them; those of 64, 70 and 76 are not.
_B64, _MARK = "[A-Za-z0-9+/=]", "[A-Z ]{0,40}PRIVATE KEY-----"
_LINES = rf"(?:\n{_B64}{{76}})*(?:\n{_B64}{{70}})*(?:\n{_B64}{{64}})*(?:\r\n{_B64}{{64}})*{_B64}*" + rf"(?:[\s\\]+{_B64}{{20,}}){{0,50}}" * 8
_LAST = r"(?:[\s\\]+[A-Za-z0-9+/]{1,19}={1,2}|\s*\n\s*[A-Za-z0-9+/]{1,19}(?m:$))?"
PRIVATE_KEY = (
    rf"-----BEGIN {_MARK}(?:[^-]*(?:-{{1,4}}[^-]+){{0,200}}-----END {_MARK}"
    rf"|(?:(?:\s+[A-Za-z-]{{1,40}}:[^\n]*){{0,4}}[\s\\]*{_B64}{{20,}}{_LINES}{_LAST})?)"
)
#: Further kinds: public credential formats.
MORE = (
    Rule("source_control", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("package", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", PRIVATE_KEY),
    Rule("url_password", r"://[^\s:/@?#]{1,128}:[^\s:/@?#]{1,128}@"),
)
RULES = BASE + MORE

#: A string that must occur between gaps: the first joins what stands before, the last what follows.
Alternative = tuple[str, ...]
GAP: frozenset[Alternative] = frozenset({("", "")})


def _joined(a: frozenset[Alternative], b: frozenset[Alternative]) -> frozenset[Alternative]:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        if len(a) >= len(b):
            b = GAP
        else:
            a = GAP
    return frozenset(x[:-1] + (x[-1] + y[0],) + y[1:] for x in a for y in b)


def _alternatives(tree) -> frozenset[Alternative]:
    """What every match of a syntax tree holds, as alternatives of strings with gaps; letters in lower case."""
    out: frozenset[Alternative] = frozenset({("",)})
    for op, arg in tree:
        if op is C.LITERAL:
            now = frozenset({(chr(arg).lower(),)})
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is C.LITERAL and chars is not None:
                    chars.add(chr(value).lower())
                elif kind is C.RANGE and chars is not None and value[1] - value[0] < 2 * MOST_CLASS:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
            now = frozenset((c,) for c in chars) if chars and len(chars) <= MOST_CLASS else GAP
        elif op is C.BRANCH:
            now = frozenset().union(*(_alternatives(x) for x in arg[1]))
        elif op is C.SUBPATTERN:
            now = _alternatives(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            one = _alternatives(inner)
            if low == 0 and high == 1:
                now = one | {("",)}
            elif low == 0:
                now = GAP
            else:
                now = frozenset({("",)})
                for _ in range(min(low, 8)):
                    now = _joined(now, one)
                if low > 8 or high != low:
                    now = _joined(now, GAP)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            now = GAP
        out = _joined(out, now)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of sets of trigrams of which one occurs whole in the lower-cased text of every match; None: no such query."""
    sets = {frozenset(s[i : i + 3] for s in alt for i in range(len(s) - 2)) for alt in _alternatives(P.parse(pattern))}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, key): which of ``grams`` occur in which text of ``texts(key, text)``."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the numbers of the rules whose trigram query the text of a key satisfies."""
    spark = texts.sparkSession
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    terms = [(g, k, c, 1 << i, (1 << len(clause)) - 1) for k, q in queries.items() for c, clause in enumerate(q) for i, g in enumerate(sorted(clause))]
    grams = sorted({t[0] for t in terms})
    # As many rows as the rules have trigrams, whatever the corpus.
    table = F.broadcast(spark.createDataFrame(terms, "trigram string, rule int, clause int, bit long, full long"))
    met = (
        postings(texts, grams).join(table, "trigram")
        .groupBy("key", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
        .where("bits = full")
    )
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's kept matches in ``text``, in time that grows as n^1.5 with the matches."""
    found, cut = F.expr(f"_m{rank}"), F.expr(f"_s{rank}")
    kept = f"length(_g{rank}[i]) >= {rule.least}"
    width = f"transform(_m{rank}, (m, i) -> cast(length(m) + length(_s{rank}[i]) as bigint))"
    return F.expr(
        f"""case when size(_m{rank}) = 0 then cast(array() as array<struct<start: bigint, rank: int, end: bigint>>) else
        transform(array(struct({width} as w, cast(ceil(sqrt(size(_m{rank}))) as int) as b)), x ->
          transform(array(struct(x.w as w, x.b as b, transform(sequence(0, cast(floor((size(x.w) - 1) / x.b) as int)), k -> aggregate(slice(x.w, k * x.b + 1, x.b), 0L, (a, v) -> a + v)) as sums)), y ->
            filter(transform(_m{rank}, (m, i) -> struct(
              aggregate(slice(y.sums, 1, cast(floor(i / y.b) as int)), 0L, (a, v) -> a + v) + aggregate(slice(y.w, cast(floor(i / y.b) as int) * y.b + 1, cast(i % y.b as int)), 0L, (a, v) -> a + v) + length(_s{rank}[i]) as start,
              {rank} as rank,
              aggregate(slice(y.sums, 1, cast(floor(i / y.b) as int)), 0L, (a, v) -> a + v) + aggregate(slice(y.w, cast(floor(i / y.b) as int) * y.b + 1, cast(i % y.b as int)), 0L, (a, v) -> a + v) + length(_s{rank}[i]) + length(m) as end)),
              (s, i) -> {kept})))[0][0] end"""
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (with ``text``) and ``found``: array of (start, rank, end), by start, then the rule's place in ``rules``."""
    keyed = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    # The id is part of the key, so that copies of one text are many keys.
    keyed = keyed.withColumn("_key", F.xxhash64("text", *(c for c in ("doc_id",) if c in docs.columns)))
    hits = common.written(candidates(keyed.select(F.col("_key").alias("key"), "text"), rules)).select(F.col("key").alias("_key"), F.col("rules").alias("_rules"))
    out = keyed.join(hits, "_key", "left")
    none = F.expr("cast(array() as array<string>)")
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        gate = F.lit(True) if trigram_query(rule.pattern) is None else F.array_contains("_rules", F.lit(k))
        out = out.withColumn(f"_m{k}", F.when(gate, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    for k, rule in enumerate(rules):
        some = F.size(f"_m{k}") > 0
        out = out.withColumn(f"_s{k}", F.when(some, F.split("text", rule.pattern, -1)).otherwise(none))
        out = out.withColumn(f"_g{k}", F.when(some, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).otherwise(none) if rule.group else F.col(f"_m{k}"))
    found = F.array_sort(F.concat(*(_spans(rule, k) for k, rule in enumerate(rules))))
    return out.withColumn("found", found).select(*(c for c in docs.columns if c != "found"), "found")


def joined(spans: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans in column ``spans``, comma-joined."""
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {kinds}[s.rank], s.start, s.end)), ',')")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``found`` in ``text`` replaced by ``mask``; overlapping spans count as one."""
    merged = F.expr(
        """aggregate(found, cast(array() as array<struct<start: bigint, end: bigint>>), (a, s) ->
        if(size(a) > 0 and s.start < element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))),
           concat(a, array(struct(s.start as start, s.end as end)))))"""
    )
    text = F.expr(
        f"""case when size(_r) = 0 then text else concat(
        array_join(transform(_r, (s, i) -> substring(text, cast(if(i = 0, 0, _r[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, _r[i - 1].end) as int))), '{mask}'),
        '{mask}', substring(text, cast(element_at(_r, -1).end as int) + 1)) end"""
    )
    return scan(docs, rules).withColumn("_r", merged).withColumn("text", text).drop("_r", "found")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    base = scan(docs).withColumn("_base", F.expr(f"filter(found, s -> s.rank < {len(BASE)})"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.rank = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return base.select("doc_id", *counts, F.sha2(joined("_base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB: every rule over every text."""
    steps, spans = [], []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        steps.append(
            f"list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(range(1, i + 1), lambda j: length(s[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0), 'n': length(m[i]), 'ok': length(g[i]) >= {r.least}}})"
        )
        spans.append(
            f"select rid, {k} as rank, '{r.kind}' as kind, u.start::bigint as start, (u.start + u.n)::bigint as stop from (select rid, unnest({steps[-1]}) as u from (select rid, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as s, regexp_extract_all(text, '{p}', {r.group}) as g from t where regexp_matches(text, '{p}'))) where u.ok"
        )
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(spans)}),
per as (select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank) filter (rank < {len(BASE)}) as base,
  string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank) as spans from found group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join per using (rid)"""
