"""Queries over planted texts and small fixtures for detection over views and fields, external recognizers and governance."""

from __future__ import annotations

import base64
import gzip
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, detectors, governance, parsers, regions, unwrapping
from ..sources.tables import table
from .planted import Query, _rows, _spelt, _texts

EMAIL = "jane.doe@mail.example.com"
_ONE = base64.b64encode(f"see {EMAIL} ok".encode()).decode()
_TWO = base64.b64encode(f"in {_ONE} out".encode()).decode()
_WIDE = base64.b64encode(f"mail {EMAIL} now".encode("utf-16-le")).decode()
_HEX = f"see {EMAIL} ok".encode().hex()
GAP = "​"
#: (text, findings): (view, form, rule, start, value, characters that folding took away, original, spans in the root or its own).
VIEWED = (
    ("ip 10.0.#.5 here", ((0, "RAW", "format.ipv4", 3, "10.0.#.5", 0, "ORIGINAL_EXACT", ""),)),
    (f"ip 10.0{GAP}.#.5 up", ((0, "FOLDED", "format.ipv4", 3, "10.0.#.5", 1, "ORIGINAL_COVER", ""),)),
    (f"x {_ONE} #", ((1, "RAW", "format.email", 4, EMAIL, 0, "ENCODED_RUNS", f"2-{2 + len(_ONE)}"),)),
    (f"x {_TWO} #", ((2, "RAW", "format.email", 4, EMAIL, 0, "ENCODED_RUNS", f"2-{2 + len(_TWO)}"),)),
    (f"x {_ONE} y {_ONE} #", ((1, "RAW", "format.email", 4, EMAIL, 0, "ENCODED_RUNS", f"2-{2 + len(_ONE)},{5 + len(_ONE)}-{5 + 2 * len(_ONE)}"),)),
    (f"x {_WIDE} #", ((1, "RAW", "format.email", 5, EMAIL, 0, "ENCODED_RUNS", f"2-{2 + len(_WIDE)}"),)),
    (f"x {_HEX} #", ((1, "RAW", "format.email", 4, EMAIL, 0, "ENCODED_RUNS", f"2-{2 + len(_HEX)}"),)),
    (f"mail {EMAIL} #", ((0, "RAW", "format.email", 5, EMAIL, 0, "ORIGINAL_EXACT", ""),)),
    ("nothing #", ()),
)
_SUBSET = tuple(r for r in detectors.RULES if r.rule in ("format.ipv4", "format.email") and r.subtype != "SUBNET")


def detections_over_views(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts and addresses in root texts, folded texts and decoded views, with the spans of the root they come from."""
    found = detection.over_views(_texts(spark, folder, [(n, t) for n, (t, _) in enumerate(VIEWED)]).select("id", "text"), _SUBSET, "id")
    return found.select("id", "view", "form", "rule", "start", F.col("end").alias("stop"), "value", "original", F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')").alias("spans"))


_V = _spelt("replace(v, '#', cast(s_suppkey % 97 + 1 as varchar(9)))")
_VIEWS_SQL = f"""select (s_suppkey * 100 + n)::bigint as id, view, form, rule, pos as start, (pos + length({_V}) + gone)::int as stop, {_V} as value, original, case when spans = '' then concat(pos, '-', pos + length({_V}) + gone) else spans end as spans
  from supplier cross join (values {_rows([(n, *f) for n, (_, found) in enumerate(VIEWED) for f in found])}) t(n, view, form, rule, pos, v, gone, original, spans)"""

#: (JSON text, findings): (path as JSON, hint source, rule, start, value).
FIELDED = (
    ("{¨db¨: {¨password¨: ¨hunter2#¨}, ¨note¨: ¨at 10.0.0.#¨}", (('["db","password"]', "PATH", "context.field-key", 0, "hunter2#"),)),
    ("{¨a¨: ¨ip ¦u0031¦u0030.0.0.#¨}", (('["a"]', "NONE", "format.ipv4", 3, "10.0.0.#"),)),
    ("{¨items¨: [{¨name¨: ¨api_key¨, ¨value¨: ¨v#x¨}]}", (('["items","0","value"]', "NAME_SIBLING", "context.field-key", 0, "v#x"),)),
    ("{¨secret¨: {¨id¨: ¨k#¨}}", (('["secret","id"]', "PATH", "context.field-key", 0, "k#"),)),
    ("{¨plain¨: ¨x#¨}", ()),
)


def detections_over_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Values whose key or sibling names a credential, and findings in values that JSON wrote differently."""
    found = detection.over_fields(_texts(spark, folder, [(n, t) for n, (t, _) in enumerate(FIELDED)]).select("id", "text"), _SUBSET, "id")
    return found.select("id", "path_ref", "hint_source", "rule", "start", F.col("end").alias("stop"), "value")


_ID = "cast(s_suppkey * 100 + n as varchar(20))"
_FIELDS_SQL = f"""select (s_suppkey * 100 + n)::bigint as id, substr(sha256(concat('10:field-path', length({_ID}), ':', {_ID}, length(path), ':', path)), 1, 16) as path_ref, hint_source, rule, pos as start, (pos + length({_V}))::int as stop, {_V} as value
  from supplier cross join (values {_rows([(n, *f) for n, (_, found) in enumerate(FIELDED) for f in found])}) t(n, path, hint_source, rule, pos, v)"""


def hinted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Whole values at configured paths, one with a segment that may be anything."""
    texts = _texts(spark, folder, [(0, "{¨owner¨: ¨ Bob # ¨, ¨items¨: [{¨sku¨: ¨P-#¨}, {¨sku¨: ¨¨}], ¨sku¨: ¨no¨}")]).select("id", "text")
    hints = spark.createDataFrame([(["owner"], "PERSON", "NAME"), (["items", "*", "sku"], "ENGINEERING_IDENTIFIER", "PART_NUMBER")], "path array<string>, semantic_type string, subtype string")
    return detection.field_hints(parsers.json_fields(texts, "id").where("path is not null").select("id", "path", "value"), hints, "id").select("id", "semantic_type", "subtype", "start", F.col("end").alias("stop"))


_HINTS_SQL = f"""select (s_suppkey * 100)::bigint as id, kind as semantic_type, subtype, pos as start, (pos + length({_V}))::int as stop from supplier cross join (values ('PERSON', 'NAME', 1, 'Bob #'), ('ENGINEERING_IDENTIFIER', 'PART_NUMBER', 0, 'P-#')) t(kind, subtype, pos, v)"""
#: (text, (subtype, value) or nothing).
KEYED = (
    ("PartNo: AB-1# x", ("PART_NUMBER", "AB-1# x")), ("see part_number=ZX# ok", ("PART_NUMBER", "ZX#")), ("see drawing: ¨D #¨ ok", ("DRAWING_NUMBER", "D #")), ("PartNo: Introduction", None), ("PLC-tag: Motor.Start", ("PLC_TAG", "Motor.Start")),
    ("ritningsnummer = R# drawing", ("DRAWING_NUMBER", "R# drawing")), ("assetTag: T# owner: me", ("ASSET_TAG", "T#")), ("funcloc=A.B", ("FUNCTIONAL_LOCATION", "A.B")), ("document: intro #", None), ("x item_id=I#, y", ("ITEM_ID", "I#")),
)


def engineering_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Values whose key names a part, a drawing, a tag and the like, in English and Swedish."""
    return detection.engineering(_texts(spark, folder, [(n, t) for n, (t, _) in enumerate(KEYED)]).select("id", "text"), "id")


_KEYED_SQL = f"""select (s_suppkey * 100 + n)::bigint as id, subtype, {_V} as value from supplier cross join (values {_rows([(n, *x) for n, (_, x) in enumerate(KEYED) if x])}) t(n, subtype, v)"""
ENGINE = "recognizer/2.2"
#: Replies (n, engine, entity, start, end, score); text number 4 has none, 5 one without entities.
REPLIES = ((0, ENGINE, "EMAIL_ADDRESS", 0, 5, 90), (0, ENGINE, "EMAIL_ADDRESS", 0, 5, 70), (0, ENGINE, "PERSON", 2, 4, 50), (1, ENGINE, "LOCATION", 0, 3, 50), (1, ENGINE, "URL", 1, 3, 50), (2, "recognizer/9", "URL", 0, 3, 50), (3, ENGINE, "URL", 4, 99, 50), (5, ENGINE, None, None, None, None), (6, ENGINE, "URL", 0, 3, 120))
STATES = ((0, "COMPLETE", "", 0), (1, "PARTIAL", "", 1), (2, "FAILURE", "ENGINE_MISMATCH", 0), (3, "FAILURE", "INVALID_RESULT", 0), (4, "FAILURE", "NO_REPLY", 0), (5, "COMPLETE", "", 0), (6, "FAILURE", "INVALID_RESULT", 0))


def _external(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = _texts(spark, folder, [(n, f"text number # {n}") for n, *_ in STATES])
    replies = spark.createDataFrame([(n, g, e, a, b, s / 100 if s is not None else None) for n, g, e, a, b, s in REPLIES], "n int, engine string, entity string, start int, end int, score double")
    return detection.external(texts.select("id", "n").join(F.broadcast(replies), "n").drop("n"), texts.select("id", "text"), ENGINE, ("PERSON", "URL"), "id")


def external_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _external(spark, folder)[0].withColumnRenamed("end", "stop")


def external_status(spark: SparkSession, folder: str) -> DataFrame:
    return _external(spark, folder)[1]


#: (JSON text, canonical text, refusal).
CANONICAL = (
    ("{¨b¨: 1, ¨a¨: [true, null, ¨x#¨]}", "{¨a¨:[true,null,¨x#¨],¨b¨:1}", None), ("{¨a¨:#}", "{¨a¨:#}", None), ("{¨a¨:1.5}", None, "NOT_CANONICALIZABLE"), ("{¨a¨:", None, "NOT_JSON"), ("{¨a¨:1,¨a¨:2}", None, "NOT_CANONICAL"),
    ("{¨é¨:¨ü¨,¨z¨:2.0}", "{¨z¨:2,¨é¨:¨ü¨}", None), ("9007199254740993", None, "NOT_CANONICALIZABLE"),
)


def canonical_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON in its one canonical form, with its digest, or why it has none."""
    return governance.canonicals(_texts(spark, folder, [(n, c[0]) for n, c in enumerate(CANONICAL)]).select("id", "text"), "id")


def _value(x: str | None) -> str:
    return "null" if x is None else f"'{x}'"


_C, _T = (_spelt(f"replace({c}, '#', cast(s_suppkey % 97 + 1 as varchar(9)))") for c in ("c", "t"))
_CANONICAL_SQL = f"""select (s_suppkey * 100 + n)::bigint as id, {_C} as canonical, refusal, sha256({_C}) as digest, coalesce({_C} = {_T}, false) as is_canonical from supplier cross join (values {', '.join(f"({n}, '{t}', {_value(c)}, {_value(r)})" for n, (t, c, r) in enumerate(CANONICAL))}) v(n, t, c, refusal)"""

_PROPOSALS = """select cast(o_custkey % 40 as bigint) as tenant, o_orderkey as proposal_id, cast(o_orderkey as bigint) as proposed_at, cast(o_orderkey % 50 + o_orderkey / 400 as bigint) as revision, concat('d', cast(o_orderkey % 5 as varchar(5))) as digest,
  concat('d', cast(case when o_orderkey % 11 = 0 then 9 else o_orderkey % 5 end as varchar(5))) as pinned_digest, case when o_orderkey % 7 = 0 then null else cast(o_orderkey + 10 - o_orderkey % 13 as bigint) end as approved_until from orders""".replace("o_orderkey / 400", "(o_orderkey - o_orderkey % 400) / 400")


def configuration_activations(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed configurations of tenants in order of time, and which became active."""
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return governance.activations(spark.sql(_PROPOSALS))


_ACTIVE_SQL = f"""with p as ({_PROPOSALS}), s as (select *, coalesce(digest = pinned_digest and approved_until > proposed_at, false) as sound from p),
 a as (select x.*, (select max(y.revision) from s y where y.tenant = x.tenant and y.sound and (y.proposed_at < x.proposed_at or y.proposed_at = x.proposed_at and y.proposal_id < x.proposal_id)) as act,
  (select max(y.digest) from s y where y.tenant = x.tenant and y.sound and y.revision = x.revision and (y.proposed_at < x.proposed_at or y.proposed_at = x.proposed_at and y.proposal_id < x.proposal_id)) as dig from s x),
 r as (select *, case when digest <> pinned_digest then 'CONFIGURATION_CONTENT_CHANGED' when act = revision and dig = digest then 'CONFIGURATION_ALREADY_ACTIVE' when revision <= act then 'CONFIGURATION_STALE' when approved_until is null then 'APPROVAL_MISSING' when approved_until <= proposed_at then 'APPROVAL_EXPIRED' else 'CONFIGURATION_ACTIVATED' end as reason from a)
 select tenant, proposal_id, reason, case when reason = 'CONFIGURATION_ACTIVATED' then revision else act end as active from r"""
_CASES = """select concat('a-', cast(n_regionkey as varchar(5))) as adapter, cast(n_nationkey as bigint) as case_id, n_nationkey % 6 as k from nation"""
_OBSERVED = f"""select adapter, case_id, code from ({_CASES}) c cross join (values {', '.join(f"({k}, '{c}')" for k, c in enumerate((*governance.REQUIREMENTS, *governance.VIOLATIONS)))}) o(j, code)
  where case_id % 9 <> 4 and (o.j < 6 and not (case_id % 8 = 3 and o.j = k) or o.j >= 6 and case_id % 10 = 7 and o.j = 6 + k)"""


def _conformance(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "nation").createOrReplaceTempView("nation")
    cases = spark.sql(_CASES).select("adapter", "case_id", F.array(*map(F.lit, governance.REQUIREMENTS)).alias("required"))
    return governance.conformance(cases, spark.sql(_OBSERVED))


def adapter_conformance(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of adapters: requirements that are not met, violations, outcome."""
    return _conformance(spark, folder).select("adapter", "case_id", F.array_join("unmet", ",").alias("unmet"), F.array_join("violations", ",").alias("violations"), "outcome")


def adapter_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return governance.adapter_verdicts(_conformance(spark, folder))


_REQUIRED, _BROKEN = (", ".join(f"'{x}'" for x in xs) for xs in (governance.REQUIREMENTS, governance.VIOLATIONS))
_OUTCOMES = f"""c as ({_CASES}), o as ({_OBSERVED}), q as (select c.adapter, c.case_id, coalesce((select string_agg(r, ',' order by r) from unnest([{_REQUIRED}]) t(r) where not exists (select 1 from o where o.adapter = c.adapter and o.case_id = c.case_id and o.code = r)), '') as unmet,
  coalesce((select string_agg(code, ',' order by code) from o where o.adapter = c.adapter and o.case_id = c.case_id and code in ({_BROKEN})), '') as violations, exists (select 1 from o where o.adapter = c.adapter and o.case_id = c.case_id) as ran from c),
  x as (select adapter, case_id, unmet, violations, case when not ran then 'NOT_RUN' when unmet <> '' or violations <> '' then 'FAIL' else 'PASS' end as outcome from q)"""


def unit_records(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping findings as units: reference, location where they are of one family, sensitivity of contacts by configuration."""
    from .catalog import _spans

    configured = spark.createDataFrame([("EMAIL", "CONFIDENTIAL"), ("NAME", "INTERNAL")], "subtype string, configured string")
    return governance.unit_records(regions.regions(_spans(spark, folder)), configured)


def _units_sql() -> str:
    from .catalog import _REGIONS

    key = "concat(length(cast(doc_id as varchar(20))), ':', doc_id, length(cast(region as varchar(20))), ':', region)"
    return f"""with {_REGIONS}, u as (select doc_id, region::bigint as region, count(distinct semantic_type) as families, min(start) as s, max("end") as e, max(case when semantic_type = 'PERSON' then case subtype when 'EMAIL' then 2 when 'NAME' then 1 end end) as r from g group by 1, 2)
      select doc_id, concat('cu-', substr(sha256({key}), 1, 32)) as unit_ref, families, case when families = 1 then s end as start, case when families = 1 then e end as stop, case r when 2 then 'CONFIDENTIAL' when 1 then 'INTERNAL' end as sensitivity from u"""


#: Extensions of the registry of subtypes: (type, subtype, result).
EXTENSIONS = (("PERSON", "NICKNAME", "ADDED"), ("PERSON", "BADGE", "ADDED"), ("CLOUD_RESOURCE", "bad name", "INVALID_NAME"), ("CLOUD_RESOURCE", "QUEUE", "REFUSED"), ("WEATHER", "RAIN", "UNKNOWN_CLASS"), ("HOST_OR_SERVICE", "POD", "DUPLICATE"), ("HOST_OR_SERVICE", "POD", "DUPLICATE"))


def registry_extensions(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions import enums

    base = spark.createDataFrame([(c, s) for c, subs in enums.SUBTYPES.items() for s in subs], "semantic_type string, subtype string")
    return governance.extended(base, spark.createDataFrame([e[:2] for e in EXTENSIONS], "semantic_type string, subtype string"))


def placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders made from a type and a number, and read back; half of the texts are spoilt."""
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    rows = spark.sql("select c_custkey, case when c_custkey % 2 = 0 then 'PERSON' else 'HOST_OR_SERVICE' end as kind from customer").withColumn("text", governance.placeholder("kind", "c_custkey"))
    rows = rows.withColumn("text", F.when(F.col("c_custkey") % 4 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    kind, n = governance.placeholder_parts("text")
    return rows.select("c_custkey", "text", kind.alias("kind"), n.alias("number"))


_PLAIN = f"mail {EMAIL} now"
_GZIP = gzip.compress(_PLAIN.encode(), mtime=0)
#: (text, its readings: depth, form, text or nothing).
WRAPPED = (
    ("".join(f"\\u{ord(c):04x}" for c in _PLAIN), ((1, "ESCAPES", _PLAIN),)), ("".join(f"&#x{ord(c):x};" for c in _PLAIN), ((1, "ESCAPES", _PLAIN),)), ("".join(f"={ord(c):02X}" for c in _PLAIN), ((1, "ESCAPES", _PLAIN),)),
    ("".join(f"&amp;#{ord(c)};" for c in _PLAIN), ((1, "ESCAPES", "".join(f"&#{ord(c)};" for c in _PLAIN)), (2, "ESCAPES", _PLAIN))), (_PLAIN.encode().hex(" "), ((1, "BYTE_PAIRS", _PLAIN),)), (str(list(_PLAIN.encode())), ((1, "DECIMAL_BYTES", _PLAIN),)),
    (base64.b64encode(_GZIP).decode(), ((1, "COMPRESSED", _PLAIN),)), (base64.b64encode(zlib.compress(_PLAIN.encode())).decode(), ((1, "COMPRESSED", _PLAIN),)), (base64.b64encode(b"PK\x03\x04" + b"0" * 20).decode(), ((1, "OPAQUE", None),)), (_PLAIN, ()),
)


def unwrapped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What texts say beneath escapes, lists of bytes and compression, for each supplier."""
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(WRAPPED)], "n int, text string")  # ten rows
    texts = table(spark, folder, "supplier").crossJoin(F.broadcast(rows)).select((F.col("s_suppkey") * 100 + F.col("n")).cast("long").alias("id"), "text")
    return unwrapping.unwrappings(texts, "id")


_UNWRAPPED_SQL = f"select (s_suppkey * 100 + n)::bigint as id, depth, form, reading from supplier cross join (values {', '.join(f'({n}, {d}, {f!r}, {_value(t)})' for n, (_, found) in enumerate(WRAPPED) for d, f, t in found)}) v(n, depth, form, reading)"
_OWN: dict[str, tuple[Query, str]] = {
    "unwrapped_texts": (unwrapped_texts, _UNWRAPPED_SQL),
    "detections_over_views": (detections_over_views, _VIEWS_SQL), "detections_over_fields": (detections_over_fields, _FIELDS_SQL), "hinted_fields": (hinted_fields, _HINTS_SQL), "engineering_keys": (engineering_keys, _KEYED_SQL),
    "external_findings": (external_findings, """select (s_suppkey * 100 + n)::bigint as id, kind as semantic_type, subtype, a as start, b as stop, s / 100 as score from supplier cross join (values (0, 'PERSON', 'EMAIL', 0, 5, 90), (0, 'PERSON', null, 2, 4, 50), (1, 'NETWORK_IDENTIFIER', 'URL', 1, 3, 50)) t(n, kind, subtype, a, b, s)"""),
    "external_status": (external_status, f"select (s_suppkey * 100 + n)::bigint as id, status, reason, unsupported::bigint as unsupported from supplier cross join (values {_rows(list(STATES))}) t(n, status, reason, unsupported)"),
    "canonical_json": (canonical_json, _CANONICAL_SQL), "configuration_activations": (configuration_activations, _ACTIVE_SQL),
    "adapter_conformance": (adapter_conformance, f"with {_OUTCOMES} select adapter, case_id, unmet, violations, outcome from x"),
    "adapter_verdicts": (adapter_verdicts, f"with {_OUTCOMES} select adapter, count(*) as cases, count(*) filter (outcome = 'PASS') as passed, case when bool_or(outcome = 'FAIL') then 'FAIL' when bool_and(outcome = 'PASS') then 'PASS' else 'NOT_RUN' end as verdict from x group by 1"),
    "registry_extensions": (registry_extensions, f"select * from (values {_rows(list(EXTENSIONS))}) t(semantic_type, subtype, result)"),
    "placeholders": (placeholders, """select c_custkey, t as text, case when c_custkey % 4 <> 3 then k end as kind, case when c_custkey % 4 <> 3 then c_custkey::bigint end as number from (select c_custkey, k, concat('[', k, '_', c_custkey, ']', case when c_custkey % 4 = 3 then 'x' else '' end) as t from (select c_custkey, case when c_custkey % 2 = 0 then 'PERSON' else 'HOST_OR_SERVICE' end as k from customer))"""),
}


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _OWN.items()} | {"unit_records": unit_records}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _OWN.items()} | {"unit_records": _units_sql()}
