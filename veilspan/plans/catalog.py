"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.hashing import hmac_sha256
from ..operators import classification, dependencies, detectors, evaluation, mappings, normalization, parsers, policy, regions, sentinel, wire
from ..sources.tables import table
from . import assured, composed, planted
from .fixtures import frame, with_

KEY = b"synthetic-key"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


# ---- spans ---------------------------------------------------------------------------------------------------------

_AT = "list_sum(list_transform(range(1, i + 1), lambda j: length(c[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0)"


def _matched(pattern: str, table_: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """DuckDB: (key, s, v, before, after) of every match of a pattern without look-around; neighbours are for the caller to check."""
    return f"""select {key}, u.s as s, u.v as v, case when u.s > 0 then substr({text}, u.s::int, 1) else '' end as before, substr({text}, (u.s + length(u.v) + 1)::int, 1) as after, substr({text}, (u.s + length(u.v) + 2)::int, 1) as after2, {text}
      from (select {key}, {text}, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {_AT}, 'v': m[i]}})) as u
      from (select {key}, {text}, regexp_extract_all({text}, '{pattern}') as m, string_split_regex({text}, '{pattern}') as c from {table_} where regexp_matches({text}, '{pattern}')))"""


_SCOPE4 = """case when a = 192 and b = 0 and c = 2 or a = 198 and b = 51 and c = 100 or a = 203 and b = 0 and c = 113 then 'DOCUMENTATION'
  when a = 10 or a = 172 and b between 16 and 31 or a = 192 and b = 168 then 'PRIVATE' when a = 127 then 'LOOPBACK' when a = 169 and b = 254 then 'LINK_LOCAL'
  when a = 100 and b between 64 and 127 then 'SHARED' when a between 224 and 239 then 'MULTICAST' when a = 0 then 'UNSPECIFIED'
  when a = 198 and b in (18, 19) or a >= 240 or a = 192 and b = 0 and c = 0 then 'RESERVED' else 'PUBLIC' end"""
_IPV4_SQL = f"""select doc_id, s::int as start, (s + length(v))::int as stop, v as value, {_SCOPE4} as scope from (
  select *, split_part(v, '.', 1)::int as a, split_part(v, '.', 2)::int as b, split_part(v, '.', 3)::int as c, split_part(v, '.', 4)::int as d from ({_matched('[0-9]{1,3}(?:[.][0-9]{1,3}){3}')})
  where not regexp_matches(before, '[A-Za-z0-9.]') and not regexp_matches(after, '[A-Za-z0-9]') and not (after = '.' and regexp_matches(after2, '[0-9]')))
  where a <= 255 and b <= 255 and c <= 255 and d <= 255"""
_EMAIL_SQL = f"""select doc_id, s::int as start, (s + length(v))::int as stop, v as value from ({_matched('[A-Za-z0-9_%+-][A-Za-z0-9_%+.-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?[.]){1,16}[A-Za-z]{2,48}')})"""


@_query("span_ipv4", _IPV4_SQL)
def span_ipv4(spark: SparkSession, folder: str) -> DataFrame:
    found = detectors.findings(_texts(spark, folder), tuple(r for r in detectors.RULES if r.rule == "format.ipv4"))
    return found.where("subtype = 'IP'").select("doc_id", "start", F.col("end").alias("stop"), "value", "scope")


@_query("span_email", _EMAIL_SQL)
def span_email(spark: SparkSession, folder: str) -> DataFrame:
    found = detectors.findings(_texts(spark, folder), tuple(r for r in detectors.RULES if r.rule == "format.email"))
    return found.select("doc_id", "start", F.col("end").alias("stop"), "value")


@_query("span_url_pages", f"""select page_id, s::int as start, (s + length(v) - length(regexp_extract(v, '[.,;:!?]*$')))::int as stop, case when lower(regexp_extract(v, '^[^:]*')) in ({', '.join(repr(x) for x in detectors.SCHEMES.split())}) then lower(regexp_extract(v, '^[^:]*')) else 'OTHER' end as scheme from ({_matched('[A-Za-z][A-Za-z0-9+.-]{0,31}://[^ <>"`/?#]{1,512}[^ <>"`]{0,900}', 'pages', 'page_id', 'url')})""")
def span_url_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = detectors.findings(table(spark, folder, "pages").select("page_id", F.col("url").alias("text")), tuple(r for r in detectors.RULES if r.rule == "format.url"), "page_id")
    return found.select("page_id", "start", F.col("end").alias("stop"), F.col("detail").alias("scheme"))


@_query("findings_all")
def findings_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule over every document."""
    return detectors.deduplicated(detectors.findings(_texts(spark, folder)))


@_query("findings_pages")
def findings_pages(spark: SparkSession, folder: str) -> DataFrame:
    return detectors.findings(table(spark, folder, "pages").select("page_id", F.col("html").alias("text")), key="page_id")


@_query("findings_by_type", f"""select 'format.ipv4' as rule, 'NETWORK_IDENTIFIER' as semantic_type, count(*) as n, count(distinct doc_id) as texts from ({_IPV4_SQL}) having count(*) > 0
  union all select 'format.email', 'PERSON', count(*), count(distinct doc_id) from ({_EMAIL_SQL}) having count(*) > 0""")
def findings_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts and addresses counted by rule."""
    found = detectors.findings(_texts(spark, folder), tuple(r for r in detectors.RULES if r.rule in ("format.ipv4", "format.email") and r.subtype != "SUBNET"))
    return found.groupBy("rule", "semantic_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("texts"))


@_query("finding_status", f"""with f as (select doc_id, count(*) as n from (select doc_id from ({_IPV4_SQL}) union all select doc_id from ({_EMAIL_SQL})) group by doc_id)
  select doc_id, case when text is null then 'FAILURE' when coalesce(n, 0) > 256 or length(text) > 1048576 then 'PARTIAL' else 'COMPLETE' end as status, coalesce(n, 0)::bigint as n from documents left join f using (doc_id)""")
def finding_status(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    found = detectors.findings(texts, tuple(r for r in detectors.RULES if r.rule in ("format.ipv4", "format.email") and r.subtype != "SUBNET"))
    return detectors.status(texts, found).select("doc_id", "status", "n")


# ---- overlap composition: spans of words stand in for findings --------------------------------------------------------

_WORDS = r"""select doc_id, cast(k * 37 % 400 as int) as start, cast(k * 37 % 400 + 3 + k * doc_id % 29 as int) as "end", case when k % 3 = 0 then 'PERSON' else 'HOST_OR_SERVICE' end as semantic_type,
  case when k % 4 = 0 then null else case when k % 3 = 0 then 'EMAIL' else 'NAME' end end as subtype, case when k % 5 = 0 then null else case k % 3 when 0 then 'INTERNAL' when 1 then 'CONFIDENTIAL' else 'SECRET' end end as sensitivity,
  k % 2 = 0 as reversible, concat('r', cast(k as varchar(10))) as rule from documents cross join (select n_nationkey + 1 as k from nation) t"""
_REGIONS = f"""w as ({_WORDS}), o as (select *, max("end") over (partition by doc_id order by start, "end" desc, rule rows between unbounded preceding and 1 preceding) as reach from w),
  g as (select *, sum(case when reach is null or start >= reach then 1 else 0 end) over (partition by doc_id order by start, "end" desc, rule rows unbounded preceding) - 1 as region from o)"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    for t in ("documents", "nation"):
        table(spark, folder, t).createOrReplaceTempView(t)
    return spark.sql(_WORDS.replace('"end"', "`end`"))


@_query("overlap_regions", f'with {_REGIONS} select doc_id, region::bigint as region, min(start) as start, max("end") as stop, count(*) as members from g group by doc_id, region')
def overlap_regions(spark: SparkSession, folder: str) -> DataFrame:
    return regions.bounds(regions.regions(_spans(spark, folder))).withColumnRenamed("end", "stop")


@_query("overlap_relations", f"""with {_REGIONS}, p as (select *, row_number() over (partition by doc_id, region order by start, "end" desc, rule) as n from g)
  select a.doc_id, a.region::bigint as region, string_agg(distinct case when a.start = b.start and a."end" = b."end" then 'IDENTICAL' when a.start <= b.start and a."end" >= b."end" then 'CONTAINING'
    when b.start <= a.start and b."end" >= a."end" then 'CONTAINED' when a.start < b."end" and b.start < a."end" then 'PARTIAL' end, ',' order by case when a.start = b.start and a."end" = b."end" then 'IDENTICAL' when a.start <= b.start and a."end" >= b."end" then 'CONTAINING'
    when b.start <= a.start and b."end" >= a."end" then 'CONTAINED' when a.start < b."end" and b.start < a."end" then 'PARTIAL' end) as relations
  from p a join p b on a.doc_id = b.doc_id and a.region = b.region and a.n < b.n where a.start < b."end" and b.start < a."end" or a.start = b.start and a."end" = b."end" or a.start <= b.start and a."end" >= b."end" group by 1, 2""")
def overlap_relations(spark: SparkSession, folder: str) -> DataFrame:
    return regions.relations(regions.regions(_spans(spark, folder))).withColumn("relations", F.array_join("relations", ","))


@_query("overlap_obligations", f"""with {_REGIONS} select doc_id, region::bigint as region, coalesce(string_agg(distinct semantic_type, ',' order by semantic_type), '') as semantic_types, coalesce(string_agg(distinct subtype, ',' order by subtype), '') as subtypes,
  coalesce(case max(case sensitivity when 'INTERNAL' then 1 when 'CONFIDENTIAL' then 2 when 'SECRET' then 4 end) when 1 then 'INTERNAL' when 2 then 'CONFIDENTIAL' when 4 then 'SECRET' end, 'UNKNOWN') as highest_sensitivity, bool_or(not reversible) as non_reversible,
  concat_ws(',', case when count(distinct semantic_type) > 1 then 'SEMANTIC_TYPE' end, case when count(distinct sensitivity) > 1 then 'SENSITIVITY' end, case when count(distinct subtype) > 1 then 'SUBTYPE' end) as conflicts from g group by doc_id, region""")
def overlap_obligations(spark: SparkSession, folder: str) -> DataFrame:
    out = regions.obligations(regions.regions(_spans(spark, folder)))
    return out.select("doc_id", "region", *(F.array_join(c, ",").alias(c) for c in ("semantic_types", "subtypes")), "highest_sensitivity", "non_reversible", F.array_join(F.array_sort("conflicts"), ",").alias("conflicts"))


@_query("overlap_adjacency", f"""with {_REGIONS}, b as (select doc_id, region, min(start) as start, max("end") as stop from g group by doc_id, region)
  select x.doc_id, x.region::bigint as left_region, y.region::bigint as right_region from b x join b y on x.doc_id = y.doc_id and x.stop = y.start""")
def overlap_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return regions.adjacent(regions.bounds(regions.regions(_spans(spark, folder))))


@_query("overlap_join", f"""with w as ({_WORDS}) select a.doc_id, a.rule as left_rule, b.rule as right_rule from w a join w b on a.doc_id = b.doc_id and a.start < b."end" and b.start < a."end" where a.semantic_type = 'PERSON' and b.semantic_type <> 'PERSON'""")
def overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    w = _spans(spark, folder)
    return regions.overlapping(w.where("semantic_type = 'PERSON'"), w.where("semantic_type <> 'PERSON'"), bucket=64).select("l.doc_id", F.col("l.rule").alias("left_rule"), F.col("r.rule").alias("right_rule"))


@_query("overlap_cover", f"""with {_REGIONS}, b as (select doc_id, region, min(start) as start, max("end") as stop from g group by doc_id, region), f as (select doc_id, start - 2 as start, "end" + 20 as stop from w)
  select doc_id, region, field_start, field_end from (select b.doc_id, b.region::bigint as region, f.start as field_start, f.stop as field_end, row_number() over (partition by b.doc_id, b.region order by f.stop - f.start, f.start, f.stop) as n
  from b left join f on b.doc_id = f.doc_id and f.start <= b.start and f.stop >= b.stop) where n = 1""")
def overlap_cover(spark: SparkSession, folder: str) -> DataFrame:
    w = _spans(spark, folder)
    fields = w.select("doc_id", (F.col("start") - 2).alias("start"), (F.col("end") + 20).alias("end"))
    return regions.smallest_cover(regions.bounds(regions.regions(w)), fields)


@_query("overlap_retention", f"with w as ({_WORDS}) select rule as basis, semantic_type, count(*) as n, count(distinct doc_id) as texts from w group by 1, 2")
def overlap_retention(spark: SparkSession, folder: str) -> DataFrame:
    return regions.retention(_spans(spark, folder).withColumn("basis", F.col("rule")))


@_query("mask_email", f"""with e as ({_EMAIL_SQL}), p as (select doc_id, list_sort(list({{'s': start, 'e': stop}})) as r from e group by doc_id)
  select doc_id, case when r is null then text else concat(array_to_string(list_transform(range(1, len(r) + 1), lambda i: substr(text, (case when i = 1 then 0 else r[i - 1].e end + 1)::int, (r[i].s - case when i = 1 then 0 else r[i - 1].e end)::int)), '[PROTECTED]'), '[PROTECTED]', substr(text, (r[len(r)].e + 1)::int)) end as text,
  coalesce(len(r), 0)::int as regions from documents left join p using (doc_id)""")
def mask_email(spark: SparkSession, folder: str) -> DataFrame:
    found = span_email(spark, folder).withColumnRenamed("stop", "end")
    return regions.masked(_texts(spark, folder), regions.bounds(regions.regions(found)))


@_query("message_mask", """select conv_id, turn, role, case when regexp_matches(text, '[0-9]{3}') then '[PROTECTED]' else text end as text from conversations""")
def message_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Whole messages with long numbers masked; role, order and count stay."""
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.when(F.col("text").rlike("[0-9]{3}"), "[PROTECTED]").otherwise(F.col("text")).alias("text"))


# ---- classification and policy -----------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"'{c}/{s}'" for c, subs in enums.SUBTYPES.items() for s in subs)
_CLASSES = ", ".join(f"'{c}'" for c in enums.SEMANTIC_CLASSES)
_LEVEL = "case {0} when 'PUBLIC' then 0 when 'INTERNAL' then 1 when 'CONFIDENTIAL' then 2 when 'RESTRICTED' then 3 when 'SECRET' then 4 end"
_NAME = "case {0} when 0 then 'PUBLIC' when 1 then 'INTERNAL' when 2 then 'CONFIDENTIAL' when 3 then 'RESTRICTED' when 4 then 'SECRET' else 'UNKNOWN' end"
_COMPOSED = f"""c as (select *, status = 'FOUND' as f, status = 'FOUND' and semantic_type in ({_CLASSES}) as known, concat(semantic_type, '/', subtype) in ({_PAIRS}) as registered from evidence),
 a as (select group_id, count(id) > count(distinct id) as twice, {', '.join(f"bool_or(status = 'FAILURE' and channel = '{x}') as {x}_failure" for x in ('detector', 'parser', 'semantic'))}, bool_or(status = 'ABSTAIN') as abstained, bool_or(f) as found, bool_or(f and channel = 'detector') as detector,
  bool_or(f and semantic_type = 'UNKNOWN') as unk, bool_or(f and semantic_type <> 'UNKNOWN' and not known) as unsup, coalesce(bool_or(known and subtype is not null and not registered), false) as badsub,
  count(distinct case when known then semantic_type end) as nt, min(case when known then semantic_type end) as t, count(distinct case when known and registered then subtype end) as ns, min(case when known and registered then subtype end) as s,
  count(distinct case when f then sensitivity end) as nl, count(distinct case when f then case when sensitivity = 'SECRET' then 1 end end) as sec, max(case when f then {_LEVEL.format('sensitivity')} end) as top, bool_or(f and semantic_type = 'CREDENTIAL_OR_SECRET') as cred,
  count(distinct case when f then scope end) as nc, min(case when f then scope end) as sc, count(distinct case when f then reversible end) as nr, coalesce(bool_or(f and not reversible), false) as norev,
  bool_or(f and sensitivity is null and semantic_type <> 'CREDENTIAL_OR_SECRET') as miss, coalesce(bool_or(f and channel = 'detector' and reversible), false) as drev, coalesce(bool_or(f and channel = 'detector' and scope is not null), false) as dsc from c group by group_id),
 b as (select *, nl + case when cred and sec = 0 then 1 else 0 end as kinds from a),
 d as (select *, concat_ws(',', case when abstained then 'ABSTAINED' end, case when nr > 1 then 'CONFLICTING_REVERSIBILITY' end, case when nc > 1 then 'CONFLICTING_SCOPE' end, case when nt > 1 then 'CONFLICTING_SEMANTIC_TYPE' end, case when kinds > 1 then 'CONFLICTING_SENSITIVITY' end, case when ns > 1 then 'CONFLICTING_SUBTYPE' end,
  case when detector_failure then 'DETECTOR_FAILURE' end, case when twice then 'DUPLICATE_EVIDENCE_ID' end, case when found and not detector then 'MISSING_DETECTOR_EVIDENCE' end, case when not found then 'MISSING_EVIDENCE' end, case when miss or found and kinds = 0 then 'MISSING_SENSITIVITY' end, case when parser_failure then 'PARSER_FAILURE' end,
  case when semantic_failure then 'SEMANTIC_FAILURE' end, case when unk then 'UNKNOWN_CLASS' end, case when unsup then 'UNSUPPORTED_CLASS' end, case when badsub then 'UNSUPPORTED_SUBTYPE' end) as reasons from b)
 select group_id, case when reasons = '' then 'RESOLVED' else 'UNRESOLVED' end as status, case when reasons = '' and nt = 1 then t else 'UNKNOWN' end as semantic_type, case when reasons = '' and ns = 1 then s end as subtype,
  {_NAME.format('case when cred then 4 else top end')} as sensitivity, reasons = '' and not cred and coalesce(top, 0) < 4 and drev and not norev as reversible, case when reasons = '' and dsc and nc = 1 then sc else 'request' end as scope, reasons from d"""


@_query("classify_evidence", f"{with_('evidence')}, {_COMPOSED}")
def classify_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return classification.composed(frame(spark, folder, "evidence"))


@_query("classify_sensitivity", f"""{with_('claims')}, l as (select *, {_LEVEL.format('sensitivity')} as lv from claims),
 g as (select group_id, coalesce(bool_or(status = 'FOUND' and origin = 'DETERMINISTIC' and credential), false) as cred, count(distinct case when status = 'FOUND' and origin = 'DETERMINISTIC' then sensitivity end) as kinds,
  max(case when status = 'FOUND' and origin = 'DETERMINISTIC' then lv end) as high, min(case when status = 'FOUND' and origin = 'DETERMINISTIC' then lv end) as low,
  max(case when status = 'FOUND' and origin = 'SEMANTIC' then case when credential then 4 else lv end end) as concern, min(case when status = 'FOUND' and origin = 'SEMANTIC' then coalesce(lv, case when credential then 4 end) end) as least,
  bool_or(status <> 'FOUND' and origin = 'DETERMINISTIC') as unsure, bool_or(status = 'FAILURE' and origin = 'SEMANTIC') as failed, bool_or(status = 'FOUND' and sensitivity is null and not coalesce(credential, false)) as missing from l group by group_id),
 h as (select *, case when cred then 4 else high end as floor_, greatest(case when cred then 4 else high end, coalesce(concern, -1)) as eff from g),
 i as (select *, unsure or failed or missing or floor_ is null or kinds > 1 and not cred as blocked from h)
 select group_id, case when blocked then 'UNRESOLVED' when coalesce(concern, floor_) > floor_ or coalesce(least, floor_) < floor_ or cred and coalesce(low, 4) < 4 then 'RESOLVED_CONSERVATIVELY' else 'RESOLVED' end as state,
  {_NAME.format('case when not blocked then floor_ end')} as floor, {_NAME.format('case when not blocked then eff end')} as effective, case when blocked then 0 else eff - floor_ end::bigint as escalation_steps from i""")
def classify_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return classification.resolved_sensitivity(frame(spark, folder, "claims"))


@_query("classify_attribute", f"""{with_('claims')} select group_id, case when bool_or(value = 'YES') then 'YES' when bool_or(value = 'NO' and origin = 'DETERMINISTIC') then 'NO' else 'UNKNOWN' end as value from claims group by group_id""")
def classify_attribute(spark: SparkSession, folder: str) -> DataFrame:
    return classification.resolved_attribute(frame(spark, folder, "claims"))


_SATISFIES = ", ".join(f"('{p}', '{f}')" for p, forms in enums.SATISFIES.items() for f in forms)
_FORMS = ", ".join(f"('{f}', {str(f in enums.SECRET_REPRESENTATIONS).lower()})" for f in enums.REPRESENTATIONS)


@_query("fidelity_division", f"""{with_('predicates')}, t(p, f) as (values {_SATISFIES}), k(f, safe) as (values {_FORMS}), q as (select distinct request_id, predicate, sensitivity in ('UNKNOWN', 'SECRET') as secret from predicates),
 n as (select request_id, count(*) as need, bool_or(secret) as secret, bool_or(predicate = 'EXACT_VALUE') as exact from q group by request_id), i as (select q.*, t.f from q join t on q.predicate = t.p join k on k.f = t.f where k.safe or not q.secret),
 s as (select request_id, string_agg(f, ',' order by f) as satisfying, bool_or(f <> 'WITHHELD') as open from (select request_id, f, count(*) as got from i group by 1, 2) join n using (request_id) where got = need group by 1),
 u as (select request_id, string_agg(predicate, ',' order by predicate) as unmet from q where not exists (select 1 from i where i.request_id = q.request_id and i.predicate = q.predicate) group by 1)
 select n.request_id, coalesce(satisfying, '') as satisfying, coalesce(unmet, '') as unmet, concat_ws(',', case when not coalesce(open, false) then 'UNMET_WITHIN_CEILING' end, case when secret and exact then 'USE_WITHOUT_REVEAL' end) as advice
 from n left join s using (request_id) left join u using (request_id)""")
def fidelity_division(spark: SparkSession, folder: str) -> DataFrame:
    return classification.fidelity(frame(spark, folder, "predicates"))


_DECIDED = f"""x as (select rule_id, profile_id, semantic_type, s.s as sensitivity, t.t as source_trust, o.o as operation, decision, review_treatments from rules, unnest(string_split(sensitivities, ',')) as s(s), unnest(string_split(source_trusts, ',')) as t(t), unnest(string_split(operations, ',')) as o(o)),
 m as (select profile_id, semantic_type, sensitivity, source_trust, operation, count(distinct rule_id) as n, min(rule_id) as rule_id, min(decision) as decision, min(review_treatments) as review_treatments from x group by all),
 j as (select r.*, p.exposure, p.permitted, p.max_cleartext, m.n, m.rule_id, m.decision, case when m.decision = 'REQUIRE_REVIEW' then string_split(m.review_treatments, ',') else [m.decision] end as ts from requests r left join profiles p using (profile_id) left join m using (profile_id, semantic_type, sensitivity, source_trust, operation)),
 k as (select *, len(list_filter(ts, lambda t: not (list_contains(string_split(permitted, ','), t) and not (exposure = 'EXTERNAL' and (sensitivity = 'SECRET' or semantic_type = 'CREDENTIAL_OR_SECRET') and t not in ('MASK', 'REMOVE')) and not (t = 'KEEP' and {_LEVEL.format('sensitivity')} > {_LEVEL.format('max_cleartext')})))) > 0 as unsafe from j),
 d as (select *, case when exposure is null or exposure <> trust_zone then 'PROFILE_MISMATCH' when status <> 'RESOLVED' then 'UNRESOLVED_CLASSIFICATION' when n is null then 'NO_RULE' when n > 1 then 'AMBIGUOUS_RULE' when decision = 'BLOCK' then 'RULE_BLOCK' when unsafe then 'UNSAFE_TREATMENT' when decision = 'REQUIRE_REVIEW' then 'RULE_REVIEW' else 'RULE_SELECTED' end as reason from k),
 e as (select request_id, profile_id, case reason when 'RULE_SELECTED' then 'SELECTED' when 'RULE_REVIEW' then 'HELD' else 'DENIED' end as state, case when reason in ('RULE_SELECTED', 'RULE_REVIEW') then decision else 'BLOCK' end as treatment, reason, case when reason in ('RULE_SELECTED', 'RULE_REVIEW') then rule_id end as rule_id from d)"""


@_query("policy_decisions", f"{with_('profiles', 'rules', 'requests')}, {_DECIDED} select request_id, state, treatment, reason, rule_id from e")
def policy_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return policy.decided(frame(spark, folder, "requests"), frame(spark, folder, "profiles"), frame(spark, folder, "rules"))


@_query("policy_reasons", f"{with_('profiles', 'rules', 'requests')}, {_DECIDED} select reason, state, treatment, count(*) as n from e group by 1, 2, 3")
def policy_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return policy_decisions(spark, folder).groupBy("reason", "state", "treatment").agg(F.count("*").alias("n"))


@_query("policy_reviewed", f"""{with_('profiles', 'rules', 'requests')}, {_DECIDED} select request_id, case when state = 'HELD' and request_id % 3 > 0 then 'SELECTED' else state end as state,
  case when state = 'HELD' and request_id % 3 > 0 then case request_id % 3 when 1 then 'MASK' else 'REMOVE' end else treatment end as treatment, case when state = 'HELD' and request_id % 3 > 0 then 'REVIEW_SELECTED' else reason end as reason, rule_id from e""")
def policy_reviewed(spark: SparkSession, folder: str) -> DataFrame:
    made = policy_decisions(spark, folder)
    outcome = F.when(F.col("request_id") % 3 == 1, "MASK").when(F.col("request_id") % 3 == 2, "REMOVE").otherwise("KEEP")
    return policy.reviewed(made, made.where("rule_id is not null").select("request_id", "rule_id", outcome.alias("treatment")), frame(spark, folder, "rules"))


_LEVELS = "case when {s} = 'DENIED' then 0 when {s} = 'HELD' then 10 else 21 + case {t} when 'REMOVE' then 0 when 'MASK' then 1 when 'TOKENIZE' then 2 when 'SYNTHETIC' then 3 when 'GENERALIZE' then 4 when 'KEEP' then 5 else -1 end end"


@_query("policy_simulation", f"""{with_('profiles', 'rules', 'requests')}, {_DECIDED}, a as (select request_id, state, treatment, profile_id, case when profile_id in (select profile_id from profiles) then profile_id end as k0 from e),
 b as (select request_id, case when request_id % 6 = 0 then 'DENIED' when request_id % 6 = 1 then 'SELECTED' else state end as s1, case when request_id % 6 = 0 then 'BLOCK' when request_id % 6 = 1 then 'MASK' else treatment end as t1, case when request_id % 6 = 2 then k0 || '-new' else k0 end as k1 from a),
 c as (select a.request_id, k0, k1, {_LEVELS.format(s='state', t='treatment')} as l0, {_LEVELS.format(s='s1', t='t1')} as l1 from a join b using (request_id))
 select request_id, case when k0 is null and k1 is null then 'UNAVAILABLE' when l1 > l0 then 'NEW_EXPOSURE' when l1 < l0 then 'NARROWED' when k1 is not null and k0 is distinct from k1 then 'SINK_REBOUND' else 'UNCHANGED' end as kind, l0::bigint as level_before, l1::bigint as level_after from c""")
def policy_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """A changed configuration against the present one, on every request as a probe."""
    made = policy_decisions(spark, folder).join(frame(spark, folder, "requests").select("request_id", "profile_id"), "request_id")
    made = made.join(frame(spark, folder, "profiles").select("profile_id", F.col("profile_id").alias("sink")), "profile_id", "left")
    m = F.col("request_id") % 6
    after = made.select("request_id", F.when(m == 0, "DENIED").when(m == 1, "SELECTED").otherwise(F.col("state")).alias("state"), F.when(m == 0, "BLOCK").when(m == 1, "MASK").otherwise(F.col("treatment")).alias("treatment"),
                        F.when(m == 2, F.concat("sink", F.lit("-new"))).otherwise(F.col("sink")).alias("sink"))
    return policy.simulated(made, after)


@_query("policy_exceptions", f"""{with_('exceptions', 'exception_uses')} select use_id, reason, case when reason = 'EXCEPTION_APPLICABLE' then 'APPLICABLE' else 'DENIED' end as state from (select u.use_id, case when e.exception_id is null then 'EXCEPTION_UNKNOWN' when e.revoked then 'EXCEPTION_REVOKED'
  when u.now >= e.expires_at then 'EXCEPTION_EXPIRED' when u.now < e.issued_at then 'EXCEPTION_NOT_YET_ACTIVE' when u.tenant is distinct from e.tenant then 'EXCEPTION_SCOPE_MISMATCH'
  when u.subject <> e.subject or u.purpose <> e.purpose or u.semantic_type <> e.semantic_type or u.sensitivity <> e.sensitivity or u.destination <> e.destination or u.operation <> e.operation then 'EXCEPTION_BINDING_MISMATCH'
  when u.active_revision is null then 'CONFIGURATION_UNAVAILABLE' when u.active_revision <> e.config_revision then 'EXCEPTION_CONFIG_SUPERSEDED' else 'EXCEPTION_APPLICABLE' end as reason from exception_uses u left join exceptions e using (exception_id))""")
def policy_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    return policy.excepted(frame(spark, folder, "exception_uses"), frame(spark, folder, "exceptions"))


# ---- measurement ---------------------------------------------------------------------------------------------------------

_FLAT = """select case_id, field_ref, start, "end", semantic_type, coalesce(subtype, '') as subtype, count(*) as {n} from {t} group by all"""
_KEYS = 'case_id, field_ref, start, "end", semantic_type, subtype'


@_query("eval_report", f"""{with_('planted', 'emitted')}, p as ({_FLAT.format(n='p', t='planted')}), e as ({_FLAT.format(n='e', t='emitted')}),
 g as (select case_id, sum(coalesce(p, 0))::bigint as planted, sum(coalesce(e, 0))::bigint as emitted, sum(least(coalesce(p, 0), coalesce(e, 0)))::bigint as matched from p full join e using ({_KEYS}) group by case_id)
 select case_id, planted, emitted, matched, planted - matched as missed, emitted - matched as false_positives, matched / nullif(planted, 0) as recall, matched / nullif(emitted, 0) as precision from g""")
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.report(frame(spark, folder, "planted"), frame(spark, folder, "emitted"))


@_query("eval_escapes", f"""{with_('planted', 'releases')}, v as (select distinct p.case_id, r.sink_id, p.value, max(contains(r.body, p.value)::int) as o from planted p join releases r using (case_id) where p.sensitivity = 'SECRET' group by 1, 2, 3)
 select case_id, sink_id, count(*) as secrets, sum(o)::bigint as escaped, case when sum(o) > 0 then 'fail' else 'pass' end as verdict from v group by 1, 2""")
def eval_escapes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.escapes(frame(spark, folder, "planted"), frame(spark, folder, "releases"))


_OUTCOMES = """s as (select p.occurrence_id, case when bool_or(e.semantic_type = p.semantic_type and coalesce(e.subtype, '') = coalesce(p.subtype, '')) then 'MATCHED' when count(e.case_id) > 0 then 'SPAN_COVERED_LABEL_DIFFERS' else 'NO_CANDIDATE_AT_SPAN' end as outcome
 from planted p left join emitted e on p.case_id = e.case_id and p.field_ref = e.field_ref and p.start = e.start and p."end" = e."end" group by 1)"""


@_query("eval_arm", f"{with_('planted', 'emitted')}, {_OUTCOMES} select occurrence_id, outcome from s")
def eval_arm(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.scored(frame(spark, folder, "planted"), frame(spark, folder, "emitted"))


@_query("eval_by_subtype", f"""{with_('planted', 'emitted')}, {_OUTCOMES} select semantic_type, subtype, count(*) as planted, count(*) filter (outcome = 'MATCHED') as matched, count(*) filter (outcome <> 'MATCHED') as missed from planted join s using (occurrence_id) group by 1, 2""")
def eval_by_subtype(spark: SparkSession, folder: str) -> DataFrame:
    planted = frame(spark, folder, "planted")
    return evaluation.by_subtype(planted, evaluation.scored(planted, frame(spark, folder, "emitted")))


@_query("eval_unmatched", f"""{with_('planted', 'emitted', 'negatives')}, e0 as (select *, event_id * 10 + case when semantic_type = 'PERSON' and event_id % 6 = 1 then 1 else 0 end as k from emitted), e as (select *, row_number() over (partition by case_id, field_ref, start, "end", semantic_type, subtype order by k) as n from e0),
 p as (select distinct case_id, field_ref, start, "end", semantic_type as t, coalesce(subtype, '') as s from planted),
 m as (select e.k, e.case_id, e.field_ref, e.start, e."end", e.semantic_type, e.n, coalesce(bool_or(p.t = e.semantic_type and p.s = coalesce(e.subtype, '')), false) as hit, count(p.t) as spans from e left join p on e.case_id = p.case_id and e.field_ref = p.field_ref and e.start = p.start and e."end" = p."end" group by all)
 select kind, count(*) as n from (select case when hit then 'DUPLICATE' when exists (select 1 from negatives n where n.case_id = m.case_id and n.field_ref = m.field_ref and n.not_a = m.semantic_type and m.start < n."end" and n.start < m."end") then 'NEGATIVE_CONTRADICTED' when spans > 0 then 'LABEL_DIFFERS' else 'UNRESOLVED' end as kind
 from m where not (hit and n = 1)) group by 1""")
def eval_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id") * 10 + F.when((F.col("semantic_type") == "PERSON") & (F.col("event_id") % 6 == 1), 1).otherwise(0)
    out = evaluation.unmatched(frame(spark, folder, "emitted").withColumn("event_id", k), frame(spark, folder, "planted"), frame(spark, folder, "negatives"))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@_query("eval_combined", f"""{with_('planted', 'emitted')}, a as (select distinct case_id, field_ref, start, "end", semantic_type, coalesce(subtype, '') as subtype, 1 as a from planted), b as (select distinct case_id, field_ref, start, "end", semantic_type, coalesce(subtype, '') as subtype, 1 as b from emitted)
 select case_id, count(*) filter (a is not null and b is not null) as both, count(*) filter (b is null) as only_left, count(*) filter (a is null) as only_right, count(*) as united from a full join b using ({_KEYS}) group by case_id""")
def eval_combined(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.combined(frame(spark, folder, "planted"), frame(spark, folder, "emitted"))


_QI = "concat_ws('|', concat('band:', band), concat('country:', country), concat('segment:', segment))"


def _reid(spark: SparkSession, folder: str) -> DataFrame:
    q = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).alias("handle"))
    return frame(spark, folder, "reid").withColumn("qi", F.array(q("country"), q("segment"), q("band")))


@_query("reid_cells", f"""{with_('reid')}, k as (select *, {_QI} as cell from reid), g as (select cell, count(*) as record_count, count(distinct site_ref) as site_count from k group by cell) select record_id, record_count, site_count, case when site_count = 1 then 'RISK' else 'COMMON' end as flag from k join g using (cell)""")
def reid_cells(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.cells(_reid(spark, folder))


@_query("reid_recommendations", f"""{with_('reid')}, n as (select 'country' as dimension, count(distinct country) as distinct_handles, 0 as o from reid union all select 'segment', count(distinct segment), 1 from reid union all select 'band', count(distinct band), 2 from reid)
 select record_id, dimension, distinct_handles, place from (select record_id, dimension, distinct_handles, row_number() over (partition by record_id order by distinct_handles, o) as place from reid cross join n where distinct_handles >= 2) where place <= 2""")
def reid_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.recommendations(_reid(spark, folder), ("country", "segment", "band"))


@_query("reid_confusion", f"""{with_('reid')}, k as (select *, {_QI} as cell from reid), g as (select cell, case when count(distinct site_ref) = 1 then 'RISK' else 'COMMON' end as local from k group by cell), v as (select label, local, coalesce(judge, 'ABSTAIN') as judge,
  case when local = 'RISK' or judge = 'RISK' then 'RISK' when coalesce(judge, 'ABSTAIN') = 'ABSTAIN' then 'ESCALATE' else 'COMMON' end as combined from k join g using (cell)), l as (select 'local' as signal, label, local as flag from v union all select 'judge', label, judge from v union all select 'combined', label, combined from v)
 select signal, count(*) as cases, count(*) filter (flag = 'RISK' and label = 'REIDENTIFIABLE') as true_flag, count(*) filter (flag = 'RISK' and label <> 'REIDENTIFIABLE') as false_flag, count(*) filter (flag in ('SAFE', 'COMMON') and label = 'REIDENTIFIABLE') as miss,
  count(*) filter (flag in ('SAFE', 'COMMON') and label <> 'REIDENTIFIABLE') as correct_safe, count(*) filter (flag in ('ABSTAIN', 'ESCALATE')) as abstained from l group by signal""")
def reid_confusion(spark: SparkSession, folder: str) -> DataFrame:
    records = _reid(spark, folder)
    flags = evaluation.cells(records).select("record_id", F.col("flag").alias("local")).join(records.select("record_id", "label", "judge"), "record_id")
    return evaluation.confusion(evaluation.verdicts(flags))


_REPLAY = """r as (select c.case_key, s.role, case when e.emission is null then 'UNKNOWN' else 'MEASURED' end as status, case when e.emission is null then 'UNKNOWN' when contains(e.emission, c.marker) then 'LEAKED' else 'HELD' end as privacy,
 case when e.task_answer is null or c.expected_answer is null then 'UNKNOWN' when e.task_answer = c.expected_answer then 'MATCH' else 'MISMATCH' end as utility, e.elapsed_ms from cases c cross join (values ('CHAMPION'), ('CHALLENGER')) s(role) left join emissions e on e.case_key = c.case_key and e.role = s.role)"""


@_query("replay_records", f"{with_('cases', 'emissions')}, {_REPLAY} select case_key, role, status, privacy, utility, elapsed_ms from r")
def replay_records(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.replayed(frame(spark, folder, "cases"), frame(spark, folder, "emissions"))


@_query("replay_summary", f"""{with_('cases', 'emissions')}, {_REPLAY} select role, count(*) as cases, count(*) filter (status = 'MEASURED') as measured, count(*) filter (privacy = 'LEAKED') as leaked, count(*) filter (utility = 'MATCH') as matches, count(*) filter (utility = 'MISMATCH') as mismatches,
 coalesce(sum(elapsed_ms), 0)::bigint as total_ms, coalesce(max(elapsed_ms), 0)::bigint as max_ms from r group by role""")
def replay_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.replay_summary(replay_records(spark, folder))


@_query("replay_disagreements", f"""{with_('cases', 'emissions')}, {_REPLAY}, p as (select a.case_key, f.field, case f.field when 'privacy' then a.privacy else a.utility end as champion, case f.field when 'privacy' then b.privacy else b.utility end as challenger from r a join r b on a.case_key = b.case_key and a.role = 'CHAMPION' and b.role = 'CHALLENGER' cross join (values ('privacy'), ('utility')) f(field))
 select case_key, field, champion, challenger from p where champion <> challenger order by case_key, field limit 64""")
def replay_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.disagreements(replay_records(spark, folder))


@_query("judge_levels", f"""{with_('answers')} select question_id, choice as level, choices from (select *, count(*) over (partition by question_id) as choices, row_number() over (partition by question_id order by p desc, place) as n from answers where p between 0 and 1) where n = 1""")
def judge_levels(spark: SparkSession, folder: str) -> DataFrame:
    answers = frame(spark, folder, "answers")
    return evaluation.measured_answers(answers.select("question_id", "choice", F.col("p").cast("double").alias("p")), answers.select("choice", "place").distinct())


@_query("judge_outcomes", f"""{with_('questions', 'replies')}, g as (select q.request_id, count(*) as n, count(*) filter (status = 'ANSWERED') as answered, coalesce(bool_or(status = 'REFUSED'), false) as refused, coalesce(max(latency_ms), 0) as ms from questions q left join replies r on q.request_id = r.request_id and q.question_id = r.question_id group by 1)
 select request_id, case when refused then 'REFUSED' when ms > 1000 then 'TIMEOUT' when answered = 0 then 'ABSTAINED' when answered < n then 'PARTIAL' else 'ANSWERED' end as outcome, answered from g""")
def judge_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.judged(frame(spark, folder, "questions"), frame(spark, folder, "replies"))


@_query("dependency_issues", f"""{with_('locked', 'sbom', 'published')}, f as (select path, count(*) as k, min({{'a': name, 'b': version, 'c': content, 'd': unsupported}}) as s from sbom where path is not null group by path), j as (select l.path as l, f.path as f, l.*, f.k, f.s.a as sa, f.s.b as sb, f.s.c as sc, f.s.d as sd from locked l full join f on l.path = f.path),
 c as (select 'SBOM_COMPONENT_DUPLICATE' as code from j where k > 1 union all select 'SBOM_COMPONENT_ABSENT_FROM_LOCKFILE' from j where l is null union all select 'DEPENDENCY_NOT_INTEGRITY_PINNED' from j where l is not null and integrity is null
 union all select 'DEPENDENCY_RESOLUTION_MISSING' from j where l is not null and resolved is null and not link union all select 'LOCKED_DEPENDENCY_ABSENT_FROM_SBOM' from j where f is null union all select 'DEPENDENCY_VERSION_MISMATCH' from j where l is not null and f is not null and (sb <> version or sa <> name)
 union all select 'DEPENDENCY_CONTENT_ALGORITHM_UNSUPPORTED' from j where l is not null and f is not null and sd union all select 'DEPENDENCY_CONTENT_MISSING' from j where l is not null and f is not null and not sd and sc is null union all select 'DEPENDENCY_CONTENT_MISMATCH' from j where l is not null and f is not null and not sd and sc is not null and integrity is not null and sc <> integrity
 union all select 'SBOM_COMPONENT_PATH_MISSING' from sbom where path is null union all select 'DEPENDENCY_NOT_IN_PUBLISHED_SET' from (select distinct name, version from locked) q where not exists (select 1 from published p where p.name = q.name and p.version = q.version)
 union all select 'DEPENDENCY_MISSING_FROM_PUBLISHED_SET' from (select distinct name, version from published) q where not exists (select 1 from locked p where p.name = q.name and p.version = q.version)) select code, count(*) as n from c group by code""")
def dependency_issues(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.compared(frame(spark, folder, "locked"), frame(spark, folder, "sbom"), frame(spark, folder, "published"))


# ---- references, lifecycle, chains ----------------------------------------------------------------------------------------

_TRANSITIONS = ", ".join(f"('{s}', '{a}', '{t}')" for (s, a), t in enums.TRANSITIONS.items())


@_query("lifecycle_step", f"""{with_('mappings', 'commands')}, t(s, a, target) as (values {_TRANSITIONS}), j as (select c.*, m.mapping_ref as known, m.tenant_id as mt, m.state, m.revision, m.created_at, m.expires_at, t.target from commands c left join mappings m on c.mapping_ref = m.mapping_ref left join t on t.s = m.state and t.a = c.action),
 r as (select *, case when known is null then 'UNKNOWN_MAPPING' when now < created_at then 'INVALID_CLOCK' when tenant_id <> mt then 'SCOPE_MISMATCH' when expected_revision <> revision then 'STALE_REVISION' when target is null then 'INVALID_TRANSITION' when target = state then 'UNCHANGED'
 when action = 'ACTIVATE' and now >= expires_at then 'EXPIRY_REACHED' when action = 'EXPIRE' and now < expires_at then 'NOT_EXPIRED' else 'CHANGED' end as reason from j)
 select command_id, case when reason in ('CHANGED', 'UNCHANGED') then reason else 'REFUSED' end as result, reason, case when reason = 'CHANGED' then target else state end as state, revision + case when reason = 'CHANGED' then 1 else 0 end as revision from r""")
def lifecycle_step(spark: SparkSession, folder: str) -> DataFrame:
    return mappings.stepped(frame(spark, folder, "mappings"), frame(spark, folder, "commands"))


@_query("authorization", f"""{with_('mappings', 'grants', 'uses')}, r as (select u.request_id, case when m.mapping_ref is null then 'UNKNOWN_MAPPING' when m.state <> 'ACTIVE' then 'MAPPING_NOT_ACTIVE' when u.now >= m.expires_at then 'MAPPING_EXPIRED' when m.semantic_type = 'CREDENTIAL_OR_SECRET' or m.sensitivity = 'SECRET' then 'NON_REVERSIBLE_MAPPING'
 when m.tenant_id <> u.tenant_id then 'SCOPE_MISMATCH' when g.grant_id is null then 'NO_GRANT' when g.mapping_ref <> m.mapping_ref then 'GRANT_MISMATCH' when g.revision <> m.revision then 'STALE_REVISION' when g.principal <> u.principal or g.tenant_id <> m.tenant_id then 'SCOPE_MISMATCH' when g.purpose <> u.purpose or g.destination <> u.destination then 'GRANT_MISMATCH'
 when g.operation <> u.operation then 'OPERATION_NOT_GRANTED' when u.now >= g.expires_at then 'GRANT_EXPIRED' else 'AUTHORIZED' end as reason from uses u left join mappings m using (mapping_ref) left join grants g using (grant_id))
 select request_id, reason, case when reason = 'AUTHORIZED' then 'AUTHORIZED' else 'DENIED' end as state from r""")
def authorization(spark: SparkSession, folder: str) -> DataFrame:
    return mappings.authorized(frame(spark, folder, "uses"), frame(spark, folder, "mappings"), frame(spark, folder, "grants"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return frame(spark, folder, "mappings").select(F.lit("tenant").alias("scope_kind"), "tenant_id", F.col("mapping_ref").alias("entity"), "semantic_type")


@_query("scoped_references")
def scoped_references(spark: SparkSession, folder: str) -> DataFrame:
    return mappings.referenced(_entities(spark, folder), KEY)


@_query("sealed_roundtrip", f"{with_('mappings')} select mapping_ref, tenant_id, tenant_id as value, cast(null as varchar) as moved from mappings")
def sealed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Values sealed and opened; opened under another tenant's name they are null."""
    key = b"0123456789abcdef0123456789abcdef"
    rows = mappings.sealed(frame(spark, folder, "mappings").select("mapping_ref", "tenant_id", F.col("tenant_id").alias("value")), key).drop("value")
    own = mappings.opened(rows, key)
    moved = mappings.opened(own.withColumnRenamed("value", "_own").withColumn("_tenant", F.col("tenant_id")).withColumn("tenant_id", F.lit("t-other")), key)
    return moved.select("mapping_ref", F.col("_tenant").alias("tenant_id"), F.col("_own").alias("value"), F.col("value").alias("moved"))


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return mappings.chained(e.select(F.col("user_id").alias("stream"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 5 == 0, "DENIED").otherwise("OK").alias("outcome"), F.col("event_id").alias("occurred_at"), "event_id"), KEY)


@_query("audit_verify", """with g as (select user_id as stream, count(*) as n from events group by 1) select stream, case when stream % 7 = 1 and n > 1 then 'TAMPERED' when stream % 7 = 2 then 'TAMPERED' when stream % 7 = 3 then 'UNANCHORED' else 'VERIFIED' end as status,
 case when stream % 7 = 1 and n > 1 then 'TAIL_TRUNCATED' when stream % 7 = 2 then 'CHAIN_BROKEN' when stream % 7 = 3 then 'NO_ANCHOR' else 'VERIFIED_TO_ANCHOR' end as finding, case when stream % 7 = 1 and n > 1 then n - 1 else n end as entries from g""")
def audit_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Chains with a cut tail, a changed entry or no anchor are told from whole ones."""
    entries = _chain(spark, folder)
    last = mappings.checkpoints(entries)
    cut = entries.join(last.select("stream", F.col("sequence").alias("_last")), "stream").where("not (stream % 7 = 1 and sequence = _last and sequence > 1)").drop("_last")
    bad = cut.withColumn("outcome", F.when((F.col("stream") % 7 == 2) & (F.col("sequence") == 1), "FORGED").otherwise(F.col("outcome")))
    return mappings.verified(bad, last.where("stream % 7 <> 3"), KEY)


@_query("audit_read", """select sequence, kind, outcome, matched, false as truncated from (select row_number() over (order by event_id) as sequence, event_type as kind, case when event_id % 5 = 0 then 'DENIED' else 'OK' end as outcome, 0 as z from events where user_id = 7) e
 cross join (select count(*) as matched from (select row_number() over (order by event_id) as s from events where user_id = 7) where s between 2 and 40) where sequence between 2 and 40""")
def audit_read(spark: SparkSession, folder: str) -> DataFrame:
    return mappings.read(_chain(spark, folder), 7, 2, 40).drop("entry_digest")


# ---- wire formats, parsing, views --------------------------------------------------------------------------------------------

@_query("stream_order", f"""{with_('fragments')}, w as (select *, lag(sequence) over (partition by stream_id order by arrival) as b, lag(final) over (partition by stream_id order by arrival) as f from fragments), g as (select *, case when sequence = coalesce(b + 1, 0) and not coalesce(f, false) then 1 else 0 end as ok from w)
 select stream_id, arrival, sequence, final, min(ok) over (partition by stream_id order by arrival rows unbounded preceding) = 1 as accepted from g""")
def stream_order(spark: SparkSession, folder: str) -> DataFrame:
    return wire.ordered(frame(spark, folder, "fragments"))


@_query("proof_freshness", f"{with_('proofs')} select event_id, now, issued_at, expires_at, issued_at <= now and issued_at >= now - 300 and expires_at > now and expires_at - issued_at <= 300 as fresh from proofs")
def proof_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return wire.fresh(frame(spark, folder, "proofs"))


@_query("chat_messages", """select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as place, role, text from conversations where conv_id in (select conv_id from conversations group by 1 having count(*) <= 64)""")
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as request bodies and read back through the translation."""
    return wire.messages(wire.built(table(spark, folder, "conversations").where("conv_id is not null and text is not null")), "conv_id")


@_query("event_props", """select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events where json_valid(props) and json_extract_string(props, '$.k') is not null""")
def event_props(spark: SparkSession, folder: str) -> DataFrame:
    return parsers.json_pairs(table(spark, folder, "events").select("event_id", "props"), "event_id", "props").where("path = 'k'")


@_query("event_json_spans", """select event_id, 'COMPLETE' as status, 'k' as path, json_extract_string(props, '$.k') as value, (strpos(props, ':') + 1)::int as start from events""")
def event_json_spans(spark: SparkSession, folder: str) -> DataFrame:
    got = parsers.json_fields(table(spark, folder, "events").select("event_id", F.col("props").alias("text")), "event_id")
    return got.select("event_id", "status", F.array_join("path", ".").alias("path"), "value", "start")


@_query("url_parts", """with u as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) as scheme, regexp_extract(url, '://([^/?#:]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#;]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages)
 select page_id, 'COMPLETE' as status, nullif(scheme, '') as scheme, nullif(host, '') as host, nullif(path, '') as path, nullif(query, '') as query, nullif(fragment, '') as fragment from u""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return parsers.url_parts(table(spark, folder, "pages")).select("page_id", "status", "scheme", "host", "path", "query", "fragment")


@_query("url_query_pairs", """select page_id, split_part(p, '=', 1) as name, url_decode(split_part(p, '=', 2)) as value from (select page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) as p from pages) where p <> ''""")
def url_query_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return parsers.query_pairs(parsers.url_parts(table(spark, folder, "pages"))).select("page_id", "name", "value")


@_query("content_types")
def content_types(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder).select("text").union(table(spark, folder, "events").select("props")).union(table(spark, folder, "pages").select("html")).union(table(spark, folder, "pages").select("url"))
    return texts.select(normalization.content_type().alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@_query("encoded_runs", f"""select doc_id, s::int as start, (s + length(v))::int as stop, v as value from ({_matched('[0-9A-Fa-f]{16,}')}) where not regexp_matches(before, '[0-9A-Za-z]') and not regexp_matches(after, '[0-9A-Za-z]')""")
def encoded_runs(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.runs(_texts(spark, folder)).where("encoding = 'HEX'").select("doc_id", "start", F.col("end").alias("stop"), "value")


@_query("normalized_views")
def normalized_views(spark: SparkSession, folder: str) -> DataFrame:
    return normalization.normalized(_texts(spark, folder)).groupBy("encoding", "depth", "status").agg(F.count("*").alias("n"))


@_query("known_values", """select b.item_id, d.doc_id from benchmark b join documents d on contains(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]', '', 'g'))""")
def known_values(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as known originals, looked for in every document by hashed heads and keyed hashes."""
    known = table(spark, folder, "benchmark").select(F.lit("t").alias("tenant_id"), F.col("item_id").cast("string").alias("ref"), F.lit("ORIGINAL").alias("kind"), F.col("text").alias("value"))
    messages = _texts(spark, folder).select("doc_id", F.lit("t").alias("tenant_id"), "text")
    return sentinel.matched(messages, known, KEY, "doc_id").select(F.col("ref").cast("long").alias("item_id"), "doc_id").distinct()


@_query("audit_hmac")
def audit_hmac(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", hmac_sha256(KEY, F.col("n_name")).alias("mac"))


def queries() -> dict[str, Query]:
    return _queries | planted.queries() | composed.queries() | assured.queries()


def oracle_sql() -> dict[str, str]:
    return _oracles | planted.oracle_sql() | composed.oracle_sql() | assured.oracle_sql()
