"""Inputs of the registered queries: SQL over the given tables that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table


def _pick(n: str, *values: str | None) -> str:
    """Value number ``n`` modulo their count."""
    whens = " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"case ({n}) % {len(values)} {whens} end"


TYPES = ("PERSON", "NETWORK_IDENTIFIER", "CLOUD_RESOURCE", "CREDENTIAL_OR_SECRET", "HOST_OR_SERVICE", "ENGINEERING_IDENTIFIER")
LEVELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "SECRET")

#: name -> (tables it reads, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "evidence": (("events",), f"""
        select event_id % 3000 as group_id, {_pick('event_id % 7', 'detector', 'parser', 'detector', 'semantic', 'detector', 'detector', 'parser')} as channel,
          concat('ev-', cast(event_id % 9500 as varchar(20))) as id, case when user_id % 41 = 0 then 'FAILURE' when user_id % 37 = 0 then 'ABSTAIN' else 'FOUND' end as status,
          case when user_id % 41 = 0 or user_id % 37 = 0 then null when event_id % 211 = 0 then 'UNKNOWN' when event_id % 199 = 0 then 'WEATHER' else {_pick('event_id % 3000', *TYPES)} end as semantic_type,
          case when user_id % 41 = 0 or user_id % 37 = 0 then null else {_pick('event_id % 3000', 'EMAIL', 'IP', None, 'API_KEY', None, 'PART_NUMBER')} end as subtype,
          case when event_id % 3000 % 6 = 3 or event_id % 97 = 0 then null else {_pick('event_id % 3000', *LEVELS[:4])} end as sensitivity,
          case when event_id % 5 = 0 then null else event_id % 3000 % 2 = 0 end as reversible,
          case when event_id % 4 = 0 then null else {_pick('event_id % 3000', 'request', 'session', 'project', 'tenant')} end as scope,
          cast(null as double) as confidence
        from events"""),
    "claims": (("events",), f"""
        select event_id % 2500 as group_id, case when event_id % 3 = 2 then 'SEMANTIC' else 'DETERMINISTIC' end as origin,
          case when user_id % 43 = 0 then 'FAILURE' when user_id % 29 = 0 then 'ABSTAIN' else 'FOUND' end as status,
          case when user_id % 43 = 0 or user_id % 29 = 0 or event_id % 101 = 0 then null else {_pick('event_id % 2500 + case when event_id % 3 = 2 then event_id % 2 else 0 end', *LEVELS)} end as sensitivity,
          case when user_id % 43 = 0 or user_id % 29 = 0 then null else event_id % 53 = 0 end as credential,
          {_pick('user_id', 'YES', 'NO', 'UNKNOWN')} as value
        from events"""),
    "predicates": (("events",), f"""
        select distinct event_id % 900 as request_id, {_pick('event_id % 11', 'KIND', 'EXISTENCE', 'SYNTAX', 'RELATIONSHIP', 'EXACT_VALUE', 'VALUE_SHAPE', 'CONSISTENCY', 'GENERALIZED', 'NOT_REQUIRED', 'KIND', 'SYNTAX')} as predicate,
          {_pick('event_id % 900', 'PUBLIC', 'SECRET', 'CONFIDENTIAL', 'UNKNOWN')} as sensitivity
        from events"""),
    "profiles": (("nation",), f"""
        select concat('p-', cast(n_nationkey as varchar(10))) as profile_id, case when n_nationkey % 2 = 0 then 'EXTERNAL' else 'LOCAL' end as exposure,
          {_pick('n_nationkey', 'KEEP,MASK,REMOVE', 'KEEP,MASK,TOKENIZE,REMOVE,GENERALIZE', 'MASK,REMOVE')} as permitted, {_pick('n_nationkey', 'INTERNAL', 'RESTRICTED', 'PUBLIC')} as max_cleartext
        from nation"""),
    "rules": (("nation",), f"""
        select concat('r-', cast(n.n_nationkey as varchar(10)), '-', cast(k.n_nationkey as varchar(10))) as rule_id, concat('p-', cast(n.n_nationkey as varchar(10))) as profile_id,
          {_pick('k.n_nationkey', *TYPES)} as semantic_type, case when k.n_nationkey % 2 = 0 then 'PUBLIC,INTERNAL,SECRET' else 'CONFIDENTIAL,RESTRICTED,INTERNAL' end as sensitivities,
          'TRUSTED,UNTRUSTED' as source_trusts, case when k.n_nationkey % 5 = 0 then 'SEND,USE' else 'SEND' end as operations,
          {_pick('n.n_nationkey + k.n_nationkey', 'MASK', 'KEEP', 'REQUIRE_REVIEW', 'BLOCK', 'REMOVE')} as decision, 'MASK,REMOVE' as review_treatments
        from nation n cross join nation k where k.n_nationkey < 9"""),
    "requests": (("orders",), f"""
        select o_orderkey as request_id, concat('p-', cast(o_custkey % 27 as varchar(10))) as profile_id, case when o_custkey % 27 % 2 = 0 then 'EXTERNAL' else 'LOCAL' end as trust_zone,
          case when o_orderkey % 3 = 0 then 'USE' else 'SEND' end as operation, {_pick('o_orderkey', 'TRUSTED', 'UNTRUSTED', 'HOSTILE', 'TRUSTED')} as source_trust,
          case when o_orderkey % 17 = 0 then 'UNRESOLVED' else 'RESOLVED' end as status, {_pick('o_custkey', *TYPES)} as semantic_type, {_pick('o_orderkey', *LEVELS)} as sensitivity
        from orders"""),
    "mappings": (("customer",), f"""
        select concat('m-', cast(c_custkey as varchar(10))) as mapping_ref, concat('t-', cast(c_nationkey as varchar(10))) as tenant_id,
          {_pick('c_custkey', 'CREATED', 'ACTIVE', 'ACTIVE', 'EXPIRED', 'ACTIVE', 'REVOKED', 'DELETED')} as state, cast(1 + c_custkey % 3 as bigint) as revision,
          cast(1000 + c_custkey as bigint) as created_at, cast(5000 + c_custkey * 3 as bigint) as expires_at, {_pick('c_custkey', *TYPES)} as semantic_type, {_pick('c_custkey', *LEVELS)} as sensitivity
        from customer"""),
    "commands": (("orders",), f"""
        select o_orderkey as command_id, concat('m-', cast(o_custkey + o_orderkey % 50 as varchar(10))) as mapping_ref, concat('t-', cast(c_nationkey as varchar(10))) as tenant_id,
          cast(1 + o_orderkey % 3 as bigint) as expected_revision, {_pick('o_orderkey', 'ACTIVATE', 'EXPIRE', 'REVOKE', 'DELETE')} as action, cast(900 + o_orderkey % 9000 as bigint) as now
        from orders left join customer on c_custkey = o_custkey + o_orderkey % 50"""),
    "grants": (("customer",), f"""
        select concat('g-', cast(c_custkey as varchar(10))) as grant_id, concat('m-', cast(c_custkey as varchar(10))) as mapping_ref, cast(1 + c_custkey % 3 as bigint) as revision,
          concat('u-', cast(c_custkey % 5 as varchar(10))) as principal, concat('t-', cast(c_nationkey as varchar(10))) as tenant_id, 'support' as purpose, concat('d-', cast(c_custkey % 2 as varchar(10))) as destination,
          {_pick('c_custkey', 'USE', 'DISPLAY', 'USE', 'EXPORT')} as operation, cast(6000 + c_custkey as bigint) as expires_at
        from customer where c_custkey % 11 <> 0"""),
    "uses": (("orders",), f"""
        select o_orderkey as request_id, concat('m-', cast(o_custkey as varchar(10))) as mapping_ref, concat('g-', cast(o_custkey as varchar(10))) as grant_id, concat('t-', cast(c_nationkey as varchar(10))) as tenant_id,
          concat('u-', cast(case when o_orderkey % 4 = 0 then o_orderkey else o_custkey end % 5 as varchar(10))) as principal, case when o_orderkey % 19 = 0 then 'audit' else 'support' end as purpose,
          concat('d-', cast(o_custkey % 2 as varchar(10))) as destination, {_pick('o_orderkey', 'USE', 'USE', 'DISPLAY')} as operation, cast(2000 + o_orderkey % 7000 as bigint) as now
        from orders left join customer on c_custkey = o_custkey"""),
    "planted": (("documents",), """
        select doc_id as occurrence_id, doc_id % 200 as case_id, 'body' as field_ref, cast(n_chars % 90 as bigint) as start, cast(n_chars % 90 + 8 as bigint) as "end",
          case when doc_id % 3 = 0 then 'CREDENTIAL_OR_SECRET' else 'PERSON' end as semantic_type, case when doc_id % 4 = 0 then null else 'EMAIL' end as subtype,
          substring(text, 1, 12) as value, case when doc_id % 3 = 0 then 'SECRET' else 'INTERNAL' end as sensitivity from documents"""),
    "emitted": (("documents",), """
        select doc_id as event_id, doc_id % 200 as case_id, 'body' as field_ref, cast((n_chars + case when doc_id % 7 = 0 then 1 else 0 end) % 90 as bigint) as start,
          cast((n_chars + case when doc_id % 7 = 0 then 1 else 0 end) % 90 + 8 as bigint) as "end", case when doc_id % 3 = 0 then 'CREDENTIAL_OR_SECRET' else 'PERSON' end as semantic_type,
          case when doc_id % 8 = 0 then null else 'EMAIL' end as subtype from documents where doc_id % 5 <> 0
        union all select doc_id, doc_id % 200, 'body', cast(n_chars % 90 as bigint), cast(n_chars % 90 + 8 as bigint), 'PERSON', 'EMAIL' from documents where doc_id % 6 = 1"""),
    "negatives": (("documents",), """
        select doc_id % 200 as case_id, 'body' as field_ref, cast(n_chars % 80 as bigint) as start, cast(n_chars % 80 + 5 as bigint) as "end", 'PERSON' as not_a from documents where doc_id % 9 = 4"""),
    "releases": (("documents",), """
        select doc_id % 200 as case_id, concat('sink-', cast(doc_id % 2 as varchar(5))) as sink_id, text as body from documents"""),
    "reid": (("customer",), """
        select c_custkey as record_id, concat('s-', cast(c_custkey % 97 as varchar(10))) as site_ref, cast(c_nationkey as varchar(10)) as country, c_mktsegment as segment, cast(c_custkey % 6 as varchar(10)) as band,
          case when c_custkey % 5 = 0 then 'REIDENTIFIABLE' else 'SAFE' end as label,
          case c_custkey % 4 when 0 then 'RISK' when 1 then 'SAFE' when 2 then 'ABSTAIN' end as judge from customer"""),
    "cases": (("documents",), """
        select doc_id as case_key, substring(text, 1, 6) as marker, case when doc_id % 10 = 0 then null else lang end as expected_answer from documents"""),
    "emissions": (("documents",), """
        select doc_id as case_key, 'CHAMPION' as role, substring(text, 1, 40) as emission, lang as task_answer, cast(n_chars % 130 as bigint) as elapsed_ms from documents where doc_id % 13 <> 0
        union all select doc_id, 'CHALLENGER', substring(text, 4, 40), case when doc_id % 4 = 0 then 'xx' else lang end, cast(n_chars % 170 as bigint) from documents where doc_id % 17 <> 0"""),
    "locked": (("part",), """
        select concat('node_modules/', cast(p_partkey as varchar(10))) as path, concat('pkg-', cast(p_partkey as varchar(10))) as name, concat('1.', cast(p_partkey % 9 as varchar(10))) as version,
          case when p_partkey % 31 = 0 then null else concat('h', cast(p_partkey % 1000 as varchar(10))) end as integrity, case when p_partkey % 23 = 0 then null else 'https://registry.invalid/' end as resolved, p_partkey % 46 = 0 as link from part where p_partkey % 12 <> 0"""),
    "sbom": (("part",), """
        select case when p_partkey % 53 = 0 then null else concat('node_modules/', cast(p_partkey as varchar(10))) end as path, concat('pkg-', cast(p_partkey as varchar(10))) as name,
          concat('1.', cast((p_partkey + case when p_partkey % 19 = 0 then 1 else 0 end) % 9 as varchar(10))) as version, case when p_partkey % 29 = 0 then null else concat('h', cast((p_partkey + case when p_partkey % 37 = 0 then 1 else 0 end) % 1000 as varchar(10))) end as content, p_partkey % 41 = 0 as unsupported
        from part where p_partkey % 14 <> 0 union all select concat('node_modules/', cast(p_partkey as varchar(10))), concat('pkg-', cast(p_partkey as varchar(10))), '9.9', 'zz', false from part where p_partkey % 59 = 1"""),
    "published": (("part",), """
        select concat('pkg-', cast(p_partkey as varchar(10))) as name, concat('1.', cast(p_partkey % 9 as varchar(10))) as version from part where p_partkey % 15 <> 0"""),
    "fragments": (("events",), """
        select user_id as stream_id, event_id as arrival, cast(row_number() over (partition by user_id order by event_id) - 1 + case when event_id % 97 = 0 then 1 else 0 end as bigint) as sequence, event_id % 61 = 0 as final from events"""),
    "proofs": (("events",), """
        select event_id, cast(10000 + event_id as bigint) as now, cast(10000 + event_id - user_id % 400 as bigint) as issued_at, cast(10000 + event_id - user_id % 400 + 60 * (event_id % 7) as bigint) as expires_at from events"""),
    "exceptions": (("customer",), f"""
        select concat('x-', cast(c_custkey as varchar(10))) as exception_id, c_custkey % 13 = 0 as revoked, cast(1000 + c_custkey % 700 as bigint) as issued_at, cast(2500 + c_custkey % 900 as bigint) as expires_at,
          concat('t-', cast(c_nationkey as varchar(10))) as tenant, cast(1 + c_custkey % 2 as bigint) as config_revision, concat('u-', cast(c_custkey % 5 as varchar(10))) as subject, 'support' as purpose,
          {_pick('c_custkey', *TYPES)} as semantic_type, {_pick('c_custkey', *LEVELS)} as sensitivity, 'd-1' as destination, 'SEND' as operation from customer"""),
    "exception_uses": (("orders",), f"""
        select o_orderkey as use_id, concat('x-', cast(o_custkey + o_orderkey % 40 * 0 + case when o_orderkey % 45 = 0 then 100000 else 0 end as varchar(10))) as exception_id, cast(900 + o_orderkey % 2200 as bigint) as now,
          concat('t-', cast(case when o_orderkey % 33 = 0 then 99 else c_nationkey end as varchar(10))) as tenant, case when o_orderkey % 50 = 0 then null else cast(1 as bigint) end as active_revision,
          concat('u-', cast(o_custkey % 5 as varchar(10))) as subject, case when o_orderkey % 21 = 0 then 'audit' else 'support' end as purpose, {_pick('o_custkey', *TYPES)} as semantic_type, {_pick('o_custkey', *LEVELS)} as sensitivity, 'd-1' as destination, 'SEND' as operation
        from orders left join customer on c_custkey = o_custkey"""),
    "answers": (("events",), """
        select user_id % 40 as question_id, concat('level-', cast(event_id % 5 as varchar(5))) as choice, event_id % 5 as place, max((event_id % 17) / 20.0) as p from events group by user_id % 40, event_id % 5"""),
    "questions": (("events",), """
        select distinct event_id % 800 as request_id, user_id % 6 as question_id from events"""),
    "replies": (("events",), """
        select event_id % 800 as request_id, user_id % 6 as question_id, min(case when user_id % 31 = 0 then 'REFUSED' when event_id % 3 = 0 then 'ABSTAINED' else 'ANSWERED' end) as status, cast(max(event_id % 1009) as bigint) as latency_ms
        from events where event_id % 4 <> 0 group by event_id % 800, user_id % 6"""),
}
#: Comma-joined columns that are arrays.
ARRAYS = {"profiles": ("permitted",), "rules": ("sensitivities", "source_trusts", "operations", "review_treatments"), "negatives": ("not_a",)}


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    from pyspark.sql import functions as F

    tables, sql = SQL[name]
    for t in {*tables} | ({"customer"} if "customer" in sql else set()):
        table(spark, folder, t).createOrReplaceTempView(t)
    out = spark.sql(sql.replace('"end"', "`end`"))
    for c in ARRAYS.get(name, ()):
        out = out.withColumn(c, F.split(c, ","))
    return out


def with_(*names: str) -> str:
    """The fixtures as common table expressions, for SQL of the same name."""
    return "with " + ", ".join(f"{n} as ({SQL[n][1]})" for n in names)
