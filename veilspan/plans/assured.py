"""Queries of ``operators.assurance``: rows of the tables with one fault planted in each, so that the SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assurance
from ..sources.tables import table
from .planted import Query, _rows

#: What is spoilt in a release, and the codes that must follow.
FAULTS = (
    ("", ()), ("expires_at = 400", ("EVIDENCE_EXPIRED", "EVIDENCE_WINDOW_INVALID")), ("issued_at = 1001", ("EVIDENCE_FUTURE_DATED",)), ("issued_at = 100", ("EVIDENCE_TOO_OLD",)), ("version = '0'", ("RELEASE_VERSION_MISMATCH",)),
    ("commit = '0'", ("SOURCE_COMMIT_MISMATCH",)), ("profile_id = '0'", ("CHANNEL_PROFILE_MISMATCH",)), ("artifact_name = '../a'", ("ARTIFACT_NAME_NOT_ALLOWED",)), ("artifact = ''", ("ARTIFACT_EVIDENCE_MISSING",)),
    ("artifact = 'other'", ("ARTIFACT_DIGEST_MISMATCH", "ARTIFACT_SIZE_MISMATCH")), ("lockfile = null", ("LOCKFILE_EVIDENCE_MISSING",)), ("pinned_lock = '0'", ("LOCKFILE_NOT_INDEPENDENTLY_PINNED",)), ("sbom = 'other'", ("SBOM_DIGEST_MISMATCH",)),
    ("scanner = null", ("SCANNER_EVIDENCE_MISSING",)), ("scanner = '{}'", ("SCANNER_DIGEST_MISMATCH",)), ("scanners = array('z')", ("SCANNER_NOT_TRUSTED",)), ("block_at = 'low'", ("FINDING_BLOCKS_PROMOTION",)),
    ("required = array()", ("CONFORMANCE_ADAPTER_UNKNOWN",)), ("adapters = array()", ("CONFORMANCE_ADAPTER_MISSING",)), ("conformance = array()", ("CONFORMANCE_EVIDENCE_MISSING",)),
    ("conformance = array(named_struct('adapter_id', 'a', 'body', '{}'))", ("CONFORMANCE_DIGEST_MISMATCH",)), ("conformance = array_repeat(conformance[0], 2)", ("CONFORMANCE_EVIDENCE_DUPLICATE",)),
    ("required = array(named_struct('adapter_id', 'a', 'suite_sha256', '0'))", ("CONFORMANCE_SUITE_MISMATCH",)), ("e_scope = 'other'", ("CHANNEL_SCOPE_MISMATCH", "CONFORMANCE_SCOPE_MISMATCH")), ("issued_at = null", ("EVIDENCE_FUTURE_DATED", "EVIDENCE_TOO_OLD", "EVIDENCE_WINDOW_INVALID")),
    ("now = 1700", ("CONFORMANCE_EVIDENCE_STALE", "EVIDENCE_TOO_OLD", "SCANNER_EVIDENCE_STALE")), ("claimed = false", ("EVIDENCE_MISSING",)),
)


def release_codes(spark: SparkSession, folder: str) -> DataFrame:
    """One release of each supplier, spoilt in one way or sound."""
    ids = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("release_id"))
    lock, sbom, artifact = (F.concat(F.lit(x), F.col("release_id").cast("string")) for x in ("lock ", "sbom ", "bytes "))
    r = ids.select("release_id", artifact.alias("artifact"), lock.alias("lockfile"), sbom.alias("sbom"), F.lit(True).alias("claimed"))
    for c in ("artifact", "lockfile", "sbom"):
        r = r.withColumn({"artifact": "artifact_sha256", "lockfile": "lock_sha256", "sbom": "sbom_sha256"}[c], F.sha2(c, 256))
    r = r.withColumn("artifact_bytes", F.octet_length("artifact").cast("long"))
    for c, v in {"issued_at": 500, "expires_at": 2000, "now": 1000, "max_age": 600}.items():
        r = r.withColumn(c, F.lit(v).cast("long"))
    for c, v in {"version": "1.0", "e_version": "1.0", "commit": "c0", "e_commit": "c0", "scope_ref": "s", "e_scope": "s", "profile_id": "p", "e_profile": "p", "artifact_name": "a.tgz", "e_artifact": "a.tgz", "block_at": "high"}.items():
        r = r.withColumn(c, F.lit(v))
    body = "to_json(named_struct('adapter_id', 'a', 'version', 1, 'suite_sha256', 'f', 'scope_ref', 's', 'artifact_sha256', artifact_sha256, 'lock_sha256', lock_sha256, 'sbom_sha256', sbom_sha256, 'completed_at', 900, 'planted_egress', 'PASS', 'functional_tests', 'PASS', 'overall', 'PASS', 'cases', array(named_struct('outcome', 'PASS', 'violations', 0))))"
    scan = "to_json(named_struct('scanner_id', 'q', 'completed', true, 'lock_sha256', lock_sha256, 'sbom_sha256', sbom_sha256, 'completed_at', 900, 'findings', array(named_struct('severity', 'moderate'))))"
    r = r.withColumn("pinned_lock", F.col("lock_sha256")).withColumn("scanner", F.expr(scan)).withColumn("scanner_sha256", F.sha2("scanner", 256)).withColumn("body", F.expr(body)).withColumn("scanners", F.array(F.lit("q")))
    r = r.withColumn("adapters", F.expr("array(named_struct('adapter_id', 'a', 'evidence_sha256', sha2(body, 256)))")).withColumn("conformance", F.expr("array(named_struct('adapter_id', 'a', 'body', body))"))
    r = r.withColumn("required", F.expr("array(named_struct('adapter_id', 'a', 'suite_sha256', 'f'))"))
    for k, (fault, _) in enumerate(FAULTS):
        if fault:
            c, v = fault.split(" = ", 1)
            r = r.withColumn(c, F.expr(f"if(release_id % {len(FAULTS)} = {k}, {v}, {c})"))
    evidence = r.where("claimed").select("release_id", "issued_at", "expires_at", "version", "commit", "scope_ref", "profile_id", "artifact_name", "artifact_sha256", "artifact_bytes", "lock_sha256", "sbom_sha256", "scanner_sha256", "adapters")
    expected = r.select("release_id", "now", "max_age", "e_version", "e_commit", "e_scope", "e_profile", "e_artifact", "pinned_lock", "block_at", "scanners", "required")
    return assurance.release_codes(evidence, expected, r.select("release_id", "artifact", "lockfile", "sbom", "scanner", "conformance"))


_REFERENCES = """select distinct concat('r', cast(c_custkey as varchar(20))) as ref, concat('t', cast(c_nationkey % 5 as varchar(9))) as tenant_id, concat('p', cast(c_nationkey as varchar(9))) as project_id, concat('s', cast(c_custkey % 7 as varchar(9))) as session_id,
  concat('v', cast(c_custkey % 3 as varchar(9))) as provenance_ref, concat('u', cast(c_custkey % 11 as varchar(9))) as principal_id, 'support' as purpose, concat('d', cast(c_custkey % 2 as varchar(9))) as destination_id from customer"""


def scope_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts on every reference, at a boundary that asks for the whole scope and at one that forgets the destination."""
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    references = spark.sql(_REFERENCES)
    loose = tuple(c for c in assurance.SCOPE if c != "destination_id")
    return assurance.scope_contract(references).withColumn("held", F.lit("all")).unionByName(assurance.scope_contract(references, loose).withColumn("held", F.lit("loose")))


_ATTEMPTS = _rows([("authorized-use", True, True), *((m, False, False) for m in assurance.MUTATIONS), ("display-not-use", True, False), ("export-not-display", True, False)])
_SCOPE_SQL = f"""select ref as of, label, boundary, case when case boundary when 'resolution' then r else a end then 'allow' else 'deny' end as expected, case when held = 'loose' and label = 'wrong-destination' then 'fail' else 'pass' end as outcome, held
  from ({_REFERENCES}) cross join (values {_ATTEMPTS}) t(label, r, a) cross join (values ('resolution'), ('authorization')) b(boundary) cross join (values ('all'), ('loose')) h(held)"""


def task_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of every order: graded, or the first thing that is missing."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("case_id"), (F.col("o_orderkey") % 10).cast("int").alias("k"))
    cases = o.select("case_id", (F.col("k") != 0).alias("has_task"), F.when(F.col("k") != 1, F.lit("yes")).alias("expected"), F.when(F.col("k") != 3, F.lit("model")).alias("required_sink"))
    results = o.where("k <> 2").select("case_id", F.when(F.col("k") == 5, F.lit(None)).when(F.col("k") == 6, F.lit("no")).otherwise(F.lit("yes")).alias("result"))
    captures = o.select("case_id", F.when(F.col("k") == 4, F.lit("log")).otherwise(F.lit("model")).alias("sink_id"))
    return assurance.task_grades(cases, results.union(results), captures.union(captures), o.where("case_id % 3 = 0").select("case_id"))


_TASKS_SQL = """select o_orderkey::bigint as case_id, case when o_orderkey % 10 = 6 then false when o_orderkey % 10 >= 7 then true end as task_correct,
  case o_orderkey % 10 when 0 then 'no-task-control' when 1 then 'no-task-control' when 2 then 'no-task-result' when 3 then 'no-task-sink-binding' when 4 then 'no-capture' when 5 then 'grader-error' end as untested,
  case when o_orderkey % 3 = 0 then 'observed-only' else 'no-operational-observation' end as operational from orders"""


def corpus_problems(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("record_id"), (F.col("c_custkey") % 9).alias("k"))
    role = F.when(F.col("k") == 1, "OTHER").when(F.col("k").isin(2, 3), "EVALUATED_CASE").otherwise("POPULATION_BACKGROUND")
    dims = F.when(F.col("k") == 6, F.expr("cast(array() as array<string>)")).when(F.col("k") == 7, F.array(F.lit("city"), F.lit("city"))).otherwise(F.array(F.lit("city"), F.lit("year")))
    r = c.select("record_id", role.alias("role"), F.when(F.col("k").isin(3, 4), "RISK").alias("label"), (F.col("k") != 5).alias("name_replaced"), dims.alias("dimensions"))
    return assurance.corpus_problems(r.union(r.where("record_id % 9 = 8")))


def replay_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A case of every order: the second of a key, families, tenants, texts and markers that do not hold."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("place"), (F.col("o_orderkey") % 8).alias("k"))
    key = F.concat(F.lit("case-"), F.col("place").cast("string"))
    marker = F.concat(F.lit(assurance.MARKER), F.substring(F.sha2(key, 256), 1, 16))
    cases = o.select(
        "place", key.alias("case_key"), F.when(F.col("k") == 1, "H01").otherwise("D03").alias("family"), F.when(F.col("k") == 2, "other").otherwise("own").alias("tenant"),
        F.when(F.col("k") == 3, "").when(F.col("k") == 4, F.repeat(F.lit("é"), 4097)).when(F.col("k") == 5, "no marker").otherwise(F.concat(F.lit("x "), marker)).alias("text"), F.when(F.col("k") == 6, "NONE").otherwise("DENY").alias("expectation"))
    again = cases.where("place % 8 = 7").withColumn("place", F.col("place") + 10_000_000_000)
    return assurance.replay_cases(cases.union(again), "own")


_REPLAY_SQL = """select o_orderkey::bigint as place, concat('case-', o_orderkey) as case_key, case o_orderkey % 8 when 1 then 'CASE_FAMILY_NOT_DEVELOPMENT' when 2 then 'FOREIGN_TENANT_SCOPE' when 3 then 'CASE_TEXT_INVALID' when 4 then 'CASE_TEXT_TOO_LARGE'
  when 5 then 'CASE_MARKER_EXPECTATION_MISMATCH' when 6 then 'CASE_MARKER_EXPECTATION_MISMATCH' end as reason from orders union all select o_orderkey::bigint + 10000000000, concat('case-', o_orderkey), 'CASE_KEY_DUPLICATE' from orders where o_orderkey % 8 = 7"""
#: Annotations: (entity, subtype, personal, special, jurisdictions, sensitivity, predicates, valid).
ANNOTATED = (
    ("entity-1", "EMAIL", "YES", "NO", "SE,NO", "INTERNAL", "KIND,SYNTAX", True), (None, None, "YES", "YES", "", "SECRET", "NOT_REQUIRED", True), ("entity_1", "EMAIL", "YES", "NO", "", "INTERNAL", "KIND", False), (None, "email", "YES", "NO", "", "INTERNAL", "KIND", False),
    (None, "EMAIL", "NO", "YES", "", "INTERNAL", "KIND", False), (None, "EMAIL", "MAYBE", "NO", "", "INTERNAL", "KIND", False), (None, "EMAIL", "YES", "NO", "SE,SE", "INTERNAL", "KIND", False), (None, "EMAIL", "YES", "NO", "swe", "INTERNAL", "KIND", False),
    (None, "EMAIL", "YES", "NO", "", "HIGH", "KIND", False), (None, "EMAIL", "YES", "NO", "", "INTERNAL", "", False), (None, "EMAIL", "YES", "NO", "", "INTERNAL", "KIND,NOT_REQUIRED", False), (None, "EMAIL", "YES", "NO", "", "INTERNAL", "KIND,KIND", False),
)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "supplier").createOrReplaceTempView("supplier")
    rows = spark.createDataFrame([(n, *a[:7]) for n, a in enumerate(ANNOTATED)], "n int, entity_ref string, subtype string, personal string, special string, jurisdictions string, sensitivity string, predicates string")
    cut = lambda c: F.when(F.col(c) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, ",")).alias(c)
    r = table(spark, folder, "supplier").select("s_suppkey").crossJoin(F.broadcast(rows))  # twelve rows
    return assurance.annotations(r.select(F.format_string("occ-%d-%d", "s_suppkey", "n").alias("occurrence_ref"), "entity_ref", F.lit("PERSON").alias("semantic_type"), "subtype", "personal", "special", cut("jurisdictions"), "sensitivity", cut("predicates")))


#: What an append said: (version, status, finding, has a receipt, permitted, finding of the gate).
APPENDED = (
    (1, "RECORDED", "RECORDED", True, True, "EVIDENCE_RECORDED"), (1, "RECORDED", "RECORDED", False, False, "EVIDENCE_INVALID"), (1, "RECORDED", "SCOPE_MISMATCH", True, False, "EVIDENCE_INVALID"), (2, "RECORDED", "RECORDED", True, False, "EVIDENCE_INVALID"),
    (1, "RESTRICTED", "AUDIT_UNAVAILABLE", False, False, "EVIDENCE_UNAVAILABLE"), (1, "RESTRICTED", "KEY_UNAVAILABLE", False, False, "EVIDENCE_INVALID"), (1, "LOST", "RECORDED", True, False, "EVIDENCE_INVALID"), (1, "RESTRICTED", "LATE", True, False, "EVIDENCE_INVALID"),
)


def effect_gates(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(n, *a[:4]) for n, a in enumerate(APPENDED)], "n int, version int, status string, finding string, has boolean")
    e = table(spark, folder, "events").select(F.col("event_id").cast("long").alias("effect_id")).withColumn("n", (F.col("effect_id") % len(APPENDED)).cast("int")).join(F.broadcast(rows), "n")
    return assurance.gated(e.select("effect_id", "version", "status", "finding", F.when(F.col("has"), F.lit("receipt")).alias("receipt")))


def decision_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of rows as policies hold them: by column name, a null apart from an empty text."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("rule_id"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, F.lit("")).otherwise(F.col("o_orderpriority")).alias("reason"))
    return assurance.digested(o, "decision", "state", "rule_id", "reason").select("rule_id", "digest")


def taxonomy_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of customers as subtypes, looked up in a taxonomy that holds one of them twice and lacks others."""
    n = table(spark, folder, "nation").select(F.col("n_name").alias("subtype"), F.col("n_regionkey").cast("long").alias("domain"), F.col("n_nationkey").alias("k"))
    taxonomy = n.where("k % 6 <> 5").unionByName(n.where("k = 3")).drop("k")
    values = table(spark, folder, "customer").join(F.broadcast(n.select(F.col("k").alias("c_nationkey"), "subtype")), "c_nationkey").select(F.col("c_custkey").cast("long").alias("value_id"), "subtype")
    return assurance.looked_up(values, taxonomy)


_PIECE = "concat(octet_length(encode({0})), ':', {0})"
_GATES = _rows([(n, a[4], a[5]) for n, a in enumerate(APPENDED)])
_STATE, _REASON, _RULE = ("concat('=', o_orderstatus)", "case o_orderkey % 4 when 0 then '' when 1 then '=' else concat('=', o_orderpriority) end", "concat('=', o_orderkey)")
_OWN: dict[str, tuple[Query, str]] = {
    "release_codes": (release_codes, f"select s_suppkey::bigint as release_id, code from supplier join (values {_rows([(k, c) for k, (_, cs) in enumerate(FAULTS) for c in cs])}) t(k, code) on s_suppkey % {len(FAULTS)} = k"),
    "scope_contract": (scope_contract, _SCOPE_SQL), "task_grades": (task_grades, _TASKS_SQL), "replay_cases": (replay_cases, _REPLAY_SQL),
    "corpus_problems": (corpus_problems, "select c_custkey::bigint as record_id, problem from customer join (values (1, 'ROLE'), (2, 'LABEL_MISSING'), (4, 'LABEL_INVENTED'), (5, 'NAME_NOT_REPLACED'), (6, 'DIMENSION_COUNT'), (7, 'DIMENSION_REPEATED'), (8, 'ID')) t(k, problem) on c_custkey % 9 = k"),
    "annotation_checks": (annotations, f"select concat('occ-', s_suppkey, '-', n) as occurrence_ref, valid from supplier cross join (values {_rows([(n, a[7]) for n, a in enumerate(ANNOTATED)])}) t(n, valid)"),
    "effect_gates": (effect_gates, f"select event_id::bigint as effect_id, permitted, finding from events join (values {_GATES}) t(n, permitted, finding) on event_id % {len(APPENDED)} = n"),
    "decision_digests": (decision_digests, f"select o_orderkey::bigint as rule_id, sha256(concat('8:decision', '6:reason', {_PIECE.format(_REASON)}, '7:rule_id', {_PIECE.format(_RULE)}, '5:state', {_PIECE.format(_STATE)})) as digest from orders"),
    "taxonomy_entries": (taxonomy_entries, "select c_custkey::bigint as value_id, n_name as subtype, case when n_nationkey % 6 <> 5 and n_nationkey <> 3 then n_regionkey::bigint end as domain from customer join nation on c_nationkey = n_nationkey"),
}


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _OWN.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _OWN.items()}
