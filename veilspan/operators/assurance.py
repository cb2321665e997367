"""Checks before something counts: release evidence, scopes, graded tasks, corpora, replay cases, annotations, recorded effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.hashing import framed

# Severities in order, what an append to the audit trail can say, states of an attribute, predicates of a task,
# families of the development partition, the marker of a planted case, and the ways a scoped reference is altered.
SEVERITIES = ("info", "low", "moderate", "high", "critical")
APPENDS = ("RECORDED", "AUDIT_UNAVAILABLE", "INVALID_DRAFT", "INVALID_CONTEXT", "INVALID_LEDGER", "KEY_UNAVAILABLE", "SCOPE_MISMATCH", "EVENT_CAPACITY")
STATES = ("YES", "NO", "UNKNOWN")
PREDICATES = ("EXACT_VALUE", "EXISTENCE", "KIND", "VALUE_SHAPE", "SYNTAX", "RELATIONSHIP", "CONSISTENCY", "GENERALIZED", "NOT_REQUIRED")
FAMILIES = ("D01", "D02", "D03", "D04", "D05", "D06", "D07", "D08", "D09", "D10", "D11", "D12")
MARKER, CASE_BYTES = "SYNTHETIC-MARKER-", 8 << 10
MUTATIONS = {
    "cross-tenant": "tenant_id", "wrong-project": "project_id", "wrong-session": "session_id", "forged-provenance": "provenance_ref", "wrong-principal": "principal_id", "wrong-purpose": "purpose",
    "wrong-destination": "destination_id", "cross-tenant-exception": "tenant_id", "unknown-reference": "ref",
}
SCOPE = ("tenant_id", "project_id", "session_id", "provenance_ref", "principal_id", "purpose", "destination_id")
CASE = "adapter_id string, version int, suite_sha256 string, scope_ref string, artifact_sha256 string, lock_sha256 string, sbom_sha256 string, completed_at long, planted_egress string, functional_tests string, overall string, cases array<struct<outcome: string, violations: int>>"
SCAN = "scanner_id string, completed boolean, lock_sha256 string, sbom_sha256 string, completed_at long, findings array<struct<severity: string>>"
_ARTIFACT, _NAME, _JURISDICTION = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$", "^[A-Z][A-Z0-9_]{0,63}$", "^[A-Z]{2}$"


def _absent(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)) == 0


def _codes(*cases: tuple[Column, str]) -> Column:
    """All codes whose condition holds; a condition that is unknown does not clear anything, so it holds."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in cases)))


def release_codes(evidence: DataFrame, expected: DataFrame, offered: DataFrame) -> DataFrame:
    """(release_id, code): every reason against a release whose signature holds; a release without rows may go.

    ``evidence(release_id, issued_at, expires_at, version, commit, scope_ref, profile_id, artifact_name, artifact_sha256,
    artifact_bytes, lock_sha256, sbom_sha256, scanner_sha256, adapters array<struct<adapter_id, evidence_sha256>>)`` is claimed;
    ``expected(release_id, now, max_age, e_version, e_commit, e_scope, e_profile, e_artifact, pinned_lock, block_at, scanners array,
    required array<struct<adapter_id, suite_sha256>>)`` is known; ``offered(release_id, artifact, lockfile, sbom, scanner, conformance
    array<struct<adapter_id, body>>)`` are the bytes.  An expected release without evidence is EVIDENCE_MISSING.  The tree of
    dependencies is compared by ``dependencies.compared``."""
    r = expected.join(evidence.withColumn("_claimed", F.lit(True)), "release_id", "left").join(offered, "release_id", "left")
    r = r.withColumn("_scan", F.from_json("scanner", SCAN))
    now, age, scan = F.col("now"), F.col("max_age"), F.col("_scan")
    sha = lambda c: F.sha2(F.col(c), 256)
    stale = lambda at: (at > now) | (now - at > age)
    direct = _codes(
        (F.col("expires_at") <= F.col("issued_at"), "EVIDENCE_WINDOW_INVALID"), (F.col("issued_at") > now, "EVIDENCE_FUTURE_DATED"), (F.col("expires_at") <= now, "EVIDENCE_EXPIRED"), (now - F.col("issued_at") > age, "EVIDENCE_TOO_OLD"),
        (F.col("version") != F.col("e_version"), "RELEASE_VERSION_MISMATCH"), (F.col("commit") != F.col("e_commit"), "SOURCE_COMMIT_MISMATCH"), (F.col("scope_ref") != F.col("e_scope"), "CHANNEL_SCOPE_MISMATCH"),
        (F.col("profile_id") != F.col("e_profile"), "CHANNEL_PROFILE_MISMATCH"), (~F.col("artifact_name").rlike(_ARTIFACT) | (F.col("artifact_name") != F.col("e_artifact")), "ARTIFACT_NAME_NOT_ALLOWED"),
        (_absent(F.col("artifact")), "ARTIFACT_EVIDENCE_MISSING"), (~_absent(F.col("artifact")) & (sha("artifact") != F.col("artifact_sha256")), "ARTIFACT_DIGEST_MISMATCH"),
        (~_absent(F.col("artifact")) & (F.octet_length("artifact") != F.col("artifact_bytes")), "ARTIFACT_SIZE_MISMATCH"), (_absent(F.col("lockfile")), "LOCKFILE_EVIDENCE_MISSING"),
        (~_absent(F.col("lockfile")) & (sha("lockfile") != F.col("lock_sha256")), "LOCKFILE_DIGEST_MISMATCH"), (_absent(F.col("sbom")), "SBOM_EVIDENCE_MISSING"),
        (~_absent(F.col("sbom")) & (sha("sbom") != F.col("sbom_sha256")), "SBOM_DIGEST_MISMATCH"), (~_absent(F.col("lockfile")) & F.col("pinned_lock").isNotNull() & (sha("lockfile") != F.col("pinned_lock")), "LOCKFILE_NOT_INDEPENDENTLY_PINNED"),
    )
    # Of the scanner's report, one that is absent, altered or unreadable says nothing more.
    block = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("block_at"))
    found = F.exists(F.col("_scan.findings"), lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"]), F.lit(0)) >= block)
    read = _codes((~F.array_contains("scanners", scan["scanner_id"]), "SCANNER_NOT_TRUSTED"), (~scan["completed"], "SCANNER_INCOMPLETE"),
                  ((scan["lock_sha256"] != F.col("lock_sha256")) | (scan["sbom_sha256"] != F.col("sbom_sha256")), "SCANNER_SUBJECT_MISMATCH"), (stale(scan["completed_at"]), "SCANNER_EVIDENCE_STALE"), (found, "FINDING_BLOCKS_PROMOTION"))
    scanned = F.when(_absent(F.col("scanner")), F.array(F.lit("SCANNER_EVIDENCE_MISSING"))).when(~sha("scanner").eqNullSafe(F.col("scanner_sha256")), F.array(F.lit("SCANNER_DIGEST_MISMATCH")))
    scanned = scanned.when(scan.isNull() | scan["findings"].isNull(), F.array(F.lit("SCANNER_EVIDENCE_MALFORMED"))).otherwise(read)
    none = F.expr("cast(array() as array<string>)")
    claims, given, wanted = (F.coalesce(c, F.expr(f"cast(array() as array<struct<adapter_id: string, {f}: string>>)")) for c, f in (("adapters", "evidence_sha256"), ("conformance", "body"), ("required", "suite_sha256")))
    ids = lambda c: F.transform(c, lambda x: x["adapter_id"])
    again = F.transform(F.sequence(F.lit(1), F.size(given) - F.size(F.array_distinct(ids(given)))), lambda _: F.lit("CONFORMANCE_EVIDENCE_DUPLICATE"))
    again = F.when(F.size(given) > F.size(F.array_distinct(ids(given))), again).otherwise(none)
    unknown = F.transform(F.array_except(ids(claims), ids(wanted)), lambda _: F.lit("CONFORMANCE_ADAPTER_UNKNOWN"))

    def adapter(need: Column) -> Column:
        claim = F.get(F.filter(claims, lambda x: x["adapter_id"] == need["adapter_id"]), 0)
        body = F.get(F.filter(given, lambda x: x["adapter_id"] == need["adapter_id"]), 0)["body"]
        a = F.from_json(body, CASE)
        first = enums.first_failing(
            (claim.isNull(), "CONFORMANCE_ADAPTER_MISSING"), (body.isNull(), "CONFORMANCE_EVIDENCE_MISSING"), (~F.sha2(body, 256).eqNullSafe(claim["evidence_sha256"]), "CONFORMANCE_DIGEST_MISMATCH"),
            (a.isNull() | a["cases"].isNull(), "CONFORMANCE_EVIDENCE_MALFORMED"), (~a["adapter_id"].eqNullSafe(need["adapter_id"]), "CONFORMANCE_SUBJECT_MISMATCH"), (~a["suite_sha256"].eqNullSafe(need["suite_sha256"]), "CONFORMANCE_SUITE_MISMATCH"),
            (~a["scope_ref"].eqNullSafe(F.col("e_scope")), "CONFORMANCE_SCOPE_MISMATCH"),
            (~(a["artifact_sha256"].eqNullSafe(F.col("artifact_sha256")) & a["lock_sha256"].eqNullSafe(F.col("lock_sha256")) & a["sbom_sha256"].eqNullSafe(F.col("sbom_sha256"))), "CONFORMANCE_SUBJECT_MISMATCH"),
            (F.coalesce(stale(a["completed_at"]), F.lit(True)), "CONFORMANCE_EVIDENCE_STALE"), (~a["version"].eqNullSafe(F.lit(1)), "CONFORMANCE_VERSION_MISMATCH"), otherwise="")
        late = _codes((F.exists(a["cases"], lambda c: ~c["outcome"].eqNullSafe(F.lit("PASS"))), "CONFORMANCE_CASE_NOT_PASSING"), (F.exists(a["cases"], lambda c: c["violations"] > 0), "CONFORMANCE_VIOLATION_REPORTED"),
                      (a["planted_egress"] != "PASS", "PLANTED_EGRESS_UNPROVEN"), (a["functional_tests"] != "PASS", "FUNCTIONAL_TESTS_UNPROVEN"), (a["overall"] != "PASS", "CONFORMANCE_FAILED"))
        return F.when(first != "", F.array(first)).otherwise(late)

    every = F.when(F.col("_claimed").isNull(), F.array(F.lit("EVIDENCE_MISSING"))).otherwise(F.concat(direct, again, unknown, F.flatten(F.transform(wanted, adapter)), scanned))
    return r.select("release_id", F.explode(F.array_distinct(every)).alias("code"))


def scope_vectors(references: DataFrame) -> DataFrame:
    """One attempt for each way of altering each of ``references(ref, tenant_id, .., destination_id)``, the untouched one, and two other
    actions, with what must come of it: (of, label, the attempt's columns, action, must_resolve, must_authorize)."""
    ends = references.agg(F.min("tenant_id").alias("_low"), F.max("tenant_id").alias("_high"))  # one row
    labels = F.array(*(F.lit(x) for x in ("authorized-use", *MUTATIONS, "display-not-use", "export-not-display")))
    v = references.crossJoin(F.broadcast(ends)).withColumn("of", F.col("ref")).withColumn("label", F.explode(labels))
    other = F.when(F.col("tenant_id") != F.col("_high"), F.col("_high")).when(F.col("_low") != F.col("_high"), F.col("_low")).otherwise(F.concat(F.lit("forged-"), "tenant_id"))
    columns = {}
    for c in ("ref", *SCOPE):
        hit = F.col("label").isin([n for n, changed in MUTATIONS.items() if changed == c])
        columns[c] = F.when(hit, other if c == "tenant_id" else F.concat(F.lit("forged-"), c)).otherwise(F.col(c))
    action = F.when(F.col("label") == "display-not-use", "DISPLAY").when(F.col("label") == "export-not-display", "EXPORT").otherwise("USE")
    altered = F.col("label").isin([*MUTATIONS])
    return v.select("of", "label", *(e.alias(c) for c, e in columns.items()), action.alias("action"), (~altered).alias("must_resolve"), (F.col("label") == "authorized-use").alias("must_authorize"))


def scope_contract(references: DataFrame, held: tuple[str, ...] = SCOPE) -> DataFrame:
    """(of, label, boundary, expected, outcome) of the boundary that asks for ``held`` columns: resolution, and use as the only authorized action."""
    known = references.select("ref", *held).distinct().withColumn("_known", F.lit(True))
    v = scope_vectors(references).join(known, ["ref", *held], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    sides = F.array(
        F.struct(F.lit("resolution").alias("boundary"), F.col("must_resolve").alias("must"), F.col("_known").alias("did")),
        F.struct(F.lit("authorization").alias("boundary"), F.col("must_authorize").alias("must"), (F.col("_known") & (F.col("action") == "USE")).alias("did")))
    x = v.select("of", "label", F.explode(sides).alias("x"))
    return x.select("of", "label", "x.boundary", F.when(F.col("x.must"), "allow").otherwise("deny").alias("expected"), F.when(F.col("x.must") == F.col("x.did"), "pass").otherwise("fail").alias("outcome"))


def task_grades(cases: DataFrame, results: DataFrame, captures: DataFrame, measures: DataFrame) -> DataFrame:
    """(case_id, task_correct, untested, operational) of ``cases(case_id, has_task, expected, required_sink)``, ``results(case_id, result)``,
    ``captures(case_id, sink_id)`` and ``measures(case_id, ..)``: what is not observed is named, and never a pass or a failure."""
    got = results.groupBy("case_id").agg(F.min("result").alias("result"), F.lit(True).alias("_result"))
    seen = captures.select("case_id", F.col("sink_id").alias("required_sink")).distinct().withColumn("_seen", F.lit(True))
    c = cases.join(got, "case_id", "left").join(seen, ["case_id", "required_sink"], "left").join(measures.select("case_id").distinct().withColumn("_measured", F.lit(True)), "case_id", "left")
    why = enums.first_failing(
        (~F.coalesce("has_task", F.lit(False)) | F.col("expected").isNull(), "no-task-control"), (F.col("_result").isNull(), "no-task-result"), (F.col("required_sink").isNull(), "no-task-sink-binding"),
        (F.col("_seen").isNull(), "no-capture"), (F.col("result").isNull(), "grader-error"), otherwise="")
    return c.select("case_id", F.when(why == "", F.col("result") == F.col("expected")).alias("task_correct"), F.nullif(why, F.lit("")).alias("untested"), F.when(F.col("_measured"), "observed-only").otherwise("no-operational-observation").alias("operational"))


def corpus_problems(records: DataFrame, most: int = 8) -> DataFrame:
    """(record_id, problem) of ``records(record_id, role, label, name_replaced, dimensions array<string>)``: any row refuses the corpus."""
    n = records.groupBy("record_id").agg(F.count("*").alias("_n"))
    r = records.join(n, records["record_id"].eqNullSafe(n["record_id"])).select(records["*"], "_n")
    d = F.coalesce("dimensions", F.expr("cast(array() as array<string>)"))
    why = _codes(
        (F.col("record_id").isNull() | (F.col("_n") > 1), "ID"), (~F.col("role").isin("EVALUATED_CASE", "POPULATION_BACKGROUND"), "ROLE"), ((F.col("role") == "EVALUATED_CASE") & F.col("label").isNull(), "LABEL_MISSING"),
        ((F.col("role") == "POPULATION_BACKGROUND") & F.col("label").isNotNull(), "LABEL_INVENTED"), (~F.col("name_replaced"), "NAME_NOT_REPLACED"), ((F.size(d) < 1) | (F.size(d) > most), "DIMENSION_COUNT"), (F.size(F.array_distinct(d)) < F.size(d), "DIMENSION_REPEATED"))
    return r.select("record_id", F.explode(why).alias("problem")).distinct()


def replay_cases(cases: DataFrame, tenant: str) -> DataFrame:
    """(place, case_key, reason) of ``cases(place, case_key, family, tenant, text, expectation)``: null is accepted.  The first of a key
    reserves it, sound or not; a declared marker is looked for, never believed."""
    first = F.row_number().over(Window.partitionBy("case_key").orderBy("place"))
    planted = F.contains("text", F.concat(F.lit(MARKER), F.substring(F.sha2("case_key", 256), 1, 16)))
    why = enums.first_failing(
        (_absent(F.col("case_key")) | (F.length("case_key") > 256), "CASE_SPEC_INVALID"), (F.col("_first") > 1, "CASE_KEY_DUPLICATE"), (~F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False)), "CASE_FAMILY_NOT_DEVELOPMENT"),
        (_absent(F.col("text")), "CASE_TEXT_INVALID"), (F.octet_length("text") > CASE_BYTES, "CASE_TEXT_TOO_LARGE"), (~F.coalesce(F.col("expectation").isin("DENY", "NONE"), F.lit(False)), "CASE_SPEC_INVALID"),
        (~F.col("tenant").eqNullSafe(F.lit(tenant)), "FOREIGN_TENANT_SCOPE"), (planted != (F.col("expectation") == "DENY"), "CASE_MARKER_EXPECTATION_MISMATCH"), otherwise="")
    return cases.withColumn("_first", first).select("place", "case_key", F.nullif(why, F.lit("")).alias("reason"))


def _ref(c: Column, kind: str) -> Column:
    return F.coalesce(c.rlike(f"^{kind}-[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(c) <= 64), F.lit(False))


def annotations(records: DataFrame) -> DataFrame:
    """(occurrence_ref, valid) of ``records(occurrence_ref, entity_ref, semantic_type, subtype, personal, special, jurisdictions array,
    sensitivity, predicates array)``: closed names, and special categories only of personal data."""
    j, p = F.col("jurisdictions"), F.col("predicates")
    fits = lambda c, allowed: F.coalesce(c.isin(*allowed), F.lit(False))
    ok = (
        _ref(F.col("occurrence_ref"), "occ") & (F.col("entity_ref").isNull() | _ref(F.col("entity_ref"), "entity")) & F.col("semantic_type").rlike(_NAME) & (F.col("subtype").isNull() | F.col("subtype").rlike(_NAME))
        & fits(F.col("personal"), STATES) & fits(F.col("special"), STATES) & ~((F.col("special") == "YES") & (F.col("personal") != "YES")) & fits(F.col("sensitivity"), enums.SENSITIVITIES)
        & (F.size(j) <= 16) & (F.size(F.array_distinct(j)) == F.size(j)) & F.forall(j, lambda x: x.rlike(_JURISDICTION))
        & (F.size(p) > 0) & (F.size(F.array_distinct(p)) == F.size(p)) & F.forall(p, lambda x: x.isin(*PREDICATES)) & ((F.size(p) == 1) | ~F.array_contains(p, "NOT_REQUIRED"))
    )
    return records.select("occurrence_ref", F.coalesce(ok, F.lit(False)).alias("valid"))


def looked_up(values: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``values(.., subtype)`` with the entry of ``taxonomy(subtype, ..)``; a subtype that the taxonomy holds twice has none."""
    once = taxonomy.join(taxonomy.groupBy("subtype").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), "subtype")
    return values.join(once, "subtype", "left")


def gated(results: DataFrame) -> DataFrame:
    """(effect_id, permitted, finding) of ``results(effect_id, version, status, finding, receipt)``: an effect may go on once its record is kept."""
    kept = F.col("status") == "RECORDED"
    sound = (F.col("version") == 1) & F.col("status").isin("RECORDED", "RESTRICTED") & F.col("finding").isin(*APPENDS) & (~kept | ((F.col("finding") == "RECORDED") & F.col("receipt").isNotNull()))
    sound = F.coalesce(sound, F.lit(False))
    finding = F.when(sound & (F.col("finding") == "AUDIT_UNAVAILABLE"), "EVIDENCE_UNAVAILABLE").when(sound & kept, "EVIDENCE_RECORDED").otherwise("EVIDENCE_INVALID")
    return results.select("effect_id", (sound & kept).alias("permitted"), finding.alias("finding"))


def digested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """``rows`` with ``digest``: SHA-256 of ``name`` and the columns by name, each framed by its length; a null is not an empty text."""
    parts = [x for c in sorted(columns) for x in (F.lit(c), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))]
    return rows.withColumn("digest", F.sha2(framed(F.lit(name), *parts), 256))
