"""Deterministic treatment rules: decisions, reviews, exceptions and the simulation of a change.

A join that finds nothing is a denial, never a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums


def exploded(rules: DataFrame) -> DataFrame:
    """One row for each exact key that a rule answers."""
    return (
        rules.withColumn("sensitivity", F.explode("sensitivities")).withColumn("source_trust", F.explode("source_trusts")).withColumn("operation", F.explode("operations"))
        .select("rule_id", "profile_id", "semantic_type", "sensitivity", "source_trust", "operation", "decision", "review_treatments").distinct()
    )


def _safe(treatment: Column) -> Column:
    secret = (F.col("sensitivity") == "SECRET") | (F.col("semantic_type") == "CREDENTIAL_OR_SECRET")
    return (
        F.array_contains("permitted", treatment)
        & ~((F.col("exposure") == "EXTERNAL") & secret & ~treatment.isin("MASK", "REMOVE"))
        & ~((treatment == "KEEP") & (enums.rank("sensitivity", enums.SENSITIVITIES) > enums.rank("max_cleartext", enums.SENSITIVITIES)))
    )


def decided(requests: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, state, treatment, reason, rule_id) of ``requests(request_id, profile_id, trust_zone, operation, source_trust,
    status, semantic_type, sensitivity)``; the first failing check names the reason."""
    keys = ["profile_id", "semantic_type", "sensitivity", "source_trust", "operation"]
    found = exploded(rules).groupBy(*keys).agg(F.count_distinct("rule_id").alias("n"), F.min("rule_id").alias("rule_id"), F.min("decision").alias("decision"), F.first("review_treatments").alias("review_treatments"))
    sinks = profiles.groupBy("profile_id").agg(F.count("*").alias("_profiles"), F.first("exposure").alias("exposure"), F.first("permitted").alias("permitted"), F.first("max_cleartext").alias("max_cleartext"))
    out = requests.join(sinks, "profile_id", "left").join(found, keys, "left")
    treatments = F.when(F.col("decision") == "REQUIRE_REVIEW", F.col("review_treatments")).otherwise(F.array("decision"))
    out = out.withColumn("_unsafe", ~F.coalesce(F.forall(treatments, _safe), F.lit(False)))
    reason = enums.first_failing(
        (F.coalesce(F.col("_profiles"), F.lit(0)) != 1, "PROFILE_MISMATCH"),
        (F.col("exposure") != F.col("trust_zone"), "PROFILE_MISMATCH"),
        ((F.col("status") != "RESOLVED") | F.col("semantic_type").isin("UNKNOWN") | F.col("sensitivity").isin("UNKNOWN"), "UNRESOLVED_CLASSIFICATION"),
        (F.col("n").isNull(), "NO_RULE"), (F.col("n") > 1, "AMBIGUOUS_RULE"),
        (F.col("decision") == "BLOCK", "RULE_BLOCK"), (F.col("_unsafe"), "UNSAFE_TREATMENT"),
        (F.col("decision") == "REQUIRE_REVIEW", "RULE_REVIEW"), otherwise="RULE_SELECTED",
    )
    out = out.withColumn("reason", reason)
    state = F.when(F.col("reason") == "RULE_SELECTED", "SELECTED").when(F.col("reason") == "RULE_REVIEW", "HELD").otherwise("DENIED")
    return out.select("request_id", state.alias("state"), F.when(state == "DENIED", "BLOCK").otherwise(F.col("decision")).alias("treatment"), "reason", F.when(state != "DENIED", F.col("rule_id")).alias("rule_id"))


def reviewed(decisions: DataFrame, reviews: DataFrame, rules: DataFrame) -> DataFrame:
    """Held ``decisions`` with an outcome of ``reviews(request_id, rule_id, treatment)`` that the rule allows become SELECTED."""
    allowed = rules.select("rule_id", F.explode("review_treatments").alias("treatment")).distinct()
    good = reviews.join(allowed, ["rule_id", "treatment"]).groupBy("request_id", "rule_id").agg(F.count("*").alias("_n"), F.first("treatment").alias("_t")).where("_n = 1")
    out = decisions.join(good, ["request_id", "rule_id"], "left")
    now = (F.col("state") == "HELD") & F.col("_t").isNotNull()
    return out.select("request_id", F.when(now, "SELECTED").otherwise(F.col("state")).alias("state"), F.when(now, F.col("_t")).otherwise(F.col("treatment")).alias("treatment"), F.when(now, "REVIEW_SELECTED").otherwise(F.col("reason")).alias("reason"), "rule_id")


def release_level(state: str, treatment: str) -> Column:
    return F.when(F.col(state) == "DENIED", 0).when(F.col(state) == "HELD", 10).otherwise(21 + F.coalesce(enums.rank(treatment, enums.RESTRICTION), F.lit(-1)))


def simulated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(request_id, kind) of two decisions on each probe, with the sink each side declares in ``sink``."""
    a = before.select("request_id", F.col("state").alias("s0"), F.col("treatment").alias("t0"), F.col("sink").alias("k0"))
    b = after.select("request_id", F.col("state").alias("s1"), F.col("treatment").alias("t1"), F.col("sink").alias("k1"))
    out = a.join(b, "request_id", "full_outer")
    l0, l1 = F.coalesce(release_level("s0", "t0"), F.lit(0)), F.coalesce(release_level("s1", "t1"), F.lit(0))
    moved = F.col("k1").isNotNull() & ~F.col("k0").eqNullSafe(F.col("k1"))
    kind = F.when(F.col("k0").isNull() & F.col("k1").isNull(), "UNAVAILABLE").when(l1 > l0, "NEW_EXPOSURE").when(l1 < l0, "NARROWED").when(moved, "SINK_REBOUND").otherwise("UNCHANGED")
    return out.select("request_id", kind.alias("kind"), l0.cast("long").alias("level_before"), l1.cast("long").alias("level_after"))


def excepted(uses: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(use_id, state, reason) of ``uses(use_id, exception_id, now, ..)`` against registered exceptions; first failing check."""
    keys = ["subject", "purpose", "semantic_type", "sensitivity", "destination", "operation"]
    e = exceptions.select(F.col("exception_id"), F.lit(True).alias("known"), "revoked", "issued_at", "expires_at", F.col("tenant").alias("e_tenant"), F.col("config_revision"), *(F.col(k).alias(f"e_{k}") for k in keys))
    out = uses.join(e, "exception_id", "left")
    differs = ~F.lit(True)
    for k in keys:
        differs = differs | ~F.col(k).eqNullSafe(F.col(f"e_{k}"))
    reason = enums.first_failing(
        (F.col("known").isNull(), "EXCEPTION_UNKNOWN"), (F.col("revoked"), "EXCEPTION_REVOKED"),
        (F.col("now") >= F.col("expires_at"), "EXCEPTION_EXPIRED"), (F.col("now") < F.col("issued_at"), "EXCEPTION_NOT_YET_ACTIVE"),
        (~F.col("tenant").eqNullSafe(F.col("e_tenant")), "EXCEPTION_SCOPE_MISMATCH"), (differs, "EXCEPTION_BINDING_MISMATCH"),
        (F.col("active_revision").isNull(), "CONFIGURATION_UNAVAILABLE"), (F.col("active_revision") != F.col("config_revision"), "EXCEPTION_CONFIG_SUPERSEDED"),
        otherwise="EXCEPTION_APPLICABLE",
    )
    return out.select("use_id", reason.alias("reason")).withColumn("state", F.when(F.col("reason") == "EXCEPTION_APPLICABLE", "APPLICABLE").otherwise("DENIED"))
