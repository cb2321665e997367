"""Composition of evidence: one classification for each group, by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums


def validated(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``state``: FOUND, ABSTAIN, FAILURE, or INVALID where a field is outside its vocabulary."""
    bad = (
        F.col("id").isNull()
        | ~F.col("status").isin("FOUND", "ABSTAIN", "FAILURE")
        | (F.col("status") == "FOUND") & F.col("semantic_type").isNull()
        | (F.col("status") != "FOUND") & F.col("semantic_type").isNotNull()
        | ~F.coalesce(F.col("sensitivity").isin(*enums.SENSITIVITIES), F.lit(True))
        | ~F.coalesce(F.col("scope").isin(*enums.SCOPES), F.lit(True))
        | F.col("confidence").isNotNull() & ~F.coalesce((F.col("channel") == "semantic") & F.col("confidence").between(0, 1), F.lit(False))
    )
    return evidence.withColumn("state", F.when(F.coalesce(bad, F.lit(True)), "INVALID").otherwise(F.col("status")))


def composed(evidence: DataFrame) -> DataFrame:
    """(group_id, status, semantic_type, subtype, sensitivity, reversible, scope, reasons).

    RESOLVED only if nothing speaks against it; sensitivity is the highest claimed, SECRET for a credential.
    """
    e = validated(evidence)
    found = F.col("state") == "FOUND"
    known = found & F.col("semantic_type").isin(*enums.SEMANTIC_CLASSES)
    pairs = [f"{c}/{s}" for c, subs in enums.SUBTYPES.items() for s in subs]
    registered = F.concat_ws("/", "semantic_type", "subtype").isin(*pairs)
    credential = found & (F.col("semantic_type") == "CREDENTIAL_OR_SECRET")
    detector = found & (F.col("channel") == "detector")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = e.groupBy("group_id").agg(
        any_(F.col("state") == "INVALID").alias("invalid"),
        (F.count(F.when(F.col("state") != "INVALID", 1)) > F.count_distinct(F.when(F.col("state") != "INVALID", F.col("id")))).alias("twice"),
        *(any_((F.col("state") == "FAILURE") & (F.col("channel") == c)).alias(f"{c}_failure") for c in ("detector", "parser", "semantic")),
        any_(F.col("state") == "ABSTAIN").alias("abstained"),
        any_(found).alias("found"),
        any_(detector).alias("detector"),
        any_(found & (F.col("semantic_type") == "UNKNOWN")).alias("unknown"),
        any_(found & ~F.col("semantic_type").isin("UNKNOWN", *enums.SEMANTIC_CLASSES)).alias("unsupported"),
        any_(known & F.col("subtype").isNotNull() & ~registered).alias("unsupported_subtype"),
        F.collect_set(F.when(known, F.col("semantic_type"))).alias("types"),
        F.collect_set(F.when(known & registered, F.col("subtype"))).alias("subtypes"),
        F.collect_set(F.when(found, F.col("sensitivity"))).alias("sensitivities"),
        F.collect_set(F.when(found, F.col("scope"))).alias("scopes"),
        F.collect_set(F.when(found, F.col("reversible"))).alias("reversibles"),
        any_(credential).alias("credential"),
        any_(found & F.col("sensitivity").isNull() & ~(F.col("semantic_type") == "CREDENTIAL_OR_SECRET")).alias("missing"),
        any_(detector & F.col("reversible")).alias("detector_reversible"),
        any_(detector & F.col("scope").isNotNull()).alias("detector_scope"),
    )
    g = g.withColumn("sensitivities", F.when(F.col("credential"), F.array_union("sensitivities", F.array(F.lit("SECRET")))).otherwise(F.col("sensitivities")))
    why = enums.reasons(
        (F.col("invalid"), "INVALID_EVIDENCE"), (F.col("twice"), "DUPLICATE_EVIDENCE_ID"),
        (F.col("detector_failure"), "DETECTOR_FAILURE"), (F.col("parser_failure"), "PARSER_FAILURE"), (F.col("semantic_failure"), "SEMANTIC_FAILURE"),
        (F.col("abstained"), "ABSTAINED"), (~F.col("found"), "MISSING_EVIDENCE"), (F.col("found") & ~F.col("detector"), "MISSING_DETECTOR_EVIDENCE"),
        (F.col("unknown"), "UNKNOWN_CLASS"), (F.col("unsupported"), "UNSUPPORTED_CLASS"), (F.col("unsupported_subtype"), "UNSUPPORTED_SUBTYPE"),
        (F.col("missing") | F.col("found") & (F.size("sensitivities") == 0), "MISSING_SENSITIVITY"),
        (F.size("types") > 1, "CONFLICTING_SEMANTIC_TYPE"), (F.size("subtypes") > 1, "CONFLICTING_SUBTYPE"), (F.size("sensitivities") > 1, "CONFLICTING_SENSITIVITY"),
        (F.size("scopes") > 1, "CONFLICTING_SCOPE"), (F.size("reversibles") > 1, "CONFLICTING_REVERSIBILITY"),
    )
    g = g.withColumn("reasons", why).withColumn("ok", F.size("reasons") == 0)
    top = F.array_max(F.transform("sensitivities", lambda s: enums.rank(s, enums.SENSITIVITIES)))
    sensitivity = enums.named(top, enums.SENSITIVITIES)
    return g.select(
        "group_id",
        F.when(F.col("ok"), "RESOLVED").otherwise("UNRESOLVED").alias("status"),
        F.when(F.col("ok") & (F.size("types") == 1), F.get("types", F.lit(0))).otherwise("UNKNOWN").alias("semantic_type"),
        F.when(F.col("ok") & (F.size("subtypes") == 1), F.get("subtypes", F.lit(0))).alias("subtype"),
        sensitivity.alias("sensitivity"),
        (F.col("ok") & (sensitivity != "SECRET") & ~F.col("credential") & F.col("detector_reversible") & ~F.array_contains("reversibles", False)).alias("reversible"),
        F.when(F.col("ok") & F.col("detector_scope") & (F.size("scopes") == 1), F.get("scopes", F.lit(0))).otherwise("request").alias("scope"),
        F.array_join("reasons", ",").alias("reasons"),
    )


def resolved_sensitivity(claims: DataFrame) -> DataFrame:
    """(group_id, state, floor, effective, escalation_steps) of ``claims(group_id, origin, status, sensitivity, credential)``.

    A deterministic floor stands; a semantic claim can only raise it; what leaves the floor uncertain stays unresolved.
    """
    found, fixed = F.col("status") == "FOUND", F.col("origin") == "DETERMINISTIC"
    level = enums.rank("sensitivity", enums.SENSITIVITIES)
    level = F.when(F.col("credential"), F.greatest(F.coalesce(level, F.lit(0)), F.lit(4))).otherwise(level)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = claims.groupBy("group_id").agg(
        any_(found & fixed & F.col("credential")).alias("credential"),
        F.count_distinct(F.when(found & fixed, F.col("sensitivity"))).alias("kinds"),
        F.max(F.when(found & fixed, level)).alias("high"),
        F.min(F.when(found & fixed, enums.rank("sensitivity", enums.SENSITIVITIES))).alias("low"),
        F.max(F.when(found & ~fixed, level)).alias("concern"),
        F.min(F.when(found & ~fixed, F.coalesce(enums.rank("sensitivity", enums.SENSITIVITIES), level))).alias("least"),
        any_(~found & fixed).alias("unsure"),
        any_((F.col("status") == "FAILURE") & ~fixed).alias("failed"),
        any_(found & F.col("sensitivity").isNull() & ~F.coalesce(F.col("credential"), F.lit(False))).alias("missing"),
    )
    floor = F.when(F.col("credential"), F.lit(4)).otherwise(F.col("high"))
    effective = F.greatest(floor, F.coalesce("concern", floor))
    blocked = F.col("unsure") | F.col("failed") | F.col("missing") | floor.isNull() | (F.col("kinds") > 1) & ~F.col("credential")
    careful = (F.coalesce("concern", floor) > floor) | (F.coalesce("least", floor) < floor) | F.col("credential") & (F.coalesce("low", F.lit(4)) < 4)
    state = F.when(blocked, "UNRESOLVED").when(careful, "RESOLVED_CONSERVATIVELY").otherwise("RESOLVED")
    return g.select(
        "group_id", state.alias("state"),
        enums.named(F.when(~blocked, floor), enums.SENSITIVITIES).alias("floor"),
        enums.named(F.when(~blocked, effective), enums.SENSITIVITIES).alias("effective"),
        F.when(blocked, 0).otherwise(effective - floor).cast("long").alias("escalation_steps"),
    )


def resolved_attribute(claims: DataFrame) -> DataFrame:
    """(group_id, value): YES wins; NO needs a deterministic claim; anything else is UNKNOWN, never null."""
    yes = F.coalesce(F.bool_or(F.col("value") == "YES"), F.lit(False))
    no = F.coalesce(F.bool_or((F.col("value") == "NO") & (F.col("origin") == "DETERMINISTIC")), F.lit(False))
    return claims.groupBy("group_id").agg(F.when(yes, "YES").when(no, "NO").otherwise("UNKNOWN").alias("value"))


def fidelity(wanted: DataFrame) -> DataFrame:
    """(request_id, satisfying, unmet, advice) of ``wanted(request_id, predicate, sensitivity)``: forms that satisfy every
    predicate within the ceiling, by relational division over a fixed table."""
    spark = wanted.sparkSession
    table = spark.createDataFrame([(p, f) for p, forms in enums.SATISFIES.items() for f in forms], "predicate string, form string")
    forms = spark.createDataFrame([(f, f in enums.SECRET_REPRESENTATIONS) for f in enums.REPRESENTATIONS], "form string, safe boolean")
    asked = wanted.select("request_id", "predicate", F.col("sensitivity").isin("UNKNOWN", "SECRET").alias("secret")).distinct()
    inside = asked.join(table, "predicate").join(forms, "form").where("safe or not secret")
    need = asked.groupBy("request_id").agg(F.count("*").alias("need"), F.bool_or("secret").alias("secret"), F.bool_or(F.col("predicate") == "EXACT_VALUE").alias("exact"))
    full = inside.groupBy("request_id", "form").agg(F.count("*").alias("got")).join(need.select("request_id", "need"), "request_id").where("got = need")
    good = full.groupBy("request_id").agg(F.array_sort(F.collect_set("form")).alias("satisfying"))
    lost = asked.join(inside.select("request_id", "predicate").distinct(), ["request_id", "predicate"], "left_anti").groupBy("request_id").agg(F.array_sort(F.collect_set("predicate")).alias("unmet"))
    out = need.join(good, "request_id", "left").join(lost, "request_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("satisfying", F.coalesce("satisfying", none)).withColumn("unmet", F.coalesce("unmet", none))
    advice = enums.reasons((F.col("secret") & F.col("exact"), "USE_WITHOUT_REVEAL"), (F.size(F.array_except("satisfying", F.array(F.lit("WITHHELD")))) == 0, "UNMET_WITHIN_CEILING"))
    return out.select("request_id", F.array_join("satisfying", ",").alias("satisfying"), F.array_join("unmet", ",").alias("unmet"), F.array_join(advice, ",").alias("advice"))
