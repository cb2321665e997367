"""Records around detection: interaction envelopes, canonical JSON, units, registries, versioned configuration, conformance."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.hashing import framed

#: Bytes and seconds of age of an envelope; depth and members of canonical JSON; the largest exact integer.
WIRE, AGE, DEPTH, MEMBERS, EXACT = 1 << 20, 300, 32, 100_000, 2**53 - 1
ENVELOPE = "version int, id string, occurred_at long, operation string, subject string, destination string, payload string, sequence long"
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
# What every adapter's case must hold, and what no case may show.
REQUIREMENTS = ("FUNCTIONAL_MATCH", "PLANTED_ORIGINAL_ABSENT", "PRE_SEND_CHECK_CONSULTED", "OPAQUE_NOT_RELEASED", "DECLARED_UNSUPPORTED", "DESTINATION_BOUND")
VIOLATIONS = ("ADAPTER_ERROR", "BUDGET_EXCEEDED", "PLANTED_ORIGINAL_RELEASED", "PLANTED_ORIGINAL_RETURNED", "UNREVIEWED_RELEASE_BYTES", "UNBOUND_RELEASE_BYTES")


def enveloped(drafts: DataFrame) -> DataFrame:
    """(interaction_id, body, refusal) of ``drafts(interaction_id, id, operation, subject, destination, payload, sequence, now)``
    with the trusted ``t_subject, t_destination, proof_from, proof_to``: a draft is bound to them or refused."""
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.col("id"), F.col("now").alias("occurred_at"), "operation", F.col("t_subject").alias("subject"), F.col("t_destination").alias("destination"), "payload", "sequence"))
    why = _refusal(F.col("operation"), F.col("now"), body)
    return drafts.select("interaction_id", F.when(why == "", body).alias("body"), F.nullif(why, F.lit("")).alias("refusal"))


def _refusal(operation: Column, at: Column, body: Column, *more: tuple[Column, str]) -> Column:
    return enums.first_failing(
        (F.octet_length(body) > WIRE, "WIRE_LENGTH"), *more, (~F.coalesce(operation.isin(*enums.INTERACTIONS), F.lit(False)), "OPERATION"),
        (~F.coalesce((at >= F.col("proof_from")) & (at < F.col("proof_to")), F.lit(False)), "OUTSIDE_PROOF_INTERVAL"), otherwise="")


def parsed(bodies: DataFrame) -> DataFrame:
    """(interaction_id, refusal, operation, payload) of ``bodies(interaction_id, body, now, t_subject, t_destination, proof_from,
    proof_to)``: read strictly, not older than five minutes, equal to what is trusted."""
    e = F.from_json("body", ENVELOPE)
    r = bodies.withColumn("e", e)
    bad = F.col("e").isNull() | F.try_parse_json("body").isNull()
    why = _refusal(
        F.col("e.operation"), F.col("e.occurred_at"), F.col("body"), (F.coalesce(bad, F.lit(True)), "MALFORMED"), (~F.coalesce(F.col("e.version") == 1, F.lit(False)), "VERSION"),
        (~F.coalesce(F.lower("e.id").rlike(UUID4), F.lit(False)), "ID"), (~F.coalesce((F.col("e.occurred_at") <= F.col("now")) & (F.col("e.occurred_at") >= F.col("now") - AGE), F.lit(False)), "STALE"),
        (~(F.col("e.subject").eqNullSafe(F.col("t_subject")) & F.col("e.destination").eqNullSafe(F.col("t_destination"))), "BOUNDARY_MISMATCH"),
    )
    return r.select("interaction_id", F.nullif(why, F.lit("")).alias("refusal"), F.when(why == "", F.col("e.operation")).alias("operation"), F.when(why == "", F.col("e.payload")).alias("payload"))


def canonical(text: str | None) -> tuple[str | None, str | None]:
    """(canonical text, refusal): keys by UTF-16 units, integers only, no space; what cannot be written so is refused."""

    class Refused(Exception):
        pass

    def pairs(items: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in items}) < len(items):
            raise Refused("NOT_CANONICAL")
        return dict(items)

    members = 0

    def write(x: object, depth: int) -> str:
        nonlocal members
        members += 1
        if depth > DEPTH or members > MEMBERS:
            raise Refused("NOT_CANONICALIZABLE")
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v, depth + 1)}" for k, v in sorted(x.items(), key=lambda e: e[0].encode("utf-16-be", "surrogatepass"))) + "}"
        if isinstance(x, list):
            return "[" + ",".join(write(v, depth + 1) for v in x) + "]"
        if isinstance(x, float):
            if not math.isfinite(x) or x != int(x):
                raise Refused("NOT_CANONICALIZABLE")
            x = int(x)
        if isinstance(x, int) and not isinstance(x, bool) and abs(x) > EXACT:
            raise Refused("NOT_CANONICALIZABLE")
        return json.dumps(x, ensure_ascii=False)

    if text is None:
        return None, "NOT_JSON"
    try:
        return write(json.loads(text, object_pairs_hook=pairs), 0), None
    except Refused as e:
        return None, e.args[0]
    except (ValueError, RecursionError):
        return None, "NOT_JSON"


def canonicals(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, canonical, refusal, digest, is_canonical) of ``texts(key, text)``; digest: SHA-256 of the canonical text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [canonical(t) for t in f.text]
            yield pd.DataFrame({key: f[key], "text": f.text, "canonical": [g[0] for g in got], "refusal": [g[1] for g in got]})

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(key, "text").mapInPandas(run, f"{key} {kind}, text string, canonical string, refusal string")
    return out.select(key, "canonical", "refusal", F.sha2("canonical", 256).alias("digest"), F.coalesce(F.col("canonical") == F.col("text"), F.lit(False)).alias("is_canonical"))


def unit_records(grouped: DataFrame, sensitivities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unit_ref, families, start, stop, sensitivity) of the groups of ``grouped(key, region, start, end, semantic_type, subtype)``.

    The reference is a digest of text and place; a group of one family has a location; a contact has the sensitivity that
    ``sensitivities(subtype, configured)`` gives its subtype, the highest where there are several."""
    rank = F.array_position(F.array(*map(F.lit, enums.SENSITIVITIES)), F.col("configured"))
    met = grouped.join(F.broadcast(sensitivities), "subtype", "left")  # as many rows as there are subtypes
    g = met.groupBy(key, "region").agg(F.count_distinct("semantic_type").alias("families"), F.min("start").alias("_s"), F.max("end").alias("_e"), F.max(F.when(F.col("semantic_type") == "PERSON", rank)).alias("_r"))
    ref = F.concat(F.lit("cu-"), F.substring(F.sha2(framed(F.col(key).cast("string"), F.col("region").cast("string")), 256), 1, 32))
    one = F.col("families") == 1
    return g.select(key, ref.alias("unit_ref"), "families", F.when(one, F.col("_s")).alias("start"), F.when(one, F.col("_e")).alias("stop"), F.get(F.array(*map(F.lit, enums.SENSITIVITIES)), (F.col("_r") - 1).cast("int")).alias("sensitivity"))


def extended(base: DataFrame, extensions: DataFrame, most: int = 128) -> DataFrame:
    """(semantic_type, subtype, result) of ``extensions(semantic_type, subtype)`` against ``base``: an extension holds as a whole or
    not at all, so one bad row refuses all rows of its type."""
    have = base.groupBy("semantic_type").agg(F.collect_set("subtype").alias("_have"))
    rows = extensions.join(have, "semantic_type", "left")
    own = Window.partitionBy("semantic_type")
    again = F.count("*").over(Window.partitionBy("semantic_type", "subtype")) > 1
    why = enums.first_failing(
        (~F.coalesce(F.col("semantic_type").isin(*enums.SEMANTIC_CLASSES), F.lit(False)), "UNKNOWN_CLASS"), (~F.coalesce(F.col("subtype").rlike("^[A-Z][A-Z0-9_]{0,63}$"), F.lit(False)), "INVALID_NAME"),
        (F.coalesce(F.array_contains("_have", F.col("subtype")), F.lit(False)) | again, "DUPLICATE"), (F.coalesce(F.size("_have"), F.lit(0)) + F.count("*").over(own) > most, "TOO_MANY"), otherwise="")
    rows = rows.withColumn("_why", why)
    return rows.select("semantic_type", "subtype", F.when(F.max(F.col("_why") != "").over(own), F.when(F.col("_why") == "", "REFUSED").otherwise(F.col("_why"))).otherwise("ADDED").alias("result"))


def activations(proposals: DataFrame) -> DataFrame:
    """(tenant, proposal_id, reason, active) of ``proposals(tenant, proposal_id, proposed_at, revision, digest, pinned_digest, approved_until)``
    in order of time: a revision is activated once, over older ones only, unchanged since it was pinned and under an approval."""
    order = Window.partitionBy("tenant").orderBy("proposed_at", "proposal_id")
    sound = (F.col("digest") == F.col("pinned_digest")) & F.col("approved_until").isNotNull() & (F.col("approved_until") > F.col("proposed_at"))
    p = proposals.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    # Of sound proposals, those that exceed all sound ones before are activated, so the active revision is their running maximum.
    active = F.max(F.when(F.col("_sound"), F.struct("revision", "digest"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_active", active)
    why = enums.first_failing(
        (~F.coalesce(F.col("digest") == F.col("pinned_digest"), F.lit(False)), "CONFIGURATION_CONTENT_CHANGED"),
        (F.coalesce((F.col("_active.revision") == F.col("revision")) & (F.col("_active.digest") == F.col("digest")), F.lit(False)), "CONFIGURATION_ALREADY_ACTIVE"),
        (F.coalesce(F.col("revision") <= F.col("_active.revision"), F.lit(False)), "CONFIGURATION_STALE"), (F.col("approved_until").isNull(), "APPROVAL_MISSING"),
        (F.col("approved_until") <= F.col("proposed_at"), "APPROVAL_EXPIRED"), otherwise="CONFIGURATION_ACTIVATED")
    out = p.withColumn("reason", why)
    return out.select("tenant", "proposal_id", "reason", F.when(F.col("reason") == "CONFIGURATION_ACTIVATED", F.col("revision")).otherwise(F.col("_active.revision")).alias("active"))


def conformance(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """(adapter, case_id, unmet, violations, outcome) of ``cases(adapter, case_id, required array)`` and
    ``observed(adapter, case_id, code)``: NOT_RUN without an observation, PASS with every requirement and no violation."""
    seen = observed.groupBy("adapter", "case_id").agg(F.collect_set("code").alias("_codes"))
    c = cases.join(seen, ["adapter", "case_id"], "left")
    unmet = F.array_sort(F.array_except("required", F.coalesce("_codes", F.expr("cast(array() as array<string>)"))))
    broken = F.array_sort(F.array_intersect(F.coalesce("_codes", F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, VIOLATIONS))))
    state = F.when(F.col("_codes").isNull(), "NOT_RUN").when((F.size(unmet) > 0) | (F.size(broken) > 0), "FAIL").otherwise("PASS")
    return c.select("adapter", "case_id", unmet.alias("unmet"), broken.alias("violations"), state.alias("outcome"))


def adapter_verdicts(outcomes: DataFrame) -> DataFrame:
    """(adapter, cases, passed, verdict): PASS needs every case, FAIL one failure, else NOT_RUN."""
    g = outcomes.groupBy("adapter").agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") == "PASS").alias("passed"), F.count_if(F.col("outcome") == "FAIL").alias("_failed"))
    return g.select("adapter", "cases", "passed", F.when(F.col("_failed") > 0, "FAIL").when(F.col("passed") == F.col("cases"), "PASS").otherwise("NOT_RUN").alias("verdict"))


def placeholder(kind: str | Column, ordinal: str | Column) -> Column:
    """``[TYPE_n]``; ``placeholder_parts`` reads it back."""
    return F.format_string("[%s_%d]", F.col(kind) if isinstance(kind, str) else kind, F.col(ordinal) if isinstance(ordinal, str) else ordinal)


def placeholder_parts(text: str) -> tuple[Column, Column]:
    """Type and number of a placeholder; nulls for anything else."""
    shape = r"^\[([A-Z][A-Z_]*)_(\d{1,9})\]$"
    return F.nullif(F.regexp_extract(text, shape, 1), F.lit("")), F.try_to_number(F.nullif(F.regexp_extract(text, shape, 2), F.lit("")), F.lit("999999999")).cast("long")
