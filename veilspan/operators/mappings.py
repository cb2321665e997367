"""Keyed references, mapping lifecycle, authorization, and tamper-evident event chains."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.hashing import framed, hmac_sha256

ZERO = "0" * 64


def referenced(entities: DataFrame, key: bytes, version: str = "1") -> DataFrame:
    """``entities(scope_kind, tenant_id, entity, semantic_type)`` with ``reference``: stable in its scope, null for credentials."""
    ref = F.concat(F.lit("ref1:"), F.substring(hmac_sha256(key, framed(F.lit("entity"), F.col("scope_kind"), F.col("tenant_id"), F.col("entity"), F.col("semantic_type"), F.lit(version))), 1, 43))
    return entities.withColumn("reference", F.when(F.col("semantic_type") != "CREDENTIAL_OR_SECRET", ref))


def sealed(rows: DataFrame, key: bytes, value: str = "value", fields: tuple[str, ...] = ("tenant_id", "mapping_ref")) -> DataFrame:
    """``rows`` with ``sealed``: AES-256-GCM of ``value``, bound to ``fields`` as associated data; the nonce is random by row."""
    aad = F.concat(F.lit("1"), framed(*(F.col(f).cast("string") for f in fields)))
    return rows.withColumn("sealed", F.when(F.octet_length(value) <= 65536, F.aes_encrypt(F.col(value).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)))


def opened(rows: DataFrame, key: bytes, fields: tuple[str, ...] = ("tenant_id", "mapping_ref")) -> DataFrame:
    """``rows`` with ``value``: null wherever key, bytes or any bound field differs."""
    aad = F.concat(F.lit("1"), framed(*(F.col(f).cast("string") for f in fields)))
    return rows.withColumn("value", F.try_aes_decrypt(F.col("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))


def stepped(mappings: DataFrame, commands: DataFrame) -> DataFrame:
    """(command_id, result, reason, state, revision): one command on the record it names; ordered refusals."""
    table = mappings.sparkSession.createDataFrame([(s, a, t) for (s, a), t in enums.TRANSITIONS.items()], "state string, action string, target string")
    m = mappings.select("mapping_ref", F.lit(True).alias("known"), F.col("tenant_id").alias("m_tenant"), "state", "revision", "created_at", "expires_at")
    out = commands.join(m, "mapping_ref", "left").join(F.broadcast(table), ["state", "action"], "left")  # twelve rows
    reason = enums.first_failing(
        (F.col("known").isNull(), "UNKNOWN_MAPPING"), (F.col("now") < F.col("created_at"), "INVALID_CLOCK"), (F.col("tenant_id") != F.col("m_tenant"), "SCOPE_MISMATCH"),
        (F.col("expected_revision") != F.col("revision"), "STALE_REVISION"), (F.col("target").isNull(), "INVALID_TRANSITION"),
        (F.col("target") == F.col("state"), "UNCHANGED"), ((F.col("action") == "ACTIVATE") & (F.col("now") >= F.col("expires_at")), "EXPIRY_REACHED"),
        ((F.col("action") == "EXPIRE") & (F.col("now") < F.col("expires_at")), "NOT_EXPIRED"), otherwise="CHANGED",
    )
    out = out.withColumn("reason", reason)
    changed = F.col("reason") == "CHANGED"
    return out.select("command_id", F.when(F.col("reason").isin("CHANGED", "UNCHANGED"), F.col("reason")).otherwise("REFUSED").alias("result"), "reason",
                      F.when(changed, F.col("target")).otherwise(F.col("state")).alias("state"), (F.col("revision") + changed.cast("long")).alias("revision"))


def authorized(requests: DataFrame, mappings: DataFrame, grants: DataFrame) -> DataFrame:
    """(request_id, state, reason); first failing check.  An absent grant is a denial."""
    m = mappings.select("mapping_ref", F.lit(True).alias("known"), F.col("tenant_id").alias("m_tenant"), F.col("state").alias("lifecycle"), "revision", F.col("expires_at").alias("m_expires"), "semantic_type", "sensitivity")
    g = grants.select("grant_id", F.lit(True).alias("granted"), F.col("mapping_ref").alias("g_ref"), F.col("revision").alias("g_revision"), F.col("principal").alias("g_principal"), F.col("tenant_id").alias("g_tenant"),
                      F.col("purpose").alias("g_purpose"), F.col("destination").alias("g_destination"), F.col("operation").alias("g_operation"), F.col("expires_at").alias("g_expires"))
    out = requests.join(m, "mapping_ref", "left").join(g, "grant_id", "left")
    reason = enums.first_failing(
        (F.col("known").isNull(), "UNKNOWN_MAPPING"), (F.col("lifecycle") != "ACTIVE", "MAPPING_NOT_ACTIVE"), (F.col("now") >= F.col("m_expires"), "MAPPING_EXPIRED"),
        ((F.col("semantic_type") == "CREDENTIAL_OR_SECRET") | (F.col("sensitivity") == "SECRET"), "NON_REVERSIBLE_MAPPING"), (F.col("m_tenant") != F.col("tenant_id"), "SCOPE_MISMATCH"),
        (F.col("granted").isNull(), "NO_GRANT"), (F.col("g_ref") != F.col("mapping_ref"), "GRANT_MISMATCH"), (F.col("g_revision") != F.col("revision"), "STALE_REVISION"),
        ((F.col("g_principal") != F.col("principal")) | (F.col("g_tenant") != F.col("m_tenant")), "SCOPE_MISMATCH"), (F.col("g_purpose") != F.col("purpose"), "GRANT_MISMATCH"),
        (F.col("g_destination") != F.col("destination"), "GRANT_MISMATCH"), (F.col("g_operation") != F.col("operation"), "OPERATION_NOT_GRANTED"),
        (F.col("now") >= F.col("g_expires"), "GRANT_EXPIRED"), otherwise="AUTHORIZED",
    )
    return out.select("request_id", reason.alias("reason")).withColumn("state", F.when(F.col("reason") == "AUTHORIZED", "AUTHORIZED").otherwise("DENIED"))


def _digest(key: bytes) -> Column:
    return hmac_sha256(key, F.concat_ws("|", F.col("sequence").cast("string"), "kind", "outcome", F.col("occurred_at").cast("string"), "prev_digest"))


def chained(events: DataFrame, key: bytes) -> DataFrame:
    """``events(stream, kind, outcome, occurred_at, event_id)`` as chains: (stream, sequence, kind, outcome, occurred_at, prev_digest,
    entry_digest).  Each digest needs the one before, so a stream is read in order, in batches, by one task."""

    def run(_key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, prev = 0, ZERO
        for f in frames:
            seqs, prevs, digests = [], [], []
            for kind, outcome, at in zip(f.kind, f.outcome, f.occurred_at, strict=True):
                sequence += 1
                seqs.append(sequence)
                prevs.append(prev)
                prev = hmac.new(key, f"{sequence}|{kind}|{outcome}|{at}|{prev}".encode(), hashlib.sha256).hexdigest()
                digests.append(prev)
            yield pd.DataFrame({"stream": f.stream, "sequence": seqs, "kind": f.kind, "outcome": f.outcome, "occurred_at": f.occurred_at, "prev_digest": prevs, "entry_digest": digests})

    schema = "stream long, sequence long, kind string, outcome string, occurred_at long, prev_digest string, entry_digest string"

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(run(None, iter([f.sort_values(["occurred_at", "event_id"])]))))

    return events.groupBy("stream").applyInPandas(whole, schema)


def verified(entries: DataFrame, anchors: DataFrame, key: bytes) -> DataFrame:
    """(stream, status, finding, entries).  Each row holds the digest before it, so every link is checked on its own."""
    order = Window.partitionBy("stream").orderBy("sequence")
    e = entries.withColumn("_prev", F.coalesce(F.lag("entry_digest").over(order), F.lit(ZERO))).withColumn("_n", F.row_number().over(order))
    broken = (F.col("sequence") != F.col("_n")) | (F.col("prev_digest") != F.col("_prev")) | (F.col("entry_digest") != _digest(key))
    g = e.groupBy("stream").agg(F.count("*").alias("entries"), F.bool_or(broken).alias("broken"))
    a = anchors.select("stream", "sequence", F.col("entry_digest").alias("anchor")).join(entries.select("stream", "sequence", "entry_digest"), ["stream", "sequence"], "left").join(g.select("stream", "entries"), "stream", "left")
    gone, differs = F.col("entry_digest").isNull(), F.col("entry_digest") != F.col("anchor")
    a = a.groupBy("stream").agg(F.count("*").alias("anchors"), F.bool_or(gone & (F.col("sequence") > F.col("entries"))).alias("cut"), F.bool_or(gone).alias("gone"), F.coalesce(F.bool_or(differs), F.lit(False)).alias("differs"))
    out = g.join(a, "stream", "left")
    finding = enums.first_failing((F.col("cut"), "TAIL_TRUNCATED"), (F.col("gone"), "ENTRY_MISSING"), (F.col("differs"), "CHECKPOINT_DIGEST_MISMATCH"), (F.col("broken"), "CHAIN_BROKEN"), (F.col("anchors").isNull(), "NO_ANCHOR"), otherwise="VERIFIED_TO_ANCHOR")
    status = F.when(finding == "VERIFIED_TO_ANCHOR", "VERIFIED").when(finding == "NO_ANCHOR", "UNANCHORED").otherwise("TAMPERED")
    return out.select("stream", status.alias("status"), finding.alias("finding"), "entries")


def checkpoints(entries: DataFrame) -> DataFrame:
    """(stream, sequence, entry_digest) of the last entry of each stream."""
    return entries.groupBy("stream").agg(F.max_by(F.struct("sequence", "entry_digest"), "sequence").alias("e")).select("stream", "e.sequence", "e.entry_digest")


def read(entries: DataFrame, stream: int, low: int, high: int, kinds: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """One stream's entries in a range of sequence, at most 1000 of them, with how many matched and whether more did."""
    rows = entries.where((F.col("stream") == stream) & F.col("sequence").between(low, high))
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    n = rows.agg(F.count("*").alias("matched"))
    first = rows.orderBy("sequence").limit(min(limit, 1000))
    return first.crossJoin(n).withColumn("truncated", F.col("matched") > min(limit, 1000)).select("sequence", "kind", "outcome", "entry_digest", "matched", "truncated")
