"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, embeddings, langid, neardup, packing, quality, secrets, substrings, toxicity, urls


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_quality": quality.op2_quality,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_minhash": neardup.op5_minhash,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_language_id": langid.op7_language_id,
        "op8_url_filter": urls.op8_url_filter,
        "op9_packing": packing.op9_packing,
        "op10_substrings": substrings.op10_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.oracle(), "op6_embeddings": embeddings.ORACLE, "op8_url_filter": urls.oracle()}
