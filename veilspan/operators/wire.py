"""Wire formats: chat requests and responses, interaction envelopes, canonical JSON, strict encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums

REQUEST = "model string, messages array<struct<role: string, content: string>>, stream boolean"
RESPONSE = "id string, choices array<struct<index: int, message: struct<role: string, content: string>, finish_reason: string>>, usage struct<prompt_tokens: long, completion_tokens: long>"
ROLES = ("system", "developer", "user", "assistant")


def requests(bodies: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, refusal, n_messages): null refusal means translated; the first failing check names the code."""
    r = bodies.select(key, "body", F.from_json("body", REQUEST).alias("r"))
    refusal = enums.first_failing(
        (F.octet_length("body") > 65536, "BODY_TOO_LARGE"), (F.col("r").isNull() | F.col("r.messages").isNull(), "INVALID_JSON"), (F.col("r.model").isNull(), "MISSING_MODEL"),
        (F.coalesce(F.col("r.stream"), F.lit(False)), "STREAM_UNSUPPORTED"), (F.size("r.messages") == 0, "NO_MESSAGES"), (F.size("r.messages") > 64, "TOO_MANY_MESSAGES"),
        (F.exists("r.messages", lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "UNSUPPORTED_ROLE"), (F.exists("r.messages", lambda m: m["content"].isNull()), "UNSUPPORTED_CONTENT"),
        otherwise="",
    )
    return r.select(key, F.nullif(refusal, F.lit("")).alias("refusal"), F.coalesce(F.size("r.messages"), F.lit(0)).alias("n_messages"))


def messages(bodies: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, place, role, text) of the requests that are translated."""
    good = requests(bodies, key).where("refusal is null").select(key)
    return bodies.join(good, key).select(key, F.posexplode(F.from_json("body", REQUEST)["messages"]).alias("place", "m")).select(key, "place", "m.role", F.col("m.content").alias("text"))


def built(turns: DataFrame, model: str = "local-model") -> DataFrame:
    """(conv_id, body): one request body for each conversation of ``turns(conv_id, turn, role, text)``, in order of turns."""
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return said.select("conv_id", F.to_json(F.struct(F.lit(model).alias("model"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))).alias("body"))


def responses(bodies: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, refusal, text, prompt_tokens, completion_tokens) of single-choice completions."""
    r = bodies.select(key, F.from_json("body", RESPONSE).alias("r"))
    refusal = enums.first_failing((F.col("r").isNull() | F.col("r.choices").isNull(), "INVALID_JSON"), (F.size("r.choices") != 1, "CHOICE_COUNT"), (F.get("r.choices", F.lit(0))["message"]["content"].isNull(), "NO_TEXT"), otherwise="")
    text = F.get("r.choices", F.lit(0))["message"]["content"]
    return r.select(key, F.nullif(refusal, F.lit("")).alias("refusal"), F.when(refusal == "", text).alias("text"), F.col("r.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.usage.completion_tokens").alias("completion_tokens"))


def fresh(proofs: DataFrame) -> DataFrame:
    """``proofs(now, issued_at, expires_at)`` with ``fresh``: issued in the last five minutes, not expired, at most five minutes long."""
    five = 300
    return proofs.withColumn("fresh", F.coalesce((F.col("issued_at") <= F.col("now")) & (F.col("issued_at") >= F.col("now") - five) & (F.col("expires_at") > F.col("now")) & (F.col("expires_at") - F.col("issued_at") <= five), F.lit(False)))


def ordered(fragments: DataFrame) -> DataFrame:
    """``fragments(stream_id, arrival, sequence, final)`` with ``accepted``: 0 first, then one more each, none after the final one."""
    order = Window.partitionBy("stream_id").orderBy("arrival")
    before = F.lag("sequence").over(order)
    good = (F.col("sequence") == F.coalesce(before + 1, F.lit(0))) & ~F.coalesce(F.lag("final").over(order), F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return fragments.withColumn("accepted", F.min(good.cast("int")).over(upto) == 1)


def strict_base64(value: str) -> Column:
    """Canonical base64: decodes, and encodes back to itself."""
    return F.coalesce(F.base64(F.try_to_binary(F.col(value), F.lit("base64"))) == F.col(value), F.lit(False))


def lower_hex(value: str) -> Column:
    return F.coalesce(F.col(value).rlike("^[0-9a-f]+$"), F.lit(False))
