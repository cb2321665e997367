"""Overlap composition of spans: regions, relations, obligations, adjacency, cover and rewriting.

Every span join has the text's key as an equality, so that it is hashed and not nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums


def regions(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spans(key, start, end, ..)`` with ``region``, from 0: strictly overlapping spans share one, touching ones do not."""
    order = Window.partitionBy(key).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    running = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("_opens", opens).withColumn("region", (F.sum("_opens").over(running) - 1).cast("long")).drop("_opens")


def bounds(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, region, start, end, members)."""
    return grouped.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members"))


def relations(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, region, relations): IDENTICAL, CONTAINING, CONTAINED and PARTIAL among the members in order."""
    order = Window.partitionBy(key, "region").orderBy("start", F.desc("end"), "rule")
    placed = grouped.withColumn("_n", F.row_number().over(order)).select(key, "region", "start", "end", "_n")
    pairs = placed.alias("a").join(placed.alias("b"), [key, "region"]).where("a._n < b._n")
    kind = F.expr(
        """case when a.start = b.start and a.end = b.end then 'IDENTICAL' when a.start <= b.start and a.end >= b.end then 'CONTAINING'
        when b.start <= a.start and b.end >= a.end then 'CONTAINED' when a.start < b.end and b.start < a.end then 'PARTIAL' end"""
    )
    found = pairs.select(key, "region", kind.alias("kind")).where("kind is not null")
    return found.groupBy(key, "region").agg(F.array_sort(F.collect_set("kind")).alias("relations"))


def obligations(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, region, semantic_types, subtypes, highest_sensitivity, non_reversible, conflicts) over the members' claims."""
    sets = grouped.groupBy(key, "region").agg(
        F.array_sort(F.collect_set("semantic_type")).alias("semantic_types"),
        F.array_sort(F.collect_set("subtype")).alias("subtypes"),
        F.max(enums.rank("sensitivity", enums.SENSITIVITIES)).alias("_top"),
        F.count_distinct("sensitivity").alias("_kinds"),
        F.coalesce(F.bool_or(~F.col("reversible")), F.lit(False)).alias("non_reversible"),
    )
    conflicts = enums.reasons((F.size("semantic_types") > 1, "SEMANTIC_TYPE"), (F.size("subtypes") > 1, "SUBTYPE"), (F.col("_kinds") > 1, "SENSITIVITY"))
    return sets.select(key, "region", "semantic_types", "subtypes", enums.named(F.col("_top"), enums.SENSITIVITIES).alias("highest_sensitivity"), "non_reversible", conflicts.alias("conflicts"))


def adjacent(bound: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, left_region, right_region): regions that touch."""
    left, right = bound.alias("a"), bound.alias("b")
    return left.join(right, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.end") == F.col("b.start"))).select(F.col(f"a.{key}"), F.col("a.region").alias("left_region"), F.col("b.region").alias("right_region"))


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", bucket: int = 1024) -> DataFrame:
    """Pairs of (l, r) structs whose spans overlap.  Long texts do not gather: spans meet within buckets of offsets, and a pair
    counts in the bucket where the later of the two begins."""
    def dealt(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*df.columns).alias(name)
        buckets = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))
        return df.select(F.col(key).alias("_k"), row, F.explode(buckets).alias("_b"))

    met = dealt(left, "l").join(dealt(right, "r"), ["_k", "_b"])
    return met.where("l.start < r.end and r.start < l.end").where(F.floor(F.greatest("l.start", "r.start") / bucket) == F.col("_b")).select("l", "r")


def smallest_cover(bound: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, region, field_start, field_end): the smallest field around each region; null where none covers it."""
    met = bound.alias("a").join(fields.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.end") >= F.col("a.end")), "left")
    order = Window.partitionBy(f"a.{key}", "a.region").orderBy(F.expr("b.end - b.start"), F.col("b.start"), F.col("b.end"))
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col(f"a.{key}"), "a.region", F.col("b.start").alias("field_start"), F.col("b.end").alias("field_end"))


def retention(found: DataFrame) -> DataFrame:
    """(basis, semantic_type, n, texts): what is kept, by source and type."""
    return found.groupBy("basis", "semantic_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("texts"))


def masked(texts: DataFrame, bound: DataFrame, key: str = "doc_id", literal: str = "[PROTECTED]") -> DataFrame:
    """``texts(key, text)`` with every region replaced by ``literal``; and how many were."""
    cuts = bound.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_r"))
    out = texts.join(cuts, key, "left")
    text = F.expr(
        f"""case when _r is null then text else concat(array_join(transform(_r, (s, i) ->
        substring(text, if(i = 0, 0, _r[i - 1].end) + 1, s.start - if(i = 0, 0, _r[i - 1].end))), '{literal}'), '{literal}', substring(text, element_at(_r, -1).end + 1)) end"""
    )
    return out.select(key, text.alias("text"), F.coalesce(F.size("_r"), F.lit(0)).alias("regions"))


def survives(texts: DataFrame, values: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): values of which a window of max(8, half its length) is still in the text."""
    size = F.greatest(F.lit(8), F.ceil(F.length("value") / 2)).cast("int")
    met = texts.join(values.where(F.length("value") >= 8).select(key, "value"), key).withColumn("_w", size)
    left = F.expr("exists(sequence(1, length(value) - _w + 1), i -> contains(text, substring(value, i, _w)))")
    return met.where(left).select(key, "value")
