"""Helpers shared by the training-data operators: inputs, scratch tables, folds, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch handed to Python; texts can be long, so a batch is bounded by its bytes.
ARROW_BYTES, ARROW_ROWS = 2 * 2**20, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with what it has freed given back to the system after each batch and at the end: workers outlive a
    stage, and would hold their largest batch beside the next stages."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    @wraps(run)
    def each(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            trim()
        trim()

    return each


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``; a local one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = tempfile.mkdtemp(prefix="veilspan-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/veilspan-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of steps that are over: they go with the driver's objects, which may stay for long in a large heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str, folds: int) -> F.Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(folds)


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Whole rows, about ``most`` at most, chosen by a hash of their key: the same rows on every run."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * 1_000_000)
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < share)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node in ``edges(a, b)`` that reaches a smaller one, as (node, component).

    Alternating large-star and small-star steps: each is a distributed min-aggregation, hot nodes are
    pre-aggregated before the shuffle, and the number of steps grows with the logarithm of the longest chain.
    Every step is a written table, so no lineage builds up.
    """
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        return (
            e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )

    before = None
    for _ in range(rounds):
        cur = written(small(large(cur)))
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
