"""Readers and writers.  Schemas are given, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCK = "packages map<string, struct<name: string, version: string, integrity: string, resolved: string, link: boolean>>"
SBOM = "components array<struct<name: string, version: string, `bom-ref`: string, hashes: array<struct<alg: string, content: string>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a closed schema; a line that does not fit is kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def locked(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, version, integrity, resolved, link) of a package lock."""
    rows = text_files(spark, path).select(F.from_json("text", LOCK)["packages"].alias("p")).select(F.explode("p").alias("path", "d")).where("path <> ''")
    return rows.select("path", F.coalesce("d.name", F.regexp_extract("path", r"([^/]+(?:/[^/]+)?)$", 1)).alias("name"), "d.version", "d.integrity", "d.resolved", F.coalesce("d.link", F.lit(False)).alias("link"))


def components(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, version, content, unsupported) of a bill of materials."""
    rows = text_files(spark, path).select(F.explode(F.from_json("text", SBOM)["components"]).alias("c"))
    sha = F.get(F.filter("c.hashes", lambda h: h["alg"] == "SHA-512"), F.lit(0))["content"]
    return rows.select(F.col("c.bom-ref").alias("path"), "c.name", "c.version", sha.alias("content"), (sha.isNull() & (F.coalesce(F.size("c.hashes"), F.lit(0)) > 0)).alias("unsupported"))


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
