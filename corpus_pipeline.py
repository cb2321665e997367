"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Each stage takes the rows that its predecessor kept, written as Parquet and read again; ``sf_dir`` gives the tables of
labels and benchmark items.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common, decontam, neardup, packing, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return _documents(secrets.redacted(docs.select(*COLUMNS)))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, in sequences mixed by source."""
    return packing.pack(docs.select(*COLUMNS), packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_copies),
    ("benchmark passages", drop_benchmarks),
    ("secrets", mask_secrets),
    ("packing", pack_tokens),
]

#: Classifier, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
