"""Comparison of a lock file, a bill of materials and a published set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(locked: DataFrame, sbom: DataFrame, published: DataFrame) -> DataFrame:
    """(code, n): how often each issue holds; no rows mean that all three describe one tree.

    ``locked(path, name, version, integrity, resolved, link)``, ``sbom(path, name, version, content, unsupported)``,
    ``published(name, version)``; integrity and content are hexadecimal SHA-512 or null."""
    first = sbom.where("path is not null").groupBy("path").agg(F.count("*").alias("_n"), F.min(F.struct("name", "version", "content", "unsupported")).alias("s"))
    both = locked.withColumn("_l", F.lit(True)).join(first, "path", "full_outer")
    l, s = F.col("_l").isNotNull(), F.col("s").isNotNull()
    met = l & s
    cases = [
        ("SBOM_COMPONENT_DUPLICATE", F.coalesce("_n", F.lit(0)) > 1),
        ("SBOM_COMPONENT_ABSENT_FROM_LOCKFILE", s & ~l),
        ("DEPENDENCY_NOT_INTEGRITY_PINNED", l & F.col("integrity").isNull()),
        ("DEPENDENCY_RESOLUTION_MISSING", l & F.col("resolved").isNull() & ~F.coalesce("link", F.lit(False))),
        ("LOCKED_DEPENDENCY_ABSENT_FROM_SBOM", l & ~s),
        ("DEPENDENCY_VERSION_MISMATCH", met & ((F.col("s.version") != F.col("version")) | (F.col("s.name") != F.col("name")))),
        ("DEPENDENCY_CONTENT_ALGORITHM_UNSUPPORTED", met & F.col("s.unsupported")),
        ("DEPENDENCY_CONTENT_MISSING", met & ~F.col("s.unsupported") & F.col("s.content").isNull()),
        ("DEPENDENCY_CONTENT_MISMATCH", met & ~F.col("s.unsupported") & F.col("s.content").isNotNull() & F.col("integrity").isNotNull() & (F.col("s.content") != F.col("integrity"))),
    ]
    codes = both.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases)))).alias("code"))
    pathless = sbom.where("path is null").select(F.lit("SBOM_COMPONENT_PATH_MISSING").alias("code"))
    keys = ["name", "version"]
    own, out = locked.select(*keys).distinct(), published.select(*keys).distinct()
    more = own.join(out, keys, "left_anti").select(F.lit("DEPENDENCY_NOT_IN_PUBLISHED_SET").alias("code"))
    less = out.join(own, keys, "left_anti").select(F.lit("DEPENDENCY_MISSING_FROM_PUBLISHED_SET").alias("code"))
    return codes.union(pathless).union(more).union(less).groupBy("code").agg(F.count("*").alias("n"))
