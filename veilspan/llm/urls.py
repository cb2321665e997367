"""URL filter by a Bloom filter cascade.

Keys are hosts and the domains above them.  Level 0 encodes the listed hosts; level 1 encodes the other keys of the corpus's
complete key universe that pass level 0; level 2 the listed ones that pass level 1; and so on until no key of the universe is
told wrongly.  Membership of every key of the corpus is then exact and needs no join: the levels are broadcast.  Their size is
known before they are built; above ``MOST_BITS`` the keys are dealt to shards by hash, and the shards' levels are asked one
after another.

Defined cases: a null url or one without ``://`` has an empty host and path, which no list holds (allow); null and repeated
page ids each give their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of all levels together that may be broadcast (64 MB), and false positives of levels after the first.
MOST_BITS, LATER_RATE = 512 * 2**20, 0.25
#: Fixed values: (host, path, verdict), as the contract states them.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The list of the query: hosts that are blocked with all their subdomains.  The operator takes any table of hosts.
LISTED_HOSTS = tuple(
    f"{label}.example.{top}"
    for label in ("spam-farm", "cheap-pills", "free-casino", "link-farm", "adult-dating", "payday-loans", "replica-watches", "crypto-doubler")
    for top in ("com", "net", "org")
)


def parts(url: str) -> tuple[Column, Column]:
    """Host and path columns of a url column."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def domains(host: str) -> Column:
    """A host and every domain above it."""
    return F.expr(f"transform(sequence(1, size(split({host}, '[.]'))), k -> array_join(slice(split({host}, '[.]'), k, size(split({host}, '[.]'))), '.'))")


class Level:
    """One Bloom filter over two 64-bit hashes of a key."""

    def __init__(self, n: int, rate: float, seed: int) -> None:
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(1.45 * n * self.k / 64) * 64)
        self.seed = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64)
        self.words = np.zeros(self.m // 64, np.uint64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (a ^ self.seed) * np.uint64(0xBF58476D1CE4E5B9), (b * self.seed) | np.uint64(1)
        x ^= x >> np.uint64(29)
        return (x[:, None] + np.arange(self.k, dtype=np.uint64) * y[:, None]) % np.uint64(self.m)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self.slots(a, b)
        return ((self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).all(1)


def _u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def _built(keys: DataFrame, level: Level) -> Level:
    """``level`` with the bits of all ``keys(a, b)``: words are or-ed in the cluster; the driver gets at most m / 64 of them."""

    def bits(frames):
        for f in frames:
            s = level.slots(_u64(f.a), _u64(f.b)).ravel()
            words = pd.DataFrame({"word": (s >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (s & np.uint64(63))).view(np.int64)})
            yield words.drop_duplicates()

    for word, value in keys.mapInPandas(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        level.words[word] = np.uint64(value % 2**64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)
    return keys.mapInPandas(lambda frames: (f[shared.value.has(_u64(f.a), _u64(f.b))] for f in frames), "a long, b long")


def cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> list[Level] | None:
    """Levels that tell the listed keys of ``universe(key, listed)`` from all others; None beyond ``most_bits``."""
    hashed = common.written(universe.groupBy(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), "key").alias("b")).agg(F.max("listed").alias("listed")))
    inside, outside = hashed.where("listed").select("a", "b"), hashed.where("not listed").select("a", "b")
    n, rest = inside.count(), outside.count()
    levels: list[Level] = []
    rate = min(0.25, max(1e-4, n / (2 * max(1, rest))))
    while n:
        level = Level(n, rate, len(levels))
        if level.m + sum(x.m for x in levels) > most_bits:
            return None
        levels.append(_built(inside, level))
        wrong = common.written(_passing(outside, level))
        inside, outside, rate, n = wrong, inside, LATER_RATE, wrong.count()
    return levels


def members(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: a key that first fails at an odd level, or at none and the last is even, is."""
    out = np.zeros(len(a), bool)
    live = np.ones(len(a), bool)
    for k, level in enumerate(levels):
        live &= level.has(a, b)
        out = np.where(live, k % 2 == 0, out)
    return out


def _asked(levels):
    """Function of two arrays of hashes of keys: whether any of the keys is listed by the broadcast ``levels``."""

    @F.pandas_udf("boolean")
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.str.len().to_numpy()
        none = np.zeros(0, np.int64)
        x, y = (np.concatenate([none, *s]).astype(np.int64).view(np.uint64) for s in (a, b))
        found = members(levels.value, x, y)
        return pd.Series(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[found], minlength=len(sizes)) > 0)

    return member


def members_of(rows: DataFrame, keys: str, universe: DataFrame, most_bits: int = MOST_BITS, shards: int = 1) -> DataFrame:
    """``rows`` with ``hit``: whether any key of the array ``keys`` is listed in ``universe(key, listed)``, which holds them all."""
    spark = rows.sparkSession
    shard = F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards))
    built = []
    for k in range(shards):
        levels = cascade(universe.where(shard == k), most_bits)
        if levels is None:
            return members_of(rows, keys, universe, most_bits, 4 * shards)
        built.append(spark.sparkContext.broadcast(levels))
    out = rows.withColumn("hit", F.lit(False))
    for k, levels in enumerate(built):
        own = F.filter(keys, lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)) == k)  # noqa: B023
        out = out.withColumn("hit", F.col("hit") | _asked(levels)(F.transform(own, lambda x: F.xxhash64(x)), F.transform(own, lambda x: F.xxhash64(F.lit("b"), x))))
        if shards > 1:
            out = common.written(out)
            levels.unpersist()
    return out


def judge(pages: DataFrame, hosts: DataFrame, rules: tuple = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages(page_id, url)``; ``hosts(host)`` are blocked with all their
    subdomains where no rule fits.  Null and repeated rows of ``hosts`` count for nothing."""
    host, path = parts("url")
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("_keys", F.when(F.col("host") != "", domains("host")).otherwise(F.expr("cast(array() as array<string>)")))
    keys = rows.select(F.explode("_keys").alias("key")).distinct()
    marked = hosts.select(F.lower(F.col("host").cast("string")).alias("key")).where("key <> ''").distinct().withColumn("_on", F.lit(True))
    universe = common.written(keys.join(marked, "key", "left").select("key", F.coalesce("_on", F.lit(False)).alias("listed")))
    rows = members_of(rows, "_keys", universe, most_bits)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("hit"), "block").otherwise("allow")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(common.table(spark, sf_dir, "pages"), spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string"))


def oracle() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in order]
    rule = " ".join(f"when {f} then '{h + p}'" for f, (h, p, _) in zip(fits, order, strict=True))
    verdict = " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, order, strict=True))
    return f"""
with t as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from t)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when len(list_filter([{', '.join(f"'{h}'" for h in LISTED_HOSTS)}], lambda h: host = h or ends_with(host, '.' || h))) > 0 then 'block' else 'allow' end as verdict from u"""
