"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A text is cut into lower-cased runs of letters and digits.  Each fixed mask takes five of the tokens at and after a
position and ignores those between, so a substituted token spoils only some of the seeds around it.  Seeds of the test items
meet seeds of the training texts in a hash join.  Short items have further masks, so that whatever tokens of an item of up to
a window are substituted within the tolerance, some mask misses them all; items under five tokens, where none may be, are
seeds as a whole.  Texts are cut by a further mask only where an item of such a length exists.  Each hit gives an alignment of item and text, and the pair stands if in some
window of ``WINDOW`` tokens of the item (or all of it, where shorter) at least ``IDENTITY`` agree with the text.

The items' seeds are broadcast while there are at most ``MOST_BROADCAST`` of them, so that seeds of the texts are never
shuffled; above that they meet in a shuffled join.

Defined cases: null and empty texts, and items without a letter or digit, are never reported; items with a null id are
reported with it; repeated items report under their smallest id; repeated rows of one id count as one; a null document id is reported as null;
empty tables give no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed masks: the token positions that count, of a span of eight.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
#: Further masks by the length of the item that needs them.
_GAPPED = (0, 1, 2, 4, 5)
EXTRA = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)), 6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: (_GAPPED,), 10: ((0, 1, 3, 7, 8),), 11: (_GAPPED,), 15: (_GAPPED,),
}
#: Tokens of the verified window, the share of them that must agree, and the most seeds that are broadcast.
WINDOW, IDENTITY, MOST_BROADCAST = 20, 0.8, 400_000


def tokens(text: str | Column) -> Column:
    """64-bit hashes of the tokens of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(lengths: set[int]) -> dict[tuple[int, ...], list[int] | None]:
    """The masks that items of ``lengths`` tokens need, and the lengths that use each; None: all."""
    out: dict[tuple[int, ...], list[int] | None] = dict.fromkeys(MASKS)
    for n in sorted(lengths & {*EXTRA}):
        for mask in EXTRA[n]:
            out.setdefault(mask, []).append(n)
    return out


def seeds(texts: DataFrame, masks: dict[tuple[int, ...], list[int] | None], own: bool = False) -> DataFrame:
    """(key, pos, seed) of every mask wherever it fits into ``texts(key, h)``; ``own``: of items, by the masks of their lengths only.

    A text becomes a row for each token before anything is hashed, all in one compiled step: a higher-order function over the
    positions would be interpreted, which takes ten times as long.  The tokens stay where they are until the seeds have left them."""
    each = []
    for k, (mask, lengths) in enumerate(masks.items()):
        fits = f"pos + {max(mask)} < size(h)" + (f" and size(h) in ({', '.join(map(str, lengths))})" if own and lengths else "")
        each.append(f"if({fits}, xxhash64({k}, {', '.join(f'get(h, pos + {o})' for o in mask)}), null)")
    # Outer: else Spark asks for the size of the tokens first, and cuts the text once more for it.
    places = texts.select("key", "h", F.posexplode_outer("h").alias("pos", "_"))
    return places.select("key", "pos", F.explode(F.expr(f"array({', '.join(each)})")).alias("seed")).where("seed is not null")


def items(bench: DataFrame) -> DataFrame:
    """(item_id, item): tokens of test items; repeated texts once, under their smallest id."""
    cut = bench.select("item_id", tokens(F.col("text").cast("string")).alias("item"))
    return cut.groupBy("item").agg(F.min("item_id").alias("item_id"))


def overlaps(docs: DataFrame, bench: DataFrame, key: str = "doc_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, item_id, matched, window, at): contaminated texts of ``docs(key, text)``.

    matched: most agreeing tokens of a window of the item; window: its size; at: where the item would begin in the text."""
    own = common.written(items(bench).where(F.size("item") > 0).withColumn("ikey", F.monotonically_increasing_id()))
    sizes = own.select("ikey", F.size("item").alias("size"))
    masks = masks_for({r.n for r in own.select(F.size("item").alias("n")).where(F.col("n") <= max(EXTRA)).distinct().collect()})  # as many rows as EXTRA has lengths
    theirs = common.written(seeds(own.select(F.col("ikey").alias("key"), F.col("item").alias("h")), masks, own=True).select(F.col("key").alias("ikey"), F.col("pos").alias("ipos"), "seed").distinct())
    row = F.xxhash64(F.col(key), F.col("text").cast("string"))
    texts = docs.select(row.alias("key"), tokens(F.col("text").cast("string")).alias("h"))
    mark = F.broadcast(theirs) if theirs.count() <= most_broadcast else theirs
    # Hits of one passage share an alignment: one row for each, whatever the number of its seeds.
    hits = seeds(texts, masks).join(mark, "seed").groupBy("key", "ikey", (F.col("pos") - F.col("ipos")).alias("at")).agg(F.count("*").alias("n"))
    lined = common.written(hits.join(sizes, "ikey").groupBy("key").agg(F.collect_list(F.struct("ikey", "at", "size")).alias("hits")))
    met = docs.select(F.col(key).alias("_id"), row.alias("key"), F.col("text").cast("string").alias("text")).join(lined, "key").select("_id", tokens("text").alias("h"), "hits")
    # An alignment takes along the tokens beside the item, and no others; beyond the text there are none (null).
    beside = "transform(hits, x -> struct(x.ikey as ikey, x.at as at, transform(sequence(0, x.size - 1), i -> if(x.at + i >= 0, get(h, x.at + i), null)) as part))"
    met = met.select("_id", F.explode(F.expr(beside)).alias("x")).select("_id", "x.*").join(own, "ikey")
    # Tokens that agree, as 0 and 1, and the best sum over a window.
    size = f"least({WINDOW}, size(item))"
    rows = met.withColumn("y", F.expr("zip_with(item, part, (t, p) -> if(coalesce(t = p, false), 1, 0))"))
    rows = rows.select("_id", "item_id", "at", F.expr(size).alias("window"), F.expr(f"array_max(transform(sequence(0, size(item) - {size}), j -> aggregate(slice(y, j + 1, {size}), 0, (n, e) -> n + e)))").alias("matched"))
    rows = rows.where(F.col("matched") >= F.ceil(IDENTITY * F.col("window")))
    return rows.groupBy("_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"), F.min("at").alias("at")).withColumnRenamed("_id", key)


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark passage."""
    keyed = docs.withColumn("_text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    bad = common.written(overlaps(keyed.select("_text", "text"), bench, "_text").select("_text").distinct())
    return keyed.join(bad, "_text", "left_anti").drop("_text")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of ``benchmark``, with the item."""
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
