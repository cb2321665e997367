"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

A text's multiset of five-word shingles has weights 1, 2, 3, ...  The weight axis is cut into dyadic blocks [0,1), [1,2),
[2,4), ...; over each shingle and block runs a Poisson process at the block's length, whose points fall at a position in
the block and on one of the signature's components, and count where the position lies below the weight.  So a weight w
costs log w processes, not w.  Points come in order of time and a process stops once it is later than the text's slowest
component.  Each component keeps its first point; two texts agree on it with the probability of their weighted Jaccard
similarity, sum of minima over sum of maxima.

Texts with the same words are one class.  Classes that share a band meet the band's most central class (a star, never all
pairs), pairs are verified on their exact multisets, and links are closed to components.  Members of one band that are then
still in different components are compared with each other in blocks inside a task, which returns links between components
and never the pairs: no link between different texts is lost.

Defined cases: a null text is empty; texts without words form one class; a text of under five words has one shingle, all its
words; repeated rows are copies; a null id is a copy like any other and never names a group that has ids; empty tables give
no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a shingle, the similarity from which texts are near-duplicates, bands and rows of a band (a pair at 0.8
#: shares no band with probability 3e-6).
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
#: Most rows and characters of a block of a band's members that are compared with each other.
BLOCK_ROWS, BLOCK_BYTES = 768, 4 << 20
#: Most classes (24 bytes each) that are broadcast to pick their texts.
MOST_BROADCAST = 1_000_000
#: Elements (distinct shingles) whose points are drawn at a time.
SLICE = 1 << 16
#: A band or group is hot from this share of all classes on, a class from this share of all rows: there are at most
#: ``BANDS / HOT_SHARE`` (32,000) such bands, and 1,000 such groups and classes.
HOT_SHARE = 1 / 1000
_SPACE = r"[^\pL\pN]+"
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def normal(texts: pa.Array) -> pa.Array:
    """Lower-cased words, one space between them."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), _SPACE, " "))


def shingles(words: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, from its normal form."""
    cut = pc.split_pattern(words, " ")
    coded = cut.values.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    ends = cut.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    n = np.diff(ends)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    n = np.where(empty, 0, n)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    at = np.repeat(ends[:-1], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    s = np.zeros(len(doc), np.uint64)
    stop = ends[:-1][doc] + n[doc]
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        s = s * _C + np.where(at + k < stop, padded[at + k], np.uint64(k))
    s = _mix(s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    return doc[starts], s[starts], np.diff(np.append(starts, len(s)))


def signatures(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signatures (n x size) of weighted sets, in order of ``doc``; elements of no set leave zeros.

    Elements are taken ``SLICE`` at a time, which bounds memory at any length of text: each component keeps its first point."""
    times, names = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    for at in range(0, len(doc), SLICE):
        own = slice(at, at + SLICE)
        _points(times, names, doc[own], element[own], weight[own], size)
    return names.reshape(n, size)


def _points(times: np.ndarray, names: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int) -> None:
    """Let the points of some elements, in order of ``doc``, into the components' first ``times`` and ``names``."""
    first, until = int(doc[0]), int(doc[-1]) + 1
    slowest = times.reshape(-1, size)[first:until]
    parts = [(doc, element, weight, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while len(at := np.flatnonzero(weight > low)):
        parts.append((doc[at], _mix(element[at] + np.uint64(low * int(_C) % 2**64)), weight[at], np.full(len(at), low), np.full(len(at), low)))
        low *= 2
    d, state, w, base, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    x = np.zeros(len(d))
    while len(d):
        state = state + _C
        r, s = _mix(state), _mix(state ^ _A)
        x = x - np.log(((r >> np.uint64(11)).astype(float) + 1) / 2**53) / length
        component = d * size + ((s >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        real = base + ((s & np.uint64(0xFFFFFFFF)) % length.astype(np.uint64)).astype(np.int64) < w
        better = np.flatnonzero(real & (x < times[component]))
        c, t = component[better], x[better]
        np.minimum.at(times, c, t)
        won = t == times[c]
        names[c[won]] = r[better][won] ^ s[better][won]
        live = x < slowest.max(1)[d - first]
        if not live.all():
            d, state, w, base, length, x = d[live], state[live], w[live], base[live], length[live], x[live]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of sorted distinct shingles with weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 1.0


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, class, bands) of every row of ``docs(doc_id, text)``; class: 128-bit hash of its words; row: 128 bits of id and text."""
    common.small_batches(docs.sparkSession)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = normal(batch.column("text"))
            doc, s, w = shingles(words)
            names = signatures(len(words), doc, s, w, bands * rows).reshape(-1, bands, rows)
            h = np.zeros(names.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                h = _mix(h * _C + names[:, :, k])
            has = np.bincount(doc, minlength=len(words)) > 0
            ids = [xxhash.xxh3_128_digest(x) for x in words.to_pylist()]
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32()), pa.array(h[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary()), flat], names=["doc_id", "row", "class", "bands"])

    return docs.select(F.col("doc_id").cast("long"), row_of("doc_id", "text").alias("row"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row binary, class binary, bands array<long>")


def row_of(doc_id: str, text: str) -> F.Column:
    """128 bits that name a row by its id and text."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), doc_id, text)), 16, "0") for k in (1, 2))))


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text) of some classes, each from the row that stands for it."""
    wanted = common.written(nodes.join(classes.select("class", "row"), "class"))
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted  # else texts are moved to meet them
    texts = docs.select(row_of("doc_id", "text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.written(texts.join(wanted, "row").select("class", "text").dropDuplicates(["class"]))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose multisets are at least ``least`` similar."""
    pairs = common.written(pairs)
    texts = _texts(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct(), classes, docs)
    # The text of a class that stands in many pairs is met in several tasks: at most 1 / HOT_SHARE classes are in so many.
    many = max(2.0, HOT_SHARE * pairs.count())
    heavy = F.broadcast(common.written(pairs.groupBy("b").agg(F.ceil(F.count("*") / many).cast("int").alias("parts")).where("parts > 1")))
    dealt = pairs.join(heavy, "b", "left").select("a", "b", F.coalesce(F.expr("pmod(xxhash64(a), parts)"), F.lit(0)).cast("int").alias("part"))
    ends = texts.select(F.col("class").alias("b"), F.col("text").alias("tb")).join(heavy, "b", "left")
    ends = ends.select("b", "tb", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("part"))
    met = dealt.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(ends, ["b", "part"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A class that stands in many pairs of the batch is cut into shingles once.
            both = pa.concat_arrays([batch.column("a"), batch.column("b")]).dictionary_encode()
            code = both.indices.to_numpy(zero_copy_only=False)
            first = np.unique(code, return_index=True)[1]
            text = pa.concat_arrays([batch.column("ta"), batch.column("tb")]).take(pa.array(first))
            doc, s, w = shingles(normal(text))
            cuts = np.searchsorted(doc, np.arange(len(text) + 1))
            bags = [(s[i:j], w[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            n = batch.num_rows
            good = [k for k in range(n) if similarity(bags[code[k]], bags[code[n + k]]) >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return common.written(met.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"))


def by_key(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str = "band") -> DataFrame:
    """``rows`` joined with ``facts``, one row a key.  The facts of ``hot`` keys are broadcast (their number is bounded), so that the
    rows of such a key stay in the tasks that hold them; only the others are moved."""
    own, mark = facts.join(F.broadcast(hot), key, "left_semi"), F.broadcast(hot)
    cold = rows.join(mark, key, "left_anti").join(facts, key)
    return cold.unionByName(rows.join(F.broadcast(own), key))


def leftover(members: DataFrame, named: DataFrame, classes: DataFrame, docs: DataFrame, least: float, hot: DataFrame) -> DataFrame:
    """Links (a, b) between components, among the members of one band that have only met the band's head.

    Bands that hold one component are done.  The members of the others are dealt to blocks bounded in rows and bytes, and
    every two blocks of a band meet in one task, which returns at most one link for each two components it joins."""
    rows = common.written(members.join(named.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    mixed = common.written(rows.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("band"))
    rows = common.written(by_key(rows, mixed, hot))
    texts = _texts(rows.select("class").distinct(), classes, docs)
    sized = rows.join(texts.select("class", F.length("text").alias("size")), "class")
    parts = common.written(sized.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts")))
    dealt = by_key(rows, parts, hot).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = dealt.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "class", "component").join(texts, "class")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        n = len(f)
        doc, s, w = shingles(normal(pa.array(f.text)))
        # A shingle of weight w is w units, so that a product of two rows is the sum of minima.
        unit = np.repeat(s, w) + (np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)).astype(np.uint64) * _C
        owner = np.repeat(doc, w)
        total = np.bincount(owner, minlength=n)
        _, column, count = np.unique(unit, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
        both = np.zeros((n, n), np.float32)
        width = int(column.max()) + 1 if len(column) else 0
        for at in range(0, width, 4096):  # in strips, so that memory is bounded
            own = (column >= at) & (column < at + 4096)
            strip = np.zeros((n, min(4096, width - at)), np.float32)
            strip[owner[own], column[own] - at] = 1
            both += strip @ strip.T
        near = both >= least * (total[:, None] + total - both) - 1e-3
        near[total == 0] = False
        kind, own = f.component.to_numpy(), f.own.to_numpy()
        root = {c: c for c in kind}

        def top(c):
            while root[c] != c:
                c = root[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            if (f.p.iat[0] == f.q.iat[0] or own[i] != own[j]) and top(kind[i]) != top(kind[j]):
                root[top(kind[i])] = top(kind[j])
                out.append((f["class"].iat[i], f["class"].iat[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return common.written(work.groupBy("band", "p", "q").applyInPandas(compare, "a binary, b binary"))


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, class, group_id, group) of every row: group_id is the smallest id of its group."""
    rows = common.written(signed(docs))
    classes = common.written(rows.groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    least_hot = F.lit(max(2.0, HOT_SHARE * classes.count()))
    banded = classes.select("class", F.explode("bands").alias("band"))
    # Sums and maxima of a band are taken in every task before they are moved, and written before they meet the band's classes.
    sizes = common.written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = common.written(sizes.where(F.col("n") >= least_hot).select("band"))
    shared = common.written(by_key(banded, sizes, hot))
    # A class is the more central, the larger its bands are: copies differ from each other more than from their source.
    central = shared.groupBy("class").agg(F.sum("n").alias("weight"))
    shared = common.written(shared.select("class", "band").join(central, "class"))
    heads = common.written(shared.groupBy("band").agg(F.max(F.struct("weight", "class"))["class"].alias("head")))
    headed = common.written(by_key(shared, heads, hot).where("class <> head").select("band", "class", "head"))
    links = verified(headed.select(F.col("class").alias("a"), F.col("head").alias("b")).distinct(), classes, docs, least)
    named = common.components(links)
    late = leftover(headed.select("band", "class"), named, classes, docs, least, hot)
    if not late.isEmpty():
        named = common.components(links.union(late))
    member = classes.select("class", "low").join(named.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    member = common.written(member.select("class", "low", "group"))
    lows = common.written(member.groupBy("group").agg(F.min("low").alias("group_id"), F.count("*").alias("n")))
    large = common.written(lows.where(F.col("n") >= least_hot).select("group"))
    facts = common.written(by_key(member.select("class", "group"), lows.drop("n"), large, "group"))
    copied = common.written(classes.where(F.col("n") >= max(2.0, HOT_SHARE * rows.count())).select("class"))
    return by_key(rows.select("doc_id", "row", "class"), facts, copied, "class")


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest id."""
    kept = groups(docs, least).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("_row")).distinct()
    kept = common.written(kept)
    out = docs.withColumn("_row", row_of("doc_id", "text")).join(kept, "_row")
    return out.dropDuplicates(["_row"]).drop("_row")


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    out = groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(False)).alias("kept"))
