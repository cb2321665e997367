"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams by language come from labelled training rows (a bounded, hash-chosen sample of whole
documents); their log-probability matrix is broadcast, and the texts of a batch are scored together: their bucket counts are
the rows of one sparse matrix, whose product with the log-probabilities gives all scores.  Every language of the sample is
learned; the matrix has 128 KB for each, and the sample bounds their number.

Defined cases: a null text, or one without letters, is ``und`` with score 0; rows with a null or empty lang or a null
id train nothing; a null id counts as held out; an empty training set predicts ``und`` everywhere; repeated rows and
extra columns change nothing; whole texts are scored at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: log2 of the buckets, n-gram sizes, the most training documents (whole ones), and numbers that a product holds at once.
BITS, SIZES, MOST_TRAIN, CELLS = 15, (1, 2, 3), 30_000, 1 << 22
UNKNOWN = "und"
#: Code points beyond this share places in the table of letters.
PLANE = 0x11_0000


def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0 (a gap)."""
    global _table
    if _table is None:
        t = np.zeros(PLANE, np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x32000)]:
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table = t
    return _table


_table: np.ndarray | None = None


def bucket_counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text and how often; n-grams of lower-cased letters, runs of anything else count as one gap."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = a > 0
    if not keep.any():
        return none
    keep[1:] |= a[:-1] > 0
    a = np.concatenate([np.zeros(1, np.uint32), a[keep], np.zeros(1, np.uint32)])
    grams, h = [], np.zeros(len(a), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1 :] + np.uint32(1)
        if n in SIZES:
            grams.append(((h ^ np.uint32(n * 0x5BD1E99 % 2**32)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    count = np.bincount(np.concatenate(grams), minlength=1 << bits)
    at = np.flatnonzero(count)
    return at, count[at]


def fit(rows: DataFrame, most: int = MOST_TRAIN, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix buckets x languages, log priors) of ``rows(doc_id, text, lang)``."""
    common.small_batches(rows.sparkSession)
    rows = rows.where("text is not null and trim(lang) <> '' and doc_id is not null")
    rows = common.bounded_sample(rows.select("doc_id", "text", "lang"), "doc_id", most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, n = bucket_counts(text, bits)
                t = total.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                t[at] += n
                t[-1] += 1
                if len(total) * len(t) > CELLS:
                    yield from counted(total)
                    total = {}
        yield from counted(total)

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at])], names=["lang", "bucket", "n"])

    sums = common.written(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # Buckets x languages numbers at most, and no more languages than the sample has documents.
    got = sums.toPandas()
    langs = sorted(got.lang.unique())
    counts, docs = np.zeros((1 << bits, len(langs)), np.float32), np.zeros(len(langs))
    if langs:
        col = got.lang.map({x: k for k, x in enumerate(langs)}).to_numpy()
        row = got.bucket.to_numpy()
        real = row < 1 << bits
        counts[row[real], col[real]] = got.n.to_numpy()[real]
        docs[col[~real]] = got.n.to_numpy()[~real]
    counts += 0.1
    return langs, np.log(counts / counts.sum(0, dtype=np.float64).astype(np.float32)), np.log(docs / docs.sum()) if langs else docs


def scores(counts: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-probability of each text in each language: the sparse rows ``counts`` times ``logs``, in steps of whole texts."""
    out = np.tile(prior, (len(counts), 1))
    sizes = np.array([len(at) for at, _ in counts], np.int64)
    upto = np.cumsum(sizes)
    low = 0
    while low < len(counts):
        begin = upto[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(upto, begin + CELLS // max(1, len(prior)), "right")))
        some = np.arange(low, high)[sizes[low:high] > 0]
        if len(some):
            at, n = (np.concatenate([counts[k][i] for k in some.tolist()]) for i in range(2))
            out[some] += np.add.reduceat(logs[at].astype(np.float64) * n[:, None], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
        low = high
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = shared.value
        for batch in batches:
            counts = [bucket_counts(t.as_py(), bits) for t in batch.column("text")]
            known = np.array([len(at) > 0 for at, _ in counts], bool) & bool(langs)
            names, score = np.full(len(counts), UNKNOWN, object), np.zeros(len(counts))
            if known.any():
                s = scores([c for c, k in zip(counts, known, strict=True) if k], logs, prior)
                names[known] = np.array(langs, object)[s.argmax(1)]
                score[known] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(common.fold("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return docs.select("doc_id", F.col("text").cast("string"), held).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the four fifths of ids that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(common.fold("doc_id", 5) != 0)))
