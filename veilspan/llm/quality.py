"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a document marked good against one marked bad) fix a linear worth by logistic loss on feature differences;
the score quantile at the training share of bad documents is the threshold, and a score is the chance of beating a document
at that threshold. Every labelled training row and every pair of them counts. Pairs are not made: the loss of a pair hangs
on two worths only, so rows are shared out between nodes on the line of worths, and the nodes of the good meet those of the bad.

Features in deviations, weights and shares of nodes are whole numbers of small parts, so sums are exact: a model is the same
in whatever order and partitions its rows come.

Defined cases: null and empty texts have the features of an empty text and a score like any other; null ids count as held
out; label rows that are null, repeated or without a document train nothing twice; without both labels in the training
rows every score is 0.5; extra columns are ignored; whole texts are read at any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The weight decay, and bits behind the point: of features in deviations, weights, worths, shares of a fine or coarse node, and moments.
DECAY, Z, W, WORTH, SHARE, HALF, MOMENT = 1e-3, 12, 20, 32, 18, 8, 30
#: Bits of a worth below a node: fine nodes are 1/16 apart (slopes, error under 1e-7), coarse ones 1/2 (curvature, which only speeds the steps).
FINE, COARSE = WORTH - 4, WORTH - 1
#: ASCII marks that are counted one by one.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_BYTES = np.frombuffer(MARKS.encode(), np.uint8)


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, length, word shape and repetition of a whole text."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).astype(float)
    n = max(1.0, raw.sum())
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    return np.array(
        [
            *(np.sqrt(raw[_MARK_BYTES] / n)),
            np.sqrt(raw[_MARK_BYTES].sum() / n),
            raw[65:91].sum() / n,
            raw[97:123].sum() / n,
            raw[48:58].sum() / n,
            raw[128:].sum() / n,
            raw[10] / n,
            raw[32] / n,
            np.log1p(n) / 10,
            min(n / k, 50.0) / 10,
            sum(map(eq, words, words[1:])) / k,
            len(set(words)) / k,
            len(set(lines)) / len(lines),
            float(not words),
        ]
    )


SIZE = len(features(""))
_UPPER = np.triu_indices(SIZE + 1)
#: (features, labels) of some rows -> sums of whole numbers by key; and the sums of such a count over all rows.
Count = Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]
Total = Callable[[Count], dict[int, np.ndarray]]


def moments(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """By label: rows, and sums of features and their squares."""
    parts = np.column_stack([np.ones(len(x)), np.rint(x * 2**MOMENT), np.rint(x * x * 2**MOMENT)]).astype(np.int64)
    return {c: parts[y == c].sum(0) for c in (0, 1) if (y == c).any()}


def _whole(model: dict, x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip((x - model["mean"]) / model["scale"], -8, 8) * 2**Z)


def worths(model: dict, x: np.ndarray) -> np.ndarray:
    """Worths in parts of 2**-WORTH; the sums stay below 2**53 and are exact."""
    return (_whole(model, x) @ model["w"]).astype(np.int64)


def tallied(model: dict) -> Count:
    """By node of the line of worths, times 4, and label (coarse nodes: and 2): rows and sums of features, or of their products, shared
    out by cubic (coarse: linear) interpolation."""

    def run(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        out, every = {}, _whole(model, x)
        for c in (0, 1):
            q = every[y == c]
            if not len(q):
                continue
            s = (q @ model["w"]).astype(np.int64)
            node, t = s >> FINE, (s & (2**FINE - 1)) / 2**FINE
            share = np.rint(np.array([-t * (t - 1) * (t - 2) / 6, t * 0, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]) * 2**SHARE)
            share[1] = 2**SHARE - share.sum(0)
            low, values = node.min() - 1, np.column_stack([np.ones(len(q)), q])
            n = int(node.max() - low) + 3
            sums = np.array([sum(np.bincount(node - low - 1 + d, share[d] * v, n) for d in range(4)) for v in values.T]).T.astype(np.int64)
            out |= {int(low + k) * 4 + c: sums[k] for k in np.flatnonzero(sums.any(1))}
            node, t = s >> COARSE, np.rint((s & (2**COARSE - 1)) / 2**COARSE * 2**HALF)
            values[:, 1:] = np.rint(q / 16)
            for k in np.unique([node, node + 1]):
                v, part = values[on := (node == k) | (node == k - 1)], np.where(node == k, 2**HALF - t, t)[on]
                out[int(k) * 4 + 2 + c] = ((v * part[:, None]).T @ v)[_UPPER].astype(np.int64)
        return out

    return run


def _met(sums: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss over all pairs of good and bad rows, its fall along the weights, and its curvature."""

    def side(kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(k for k in sums if k & 3 == kind)
        return np.array([k >> 2 for k in keys]), np.array([sums[k] for k in keys], float)

    (at_bad, bad), (at_good, good), (low, bads), (high, goods) = map(side, range(4))
    pairs, lost, fall = good[:, 0].sum() * bad[:, 0].sum(), 0.0, np.zeros(SIZE)
    for k in range(0, len(good), 256):
        some = good[k : k + 256]
        gap = np.clip((at_good[k : k + 256, None] - at_bad) * 2.0 ** (FINE - WORTH), -500, 500)
        p = 1 / (1 + np.exp(gap))
        lost += some[:, 0] @ np.logaddexp(0, -gap) @ bad[:, 0]
        fall += (p @ bad[:, 0]) @ some[:, 1:] - (some[:, 0] @ p) @ bad[:, 1:]
    p = 1 / (1 + np.exp(np.clip((high[:, None] - low) * 2.0 ** (COARSE - WORTH), -500, 500)))
    p *= 1 - p

    def summed(weights: np.ndarray, products: np.ndarray) -> np.ndarray:
        m = np.zeros((SIZE + 1, SIZE + 1))
        m[_UPPER] = weights @ products
        return (m + np.triu(m, 1).T)[1:, 1:]

    row = slice(1, SIZE + 1)  # of the products: row 0 is the count and the sums
    cross = goods[:, row].T @ p @ bads[:, row]
    bend = summed(p @ bads[:, 0], goods) + summed(goods[:, 0] @ p, bads) - cross - cross.T
    return lost / pairs, fall / pairs / 2**Z, bend / (goods[:, 0].sum() * bads[:, 0].sum()) / 4.0 ** (Z - 4)


def ranked(total: Total, model: dict, places: list[int]) -> list[int]:
    """The worths at these places in the order of all rows, by counts in ever finer bins."""
    found: list[tuple[int | None, int]] = [(None, k) for k in places]
    for shift in (36, 24, 12, 0):
        bins = [b for b, _ in found if b is not None]

        def counts(x: np.ndarray, y: np.ndarray, shift: int = shift, bins: list[int] = bins) -> dict[int, np.ndarray]:
            s = worths(model, x)
            values, n = np.unique((s[np.isin(s >> (shift + 12), bins)] if bins else s) >> shift, return_counts=True)
            return {int(v): n[k : k + 1] for k, v in enumerate(values)}

        got = total(counts)
        for i, (b, place) in enumerate(found):
            for v in sorted(v for v in got if b is None or v >> 12 == b):
                if place < got[v][0]:
                    found[i] = v, place
                    break
                place -= int(got[v][0])
    return [b for b, _ in found]


def fitted(total: Total) -> dict:
    """Bradley-Terry worths over all rows that ``total`` counts, and the quantile threshold."""
    model = {"mean": np.zeros(SIZE), "scale": np.ones(SIZE), "w": np.zeros(SIZE), "threshold": 0.0}
    sums = total(moments)
    if len(sums) < 2:
        return model
    both = sums[0] + sums[1]
    n, share = int(both[0]), int(sums[0][0]) / int(both[0])
    model["mean"] = both[1 : SIZE + 1] / 2**MOMENT / n
    model["scale"] = np.sqrt(np.maximum(0, both[SIZE + 1 :] / 2**MOMENT / n - model["mean"] ** 2)) + 1e-6
    best, least, step = np.zeros(SIZE), np.inf, np.zeros(SIZE)
    for _ in range(50):  # Newton steps on the logistic loss of differences, halved where the loss grows
        w = np.rint((best + step) * 2**W)
        lost, fall, bend = _met(total(tallied(model | {"w": w})))
        w = w / 2**W
        lost += DECAY / 2 * w @ w
        if lost > least + 1e-7:
            step = step / 2
        else:
            best, least = w, lost
            step = np.linalg.solve(bend + DECAY * np.eye(SIZE), fall - DECAY * w)
        if np.abs(step).max() < 1e-4:
            break
    model["w"] = np.rint(best * 2**W)
    # The quantile of the training scores at the share of bad ones, in the middle of the gap there.
    at = min(n - 1, max(1, round(share * n)))
    model["threshold"] = sum(ranked(total, model, [at - 1, at])) / 2
    return model


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """``fitted`` over features ``x`` of documents marked ``y`` (1 good, 0 bad)."""
    return fitted(lambda count: count(x, y))


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((worths(model, x) - model["threshold"]) / 2**WORTH, -30, 30)))


def marked(labels: DataFrame, label: str, rows) -> DataFrame:
    """(doc_id, y) of the labelled documents among ``rows`` (a condition on doc_id)."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & rows).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training(docs: DataFrame, labels: DataFrame, label: str, rows, most: int) -> DataFrame:
    """(doc_id, text, y): labelled documents among ``rows`` (a condition on doc_id), at most about ``most``.

    The labels are sampled before they meet the texts, so only sampled texts are moved.
    """
    kept = common.bounded_sample(marked(labels, label, rows), "doc_id", most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(kept, "doc_id").select("doc_id", "text", "y")


def over(rows: DataFrame) -> Total:
    """Sums over all of ``rows(y, x)``: each task adds its own rows, then the sums of all tasks are added by key."""

    def tallies(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "sums"])

    def total(count: Count) -> dict[int, np.ndarray]:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in count(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE), batch.column("y").to_numpy(zero_copy_only=False)).items():
                    sums[k] = sums[k] + v if k in sums else v
            yield tallies(sums)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in zip(batch.column("key").to_pylist(), batch.column("sums"), strict=True):
                    v = np.frombuffer(v.as_py(), np.int64)
                    sums[k] = sums[k] + v if k in sums else v
            yield tallies(sums)

        schema = "key long, sums binary"
        return {r.key: np.frombuffer(r.sums, np.int64) for r in rows.mapInArrow(counted, schema).repartition("key").mapInArrow(added, schema).collect()}

    return total


def measured(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """(doc_id, held_out, x) of every row: the features of its whole text."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")])
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * SIZE, x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], names=["doc_id", "held_out", "x"])

    out = F.coalesce(common.fold("doc_id", folds) == held, F.lit(True)).alias("held_out")
    return docs.select("doc_id", F.col("text").cast("string"), out).mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def judged(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows that are ``measured``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(shared.value, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array(s >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scored(docs: DataFrame, model: dict, folds: int, held: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return judged(measured(docs, folds, held), model)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows = common.written(measured(docs, 3, 1))  # texts are read once: features train and are scored
    train = rows.where("not held_out").join(marked(labels, "quality", common.fold("doc_id", 3) != 1), "doc_id").select("y", "x")
    return judged(rows, fitted(over(common.written(train))))
