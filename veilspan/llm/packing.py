"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after another).  With ``W`` full windows and ``T_j`` tokens in
queue ``j``, a window owes queue ``j`` its quantum ``q_j = T_j / W``; what rounding leaves open is the queue's deficit
and is carried on.  Served in a fixed queue order, the tokens that queues ``0..j`` have been given before window ``w``
are ``F_j(w) = floor(w * (T_0 + .. + T_j) / W)``, so queue ``j`` has been given ``F_j(w) - F_{j-1}(w)``, its deficit is
always under one token, and every window is full.  Because this closed form needs no earlier window, deficits are
carried across partitions without any task waiting for another: a document that knows where it begins in its queue
knows its windows.  A queue has at least a token a window, so that its share never goes back.

The ``MOST_QUEUES`` sources with the most tokens have queues of their own; the others, and sources under a token a window
and a window more, share one (while that is too small itself, the next smallest source joins it).  Its documents stay whole
and are served by the share of their own source that comes before them, with a phase hashed from the source: at any point of
the shared queue each of its sources has been given what its tokens are owed, to within one of its documents.

Target proportions other than the corpus's own hold until a queue is empty; ``Mixture`` puts a schedule after another, one for
each set of queues that are left.

The last ``T mod size`` tokens, cut from the ends of the longest queues, fill one shorter sequence.

Tokens are made once, written to a shared scratch table as 16-bit ids, and cut in a second pass.

Defined cases: a null text is empty and packs as the end token alone; a null source is its own queue; repeated rows
are packed as often as they occur; null and repeated ids are carried through; an empty table gives no rows; extra
columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Sequence length, end-of-document id, the most sources that get a queue of their own, and the parts in which the shared one is put in order.
SIZE, END_ID, MOST_QUEUES, SLICES = 2048, 1, 255, 4096
VOCABULARY = "word_bpe_49k.json"

_encoders: dict[str, object] = {}


def _encoder(path: str):
    from .bpe import WordBPE

    if path not in _encoders:
        _encoders[path] = WordBPE(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, key, rel, n, ids): key: of the source, null as well; ids as little-endian uint16; rel: tokens of the same part and source before."""
    schema = "doc_id long, part long, key string, rel long, n long, ids binary"

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, used = _encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, texts, keys = batch.columns
            rows = [np.append(x, np.uint16(end_id)) for x in encoder.encode(texts)]
            rel = []
            for k, x in zip(keys.to_pylist(), rows, strict=True):
                rel.append(used.get(k, 0))
                used[k] = rel[-1] + len(x)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([part] * n, pa.int64()), keys.cast(pa.string()), pa.array(rel, pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in rows], pa.binary())],
                names=["doc_id", "part", "key", "rel", "n", "ids"],
            )

    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.alias("key")).mapInArrow(run, schema)


def shared(tokens: DataFrame, bases: DataFrame) -> DataFrame:
    """(part, key, rel, at): where the documents of sources that share a queue begin in it; ``bases(part, key, base, total)``.

    A document's place is the share of its source's tokens that comes before it, with a part of its own length that is hashed
    from the source, so that sources of one document are spread too.  Slices of that place are put in order side by side."""
    phase = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / F.lit(1_000_003)
    rows = tokens.select("part", "key", "rel", "n").join(bases, ["part", "key"]).withColumn("place", (F.col("base") + F.col("rel") + phase * F.col("n")) / F.col("total"))
    rows = common.written(rows.select("part", "key", "rel", "n", "place", F.least(F.floor(F.col("place") * SLICES), F.lit(SLICES - 1)).cast("int").alias("slice")))
    sums = [0] * SLICES
    for r in rows.groupBy("slice").agg(F.sum("n").alias("n")).collect():  # at most SLICES rows
        sums[r.slice] = r.n
    opens = tokens.sparkSession.createDataFrame(list(enumerate(np.cumsum([0, *sums[:-1]], dtype=np.int64).tolist())), "slice int, open long")
    order = Window.partitionBy("slice").orderBy("place", "key", "part", "rel").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(opens), "slice").select("part", "key", "rel", (F.col("open") + F.col("in")).alias("at"))


class Schedule:
    """Which window serves which tokens of each queue; ``totals``: tokens by queue."""

    def __init__(self, totals: list[int], size: int) -> None:
        self.size, total = size, sum(totals)
        self.windows, rest = divmod(total, size)
        kept = list(totals)
        self.tail = [0] * len(totals)
        for j in sorted(range(len(totals)), key=lambda j: (-kept[j], j)):
            take = min(rest, kept[j])
            kept[j], self.tail[j], rest = kept[j] - take, take, rest - take
        self.kept = kept
        self.upto = [0, *np.cumsum(kept, dtype=object).tolist()]
        self.tail_at = [0, *np.cumsum(self.tail, dtype=object).tolist()]

    def _share(self, w: np.ndarray, total: int) -> np.ndarray:
        q, r = divmod(int(total), max(1, self.windows))
        if self.windows >= 2**31:  # exact beyond 64 bits
            return w * q + np.array([int(x) * r // self.windows for x in w.tolist()], np.int64)
        return w * q + w * r // max(1, self.windows)

    def given(self, j: int, w: np.ndarray) -> np.ndarray:
        """Tokens of queue j in the windows before w."""
        return self._share(w, self.upto[j + 1]) - self._share(w, self.upto[j])

    def place(self, j: int, w: np.ndarray) -> np.ndarray:
        """Where queue j begins in window w."""
        return self._share(w + 1, self.upto[j]) - self._share(w, self.upto[j])

    def window_of(self, j: int, at: np.ndarray) -> np.ndarray:
        """The window that holds each token: the last w with given(w) <= at."""
        low = np.clip((at / max(1e-9, self.kept[j] / max(1, self.windows))).astype(np.int64) - 3, 0, self.windows)
        out = low
        for step in range(1, 7):
            w = np.minimum(low + step, self.windows)
            out = np.where(self.given(j, w) <= at, np.maximum(out, w), out)
        return np.minimum(out, max(0, self.windows - 1))

    def pieces(self, j: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, length, sequence, offset) of every piece of documents at ``start`` in queue j."""
        main = np.minimum(start + n, self.kept[j])
        has = np.flatnonzero(start < main)
        first, last = self.window_of(j, start[has]), self.window_of(j, main[has] - 1)
        many = last - first + 1
        doc = np.repeat(has, many)
        w = np.repeat(first, many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        opens = self.given(j, w)
        a, b = np.maximum(opens, start[doc]), np.minimum(self.given(j, w + 1), main[doc])
        real = b > a
        doc, w, a, b, opens = doc[real], w[real], a[real], b[real], opens[real]
        out = [doc, a - start[doc], b - a, w, self.place(j, w) + a - opens]
        late = np.flatnonzero(start + n > self.kept[j])
        a = np.maximum(start[late], self.kept[j])
        end = [late, a - start[late], start[late] + n[late] - a, np.full(len(late), self.windows), int(self.tail_at[j]) + a - self.kept[j]]
        return tuple(np.concatenate([x, np.asarray(y, np.int64)]) for x, y in zip(out, end, strict=True))


class Mixture:
    """Schedules one after another: windows of the target weights until a queue is empty, then of the weights that are left.

    A phase has as many windows as every queue with a weight can serve; the window in which one runs out is a phase of its own,
    in which it gives what it has.  Queues without a weight are served when all others are empty, by their own proportions.  The
    phases follow from the totals alone, so there are at most two for each queue, and no window waits for another."""

    def __init__(self, totals: list[int], weights: list[float], size: int) -> None:
        left, window = list(totals), 0
        self.phases: list[tuple[int, list[int], Schedule]] = []
        while sum(left) >= size:
            live = self._weights(left, weights, size)
            many = min(int(left[j] / (size * w)) for j, w in live.items())
            take = [0] * len(totals)
            if many:
                for j, w in live.items():
                    take[j] = min(left[j], int(many * size * w))
            # Queues that run out give all they have; the rest is dealt to the others, largest remainder first.
            while (need := max(1, many) * size - sum(take)) > 0:
                rest = [n - t for n, t in zip(left, take, strict=True)]
                share = self._weights(rest, weights, size)
                part = {j: min(rest[j], int(need * w)) for j, w in share.items()}
                if not any(part.values()):
                    part = {j: 1 for j in sorted(share, key=lambda j: (-need * share[j], j))[:need]}
                for j, n in part.items():
                    take[j] += n
            self.phases.append((window, [n - m for n, m in zip(totals, left, strict=True)], Schedule(take, size)))
            left = [n - t for n, t in zip(left, take, strict=True)]
            window += max(1, many)
        self.phases.append((window, [n - m for n, m in zip(totals, left, strict=True)], Schedule(left, size)))

    @staticmethod
    def _weights(left: list[int], weights: list[float], size: int) -> dict[int, float]:
        """Shares of the queues that are served now; none is under two tokens a window."""
        some = {j: weights[j] for j, n in enumerate(left) if n and weights[j] > 0} or {j: float(n) for j, n in enumerate(left) if n}
        total = sum(some.values())
        some = {j: max(w / total, 2 / size) for j, w in some.items()}
        return {j: w / sum(some.values()) for j, w in some.items()}

    def pieces(self, j: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``Schedule.pieces``."""
        out = [[np.zeros(0, np.int64)] * 5]
        for window, begins, plan in self.phases:
            low, high = begins[j], begins[j] + plan.kept[j] + plan.tail[j]
            own = np.flatnonzero((start < high) & (start + n > low))
            a, b = np.maximum(start[own], low), np.minimum(start[own] + n[own], high)
            doc, at, many, sequence, offset = plan.pieces(j, a - low, b - a)
            out.append([own[doc], at + (a - start[own])[doc], many, sequence + window, offset])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, most_queues: int = MOST_QUEUES, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue) of ``docs(doc_id, text, source)``.

    ``weights``: target proportions of tokens by source, for ``most_queues`` sources at most (else ValueError); other sources come
    when those are empty.  Without it the targets are the sources' own shares of the corpus."""
    if weights is not None and (len(weights) > most_queues or any(w <= 0 for w in weights.values())):
        raise ValueError("weights")
    spark = docs.sparkSession
    common.small_batches(spark)
    tokens = common.written(tokenized(docs, path, end_id))
    parts = common.written(tokens.groupBy("part", "key").agg(F.sum("n").alias("n")).coalesce(8))
    by_source = parts.groupBy("key").agg(F.sum("n").alias("total"))
    total = by_source.agg(F.sum("total")).first()[0] or 0
    windows = total // size
    named = [f"={k}" for k in weights or ()]
    own = (by_source.where(F.col("key").isin(named)) if weights is not None else by_source).orderBy(F.desc("total"), "key").limit(most_queues).collect()
    # A queue below a token a window joins the shared one; while that is too small itself, so does the next smallest.
    tail = total - sum(r.total for r in own)
    while weights is None and own and (own[-1].total < windows + size or 0 < tail < windows + size or not windows):
        tail += own.pop().total
    other = len(own)
    totals = [*(r.total for r in own), tail]
    plan = Schedule(totals, size) if weights is None else Mixture(totals, [*(weights[r.key[1:]] for r in own), 0.0], size)
    queues = F.broadcast(spark.createDataFrame([(r.key, k) for k, r in enumerate(own)], "key string, own int"))
    order = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).join(queues, "key", "left").withColumn("to", F.coalesce("own", F.lit(other)))
    bases = common.written(bases.select("part", "key", "to", "base").coalesce(8))
    placed = tokens.join(bases.where(F.col("to") < other), ["part", "key"]).select("doc_id", "to", (F.col("base") + F.col("rel")).alias("at"), "n", "ids")
    if tail:
        ends = bases.where(F.col("to") == other).join(by_source, "key").select("part", "key", "base", "total")
        late = tokens.join(shared(tokens, ends), ["part", "key", "rel"]).select("doc_id", F.lit(other).alias("to"), "at", "n", "ids")
        placed = placed.union(late) if own else late
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, to, at, n, raw = batch.columns
            to, at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (to, at, n))
            wide = [memoryview(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in raw]
            for j in np.unique(to).tolist():
                rows = np.flatnonzero(to == j)
                doc, start, length, sequence, offset = plan.pieces(j, at[rows], n[rows])
                doc = rows[doc]
                crc = [zlib.crc32(wide[d][4 * a : 4 * b]) for d, a, b in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], sequence, offset)), pa.array([j] * len(doc), pa.int32())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    return placed.mapInArrow(run, schema)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of all ``documents``, in sequences of 2048 tokens mixed by source."""
    return pack(common.table(spark, sf_dir, "documents"), vocabulary())
