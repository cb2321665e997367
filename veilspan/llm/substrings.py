"""Exact substring removal by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier.  The longest previous factor of a position is the
longer of its common prefixes with the nearest earlier positions on both sides in suffix order (previous and next smaller
positions); a window of ``LENGTH`` bytes is removed where that factor reaches ``LENGTH``.  Suffix arrays are built for groups
of windows that can be equal at all, which are found first:

1. Anchors.  The window at a position belongs to the least hash of the grams in it (leftmost of equals), the same in every
   copy.  Consecutive windows of one anchor form a stretch.  Each task compares the bytes of its own equal stretches: all but
   the first are removed whole.  What is left goes by the anchor's hash to a bucket, without its bytes, and an anchor that
   stands there once holds no repeated string.
2. The stretches of the other anchors meet with their bytes, by anchor.  Equal ones are told by their bytes; over the
   different ones of an anchor a suffix array is built, its neighbours' common prefixes are measured, and the longest
   previous factors of all windows follow.

Hashes only say what can be equal; every byte that is removed has been compared.  An anchor with more than ``HOT`` stretches
is dealt to groups of about that many.  What is repeated inside a group is settled there; the windows that are left, bytes of
their own and no longer the corpus, meet again by anchors of a longer gram (at last the whole window), so that no task holds
a group that grows with the corpus.
Rows travel packed in column blocks, in text order, one for each task and bucket; the number of buckets follows the text.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; of rows with one id, those with different
texts are ordered by a hash of their text and those with equal texts count as one document; null ids come before all others;
empty tables give no rows; extra columns are ignored; texts of any length are read whole, long ones in overlapping segments.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string, and of an anchor's gram from round to round.
LENGTH, GRAMS = 100, (24, 60, 100)
#: Windows of a segment, text bytes of a task settled together, text bytes of a bucket of anchors, bytes of a bucket of
#: stretches, bytes under one suffix array (if one group has no more), and stretches of an anchor that make it hot.
SEGMENT, CHUNK, ANCHORED, STRETCHED, ARRAY, HOT = 1 << 20, 10 << 20, 16 << 20, 6 << 20, 1 << 20, 8192
#: Stands for a null id: before all others.
NO_ID = -(2**63)
ASK, DONE, REQUEST, SHARED, LEFT = range(5)
SCHEMA = "kind int, key long, doc long, row long, base long, start long, n int, salts int"
FOUND = "kind int, doc long, row long, start long, n int, raw binary"
BLOCKS = "bucket int, block binary"
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_draw = np.random.Generator(np.random.PCG64(20))
_TABLE = _draw.integers(0, 2**64, 256, np.uint64)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASES[0], pow(_BASES[0], -1, 2**64)):
            p = np.full(max(n, SEGMENT + 4 * LENGTH), np.uint64(b))
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of any substrings of some bytes."""
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    return _mix((sums[stop] - sums[start]) * down[start])


def stretches(raw: np.ndarray, ends: np.ndarray, gram: int = GRAMS[0], bits: int = 64) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, class hash) of the stretches of texts that end at ``ends`` in ``raw``; ``bits`` of a hash count."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < LENGTH:
        return none
    power, grown = 1, {1: _TABLE[raw]}
    while power * 2 <= gram:
        last = grown[power]
        grown[power * 2] = last[:-power] * np.uint64(pow(_BASES[1], power, 2**64)) + last[power:]
        power *= 2
    out, done = grown[power], power
    while done < gram:
        step = 1 << ((gram - done).bit_length() - 1)
        n = len(raw) - done - step + 1
        out = out[:n] * np.uint64(pow(_BASES[1], step, 2**64)) + grown[step][done : done + n]
        done += step
    del grown
    out = _mix(out)
    # The least of LENGTH - gram + 1 neighbouring hashes, with its place in the low bits.
    low = np.uint64((1 << 30) - 1)
    least = (out & ~low) | np.arange(len(out), dtype=np.uint64)
    span, size = LENGTH - gram + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(raw) - LENGTH + 1
    least = np.minimum(least[:n], least[span - size : span - size + n])
    owner = (least & low).astype(np.int64)
    cut = np.zeros(n + 1, np.int64)  # windows that do not end in the text they start in
    np.add.at(cut, np.clip(ends[:-1] - LENGTH + 1, 0, n), 1)
    np.add.at(cut, np.clip(ends[:-1], 0, n), -1)
    at = np.flatnonzero(np.cumsum(cut[:n]) == 0)
    if not len(at):
        return none
    text = np.searchsorted(ends, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    start = at[first]
    windows = np.diff(np.append(first, len(at)))
    keep = np.uint64(2**bits - 1)
    return start, windows, out[owner[start]] & keep, _hashes(raw, start, start + windows + LENGTH - 1) & keep


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def previous_factors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Longest previous factor, up to ``length`` (64 to 128), of each window of ``length`` bytes at the ascending positions ``at`` in ``raw``.

    Windows are ordered by their bytes (prefix doubling over ranks, exact), then by position.  Neighbours' common prefixes
    come from the same ranks, and the previous and next smaller positions from jumps over larger ones."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(256, np.uint8)])
    rank = {8: _ranks(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 128]).view(">u8").ravel().astype(np.uint64))}
    for step in (8, 16, 32):
        rank[2 * step] = _ranks(rank[step] << np.uint64(32) | np.append(rank[step][step:], np.zeros(step, np.uint64)))
    whole = rank[64][at] << np.uint64(32) | rank[64][at + (length - 64)]
    order = np.argsort(whole, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    same = np.zeros(len(a), np.int64)
    for step in (64, 32, 16, 8):
        same += step * (rank[step][a + same] == rank[step][b + same])
    live = np.ones(len(a), bool)
    for _ in range(7):
        live &= padded[a + same] == padded[b + same]
        same += live
    same = np.where(whole[order[:-1]] == whole[order[1:]], length, np.minimum(same, length - 1))

    def nearest(place: np.ndarray, common_: np.ndarray) -> np.ndarray:
        """Common prefix with the nearest smaller position before each in suffix order; ``common_``: with the one just before."""
        last, low = np.arange(-1, len(place) - 1), np.append(0, common_)
        open_ = np.flatnonzero(np.append(False, place[:-1] > place[1:]))
        while len(open_):
            j = last[open_]
            low[open_], last[open_] = np.minimum(low[open_], low[j]), last[j]
            open_ = open_[last[open_] >= 0]
            open_ = open_[place[last[open_]] > place[open_]]
        low[last < 0] = 0
        return low

    out = np.zeros(len(at), np.int64)
    out[order] = np.maximum(nearest(order, same), nearest(order[::-1], same[::-1])[::-1])
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row begins a run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Rows:
    """Columns kind, key, doc, row, base (where the piece of text begins in its document), start, n."""

    TYPES = np.int8, *[np.int64] * 6

    def __init__(self, *columns: np.ndarray) -> None:
        self.kind, self.key, self.doc, self.row, self.base, self.start, self.n = self.columns = columns

    @classmethod
    def of(cls, kind: int, *columns: np.ndarray) -> Rows:
        """Of one kind; ``columns`` from the key on."""
        return cls(np.full(len(columns[0]), kind, np.int8), *columns)

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True))) if parts else cls(*(np.zeros(0, t) for t in cls.TYPES))

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*(c[at] for c in self.columns))

    def merged(self) -> Rows:
        """In text order, neighbouring stretches of one kind as one."""
        rows = self.take(np.lexsort((self.start, self.row, self.doc, self.kind)))
        if not len(rows):
            return rows
        new = _runs(rows.kind, rows.doc, rows.row)
        stop = rows.start + rows.n
        new[1:] |= rows.start[1:] > stop[:-1]
        first = np.flatnonzero(new)
        upto = np.maximum.reduceat(stop, first)
        rows = rows.take(first)
        return Rows(*rows.columns[:6], upto - rows.start)

    def plain(self, salts: np.ndarray | int = 1) -> pa.RecordBatch:
        """SCHEMA."""
        columns = [*self.columns, np.broadcast_to(np.asarray(salts), len(self))]
        types = pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def block(self, tail: bytes = b"") -> bytes:
        """Keys as they are, the rest as differences in text order under zstd, then ``tail``."""
        rest = b"".join(x.tobytes() for x in (np.diff(self.doc, prepend=0), self.row, np.diff(self.base, prepend=0), np.diff(self.start, prepend=0), self.n, self.kind))
        return len(self).to_bytes(4, "little") + self.key.tobytes() + zstandard.compress(rest + tail, 3)

    @classmethod
    def unblock(cls, raw: bytes) -> tuple[Rows, bytes]:
        k = int.from_bytes(raw[:4], "little")
        rest = zstandard.decompress(raw[4 + 8 * k :])
        doc, row, base, start, n = (np.frombuffer(rest, np.int64, k, 8 * k * i) for i in range(5))
        return cls(np.frombuffer(rest, np.int8, k, 40 * k), np.frombuffer(raw, np.int64, k, 4), np.cumsum(doc), row, np.cumsum(base), np.cumsum(start), n), rest[41 * k :]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _blocks(rows: Rows, where: np.ndarray) -> Iterator[pa.RecordBatch]:
    """BLOCKS of rows by their bucket, each in text order."""
    order = np.lexsort((rows.start, rows.row, rows.doc, where))
    rows, where = rows.take(order), where[order]
    cuts = np.append(np.flatnonzero(_runs(where)), len(where))
    yield from _batches([(int(where[a]), rows.take(np.arange(a, b)).block()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _batches(parts: list[tuple[int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    size = 0
    for part in [*parts, None]:
        if held and (part is None or size > most or len(held) >= 2048):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary())], names=["bucket", "block"])
            held, size = [], 0
        if part is not None:
            held.append(part)
            size += len(part[1])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bucket, from batches sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(block)
    if held:
        yield held


def settled(rows: Rows, cls: np.ndarray, place: np.ndarray, raw: bytes) -> Rows:
    """Rows that ask, and what is done: stretches with the bytes of an earlier one; ``place``: where each begins in ``raw``."""
    order = np.lexsort((rows.start, rows.row, rows.doc, cls, rows.key))
    rows, cls, place = rows.take(order), cls[order], place[order]
    first = _runs(rows.key, cls)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.flatnonzero(~first)
    size = rows.n + LENGTH - 1
    equal = np.zeros(len(rows), bool)
    equal[later] = np.fromiter((raw[a : a + k] == raw[b : b + m] for a, k, b, m in zip(place[later].tolist(), size[later].tolist(), place[lead[later]].tolist(), size[lead[later]].tolist(), strict=True)), bool, len(later))
    # The same place twice is a repeated row, not a later copy.
    same = (rows.doc == rows.doc[lead]) & (rows.row == rows.row[lead]) & (rows.start == rows.start[lead])
    done = rows.take(equal & ~same)
    return Rows.joined([Rows.of(DONE, *done.columns[1:]).merged(), rows.take(~equal)])


def anchored(docs: DataFrame, buckets: int, gram: int, bits: int, hot: int, segment: int, chunk: int) -> DataFrame:
    """SCHEMA of ``docs(doc, row, base, text)``: what is done, and the stretches of anchors that stand more than once (REQUEST),
    with the number of groups of a hot anchor in ``salts``.  ``text``: bytes of the document from ``base`` on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[tuple[int, int, int, int, bytes]] = []
        held: list[tuple[np.ndarray, ...]] = []
        raws: list[bytes] = []
        filled = size = 0

        def anchor() -> None:
            nonlocal todo, filled, size
            raw = b"".join(t[4] for t in todo)
            ends = np.cumsum([len(t[4]) for t in todo])
            start, n, key, cls = stretches(np.frombuffer(raw, np.uint8), ends, gram, bits)
            which = np.searchsorted(ends, start, "right")
            doc, row, base, off = (np.array([t[i] for t in todo], np.int64)[which] for i in range(4))
            held.append((key.view(np.int64), doc, row, base, start - np.concatenate([[0], ends[:-1]])[which] + off, n, cls, start + size))
            raws.append(raw)
            size += len(raw)
            todo, filled = [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, raws, size
            *columns, cls, place = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = settled(Rows.of(ASK, *columns), cls, place, b"".join(raws))
            held, raws, size = [], [], 0
            yield from _blocks(rows, np.where(rows.kind == ASK, _bucket(rows.key, buckets), _bucket(rows.doc, buckets)))

        for batch in batches:
            for doc, row, base, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "base", "text")), strict=True):
                for at in range(0, len(text) - LENGTH + 1, segment):
                    piece = text[at : at + segment + LENGTH - 1]
                    if todo and filled + len(piece) > segment + LENGTH:
                        anchor()
                    todo.append((doc, row, base, base + at, piece))
                    filled += len(piece)
                    if size + filled >= chunk:
                        anchor()
                        yield from settle()
        if todo:
            anchor()
        if held:
            yield from settle()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _buckets(batches):
            rows = Rows.joined([Rows.unblock(b)[0] for b in blocks])
            yield rows.take(rows.kind == DONE).plain()
            rows = rows.take(rows.kind == ASK)
            _, group, many = np.unique(rows.key, return_inverse=True, return_counts=True)
            again = np.flatnonzero(many[group] > 1)
            again = again[np.lexsort((rows.start[again], rows.row[again], rows.doc[again]))]
            rows = rows.take(again)
            yield Rows.of(REQUEST, *rows.columns[1:]).plain(-(-many[group][again] // hot))

    return docs.mapInArrow(cut, BLOCKS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, SCHEMA)


def compared(asked: DataFrame, buckets: int, array: int) -> DataFrame:
    """FOUND of ``asked(doc, row, base, text, spans)``, spans being requested stretches: what is done, and what hot anchors leave
    (LEFT), with its bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches with their bytes, by the bucket of their anchor and, where that is hot, of their group."""
        held: list[Rows] = []
        texts: list[bytes] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held, texts, size
            rows = Rows.joined(held)
            where = _bucket(rows.key, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.append(np.flatnonzero(_runs(where[order])), len(order))
            yield from _batches([(int(where[order[a]]), rows.take(order[a:b]).block(b"".join(texts[i] for i in order[a:b].tolist()))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            held, texts, size = [], [], 0

        for batch in batches:
            for doc, row, base, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "base", "text")), batch.column("spans"), strict=True):
                start, n, key, salts = (spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "key", "salts"))
                own = tuple(np.full(len(start), x, np.int64) for x in (doc, row, base))
                salt = _mix(own[0].view(np.uint64) ^ _mix(own[1].view(np.uint64) + start.view(np.uint64))) % salts.view(np.uint64)
                held.append(Rows(np.where(salts > 1, SHARED, REQUEST).astype(np.int8), _mix(key.view(np.uint64) + _mix(salt)).view(np.int64), *own, start, n))
                texts += [raw[a : a + k + LENGTH - 1] for a, k in zip((start - base).tolist(), n.tolist(), strict=True)]
                size += int(n.sum()) + len(n) * (LENGTH + 60)
                if size >= CHUNK:
                    yield from emit()
        if held:
            yield from emit()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _buckets(batches):
            parts, pieces = [], []
            for block in blocks:
                rows, tail = Rows.unblock(block)
                ends = np.cumsum(rows.n + LENGTH - 1).tolist()
                pieces += [tail[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                parts.append(rows)
            rows = Rows.joined(parts)
            order = np.lexsort((rows.start, rows.row, rows.doc, rows.key))
            rows = rows.take(order)
            pieces = [pieces[i] for i in order.tolist()]
            # Different stretches of a group, each where it stands first; the others are done, but for repeated rows.
            seen: dict[tuple[int, bytes], int] = {}
            lead = np.fromiter((seen.setdefault((k, p), i) for i, (k, p) in enumerate(zip(rows.key.tolist(), pieces, strict=True))), np.int64, len(rows))
            del seen
            later = lead < np.arange(len(rows))
            same = (rows.doc == rows.doc[lead]) & (rows.row == rows.row[lead]) & (rows.start == rows.start[lead])
            out = [Rows.of(DONE, *rows.take(later & ~same).columns[1:])]
            firsts = np.flatnonzero(~later)
            group = np.cumsum(_runs(rows.key[firsts])) - 1
            many = np.bincount(group)[group] if len(firsts) else group
            alone = firsts[(many == 1) & (rows.kind[firsts] == SHARED)]
            left = [(rows.take(alone), [pieces[i] for i in alone.tolist()])]
            firsts, group = firsts[many > 1], group[many > 1]
            low, upto = 0, np.cumsum(rows.n[firsts] + LENGTH - 1)
            while low < len(firsts):  # whole groups under one array, as many as fit
                high = max(int(np.searchsorted(upto, upto[low] + array)), low + 1)
                whole = high == len(firsts) or group[high - 1] == group[low]
                high = int(np.searchsorted(group, group[high - 1], "right" if whole else "left"))
                some = firsts[low:high]
                some = some[np.lexsort((rows.start[some], rows.row[some], rows.doc[some]))]
                n = rows.n[some]
                size = n + LENGTH - 1
                own = np.repeat(np.arange(len(some)), n)
                inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                gone = previous_factors(np.frombuffer(b"".join(pieces[i] for i in some.tolist()), np.uint8), np.repeat(np.cumsum(size) - size, n) + inside) >= LENGTH
                new = _runs(own, gone) if len(own) else gone
                first = np.flatnonzero(new)
                runs = rows.take(some[own[first]])
                runs = Rows(*runs.columns[:5], runs.start + inside[first], np.diff(np.append(first, len(own))))
                out.append(Rows.of(DONE, *runs.take(gone[first]).columns[1:]))
                stay = np.flatnonzero(~gone[first] & (runs.kind == SHARED))
                left.append((runs.take(stay), [pieces[some[own[k]]][inside[k] : inside[k] + m + LENGTH - 1] for k, m in zip(first[stay].tolist(), runs.n[stay].tolist(), strict=True)]))
                low = high
            yield found(DONE, Rows.joined(out).merged(), None)
            for some, raw in left:
                if len(some):
                    yield found(LEFT, some, raw)

    def found(kind: int, rows: Rows, raw: list[bytes] | None) -> pa.RecordBatch:
        k = len(rows)
        columns = [pa.array(np.full(k, kind, np.int32)), *map(pa.array, (rows.doc, rows.row, rows.start)), pa.array(rows.n.astype(np.int32)), pa.array(raw or [None] * k, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return asked.mapInArrow(gather, BLOCKS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, FOUND)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``doc`` and ``row``: row tells apart different texts of one id, and is 0 where an id is alone."""
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    if again.isEmpty():
        return docs.select(doc, F.lit(0).cast("long").alias("row"), text)
    many = common.written(again.withColumn("_again", F.lit(True)))
    return docs.join(many, docs.doc_id.eqNullSafe(many._id), "left").select(doc, F.when(F.col("_again"), F.xxhash64(text)).otherwise(F.lit(0)).alias("row"), text)


def repeated(rows: DataFrame, grams: tuple[int, ...] = GRAMS, bits: int = 64, hot: int = HOT, segment: int = SEGMENT, chunk: int = CHUNK, array: int = ARRAY) -> list[DataFrame]:
    """Tables (doc, row, start, n) of the windows of ``rows(doc, row, text)`` that also start earlier."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, long = [], rows.where(F.octet_length("text") >= LENGTH).select("doc", "row", F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("text"))
    size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for k, gram in enumerate(grams):
        level = common.written(anchored(long, max(parts, math.ceil(size / ANCHORED)), gram, bits, hot if k < len(grams) - 1 else 1 << 40, segment, chunk))
        common.release(spark)
        out.append(level.where(F.col("kind") == DONE).select("doc", "row", "start", "n"))
        asks = level.where(F.col("kind") == REQUEST)
        size = asks.agg(F.sum(F.col("n") + LENGTH - 1)).first()[0] or 0
        if not size:
            break
        asked = asks.groupBy("doc", "row", "base").agg(F.collect_list(F.struct("start", "n", "key", "salts")).alias("spans"))
        late = common.written(compared(long.join(asked, ["doc", "row", "base"]).select("doc", "row", "base", "text", "spans"), max(parts, math.ceil(size / STRETCHED)), array))
        common.release(spark)
        out.append(late.where(F.col("kind") == DONE).select("doc", "row", "start", "n"))
        long = late.where(F.col("kind") == LEFT).select("doc", "row", F.col("start").alias("base"), F.col("raw").alias("text"))
        size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if not size:
            break
    return out


def removed(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs(doc_id, text)``; ``limits`` of ``repeated``."""
    common.small_batches(docs.sparkSession)
    rows = numbered(docs.select("doc_id", "text"))
    done = None
    for part in repeated(rows, **limits):
        done = part if done is None else done.union(part)
    gone = done.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                n = len(raw)
                if not spans.is_valid or not len(spans):
                    out.append((n, 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                start, many = (spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + many - 1 + LENGTH, -1)
                lost = np.cumsum(edge[:n]) > 0
                kept = np.frombuffer(raw, np.uint8)[~lost].tobytes()
                out.append((n, int(lost.sum()), int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = rows.join(gone, ["doc", "row"], "left").select("doc", "row", "text", "spans")
    out = whole.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated strings of 100 bytes are gone."""
    return removed(common.table(spark, sf_dir, "documents"))
