"""Batched byte-pair encoding of whole texts with a public vocabulary file.

Words are cut once, looked up in a bounded cache, and the unseen ones of a batch are merged together in numpy:
each step replaces, in every word at once, the leftmost pair of lowest rank.  Texts outside Latin-1, and the few
whose white space or special strings need the library's own rules, go through ``tokenizers`` itself, so the ids
always equal the library's.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: What is set apart from its neighbours, tried in this order; what is left between white space are runs of letters.
APART = rf"('s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+)"
ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}]|<\||[^\x{00}-\x{ff}]"


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Index(dict):
    """word -> number in order of first sight; unseen words are noted."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class _Runs:
    """Id sequences of the numbered keys of an index."""

    def __init__(self) -> None:
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def add(self, lens: np.ndarray, flat: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``which`` one after another, and where each begins."""
        lens = self.lens[which]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[np.repeat(self.starts[which] - upto[:-1], lens) + np.arange(upto[-1])], upto


class WordBPE:
    def __init__(self, path: str, cache_words: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end, chars = model["end_of_word_suffix"], byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.first = self._filled(keys, ranks, 20, np.uint64(0x9E3779B97F4A7C15))
        lost = self.first[0][self._slot(keys, self.first)] != keys
        for k in range(1, 1000):
            self.second = self._filled(keys[lost], ranks[lost], 18, np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % 2**64))
            if (self.second[0][self._slot(keys[lost], self.second)] == keys[lost]).all():
                break
        else:
            raise ValueError("no second table without collisions")
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.words, self.ids = _Index(), _Runs()

    @staticmethod
    def _slot(keys: np.ndarray, table: tuple) -> np.ndarray:
        return ((keys * table[2]) >> np.uint64(64 - table[3])).astype(np.int64)

    def _filled(self, keys: np.ndarray, ranks: np.ndarray, bits: int, by: np.uint64) -> tuple:
        slots = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE), by, bits
        at = self._slot(keys, slots)
        slots[0][at], slots[1][at] = keys, ranks
        return slots

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        i, j = self._slot(key, self.first), self._slot(key, self.second)
        return np.where(self.first[0][i] == key, self.first[1][i], np.where(self.second[0][j] == key, self.second[1][j], NONE))

    def _merge(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of ids padded with zeros, and their lengths, for words of a like length."""
        n = np.array([len(w) for w in words])
        wide = int(n.max())
        col = np.arange(wide)
        real = col < n[:, None]
        raw = np.zeros((len(words), wide), np.int64)
        raw[real] = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        rows = np.arange(len(words))
        ids[rows, n - 1] = self.final[raw[rows, n - 1]]
        ids[~real] = 0
        if wide == 1:
            return ids, n
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rank[col[:-1] >= (n - 1)[:, None]] = NONE
        out, left = ids.copy(), rows
        while len(left):
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            go = best < NONE
            if not go.all():
                out[left[~go]] = ids[~go]
                ids, rank, at, best, left = ids[go], rank[go], at[go], best[go], left[go]
                if not len(left):
                    break
            k = np.arange(len(at))
            n[left] -= 1
            m = n[left]
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1))), col + (col > at[:, None]), 1)
            ids[k, at] = self.made[best]
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE), col[:-1] + (col[:-1] >= at[:, None]), 1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < m - 1)
            rank[after, at[after]] = self._rank(ids[after, at[after]], ids[after, at[after] + 1])
        return out, n

    def _learn(self) -> None:
        """Ids of the words that were first seen just now."""
        if not self.words.fresh:
            return
        raw = [w.encode() for w in self.words.fresh]
        self.words.fresh = []
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        lens = np.zeros(len(raw), np.int64)
        made = []
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 11), (11, 15), (15, 20), (20, 28), (28, 48)):
            for part in np.array_split(at := np.flatnonzero((size > low) & (size <= high)), max(1, len(at) // 20_000)):
                if len(part):
                    ids, n = self._merge([raw[i] for i in part.tolist()])
                    lens[part] = n
                    made.append((part, ids.astype(np.uint16), n))
        for i in np.flatnonzero(size > 48).tolist():
            ids = np.array(self.library.encode(raw[i].decode(), add_special_tokens=False).ids, np.uint16)[None]
            lens[i] = ids.shape[1]
            made.append((np.array([i]), ids, lens[i : i + 1]))
        upto = np.concatenate([[0], np.cumsum(lens)])
        flat = np.zeros(upto[-1], np.uint16)
        for part, ids, n in made:
            real = np.arange(ids.shape[1]) < n[:, None]
            flat[(upto[part][:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
        self.ids.add(lens, flat)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint16 ids of each text (null: none), equal to the library's with add_special_tokens=False."""
        if len(self.words) > self.cache_words:
            self._clear()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint16)
        plain = np.flatnonzero(~odd)
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(plain))), APART, r" \1 ")
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(spaced))
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        own = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self._learn()
        ids, upto = self.ids.take(own[coded.indices.to_numpy(zero_copy_only=False)])
        cuts = upto[ends]
        for k, a, b in zip(plain.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out
