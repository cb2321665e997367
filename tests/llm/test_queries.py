"""The registered queries over whole tables, against brute force, SQL, the library's own ids or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from veilspan.llm import decontam, registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").toPandas() for t in ("documents", "labels", "benchmark")}


def ran(spark, name):
    return QUERIES[name](spark, str(DATA)).toPandas()


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want, got = c.execute(registry.oracle_sql()[name]).df(), ran(spark, name)
    rows = lambda f: sorted(repr(tuple(None if x is None or x != x else int(x) if isinstance(x, (bool, np.bool_, float, np.integer)) else x for x in r)) for r in f[sorted(want.columns)].astype(object).itertuples(index=False))
    assert set(want.columns) <= set(got.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name, label, folds, held", [("op2_quality", "quality", 3, 1), ("op4_toxicity", "toxic", 5, 0)])
def test_classifiers_hold_out(spark, tables, name, label, folds, held):
    got, docs = ran(spark, name), tables["documents"]
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [fold(d, folds) == held for d in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    marked = got[got.held_out].merge(tables["labels"][["doc_id", label]].dropna(), on="doc_id")
    assert len(marked) and (marked.predicted == marked[label]).mean() >= 0.9


def test_op7_language(spark, tables):
    got, docs = ran(spark, "op7_language_id"), tables["documents"]
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [fold(d, 5) == 0 for d in got.doc_id]).all()
    both = got.merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    letters = both.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert (both[~letters].lang_pred == "und").all()
    # Junk and texts of a word or two belong to no language for certain.
    sure = both[both.held_out & both.lang.notna() & (both.text.fillna("").str.split().str.len() >= 20)]
    assert len(sure) and (sure.lang_pred == sure.lang).mean() >= 0.9


def test_op3_matches_brute_force(spark, tables):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    known = {}
    code = lambda ws: np.array([known.setdefault(w, len(known)) for w in ws], np.int64)
    items = {}
    for i, t in zip(tables["benchmark"].item_id, tables["benchmark"].text, strict=True):
        key = tuple(words(t))
        if key:
            items[key] = min(i, items.get(key, i))
    want = set()
    for d, t in zip(tables["documents"].doc_id, tables["documents"].text, strict=True):
        own = code(words(t))
        for key, i in items.items():
            item, n = code(key), len(key)
            w = min(n, decontam.WINDOW)
            padded = np.concatenate([np.full(n - 1, -1), own, np.full(n - 1, -1)])
            if len(own) == 0 or not np.isin(item, own).sum() >= math.ceil(decontam.IDENTITY * w):
                continue
            agree = np.lib.stride_tricks.sliding_window_view(padded, n) == item
            sums = np.concatenate([np.zeros((len(agree), 1), int), agree.cumsum(1)], 1)
            if (sums[:, w:] - sums[:, :-w]).max() >= math.ceil(decontam.IDENTITY * w):
                want.add((int(d), int(i)))
    got = ran(spark, "op3_decontamination")
    assert want and set(zip(got.doc_id.astype(int), got.item_id.astype(int), strict=True)) == want and len(got) == len(want)


def test_op5_matches_brute_force(spark, tables):
    docs = tables["documents"]

    def bag(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))

    bags, ids = [bag(t) for t in docs.text], [int(d) for d in docs.doc_id]
    group = {d: d for d in ids}
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (not bags[i] and not bags[j]) or (bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()))]
    for _ in ids:
        before = dict(group)
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    got = ran(spark, "op5_minhash")
    assert near and dict(zip(got.doc_id.astype(int), got.group_id.astype(int), strict=True)) == group and (got.kept == (got.doc_id == got.group_id)).all()


def test_op9_round_trip(spark, tables):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, docs = ran(spark, "op9_packing"), tables["documents"]
    pieces = dict(list(got.sort_values("start").groupby("doc_id")))
    assert set(pieces) == set(docs.doc_id)
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids, at, own = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0, pieces[d]
        for p in own.itertuples():
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and (sizes < 2048).sum() <= 1


def test_op10_matches_brute_force(spark, tables):
    seen, want = set(), {}
    for d, t in sorted(zip(tables["documents"].doc_id, tables["documents"].text, strict=True)):
        b = (t or "").encode()
        lost = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            s = hashlib.blake2b(b[p : p + 100], digest_size=16).digest()
            if s in seen:
                lost[p : p + 100] = True
            seen.add(s)
        lost = lost[: len(b)]
        runs = int((lost[1:] & ~lost[:-1]).sum() + lost[:1].sum())
        want[int(d)] = (len(b), int(lost.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~lost])).hexdigest())
    got = ran(spark, "op10_substrings")
    assert {int(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want and len(got) == len(want)
