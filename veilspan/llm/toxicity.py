"""Toxicity by weak supervision.

Voters are insult terms of a fixed lexicon, word stems induced from labelled training rows, and patterns (how many
distinct terms, how dense, address to a reader).  A generative label model over the votes of a bounded sample of training
rows estimates by expectation maximisation how often each voter votes in both classes and how its votes correlate with the
others' within a class; voters that go together are one block with one distribution, so that they are not counted twice.
The posterior comes from the votes alone: labels only propose stems and say where the estimation begins.  A linear
classifier on vote features is trained on the posteriors and scores every text.

Defined cases: null and empty texts have no votes and a score like any other; null ids count as held out; null or repeated
labels train nothing twice; without rows of both labels the fixed lexicon votes alone; an empty table gives no rows; repeated
rows are scored each; extra columns are ignored; whole texts are read at any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import training

#: The most labelled rows that are fitted, lengths of a stem, the share of toxic rows (and the number) that a stem must stand in,
#: and the correlation within a class from which two voters belong to one block.  With that share a text of k pieces brings
#: in k / LEAST_SHARE stems at most, on average over the toxic rows: no further bound is needed.
MOST_TRAIN, STEM, LEAST_SHARE, LEAST_ROWS, TOGETHER = 20_000, (4, 5, 6), 0.02, 4, 0.5
#: Fixed lexicon of insults, matched as whole words.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "imbecile", "cretin", "vermin", "filth", "dumb", "bastard", "degenerate", "parasite")
WORD = re.compile(r"[^\W\d_]+")


class Voters:
    """Lexicon, stem and pattern voters over whole texts."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = sorted({f"{w}$" for w in LEXICON} | set(keys))
        self.names = [*self.keys, "two terms", "three terms", "dense", "addressed"]
        self._open()

    def _open(self) -> None:
        self.words = ahocorasick.Automaton()
        for k, key in enumerate(self.keys):
            self.words.add_word(key[:-1], (k, key[-1] == "$", len(key) - 1))
        self.words.make_automaton()

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "names": self.names}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._open()

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Hits by term, and how many follow a form of address."""
        low = (text or "").lower()
        hits: dict[int, int] = {}
        addressed, n = 0, len(low)
        for end, (k, whole, size) in self.words.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha() or whole and end + 1 < n and low[end + 1].isalpha():
                continue
            hits[k] = hits.get(k, 0) + 1
            addressed += bool(re.search(r"\b(you|your|such an?|you are|tu|du|usted)\s*$", low[max(0, start - 12) : start]))
        return hits, addressed

    def votes(self, text: str | None) -> np.ndarray:
        """One of 0 and 1 from each voter."""
        hits, addressed = self.counts(text)
        out = np.zeros(len(self.names))
        out[list(hits)] = 1
        total = sum(hits.values())
        out[len(self.keys) :] = total >= 2, total >= 3, total > 0 and total * 60 >= len((text or "").split()), addressed > 0
        return out


def blocks(together: np.ndarray) -> np.ndarray:
    """Number of each voter's block: the components of a symmetric relation."""
    name = np.arange(len(together))
    while True:
        low = np.where(together, name, len(name)).min(1, initial=len(name))
        new = np.minimum(name, low)
        if (new == name).all():
            return np.unique(name, return_inverse=True)[1]
        name = new


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Posterior that each row is toxic, from its votes.

    Expectation maximisation from ``y`` as the first guess.  A round estimates each voter's rate in both classes and the
    correlations of what the rates leave open; blocks of voters that correlate by ``TOGETHER`` or more have one distribution
    over how many of them vote, and blocks are independent within a class.
    """
    q, n = np.where(y == 1, 0.9, 0.05), len(votes)
    for _ in range(rounds):
        p1, p0 = (q @ votes + 0.5) / (q.sum() + 1), ((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1)
        rest = votes - np.outer(q, p1) - np.outer(1 - q, p0)
        sd = np.sqrt((rest**2).mean(0)) + 1e-6
        block = blocks(rest.T @ rest / n >= TOGETHER * np.outer(sd, sd))
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        odds = np.full(n, np.log(prior / (1 - prior)))
        for b in range(block.max() + 1):
            many = votes[:, block == b].sum(1).astype(np.int64)
            kinds = many.max() + 1
            on = (np.bincount(many, q, kinds) + 0.5 / kinds) / (q.sum() + 0.5)
            off = (np.bincount(many, 1 - q, kinds) + 0.05 / kinds) / ((1 - q).sum() + 0.05)
            odds += np.log(on / off)[many]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-5:
            return new
        q = new
    return q


def linear(votes: np.ndarray, q: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of logistic regression on posterior labels, by Newton steps."""
    x = np.column_stack([votes, np.ones(len(votes))])
    keep = decay * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + keep, x.T @ (q - p) / len(x) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """Voters and the classifier's weights, from the labelled rows that are not held out."""
    common.small_batches(docs.sparkSession)
    rows = training(docs, labels, "toxic", common.fold("doc_id", 5) != 0, MOST_TRAIN)

    @common.lean
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each sampled text: order and repetition do not matter to induction."""
        for batch in batches:
            words = [" ".join(sorted(set(WORD.findall((t.as_py() or "").lower())))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(words, pa.string())], names=["doc_id", "y", "words"])

    stored = common.written(rows)
    keys: list[str] = _keys(stored.mapInArrow(gathered, "doc_id long, y int, words string"))
    voters = Voters(keys)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @common.lean
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [np.flatnonzero(shared.value.votes(t.as_py())).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(on, pa.list_(pa.int32()))], names=["doc_id", "y", "on"])

    got = stored.mapInArrow(voted, "doc_id long, y int, on array<int>").orderBy("doc_id").toPandas()  # at most MOST_TRAIN rows
    votes = np.zeros((len(got), len(voters.names)))
    for k, on in enumerate(got.on):
        votes[k, list(on)] = 1
    if not len(got) or got.y.nunique() < 2:
        w = np.full(len(voters.names) + 1, 4.0)
        w[-1] = -2.0
        return voters, w
    return voters, linear(votes, label_model(votes, got.y.to_numpy().astype(float)))


def _keys(words: DataFrame) -> list[str]:
    """Stems worth a vote, from counts made in the cluster: the driver gets those that pass, bounded by LEAST_SHARE."""
    pieces = F.array_distinct(F.flatten(F.transform(F.split("words", " "), lambda w: F.filter(
        F.array(F.when(F.length(w) >= 3, F.concat(w, F.lit("$"))), *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEM)), lambda x: x.isNotNull()))))
    stored = common.written(words)
    sizes = {r.y: r["count"] for r in stored.groupBy("y").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    seen = stored.select("y", F.explode(pieces).alias("key")).groupBy("key").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    good = seen.where((F.col("c1") >= max(LEAST_ROWS, LEAST_SHARE * n1)) & (F.col("c1") / n1 >= 12 * (F.col("c0") + 0.5) / n0))
    kept: list[str] = []
    stems: set[str] = set()
    for r in good.orderBy(F.desc("c1"), F.length("key"), "key").collect():
        if not any(r.key[:n] in stems for n in STEM):
            kept.append(r.key)
            if r.key[-1] == "*":
                stems.add(r.key[:-1])
    return kept


def scored(docs: DataFrame, model: tuple[Voters, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id, held_out) with ``score`` and ``predicted`` of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        voters, w = shared.value
        return pd.Series([float(1 / (1 + np.exp(-np.clip(voters.votes(t) @ w[:-1] + w[-1], -30, 30)))) for t in texts], dtype="float64")

    held = F.coalesce(common.fold("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    out = docs.withColumn("held_out", held) if keep is None else docs
    return out.select(*(keep or ["doc_id", "held_out"]), toxic(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
