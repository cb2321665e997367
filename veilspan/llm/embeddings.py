"""Embedding near-duplicates: dual traversal of cover trees, exact at a cosine threshold.

Equal vectors of one label are one class with a multiplicity.  Each label's classes are dealt to cells around pivots and on
to blocks of bounded size; a block is known by its centre and covering radius, and two blocks of a label meet only if their
balls come within the threshold's distance of each other.  In a task, a cover tree over each of the two blocks (nested
centres, radii halved from level to level) is traversed in pairs of nodes, pruned by the covering radii, and what remains is
compared by cosine in double precision.  A task returns sums and a spanning forest, never the pairs themselves, so a label or
a group with a third of all rows stays linear in what is moved for each pair of blocks.

Defined cases: a null vector or label, a zero vector, and one with null or non-finite components links with nothing and is
its own component, kept; a row with a null id links with nothing, is counted by no other row, and has a null component, kept;
repeated rows of one id count as one vector; different vectors of one id are rows of the links and the component that they
have together; vectors of different lengths link with nothing of the other length; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Threshold, most vectors in a block, most pivots of a label and of all labels together, rows of a tree's leaf, and balls of a label that meet all others in one slice.
COSINE, BLOCK, MOST_PIVOTS, ALL_PIVOTS, LEAF, SLICE = 0.98, 4096, 32, 8192, 48, 256


def net(x: np.ndarray, rows: np.ndarray, head: int, level: float, chunk: int = 256) -> list[tuple[int, np.ndarray]]:
    """(centre, rows) greedily: every row within ``level`` of its centre, centres further apart than that; ``head`` is the first."""
    least = 1 - level * level / 2  # of unit vectors
    centers, owner = [head], np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), chunk):
        own = rows[at : at + chunk]
        near = x[own] @ x[centers].T >= least
        owner[at : at + chunk] = near.argmax(1)
        open_ = np.flatnonzero(~near.any(1))
        if len(open_):
            gram = x[own[open_]] @ x[own[open_]].T >= least
            free = np.ones(len(open_), bool)
            for k in range(len(open_)):
                if free[k]:
                    now = gram[k] & free
                    now[k] = True
                    owner[at + open_[now]] = len(centers)
                    free &= ~now
                    centers.append(int(own[open_[k]]))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(centers) + 1))
    return [(c, rows[order[i:j]]) for c, i, j in zip(centers, cuts[:-1], cuts[1:], strict=True)]


class Tree:
    """Cover tree over unit vectors: each node has a centre, the radius that covers its rows, and children of half the level's radius."""

    __slots__ = ("center", "radius", "rows", "children", "centers", "radii")

    def __init__(self, x: np.ndarray, rows: np.ndarray, center: int, level: float) -> None:
        self.center, self.rows, self.children, self.radius = center, rows, [], 0.0
        if len(rows) > 1:
            gap = x[rows] - x[center]
            self.radius = float(np.sqrt((gap * gap).sum(1)).max())
        if len(rows) <= LEAF or self.radius == 0:
            return
        while level >= self.radius:
            level /= 2
        # Nested: the first centre of the next level is this one.
        self.children = [Tree(x, own, c, level / 2) for c, own in net(x, rows, center, level)]
        self.centers = np.array([c.center for c in self.children])
        self.radii = np.array([c.radius for c in self.children])


def near_pairs(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of x, of y) with cosine >= least, by dual traversal: pairs of nodes whose balls are further apart are pruned."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            i, j = np.nonzero(x[p.rows] @ y[q.rows].T >= least)
            if len(i):
                yield p.rows[i], q.rows[j]
            continue
        left, lc, lr = (p.children, p.centers, p.radii) if p.children else ([p], np.array([p.center]), np.array([p.radius]))
        right, rc, rr = (q.children, q.centers, q.radii) if q.children else ([q], np.array([q.center]), np.array([q.radius]))
        for at in range(0, len(left), 512):
            apart = np.maximum(0, 2 - 2 * (x[lc[at : at + 512]] @ y[rc].T))
            i, j = np.nonzero(apart <= (lr[at : at + 512, None] + rr + reach) ** 2)
            todo += [(left[at + k], right[m]) for k, m in zip(i.tolist(), j.tolist(), strict=True)]


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    up = np.arange(n)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in links:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)])


def linked(vectors: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    fine = F.expr("vec_id is not null and embedding is not null and label is not null and size(embedding) > 0 and not exists(embedding, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(embedding, e -> e <> 0)")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    same = F.expr("concat_ws('/', size(embedding), label)")
    valid = rows.where(fine).select("vec_id", same.alias("label"), "embedding").distinct()
    classes = common.written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label").agg(F.count("*").alias("size"))
    # Pivots of labels that need more than one block: bounded in number for each label and in all.
    many = sizes.where(F.col("size") > block)
    share = F.least(F.lit(1.0), F.least(F.lit(4.0 * MOST_PIVOTS), 8.0 * F.ceil(F.col("size") / block)) / F.col("size"))
    picked = classes.join(many, "label").where(F.pmod(F.xxhash64("class"), F.lit(1_000_003)) < share * 1_000_003).select("class", "label", "embedding", F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("size") / block)).alias("k")).orderBy(F.xxhash64("class"), "class").limit(ALL_PIVOTS).collect()
    pivots: dict[str, np.ndarray] = {}
    for label in sorted({r.label for r in picked}):
        own = sorted((tuple(r.embedding), r.k) for r in picked if r.label == label)
        own = [e for e, k in own[: own[0][1]]]
        pivots[label] = _unit(pd.Series(own))
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("int")
    def cell(label: pd.Series, embedding: pd.Series) -> pd.Series:
        out = np.zeros(len(label), np.int32)
        for name, at in label.groupby(label).groups.items():
            if name in shared.value:
                pos = label.index.get_indexer(at)
                out[pos] = (_unit(embedding.iloc[pos]) @ shared.value[name].T).argmax(1)
        return pd.Series(out)

    celled = common.written(classes.withColumn("cell", cell("label", "embedding")))
    cells = celled.groupBy("label", "cell").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / F.lit(0.8 * block)).cast("int"))
    dealt = celled.join(cells.select("label", "cell", "parts"), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("class", F.lit("part")), F.col("parts")))
    dealt = common.written(dealt.withColumn("block", F.xxhash64("label", "cell", "part")).select("label", "block", "class", "n", "embedding"))

    def measure(f: pd.DataFrame) -> pd.DataFrame:
        x = _unit(f.embedding)
        c = x.mean(0)
        return pd.DataFrame({"label": [f.label.iloc[0]], "block": [f.block.iloc[0]], "center": [c.tolist()], "radius": [float(np.sqrt(((x - c) ** 2).sum(1)).max())]})

    balls = common.written(dealt.groupBy("block").applyInPandas(measure, "label string, block long, center array<double>, radius double"))
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    apart = F.expr("aggregate(zip_with(a.center, b.center, (u, v) -> (u - v) * (u - v)), 0D, (s, v) -> s + v)")
    # A label's balls meet in slices, so that a hot label is many keys.
    slices = balls.groupBy("label").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sliced = balls.join(slices, "label")
    left = sliced.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = sliced.withColumn("slice", F.pmod(F.xxhash64("block", F.lit("slice")), F.col("slices")).cast("int"))
    met = left.alias("a").join(right.alias("b"), ["label", "slice"]).where("a.block <= b.block").where(F.sqrt(apart) <= F.col("a.radius") + F.col("b.radius") + reach)
    met = common.written(met.select(F.col("a.block").alias("p"), F.col("b.block").alias("q")).withColumn("pair", F.xxhash64("p", "q")))
    sides = met.select("pair", F.col("p").alias("block"), F.lit(0).alias("side")).union(met.where("p <> q").select("pair", F.col("q").alias("block"), F.lit(1)))
    work = sides.join(dealt.select("block", "class", "n", "embedding"), "block").select("pair", "side", "class", "n", "embedding")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "class"], ignore_index=True)
        x, n = _unit(f.embedding), f.n.to_numpy()
        left, right = np.flatnonzero(f.side == 0), np.flatnonzero(f.side == 1)
        a = Tree(x, left, int(left[0]), 2.0)
        b = Tree(x, right, int(right[0]), 2.0) if len(right) else a
        links, sums = [], np.zeros(len(f), np.int64)
        for i, j in near_pairs(a, b, x, x, least):
            if a is b:
                i, j = i[i != j], j[i != j]  # both orders come up
                np.add.at(sums, i, n[j])
            else:
                np.add.at(sums, i, n[j])
                np.add.at(sums, j, n[i])
            links.append((i, j))
        some = np.flatnonzero(sums)
        root = _forest(len(f), links)
        name = f["class"].to_numpy()
        return pd.DataFrame({"class": name[some], "links": sums[some], "root": name[root[some]]})

    found = common.written(work.groupBy("pair").applyInPandas(compare, "class long, links long, root long"))
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = common.components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    member = classes.select("label", "embedding", "low", "n", "class").join(sums, "class", "left").join(named.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    member = common.written(member.select("class", "label", "embedding", "low", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    each = member.join(low, "component").select("label", "embedding", "n_links", "component_id")
    inside = valid.join(each, ["label", "embedding"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(inside, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return linked(common.table(spark, sf_dir, "embeddings"))


#: The same in DuckDB: all pairs of a label, and a recursive closure.
ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a),
c as (select a, min(b) as b from r group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) as component_id, e.vec_id is not distinct from least(e.vec_id, coalesce(c.b, e.vec_id)) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id"""
