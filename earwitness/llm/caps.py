"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: the vector is cut into two halves,
each half has a random codebook, and every pair of codewords is a direction. The
inner product with a direction is the sum of two, so a vector's list of all
directions beyond a threshold is decoded from two short lists without looking at
most of the pairs. Vectors meet in the filters that both lists hold, and only
those are compared, in double precision.

Exact copies are one class with a count. A filter's members are compared in
blocks, so a filter that a third of all vectors fall in is shared by many tasks,
and each block gives sums and a spanning forest: no task returns all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import numbered
from earwitness.llm.components import smallest_labels
from earwitness.session import cut_lineage


@dataclass(frozen=True)
class CapParams:
    """``lists``: expected directions of a random vector; ``least``: best ones taken where fewer exceed the threshold.

    ``members`` is how many vectors of one label a filter has on average, which
    sets the size of the codebooks; ``block`` is how many meet in one task.
    """

    cosine: float = 0.98
    lists: int = 16
    least: int = 12
    members: int = 16
    most_words: int = 1 << 12
    block: int = 1024
    seed: int = 11


PARAMS = CapParams()


def codebook(words: int, dimensions: int, half: int, seed: int) -> np.ndarray:
    """``words`` random unit vectors for one half of vectors of ``dimensions``."""
    rng = np.random.default_rng([seed, words, dimensions, half])
    out = rng.normal(size=(words, dimensions // 2 if half == 0 else dimensions - dimensions // 2))
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def decoded(left: np.ndarray, right: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Directions (i * words + j) with ``left[i] + right[j] >= threshold``, or the ``least`` best if those are fewer.

    Both sides are walked from their best codewords down, as far as a partner can
    still reach the threshold.
    """
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = left[a], right[b]
    reach = np.searchsorted(-y, x - threshold, side="right")  # partners of each left word
    if reach.sum() < least:  # the best ones have few words on one side: pair k of a list has (i + 1) * (j + 1) <= least
        i, j = np.divmod(np.arange(len(x[:least]) * len(y[:least])), len(y[:least]))
        near = (i + 1) * (j + 1) <= least
        i, j = i[near], j[near]
        best = np.argsort(-(x[i] + y[j]), kind="stable")[:least]
        return np.sort(a[i[best]] * len(right) + b[j[best]])
    used = np.flatnonzero(reach)
    i = np.repeat(used, reach[used])
    j = np.arange(len(i)) - np.repeat(np.cumsum(reach[used]) - reach[used], reach[used])
    return np.sort(a[i] * len(right) + b[j])


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _filter_rows(batches, words: int, p: CapParams):
    """A row (label, size, filter, node, count, vector, filters) for each direction of each vector."""
    books: dict[int, tuple] = {}
    for batch in batches:
        rows = {k: [] for k in ("label", "dims", "filter", "node", "copies", "vector", "filters")}
        for label, node, copies, vector in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "copies", "vector")), strict=True):
            d = len(vector)
            if d not in books:
                level = NormalDist().inv_cdf(1 - min(0.5, p.lists / words**2)) / np.sqrt(d) * np.sqrt(2)
                books[d] = codebook(words, d, 0, p.seed), codebook(words, d, 1, p.seed), level
            one, two, level = books[d]
            x = _units(np.array([vector], float))[0]
            found = decoded(one @ x[: d // 2], two @ x[d // 2 :], level, p.least)
            for f in found:
                for k, v in zip(rows, (label, d, f, node, copies, vector, found), strict=True):
                    rows[k].append(v)
        if rows["node"]:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _compared(table: pa.Table, cosine: float) -> pa.Table:
    """Linked copies of each vector of a block pair, and a spanning forest of the links.

    A pair that shares several filters counts in its first one only.
    """
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    here = table.column("filter")[0].as_py()
    side = table.column("block").to_numpy() == table.column("i")[0].as_py()
    unit = _units(np.array(table.column("vector").to_pylist(), float))
    earlier = [set(f[: f.index(here)]) for f in table.column("filters").to_pylist()]
    linked = unit @ unit.T >= cosine
    if not side.all():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    x, y = np.nonzero(np.triu(linked))
    both = [earlier[a].isdisjoint(earlier[b]) for a, b in zip(x, y, strict=True)]
    x, y = x[both], y[both]
    found = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
    root = np.arange(len(node))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    joins = []
    for a, b in zip(x, y, strict=True):
        a_top, b_top = top(a), top(b)
        if a_top != b_top:
            root[b_top] = a_top
            joins.append((node[a], node[b]))
    some = np.flatnonzero(found)
    nodes = [*node[some], *(a for a, _ in joins)]
    return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array([*found[some].astype(np.int64), *([0] * len(joins))], pa.int64()), "to": pa.array([*([None] * len(some)), *(b for _, b in joins)], pa.int64())})


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: CapParams = PARAMS) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Rows are compared with rows of the same non-null label and the same number of
    dimensions. Null, empty and zero vectors, and those with null or non-finite
    components, link with nothing. A copy of a vector under the same label is a
    link. A row with a null id has links like any other, and its component is the
    smallest id in it. ``kept`` is true for the row whose id is its component.
    """
    p = params
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("vector"))
    good = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    known = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = numbered(known.where("good").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "node")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words = max(4, min(p.most_words, int(np.ceil(np.sqrt(most * p.lists / p.members)))))
    ddl = "label long, dims int, filter long, node long, copies long, vector array<double>, filters array<long>"
    filters = cut_lineage(classes.select("label", "node", "copies", "vector").mapInArrow(partial(_filter_rows, words=words, p=p), ddl))
    key = ["label", "dims", "filter"]
    sizes = filters.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / p.block).cast("int"))
    dealt = filters.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = cut_lineage(pairs.groupBy(*key, "i", "j").applyInArrow(lambda t: _compared(t, p.cosine), "node long, links long, to long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = smallest_labels(classes.select("node", F.col("first").alias("label")), found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    about = classes.join(placed, "node").join(links, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    alone = known.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    every = known.where("good").join(about, ["label", "vector"]).select("id", "n_links", "component").union(alone)
    return every.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
