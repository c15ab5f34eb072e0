"""Embedding whitening: shifted Cholesky QR over Gram passes, then an SVD of the small factor."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The integer grid of the fit: one unit of a vector is 64 steps, counted from a million.
STEPS, OFFSET = 64, 1_000_000
#: Cholesky QR passes. The first, shifted one bounds the condition number, the second and third bring it to one.
PASSES = 3
#: Rows of a batch handled at once in a task.
BLOCK_ROWS = 4096


def _unit() -> float:
    return float(np.finfo(np.float64).eps) / 2


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite entries.

    A matrix needs one number of dimensions: the one that most of these vectors
    have (the larger of equally frequent ones). Vectors of other lengths, empty ones
    among them, are left out as well.
    """
    finite = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = finite.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return finite.where(F.size(vector_col) == (sizes.d if sizes else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of one batch as doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def on_grid(vectors: np.ndarray) -> np.ndarray:
    """Entries as whole numbers, less the offset; refuses what a long cannot hold."""
    steps = np.floor(STEPS * vectors)
    if len(steps) and np.abs(steps).max() >= 2.0**62:
        raise ValueError("a vector entry is too large for the integer grid")
    return steps.astype(np.int64)


def _blocks(batches, d: int, name: str):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            if part.num_rows:
                yield part, on_grid(_matrix(part.column(name), d))


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums of the grid entries (offset taken off) by dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, each entry rounded once: n * x - S is exact wherever it fits a long."""
        largest = int(np.abs(x).max()) if x.size else 0
        if self.n * largest + max(map(abs, self.sums)) < 2**62:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return ((self.n * x.astype(object) - np.array(self.sums, object)) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exactly: n^2 * sum(x^2) - 2n * sum(x S) + sum(S^2)."""
        largest, d = int(np.abs(x).max()) if x.size else 0, len(self.sums)
        if max(map(abs, self.sums), default=0) >= 2**60 or largest >= 2**24 or d >= 2**8:
            wide, sums = x.astype(object), np.array(self.sums, object)
            squares, products = (wide * wide).sum(1).tolist(), (wide * sums).sum(1).tolist()
        else:
            high, low = np.divmod(np.array(self.sums, np.int64), 1 << 30)
            squares = (x * x).sum(1).tolist()
            products = [(h << 30) + lo for h, lo in zip((x @ high).tolist(), (x @ low).tolist(), strict=True)]
        own = sum(s * s for s in self.sums)
        return [self.n * self.n * q - 2 * self.n * p + own for q, p in zip(squares, products, strict=True)]


def _sums(batches, d: int, name: str):
    total, n = np.zeros(d, object), 0
    for part, x in _blocks(batches, d, name):
        total, n = total + (x.astype(object).sum(0) if np.abs(x).max() >= 2**50 else x.sum(0).astype(object)), n + part.num_rows
    if n:
        yield pa.RecordBatch.from_pydict({"k": np.arange(d + 1, dtype=np.int32), "high": [int(s) >> 32 for s in total] + [0], "low": [int(s) & 0xFFFFFFFF for s in total] + [n]})


def centre(df: DataFrame, vector_col: str, d: int) -> Centre:
    """Exact sums; one row for each dimension reaches the driver, whatever the number of tasks."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = df.select(vector_col).mapInArrow(partial(_sums, d=d, name=vector_col), "k int, high long, low long").groupBy("k").agg(wide("high"), wide("low"))
    by = {r.k: (int(r.high) << 32) + int(r.low) for r in parts.collect()}
    return Centre(by.get(d, 0), tuple(by.get(k, 0) for k in range(d)))


def _rows_of(x: np.ndarray, at: Centre, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Centred rows, solved against each triangular factor in turn."""
    a = at.centred(x)
    for r in factors:
        a = np.linalg.solve(r.T, a.T).T
    return a


def _grams(batches, d: int, name: str, at: Centre, factors: tuple[np.ndarray, ...], project: np.ndarray | None):
    total, sums = None, 0.0
    for _, x in _blocks(batches, d, name):
        a = _rows_of(x, at, factors)
        a = a if project is None else a @ project
        total, sums = (a.T @ a if total is None else total + a.T @ a), sums + a.sum(0)
    if total is not None:
        i, j = np.triu_indices(len(total))
        k = np.arange(len(total), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"i": np.concatenate([i.astype(np.int32), k]), "j": np.concatenate([j.astype(np.int32), np.full(len(k), -1, np.int32)]), "v": np.concatenate([total[i, j], sums])})


def gram(df: DataFrame, vector_col: str, d: int, at: Centre, factors: tuple[np.ndarray, ...], project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the rows so far orthogonalised; tasks add up their own, Spark adds the tasks."""
    width = d if project is None else project.shape[1]
    parts = df.select(vector_col).mapInArrow(partial(_grams, d=d, name=vector_col, at=at, factors=factors, project=project), "i int, j int, v double")
    out, sums = np.zeros((width, width)), np.zeros(width)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.j < 0:
            sums[r.i] = r.v
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.v
    return out, sums


def _upper(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of ``g``, shifted as far as it must be to be definite."""
    eye = np.eye(len(g))
    while True:
        try:
            return np.linalg.cholesky(g + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(4 * shift, _unit() * float(np.trace(g)), float(np.finfo(np.float64).tiny))


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``project`` turns centred rows into whitened ones, a column a component."""

    at: Centre
    project: np.ndarray
    explained: tuple[float, ...]
    identity_error: float


def fit(df: DataFrame, vector_col: str, most: int) -> Whitening | None:
    """Components of all rows of ``df`` (as ``usable`` gives them), at most ``most``; None for an empty table.

    Rows A, centred. Each pass takes the Gram matrix of A R^-1 for the factors so far
    and its Cholesky factor; the first is shifted by 11 (n d + d (d + 1)) u times the
    squared norm, which makes it definite whatever the condition of A. The composed
    factor R has A = Q R with Q orthonormal, so the SVD of R gives the components. The
    Gram matrix of the last Q enters as its square root: it is the identity but for
    directions without any variance, which thus stay without. Components whose
    variance is below rounding cannot be whitened and aren't returned.
    """
    first = df.select(F.size(vector_col).alias("d")).head()
    if first is None:
        return None
    d = first.d
    at = centre(df, vector_col, d)
    factors: tuple[np.ndarray, ...] = ()
    for k in range(PASSES):
        g, _ = gram(df, vector_col, d, at, factors)
        if not g.any():
            return Whitening(at, np.zeros((d, 0)), (), 0.0)
        shift = 11 * (at.n * d + d * (d + 1)) * _unit() * float(np.linalg.norm(g, 2)) if k == 0 else 0.0
        factors = (*factors, _upper(g, shift))
    last, _ = gram(df, vector_col, d, at, factors)
    values, basis = np.linalg.eigh(last)
    root = (basis * np.sqrt(np.clip(values, 0, None))) @ basis.T
    composed = root
    for r in reversed(factors):
        composed = composed @ r
    _, sigma, components = np.linalg.svd(composed)
    total = float((sigma**2).sum())
    kept = int((sigma > sigma[0] * d * 16 * _unit()).sum())
    kept = min(kept, most)
    project = components[:kept].T / sigma[:kept] * np.sqrt(at.n)
    w, sums = gram(df, vector_col, d, at, (), project)
    covariance = w / at.n - np.outer(sums / at.n, sums / at.n)
    return Whitening(at, project, tuple(float(s * s) / total for s in sigma[:kept]), float(np.abs(covariance - np.eye(kept)).max()))


def _whitened(batches, d: int, name: str, keep: list[str], found: Whitening):
    for part, x in _blocks(batches, d, name):
        deviations = found.at.deviations(x)
        rows = found.at.centred(x) @ found.project
        values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1] if rows.size else np.zeros(len(rows) + 1, np.int32), pa.array(rows.ravel()))
        made = pa.StructArray.from_arrays([pa.array([str(v) for v in deviations]), values], names=["deviation", "whitened"])
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, "__out"])


def whitened(df: DataFrame, id_col: str, vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row for each usable vector of ``df`` and component: ``id_col, component, n, deviation, whitened, explained, identity_error, deviation_exact``.

    Entries c become floor(64 c) + 1000000 and are fitted as such; all usable rows are
    fit and transformed, whatever their ids (null and repeated ones included).
    ``deviation`` is the sum over dimensions of (n x - S)^2; it is null where it passes
    64 bits, and ``deviation_exact`` (a decimal of up to 38 digits) has it there. An
    empty table, or one whose rows are all alike, has no components and so no rows.
    """
    rows = usable(df.select(F.col(id_col), F.col(vector_col)), vector_col)
    found = fit(rows, vector_col, most)
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if found is None or not found.explained:
        return df.sparkSession.createDataFrame([], shape)
    d = len(found.at.sums)
    made = rows.mapInArrow(partial(_whitened, d=d, name=vector_col, keep=[id_col], found=found), f"`{id_col}` {kind}, __out struct<deviation: string, whitened: array<double>>")
    each = made.select(id_col, F.expr("try_cast(__out.deviation as decimal(38,0))").alias("exact"), F.posexplode("__out.whitened").alias("k", "value"))
    share = F.element_at(F.array(*map(F.lit, found.explained)), F.col("k") + 1)
    return each.select(
        id_col, (F.col("k") + 1).alias("component"), F.lit(found.at.n).cast("long").alias("n"), F.expr("try_cast(exact as long)").alias("deviation"), F.col("value").alias("whitened"),
        share.alias("explained"), F.lit(found.identity_error).alias("identity_error"), F.col("exact").alias("deviation_exact"))
