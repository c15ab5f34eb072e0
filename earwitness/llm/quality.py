"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import Memo, crc_fold, extend, hash_share
from earwitness.session import cut_lineage


@dataclass(frozen=True)
class QualityParams:
    """Bounds and sizes of the model; the sample bound is the only place where rows are sampled, and only for the fit."""

    sample_rows: int = 8_000
    sample_parts: int = 8
    folds: int = 4
    held_out: int = 2
    word_rows: int = 1 << 13
    dimensions: int = 48
    nonzeros: int = 6
    window: int = 2
    hidden: int = 24
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-3
    calibration_share: float = 0.2
    accept: float = 0.7
    seed: int = 7


PARAMS = QualityParams()
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_TWICE = re.compile(r"(.)\1+", re.S)


def shape(chunk: str) -> str:
    """Letters as A or a, digits as 0, all else as it is; repeats once."""
    return _TWICE.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", chunk))))


def _row(kind: str, word: str, rows: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{word}") % rows


def _codes(chunk: str, rows: int) -> int:
    """Row of the word and row of its shape in one number."""
    return _row("word", "".join(c for c in chunk if c.isalnum()).lower(), rows) * rows + _row("shape", shape(chunk), rows)


def word_codes(text: str | None, memo: Memo, rows: int) -> np.ndarray:
    """Vector rows of a text in order: word, shape, and a mark for a word said twice in a row."""
    chunks = text.split() if text else []
    codes = np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks))
    again = np.empty(len(codes), np.int64)
    marks = _row("mark", "same", rows), _row("mark", "new", rows)
    if len(codes):
        again[0] = marks[1]
        again[1:] = np.where(codes[1:] == codes[:-1], *marks)
    return np.stack([codes // rows, codes % rows, again], 1).ravel()


def index_vectors(p: QualityParams) -> np.ndarray:
    """Sparse ternary vectors, one a row, from the seed alone."""
    rng = np.random.default_rng(p.seed)
    out = np.zeros((p.word_rows, p.dimensions), np.int64)
    for k in range(p.nonzeros):
        out[np.arange(p.word_rows), rng.integers(0, p.dimensions, p.word_rows)] += 1 if k % 2 else -1
    return out


def _memo(p: QualityParams) -> Memo:
    return Memo(partial(_codes, rows=p.word_rows))


def _around(codes: np.ndarray, index: np.ndarray, reach: int) -> np.ndarray:
    """For each place of a text the sum of the index vectors at most ``reach`` places away, without its own."""
    own = index[codes]
    sums = np.zeros((len(codes) + 1, index.shape[1]), index.dtype)
    np.cumsum(own, 0, out=sums[1:])
    at = np.arange(len(codes))
    return sums[np.minimum(at + reach + 1, len(codes))] - sums[np.maximum(at - reach, 0)] - own


#: Vector rows whose context sums travel together.
ROWS_TOGETHER = 512


def _contexts(batches, p: QualityParams):
    """Sums of the index vectors seen around every row, as whole numbers, ``ROWS_TOGETHER`` rows at a time."""
    memo, index = _memo(p), index_vectors(p)
    total = np.zeros_like(index)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            codes = word_codes(text, memo, p.word_rows)
            if len(codes):
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                total[codes[order][starts]] += np.add.reduceat(_around(codes, index, 3 * p.window)[order], starts)
    for k in range(0, p.word_rows, ROWS_TOGETHER):
        part = total[k : k + ROWS_TOGETHER]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "sums"])


def _added(parts: pa.Table) -> pa.Table:
    """One row for all of a group: its sums added up."""
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in parts.column("sums"))
    return pa.table({"first": parts.column("first").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(sample: DataFrame, p: QualityParams) -> np.ndarray:
    """Own index vector and the direction of the contexts, side by side in one space and of one length.

    Spark adds up what the tasks found, so that one matrix reaches the driver whatever their number.
    """
    index = index_vectors(p)
    sums = np.zeros_like(index)
    shape = "first int, sums binary"
    for r in sample.select("text").mapInArrow(partial(_contexts, p=p), shape).groupBy("first").applyInArrow(_added, shape).collect():
        sums[r.first : r.first + ROWS_TOGETHER] = np.frombuffer(r.sums, np.int64).reshape(-1, p.dimensions)
    unit = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    return (unit(index.astype(float)) + unit(sums.astype(float))).astype(np.float32)


def _pooled(text: str | None, memo: Memo, vectors: np.ndarray) -> np.ndarray:
    codes = word_codes(text, memo, len(vectors))
    return vectors[codes].mean(0, dtype=np.float64) if len(codes) else np.zeros(vectors.shape[1])


def _pooler(vectors, p: QualityParams):
    memo = _memo(p)
    return lambda batch: {"x": [_pooled(t, memo, vectors.value) for t in batch.column("text").to_pylist()]}


@dataclass(frozen=True)
class Network:
    """Two layers over standardised pooled vectors; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, p: QualityParams) -> Network:
    """Full-batch Adam on the cross-entropy with both classes weighing the same."""
    rng = np.random.default_rng(p.seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], p.hidden)), np.zeros(p.hidden), rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for step in range(1, p.steps + 1):
        h = np.tanh(z @ params[0] + params[1])
        error = weight * (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y)
        back = error[:, None] * params[2] * (1 - h * h)
        grads = [z.T @ back + p.decay * params[0], back.sum(0), h.T @ error + p.decay * params[2], error.sum(keepdims=True)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - p.rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def calibrated(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature, of a fixed grid, with the smallest log loss on rows that the weights have not seen."""
    if not len(y):
        return net
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    logit = net.logits(x)
    loss = [np.logaddexp(0, np.where(y == 1, -logit, logit) / t).mean() for t in grid]
    return Network(**{**net.__dict__, "temperature": float(grid[int(np.argmin(loss))])})


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    net: Network | None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", params: QualityParams = PARAMS) -> Model:
    """Word vectors and network from labelled rows outside the held-out fold.

    About ``sample_rows`` of them, picked by the hash of their id, are used (all,
    if there are fewer). Null labels and ids are ignored; an id with several labels
    has the smallest. Without rows of both classes there is no network.
    """
    p = params
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    usable = usable.where(crc_fold("id", p.folds) != p.held_out)
    share = F.lit(min(1.0, p.sample_rows / max(1, usable.count())))
    picked = usable.where(hash_share(share, "id")).groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), "text").where(hash_share(share, "id") & (crc_fold("id", p.folds) != p.held_out))
    sample = cut_lineage(rows.join(picked, "id").repartition(p.sample_parts, F.xxhash64("id", "text")))
    vectors = word_vectors(sample, p)
    spread = sample.sparkSession.sparkContext.broadcast(vectors)
    seen = extend(sample, partial(_pooler, spread, p), "x array<double>", ["id", "y"]).select("id", "y", "__out.x").toPandas()
    if seen.y.nunique() < 2:
        return Model(vectors, None)
    seen = seen.assign(k=[xxhash.xxh3_64_intdigest(str(i)) for i in seen.id], first=[v[0] for v in seen.x]).sort_values(["k", "first"], kind="stable")
    x, y = np.stack(seen.x), seen.y.to_numpy()
    later = (seen.k % 1000 < p.calibration_share * 1000).to_numpy()
    if len(set(y[~later])) < 2:
        later[:] = False
    return Model(vectors, calibrated(train(x[~later], y[~later], p), x[later], y[later]))


def _scorer(model, p: QualityParams):
    vectors, net, memo = model.value.vectors, model.value.net, _memo(p)

    def make(batch):
        texts = batch.column("text").to_pylist()
        if net is None:
            return {"score": [0.5] * len(texts)}
        return {"score": net.scores(np.stack([_pooled(t, memo, vectors) for t in texts]))}

    return make


def scored(docs: DataFrame, model: Model, keep: list[str], params: QualityParams = PARAMS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__out.score``, the calibrated probability of label 1, of every whole text.

    A null or empty text is scored as the zero vector; without a network every
    score is 0.5. Rows stay rows, whatever their ids.
    """
    return extend(docs, partial(_scorer, docs.sparkSession.sparkContext.broadcast(model), params), "score double", keep)


def accepted(params: QualityParams = PARAMS) -> Column:
    return F.col("__out.score") >= params.accept
