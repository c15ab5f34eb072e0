"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams of a language, in
order. A document gets the same kind of list, and each language is as far away as
the sum, over the document's list, of how many places an n-gram is out of place
in the profile; an n-gram that the profile lacks counts as the longest distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earwitness.llm.common import extend, hash_share


@dataclass(frozen=True)
class ProfileParams:
    """``sample_rows``: documents of each language, about, that a profile is learned from (the only sampling,
    picked by the hash of the id). N-grams of up to three
    code points pack into one whole number."""

    sample_rows: int = 4_000
    length: int = 400
    sizes: tuple[int, ...] = (1, 2, 3)


PARAMS = ProfileParams()
UNKNOWN = "und"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_POINT = np.uint64(21)


def ngram_counts(text: str | None, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the lower-cased words, each between spaces, as packed numbers, and how often each occurs."""
    words = _LETTERS.findall(text.lower()) if text and _LETTER.search(text) else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = points == 32
    found = []
    for n in sizes:
        grams = np.zeros(max(0, len(points) - n + 1), np.uint64)
        inner = np.zeros(len(grams), bool)
        for k in range(n):
            grams = (grams << _POINT) | points[k : len(points) - n + 1 + k]
            inner |= space[k : len(points) - n + 1 + k] if 0 < k < n - 1 or n == 1 else False
        found.append(grams[~inner])  # none goes across a space
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent n-grams; ties by their number."""
    return grams[np.lexsort((grams, -counts))[:length]]


def _counted(batches, sizes):
    """Counts by language and n-gram, summed over each batch."""
    for batch in batches:
        total: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.setdefault(lang, []).append(ngram_counts(text, sizes))
        for lang, parts in total.items():
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def profiles(labelled: DataFrame, params: ProfileParams = PARAMS) -> dict[str, np.ndarray]:
    """Profiles learned from rows (``id``, ``lang``, ``text``) with a language.

    Every language gets one; ``length`` n-grams of each come to the driver.
    """
    known = labelled.where("lang is not null and id is not null")
    sizes = known.groupBy("lang").count().collect()
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, params.sample_rows / r["count"])) for r in sizes], "lang string, __share double")
    picked = known.join(shares, "lang").where(hash_share(F.col("__share"), "id")).select("lang", "text")
    counts = picked.mapInArrow(partial(_counted, sizes=params.sizes), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.length).orderBy("lang", "rank").select("lang", "gram").toArrow()
    grams = best.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    langs = best.column("lang").to_pylist()
    starts = [k for k in range(len(langs)) if k == 0 or langs[k] != langs[k - 1]]
    return {langs[a]: grams[a:b] for a, b in zip(starts, [*starts[1:], len(langs)], strict=False)}


class Classifier:
    """Nearest profile by out-of-place distance; ties go to the first language by name."""

    def __init__(self, learned: dict[str, np.ndarray], params: ProfileParams = PARAMS) -> None:
        self.params, self.languages = params, sorted(learned)
        each = [learned[x] for x in self.languages]
        grams = np.concatenate(each) if each else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.starts = np.unique(grams, return_index=True) if not len(order) else np.unique(grams[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(grams))
        # For each n-gram, side by side, the languages whose profiles have it, and its places there.
        self.lang = np.repeat(np.arange(len(each)), [len(g) for g in each])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in each])[order] if each else grams

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for the profile itself, 0 if it has none of the document's n-grams."""
        grams, counts = ngram_counts(text, self.params.sizes)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        top = ranked(grams, counts, self.params.length)
        at = np.searchsorted(self.grams, top)
        known = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == top) if len(self.grams) else np.empty(0, int)
        first, n = self.starts[at[known]], (self.ends - self.starts)[at[known]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        apart = np.abs(self.place[entry] - np.repeat(known, n)) - self.params.length
        out = self.params.length * len(top) + np.bincount(self.lang[entry], apart, len(self.languages)).astype(np.int64)
        best = int(np.argmin(out))
        return self.languages[best], 1 - float(out[best]) / (self.params.length * len(top))


def _predictor(learned, params):
    classifier = Classifier(learned.value, params)

    def make(batch):
        found = [classifier.predict(t) for t in batch.column("text").to_pylist()]
        return {"lang": [f[0] for f in found], "score": [f[1] for f in found]}

    return make


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str], params: ProfileParams = PARAMS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__out.lang``, ``__out.score`` of every whole ``text``.

    ``und`` with score 0 for a null text or one without letters, and for all if
    nothing was learned. Rows stay rows, whatever their ids.
    """
    return extend(docs, partial(_predictor, docs.sparkSession.sparkContext.broadcast(learned), params), "lang string, score double", keep)
