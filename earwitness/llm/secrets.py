"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Every other run of key-like characters is a candidate. Its encoding is inferred
from its characters, and three tests ask whether it may be a uniform random
string of that encoding: chi-squared of the symbol counts, Wald-Wolfowitz runs
about the alphabet's middle, and the correlation of neighbours. Fisher's method
joins them into one p-value; natural words get very small ones.

How often ordinary text of a length looks as random as a candidate is learned
from the corpus itself: the running letters of every whole document are cut into
consecutive strings of each length class. Against that null each candidate has an
empirical p-value, and a Benjamini-Hochberg threshold is set in each length
class. Only counts per length class and level leave the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import extend

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
#: Shortest candidate of the battery, and the shortest lengths of the length classes.
LENGTHS = (16, 20, 28, 40, 64)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LENGTHS[0])
#: Share of false discoveries allowed in each length class.
FALSE_DISCOVERIES = 0.01
#: Levels of -log10 of the combined p-value: LEVELS steps of 1 / PER_DECADE.
LEVELS, PER_DECADE = 400, 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough, in code points."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of at least the least length starts where the run starts: the same matches as dropping short ones.
    return out + [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _DIGITS + _UPPER + _LOWER
#: Encodings from small to large, as their symbols in order; the last has every character of a candidate.
ALPHABETS = (_DIGITS, _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], "234567" + _UPPER, _ALNUM, "+/" + _ALNUM, "-_" + _ALNUM, "+-/_=" + _ALNUM)


def alphabet_of(token: str) -> str:
    """The smallest encoding that has all characters of ``token``, as its symbols in order."""
    used = set(token)
    return next((symbols for symbols in ALPHABETS if used <= set(symbols)), ALPHABETS[-1])


def _tail(z: float) -> float:
    return max(1e-300, math.erfc(z / math.sqrt(2)) / 2)


def battery(token: str) -> float:
    """Combined p-value of ``token`` under a uniform random string of its encoding."""
    symbols = alphabet_of(token)
    place = {c: k for k, c in enumerate(symbols)}
    values = [place[c] for c in token]
    n, size = len(values), len(symbols)
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * size / n - n
    uniform = _tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))

    above = [2 * v >= size for v in values]
    high = sum(above)
    low = n - high
    runs = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
    spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    runs_p = min(1.0, 2 * _tail(abs(runs - 1 - 2 * high * low / n) / math.sqrt(spread))) if spread > 0 else _tail(math.sqrt(n))

    mean = sum(values) / n
    power = sum((v - mean) ** 2 for v in values)
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / power if power else 1.0
    serial = min(1.0, 2 * _tail(abs(r + 1 / n) * math.sqrt(n)))

    half = -(math.log(uniform) + math.log(runs_p) + math.log(serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def length_class(n: int) -> int:
    return sum(n >= least for least in LENGTHS) - 1


def level(token: str) -> int:
    """How far from random: 0 is as random as can be."""
    return min(LEVELS, int(-math.log10(max(1e-300, battery(token))) * PER_DECADE))


#: For each byte the encodings that have it, a bit each; its place in each; sizes; the bytes that running letters leave out.
_SORTS = np.array([sum((chr(c) in x) << k for k, x in enumerate(ALPHABETS)) for c in range(256)], np.uint8)
_PLACE = np.array([[max(0, x.find(chr(c))) for c in range(256)] for x in ALPHABETS], np.uint8)
_SIZES = np.array([len(x) for x in ALPHABETS])
_OTHER = bytes(c for c in range(256) if chr(c) not in "+-/_" + _ALNUM)
#: Characters handled at once, which bounds memory.
_AT_ONCE = 1 << 16
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tails(z: np.ndarray) -> np.ndarray:
    return np.maximum(1e-300, _erfc(z / math.sqrt(2)).astype(float) / 2)


def levels(tokens: np.ndarray) -> np.ndarray:
    """``level`` of many strings of one length: a row of bytes each, of key characters."""
    rows, n = tokens.shape
    has = np.bitwise_and.reduce(_SORTS[tokens], axis=1).astype(int)
    which = np.log2(has & -has).astype(int)
    values, size = _PLACE[which[:, None], tokens], _SIZES[which]

    most = int(_SIZES.max())
    counts = np.bincount((values + np.arange(rows)[:, None] * most).ravel(), minlength=rows * most).reshape(rows, most)
    chi = np.einsum("ij,ij->i", counts, counts) * size / n - n
    uniform = _tails((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))

    above = values >= ((size + 1) // 2)[:, None]
    high = above.sum(axis=1)
    low = n - high
    changes = (above[:, 1:] != above[:, :-1]).sum(axis=1)
    spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    some = spread > 0
    z = np.where(some, np.abs(changes - 2 * high * low / n) / np.sqrt(np.where(some, spread, 1)), math.sqrt(n))
    runs_p = np.where(some, np.minimum(1.0, 2 * _tails(z)), _tails(z))

    off = values - values.mean(axis=1, keepdims=True)
    power = np.einsum("ij,ij->i", off, off)
    r = np.where(power > 0, np.einsum("ij,ij->i", off[:, :-1], off[:, 1:]) / np.where(power > 0, power, 1), 1.0)
    serial = np.minimum(1.0, 2 * _tails(np.abs(r + 1 / n) * math.sqrt(n)))

    half = -(np.log(uniform) + np.log(runs_p) + np.log(serial))
    p = np.exp(-half) * (1 + half + half * half / 2)
    return np.minimum(LEVELS, (-np.log10(np.maximum(1e-300, p)) * PER_DECADE).astype(int))


def null_counts(running: list[bytes]) -> list[dict]:
    """How many strings of each length class and level the running letters of many texts have, each cut into consecutive strings on its own."""
    out = []
    for kind, n in enumerate(LENGTHS):
        text = np.frombuffer(b"".join(x[: len(x) // n * n] for x in running), np.uint8).reshape(-1, n)
        step = _AT_ONCE // n
        counts = sum((np.bincount(levels(text[at : at + step]), minlength=LEVELS + 1) for at in range(0, len(text), step)), np.zeros(LEVELS + 1, int))
        out += [{"class": kind, "level": int(k), "n": int(counts[k])} for k in np.flatnonzero(counts)]
    return out


def _united(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan_text(text: str | None) -> dict:
    """Base spans, candidates beyond them, and the running letters beyond both.

    What base spans leave of a run of key characters are candidates of their own,
    tested without the separators at the cut.
    """
    text = text or ""
    base = base_spans(text)
    taken = _united((a, b) for _, a, b in base)
    candidates, cut, first, at = [], [], 0, 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        k, start = first, a
        while start < b:
            stop, after = (taken[k][0], taken[k][1]) if k < len(taken) and taken[k][0] < b else (b, b)
            token = text[start:stop].rstrip("=")
            token = token.lstrip("+-/_=") if start > a else token
            token = token.rstrip("+-/_=") if stop < b else token
            if len(token) >= LENGTHS[0]:
                candidates.append({"start": start, "end": stop, "class": length_class(len(token)), "level": level(token)})
            k, start = k + 1, after
    for a, b in _united([*map(tuple, taken), *((c["start"], c["end"]) for c in candidates)]):
        cut.append(text[at:a])
        at = b
    cut.append(text[at:])
    running = "".join(cut).encode("utf-8", "surrogatepass").translate(None, _OTHER)
    return {"base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "candidates": candidates, "running": running}


_SPAN = "struct<kind:string,start:long,end:long>"
_SCAN = f"base array<{_SPAN}>, candidates array<struct<start:long,end:long,class:int,level:int>>, null array<struct<class:int,level:int,n:long>>"


def _scanner():
    def make(batch):
        found = [scan_text(t) for t in batch.column("text").to_pylist()]
        null = [null_counts([f["running"] for f in found]), *[[]] * (len(found) - 1)]
        return {k: [f[k] for f in found] for k in ("base", "candidates")} | {"null": null[: len(found)]}

    return make


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__out`` with ``base`` spans and ``candidates`` of every whole ``text`` (null: empty).

    ``__out.null`` has the counts of ordinary strings per length class and level,
    those of a batch's rows in the first of them; only their sums mean anything.
    """
    return extend(docs, _scanner, _SCAN, keep)


@dataclass(frozen=True)
class Thresholds:
    """For each length class the highest level that still counts as random; -1: none."""

    levels: tuple[int, ...]

    def flagged(self, candidate: Column) -> Column:
        at = F.element_at(F.array(*map(F.lit, self.levels)), candidate["class"] + 1)
        return candidate.level <= at


def _cut(targets: dict[int, int], null: dict[int, int], share: float) -> int:
    m, n = sum(targets.values()), sum(null.values())
    best, seen, chance = -1, 0, 0
    for step in sorted({*targets, *null}):
        seen += targets.get(step, 0)
        chance += null.get(step, 0)
        if targets.get(step) and (1 + chance) / (1 + n) * m / seen <= share:
            best = step
    return best


def thresholds(found: DataFrame, share: float = FALSE_DISCOVERIES) -> Thresholds:
    """Benjamini-Hochberg thresholds from all candidates and null strings of ``found``.

    The driver sees at most length classes x levels counts. A class without
    enough null strings to reach ``share`` flags nothing.
    """
    targets = found.select(F.explode("__out.candidates").alias("c")).groupBy("c.class", "c.level").count().collect()
    null = found.select(F.explode("__out.null").alias("c")).groupBy("c.class", "c.level").agg(F.sum("c.n").alias("count")).collect()
    of = lambda rows, k: {r["level"]: r["count"] for r in rows if r["class"] == k}
    return Thresholds(tuple(_cut(of(targets, k), of(null, k), share) for k in range(len(LENGTHS))))


def _ordered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.array_position(kinds, s.kind).alias("order"), s.end.alias("end"), s.kind.alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))


def all_spans(limits: Thresholds) -> Column:
    """Base spans and flagged candidates of ``__out``, by start and then kind."""
    extra = F.transform(F.filter("__out.candidates", limits.flagged), lambda c: F.struct(F.lit("random").alias("kind"), c.start.alias("start"), c.end.alias("end")))
    return _ordered(F.concat("__out.base", extra))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: str, spans: Iterable[tuple[int, int]], mark: str) -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at, last = [], 0, 0
    for start, end in sorted(spans):
        if start >= last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = last
    return "".join([*out, text[at:]])


def _redactor(limits: Thresholds, mark: str):
    def make(batch):
        out = []
        for text in batch.column("text").to_pylist():
            found = scan_text(text) if text else None
            if found:
                spans = [(s["start"], s["end"]) for s in found["base"]]
                spans += [(c["start"], c["end"]) for c in found["candidates"] if c["level"] <= limits.levels[c["class"]]]
                text = redacted(text, spans, mark) if spans else text
            out.append(text)
        return {"text": out}

    return make


def without_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` become ``mark``, and ``n_chars``, where there is such a column, follows a changed text."""
    limits = thresholds(scanned(docs.select("text"), []))
    clean = extend(docs, partial(_redactor, limits, mark), "text string")
    changed = ~F.col("text").eqNullSafe(F.col("__out.text"))
    new = {"text": F.col("__out.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("__out.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumns(new).select(docs.columns)
