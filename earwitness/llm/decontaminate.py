"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce

from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import extend, numbered, utf8

#: Words of a window.
WINDOW = 13
#: A document is contaminated from one hit word in so many words.
WORDS_PER_HIT = 20
#: Bytes of benchmark text searched for at once: what one broadcast may hold. A larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Words looked at to decide on a shift.
BLOCK = 2

_LETTERS = bytes.maketrans(
    bytes(range(128)),
    bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(128)),
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, ASCII letters and everything beyond ASCII."""
    return text.translate(_LETTERS).split() if text else []


class _Table:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], set[str]], base: int) -> None:
        self.length, self.block, self.base = length, min(BLOCK, length), base
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[tuple[int, ...], set[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block - 1, length):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, length), length - 1 - end)
            self.buckets.setdefault(self._key(words, length - 1), {}).setdefault(words[0], []).append((words, items))
        self.jump = length - self.block + 1

    def _key(self, words, end: int) -> int:
        return words[end] if self.block == 1 else words[end - 1] * self.base + words[end]

    def search(self, words: list[int]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of every occurrence, by position."""
        at, n, last = self.length - 1, len(words), self.length - 1
        shift, jump, base, single = self.shift, self.jump, self.base, self.block == 1
        while at < n:
            word = words[at]
            if not word:  # in no pattern
                at += self.length
                continue
            key = word if single else words[at - 1] * base + word
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            for pattern, items in self.buckets[key].get(words[at - last], ()):
                if words[at - last : at + 1] == list(pattern):
                    yield at - last, items
            at += 1


class WuManber:
    """Every occurrence of windows of benchmark items in a word sequence."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            length = min(window, len(words))
            for at in range(len(words) - length + 1 if words else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[at : at + length]), set()).add(name)
        self.tables = [_Table(length, patterns, len(self.ids) + 1) for length, patterns in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged runs (start, end) of hit words, and the items hit."""
        get = self.ids.get
        numbers = [get(w, 0) for w in words]
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        for t in self.tables:
            for start, items in t.search(numbers):
                runs.append((start, start + t.length))
                found |= items
        return merged(runs), sorted(found)


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _searcher(patterns: Broadcast, window: int):
    search = WuManber(patterns.value, window)

    def make(batch):
        words = [words_of(t) for t in utf8(batch.column("text"))]
        found = [search.hits(w) for w in words]
        return {"n_words": [len(w) for w in words], "hits": [[{"start": a, "end": b} for a, b in runs] for runs, _ in found], "items": [items for _, items in found]}

    return make


def _searched(docs: DataFrame, items: DataFrame, keep: list[str], window: int) -> DataFrame:
    patterns = docs.sparkSession.sparkContext.broadcast([(r.item, r.text.encode()) for r in items.toLocalIterator()])
    return extend(docs, partial(_searcher, patterns, window), _FOUND, keep)


def _merged_runs(runs: Column) -> Column:
    """``merged`` as a column: runs that overlap or touch become one."""
    kind = "array<struct<start:long,end:long>>"

    def step(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (x.start <= F.try_element_at(done, F.lit(-1)).end), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.array().cast(kind), step)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and a struct ``__out``: ``n_words``, ``hits`` (merged runs of hit word positions), ``items`` (ids whose windows occur).

    The column ``text`` is searched whole. A null or empty text has no words; items
    without an id or without words are ignored; rows of one item id count as one
    item; an empty benchmark hits nothing. Rows stay rows, also with null or
    repeated ids.

    The patterns are sent to all tasks, at most ``block_bytes`` of benchmark text
    at once; a benchmark within that bound needs one pass and no shuffle. A larger
    one is searched block by block, and the blocks' hits are joined by row.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        return _searched(docs, items, keep, window)
    docs = numbered(docs, "__row")
    found = reduce(DataFrame.union, (_searched(docs.select("__row", "text"), items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), ["__row"], window) for b in range(blocks)))
    joined = found.groupBy("__row").agg(
        F.max("__out.n_words").alias("n_words"), F.flatten(F.collect_list("__out.hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__out.items")))).alias("items"))
    joined = joined.select("__row", F.struct("n_words", _merged_runs(F.col("hits")).alias("hits"), "items").alias("__out"))
    return docs.join(joined, "__row").select(*keep, "__out")


def n_hit(found: str = "__out") -> Column:
    """Hit words of a row of ``benchmark_hits``."""
    return F.aggregate(F.col(f"{found}.hits"), F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)


def contaminated(found: str = "__out", words_per_hit: int = WORDS_PER_HIT) -> Column:
    """A hit, and one hit word in ``words_per_hit`` words at least."""
    return (n_hit(found) > 0) & (n_hit(found) * words_per_hit >= F.col(f"{found}.n_words"))


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all columns, that are not contaminated."""
    return benchmark_hits(docs, benchmark, docs.columns).where(~contaminated()).drop("__out")
