"""Packing documents into token sequences by vector best fit."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import extend, numbered

#: Pieces packed together by one task; as many shards as the pieces need are packed independently.
SHARD_PIECES = 8192


@dataclass(frozen=True)
class Capacities:
    """What one sequence may hold, and how bins are chosen.

    ``attention`` bounds the sum of squared piece lengths. The defaults never bind
    before the tokens do, so that sequences are as few as can be; lower ones trade
    sequences for cheaper attention or fewer documents each. ``rule`` is ``norm``
    (smallest weighted norm of what stays free) or ``dot`` (largest weighted
    product of demand and what is free).
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    rule: str = "norm"


DEFAULT = Capacities()


#: A full stop or comma before a space that another sign precedes: the tokenizer keeps them together.
#: The control characters U+001C to U+001F are signs to it, though Python takes them for white space.
_CROWDED = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ\t\n\x0b\x0c\r \x85\xa0][.,] ")
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")


def space_free_parts(text: str | None) -> list[str]:
    """Parts of a text whose tokens, one part after the other, are the text's.

    No pattern of the tokenizer crosses a space or a line feed, and its normal forms
    leave them apart. In a Latin-1 text, where lower case and normal forms are plain,
    words are lower-cased first and lose a full stop or comma that stands alone
    after them, so that fewer parts are new.
    """
    if not text:
        return []
    line = text.replace("\n", " ")
    try:
        line.encode("latin-1")
    except UnicodeEncodeError:
        return line.split(" ")
    line = line.lower()
    if _CROWDED.search(line) is None:
        line = line.replace(". ", " . ").replace(", ", " , ")
    return line.split(" ")


class WordTokens:
    """Token ids of texts by way of their space-free parts, which repeat: new ones only are encoded.

    A plain word is one piece for the tokenizer's patterns and goes straight to its model.
    """

    def __init__(self, path: str | None = None, entries: int = 250_000) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.whole = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[k for token, k in vocabulary.items() if token.endswith(self.whole.model.end_of_word_suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.entries = entries

    def _whole(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        encoded = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return zip(texts, (struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoded), strict=True)

    def _plain(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """All words in one text; each ends with the next token that ends a word."""
        ids = np.array(self.plain.encode("\n".join(words), add_special_tokens=False).ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return zip(words, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True)

    def learn(self, parts: set[str]) -> None:
        """Makes all of ``parts`` known. What was not met for long is forgotten, half of it at a time."""
        if len(self.known) > self.entries:
            self.before, self.known = self.known, {}
        plain, odd = [], []
        for p in parts.difference(self.known):
            ids = self.before.get(p)
            if ids is not None:
                self.known[p] = ids
            elif p.isalpha() and _PLAIN.fullmatch(p):
                plain.append(p)
            else:
                odd.append(p)
        self.known.update(self._whole(odd))
        self.known.update(self._plain(plain))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        parts = [space_free_parts(t) for t in texts]
        self.learn(set().union(*parts))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@cache
def _words(path: str | None) -> WordTokens:
    """One for each worker process, which keeps what it has learned for its next task."""
    return WordTokens(path)


_END = np.array([1], "<u4").tobytes()
_PIECE = "piece:int,start:long,length:long,ids_crc32:long"


def _cutter(path: str | None, tokens: int, with_ids: bool):
    words = _words(path)

    def pieces(ids: bytes) -> list[dict]:
        out = []
        for k, at in enumerate(range(0, len(ids), 4 * tokens)):
            part = ids[at : at + 4 * tokens]
            out.append({"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} | ({"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else {}))
        return out

    def make(batch):
        texts = batch.column("text").to_pylist()
        return {"pieces": [pieces(ids + _END) for at in range(0, len(texts), 256) for ids in words.ids(texts[at : at + 256])]}

    return make


def pieces(docs: DataFrame, keep: list[str], tokens: int = DEFAULT.tokens, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of ``docs``: columns ``keep``, piece, start, length, ids_crc32 and, if asked for, ids.

    A text is its tokens and the end token 1; a null or empty text is the end token
    alone. Only texts of over ``tokens`` tokens are cut.
    """
    kind = f"pieces array<struct<{_PIECE}{',ids:array<int>' if with_ids else ''}>>"
    cut = extend(docs, partial(_cutter, tokenizer, tokens, with_ids), kind, keep)
    return cut.select(*keep, F.explode("__out.pieces").alias("__p")).select(*keep, "__p.*")


def best_fit(lengths: np.ndarray, caps: Capacities = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece. Longest first (ties by position); each goes where all three
    demands fit and the rule is best, or opens a bin."""
    limit = np.array([caps.tokens, caps.documents, caps.attention], float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    need = demand / limit
    weight = need.sum(0) / max(1e-12, need.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, used = np.empty((max(1, len(lengths)), 3)), np.zeros(max(1, len(lengths)), np.int64)
    open_bins = np.empty(0, np.int64)
    opened = 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = need.min(0) if len(lengths) else None
    for item in order:
        want = need[item]
        spare = free[open_bins] - want
        fits = np.flatnonzero((spare >= -1e-12).all(1))
        if len(fits):
            score = (weight * spare[fits] ** 2).sum(1) if caps.rule == "norm" else -(weight * want * free[open_bins[fits]]).sum(1)
            chosen = open_bins[fits[int(np.argmin(score))]]
        else:
            chosen = opened
            free[chosen] = 1.0
            opened += 1
            open_bins = np.append(open_bins, chosen)
        free[chosen] -= want
        bins[item], offsets[item] = chosen, used[chosen]
        used[chosen] += lengths[item]
        if (free[chosen] < least - 1e-12).any():  # nothing fits any more
            open_bins = open_bins[open_bins != chosen]
    return bins, offsets


def _pack(shard: pa.Table, caps: Capacities) -> pa.Table:
    shard = shard.sort_by("__row")
    bins, offsets = best_fit(shard.column("length").to_numpy(), caps)
    ids = bins + shard.column("__shard").to_numpy() * (1 << 32)
    return shard.drop_columns(["__row", "__shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))


def packed(cut: DataFrame, caps: Capacities = DEFAULT, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` (rows with a ``length``) with ``sequence_id`` and ``offset``.

    Rows are numbered, dealt evenly over shards of about ``shard_pieces`` by the
    hash of their number, whatever their ids, and each shard is packed by itself:
    a part-filled sequence or two per shard is all that differs from one great
    packing. A single piece beyond a capacity is an error of the caller's limits.
    """
    rows = numbered(cut, "__row")
    shards = -(-rows.count() // shard_pieces) or 1
    dealt = rows.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__shard").applyInArrow(lambda shard: _pack(shard, caps), ddl)


def packed_documents(docs: DataFrame, id_col: Column | str = "doc_id", caps: Capacities = DEFAULT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (id and ``text``) with their sequences and offsets."""
    return packed(pieces(docs.select(id_col, "text"), [id_col], caps.tokens, tokenizer, with_ids), caps)
