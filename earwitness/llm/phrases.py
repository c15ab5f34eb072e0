"""Phrase collocation mining by SON partitioning: shards mined on their own at lowered support, candidates counted exactly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earwitness.llm.common import HASH_BASE, Powers, bitmaps, maybe_in, utf8
from earwitness.session import cut_lineage


@dataclass(frozen=True)
class PhraseParams:
    """``shards`` only decides how much is counted before the exact count, never what is found.

    A shard is a share of the documents by the hash of the text, spread over as many
    tasks as it has partitions; with more shards local support sinks towards one.
    """

    support: int = 100
    longest: int = 5
    report: int = 2000
    shards: int = 4


PARAMS = PhraseParams()
#: Bytes of text held by a task before its n-grams are counted and handed on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Bytes whose running sums are held at once.
STRETCH = 1 << 18
#: Bits of a phrase's key that are counted by shard. Fewer travel lighter; phrases that share them are candidates together.
KEY_BITS = 40
_NEXT, _ONE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)


def _kinds() -> np.ndarray:
    """0 for a byte of a word, 1 for white space within a piece, 2 for the end of a piece."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b" \t")] = 1
    kinds[list(b".,;:!?\n\x0b\x0c\r")] = 2
    return kinds


_KINDS = _kinds()
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Block:
    """Words of many texts: where they begin and end in the joined bytes, their hashes, pieces and the text each is of."""

    raw: bytes
    langs: list[str]
    shards: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    row: np.ndarray

    def word_numbers(self) -> np.ndarray:
        """Equal words by one number; told apart by their bytes."""
        edges = np.stack([self.start, self.end], 1).ravel()
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.raw)])
        return pieces.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


def block(texts: list[bytes], langs: list[str], shards: list[int], powers: Powers) -> Block:
    """Words of lower-cased texts; a full stop stands between two texts.

    A word's hash is a polynomial in its bytes, taken for all words at once from
    running sums. It serves to find candidates only.
    """
    raw = b".".join(texts).translate(_UPPER)
    data = np.frombuffer(raw, np.uint8)
    kinds = _KINDS[data]
    inside = np.concatenate([[False], kinds == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    hashes = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # sums of a bounded stretch at once; a longer word is one of its own
        to = max(at + 1, int(np.searchsorted(end, start[at] + STRETCH, "right")))
        low = start[at]
        hashes[at:to] = _mixed(powers.hashes(powers.sums(data[low : end[to - 1]]), start[at:to] - low, end[at:to] - low))
        at = to
    piece = np.searchsorted(np.flatnonzero(kinds == 2), start)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begins)))
    return Block(raw, langs, np.array(shards, np.int64), start.astype(np.int64), end.astype(np.int64), hashes, piece, row)


def _blocks(batches):
    powers = Powers()
    texts, langs, shards, size = [], [], [], 0
    for batch in batches:
        for lang, shard, text in zip(batch.column("lang").to_pylist(), batch.column("shard").to_pylist(), utf8(batch.column("text")), strict=True):
            if size and size + len(text) > BLOCK_BYTES:
                yield block(texts, langs, shards, powers)
                texts, langs, shards, size = [], [], [], 0
            texts.append(text)
            langs.append(lang)
            shards.append(shard)
            size += len(text) + 1
    if texts:
        yield block(texts, langs, shards, powers)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _NEXT
    return h ^ (h >> np.uint64(32))


def _seeds(langs: list[str]) -> np.ndarray:
    """What sets the phrases of one language apart from those of another."""
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in langs], np.uint64)


def gram_keys(of: Block, longest: int) -> list[np.ndarray]:
    """For 1, 2 ... words: keys of the phrases that begin at each word, and 0 where the piece is too short."""
    out = [_mixed(of.hashes ^ _seeds(of.langs)[of.row]) | _ONE]
    for k in range(1, longest):
        grown = np.zeros_like(out[0])
        reach = max(0, len(grown) - k)
        whole = of.piece[k:] == of.piece[:reach]
        grown[:reach] = np.where(whole, _mixed(out[-1][:reach] * HASH_BASE + of.hashes[k:]) | _ONE, np.uint64(0))
        out.append(grown)
    return out


def _groups(of: Block, salt: np.ndarray) -> np.ndarray:
    """A number for the language and shard of each text."""
    return _seeds(of.langs).view(np.int64) ^ salt[of.shards]


def _shard_salt(shards: int) -> list[int]:
    """What sets the keys of one shard apart from those of another in a bitmap."""
    return [int(x) for x in np.random.default_rng(11).integers(-(1 << 62), 1 << 62, shards)]


def _numbers(values: list) -> np.ndarray:
    """Equal values by one number, counted from 0."""
    known = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return np.array([known[v] for v in values], np.int64)


def _word_totals(batches, salts: list[int]):
    salt = np.array(salts, np.int64)
    for of in _blocks(batches):
        n = np.bincount(of.row, minlength=len(of.langs))
        yield pa.RecordBatch.from_arrays([pa.array(of.langs, pa.string()), pa.array(of.shards.astype(np.int32)), pa.array(_groups(of, salt)), pa.array(n.astype(np.int64))], names=["lang", "shard", "group", "n"])


def _local(batches, k: int, salts: list[int], shorter: Broadcast | None):
    """``group, key, n`` of the phrases of ``k`` words whose two phrases of one word less may be frequent in the shard."""
    salt = np.array(salts, np.int64)
    for of in _blocks(batches):
        grams = gram_keys(of, k)
        at = np.flatnonzero(grams[k - 1])
        if shorter is not None:
            for step in (0, 1):
                before = grams[k - 2][at + step].view(np.int64) ^ salt[of.shards[of.row[at]]]
                at = at[maybe_in(shorter.value, before)]
        if len(at):
            keys, group = (grams[k - 1][at] & np.uint64((1 << KEY_BITS) - 1)).view(np.int64), _groups(of, salt)[of.row[at]]
            order = np.lexsort((keys, group))
            keys, group = keys[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(keys[first]), pa.array(np.diff(first, append=len(keys)))], names=["group", "key", "n"])


def _exact(batches, longest: int, candidates: Broadcast):
    """``lang, phrase, n`` of the phrases that may be candidates, as texts."""
    for of in _blocks(batches):
        if not len(of.start):
            continue
        word, same = of.word_numbers(), _numbers(of.langs)[of.row]
        at = np.arange(len(word))
        for k, keys in enumerate(gram_keys(of, longest), 1):
            stays = (keys[at] != 0) & maybe_in(candidates.value, keys[at].view(np.int64))
            at, same = at[stays], same[stays]
            if not len(at):
                break
            # Equal phrases by one number: that of the words before and that of the last word.
            _, first, same, n = np.unique(same * len(word) + word[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
            begins = at[first]
            spans = zip(of.start[begins].tolist(), of.end[begins + k - 1].tolist(), strict=True)
            texts = [b" ".join(x for x in of.raw[a:b].replace(b"\t", b" ").split(b" ") if x) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([of.langs[r] for r in of.row[begins].tolist()], pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])


def _placed(docs: DataFrame, p: PhraseParams) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64("text"), F.lit(p.shards)).cast("int").alias("shard"), "text").where("text is not null")


def _freed(maps: list[Broadcast]) -> None:
    for one in maps:
        one.destroy()


def frequent(docs: DataFrame, p: PhraseParams = PARAMS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words said ``support`` times in their language, ``(lang, phrase, words, a)``, and ``(lang, n)`` word counts.

    A shard with w of a language's n words is mined for all phrases with local count
    c, where c * n >= support * w, word count by word count: a longer phrase is
    counted where both phrases of one word less are locally frequent. A phrase that
    misses this in every shard has less than ``support`` occurrences in all. Local
    phrases are known by hash; bitmaps of fixed size name them to the tasks. What may
    be a candidate is then counted over all documents by its text, so neither a
    clash of hashes nor a crowded bitmap changes a count.
    """
    placed, salts = _placed(docs, p), _shard_salt(p.shards)
    sizes = cut_lineage(placed.mapInArrow(partial(_word_totals, salts=salts), "lang string, shard int, group long, n long").groupBy("lang", "shard", "group").agg(F.sum("n").alias("w")))
    totals = sizes.groupBy("lang").agg(F.sum("w").alias("n"))
    least = cut_lineage(sizes.join(totals.where("n > 0"), "lang").select("group", "shard", F.expr(f"({p.support}L * w + n - 1) div n").alias("least")))
    local, shorter = [], None
    for k in range(1, p.longest + 1):
        counted = placed.mapInArrow(partial(_local, k=k, salts=salts, shorter=shorter), "group long, key long, n long").groupBy("group", "key").agg(F.sum("n").alias("n"))
        found = cut_lineage(counted.join(least, "group").where("n >= least").select("key", "shard"))
        if shorter is not None:
            _freed([shorter])
        local.append(found.select("key"))
        salted = F.col("key").bitwiseXOR(F.element_at(F.array(*map(F.lit, salts)), F.col("shard") + 1))
        shorter = bitmaps(found.select(salted.alias("key")), "key", F.lit(True))[0]
    _freed([shorter])
    union = local[0]
    for more in local[1:]:
        union = union.union(more)
    (candidates,) = bitmaps(union, "key", F.lit(True))
    counted = placed.mapInArrow(partial(_exact, longest=p.longest, candidates=candidates), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    exact = cut_lineage(counted.where(F.col("a") >= p.support).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a"))
    _freed([candidates])
    return exact, totals


def score() -> Column:
    """1000 a n / (l r), rounded down, in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(38,0))"
    return F.expr(f"cast(({wide(1000)} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) as long)")


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def collocations(docs: DataFrame, p: PhraseParams = PARAMS) -> DataFrame:
    """The best phrases of every language of ``docs(text, lang)``: ``lang, rank, phrase, a, l, r, n, score``.

    Null texts are empty, a null language is ``und``; rows count as often as they
    are there. The score of a phrase is that of its worst cut, 1000 a n / (l r) rounded
    down, in decimals of 38 digits. A phrase within a longer one of the same count is
    dropped; since counts can only fall as a phrase grows, those longer by one word
    decide. An empty table gives no rows.
    """
    exact, totals = frequent(docs, p)
    several = exact.where("words > 1")
    longer = exact.where("words > 2")
    inner = longer.select("lang", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("of_longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = several.join(covered, ["lang", "phrase"], "left").where("of_longer is null or of_longer < a").select("lang", "phrase", "words", "a")
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", _part(F.lit(1), F.col("k")).alias("front"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = exact.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"))
    cut = cut.join(known.select("lang", F.col("part").alias("front"), F.col("count").alias("l")), ["lang", "front"]).join(known.select("lang", F.col("part").alias("rest"), F.col("count").alias("r")), ["lang", "rest"]).join(totals, "lang")
    worst = cut.select("*", score().alias("score")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.report)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
