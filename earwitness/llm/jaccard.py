"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Every set is XOR-hashed into a
sketch of 32-bit chunks: a shingle falls on one chunk, flips one of its parity
bits and XORs a hash into the rest. So the Hamming distance of two sketches, in
parity bits as well as in chunks, is at most the symmetric difference of the sets.
At a similarity of ``percent`` sets of sizes x and y differ in at most
``(x + y) * (100 - percent) / (100 + percent)`` shingles. A set with two chunks
in use more than that shares two of them with every set it is linked to
(pigeonhole); sketches of a size band are long enough for that, and the rare set
that has fewer in use gives its unused chunks too. Pairs that share two chunks
are verified on the exact sets.

Documents with equal sets are one class, and everything after the first scan
works on classes. Buckets with equal members count once. Small buckets give their
pairs. A set of ``u`` keys shares all but ``differ`` of them with each set it is
linked to, so two of the shared ones are among its first ``differ + 2`` in any order
that holds for all sets. With keys of small buckets first, a class needs to stand in
few large ones, and in none if it shares only a passage. Of those it first picks a
few by a hash of the key, as near copies do alike, and is compared there along a
spanning forest, its block of sketches within itself and with the bucket's first;
then it stands in all those whose members are still apart, where members of the
largest component meet the others only. No pair that could join two components
goes unverified, and no group is expanded into all its pairs. Fixed-size bitmaps
keep rows that can't matter out of shuffles.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import Memo, bitmaps, extend, maybe_in, numbered, utf8
from earwitness.llm.components import roots
from earwitness.session import cut_lineage

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Bits of a bitmap: 4 MB. Several are made on the way, and the driver holds what Spark sends of them.
MAP_BITS = 1 << 25
#: Ratio of a size band.
BAND_RATIO = 1.5
#: Large buckets that a class stands in before its component is known.
PICKED = 3
#: Members up to which a bucket's pairs are listed; a larger one is compared in blocks of BLOCK members.
SMALL, BLOCK = 32, 1024


def _band_edges(ratio: float = BAND_RATIO) -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return edges


EDGES = _band_edges()


@cache
def band_chunks(band: int, percent: int) -> tuple[int, int]:
    """How much linked sets of a band differ at most, and the chunks of its sketches (0 where only equal sets link).

    Chunks are as few as leave two more in use than that, by three standard
    deviations, for the smallest set of the band; tiny sets have as many as shingles.
    """
    small = EDGES[band + 1] - 1
    differ = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
    if not differ:
        return 0, 0
    least = EDGES[band]
    for chunks in range(differ + 2, max(differ + 2, least) + 1):
        unused = (1 - 1 / chunks) ** least
        if chunks * (1 - unused) - 3 * (chunks * unused * (1 - unused)) ** 0.5 >= differ + 2:
            return differ, chunks
    return differ, max(differ + 2, least)


def bands_of(size: int, percent: int) -> list[int]:
    """The band of a set, and those below that a linked set may be in."""
    bands = [bisect_right(EDGES, size) - 1]
    while bands[-1] and EDGES[bands[-1]] - 1 >= -(-size * percent // 100):
        bands.append(bands[-1] - 1)
    return bands


_ODD = (np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, memo: Memo, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; of the whole sequence if it is shorter than one."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    total = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = _mix(total * _ODD[0][0] + h[k : len(h) - n + 1 + k])
    return np.unique(total)


#: The half of a chunk that holds parity bits.
PARITY = np.uint32(0xFFFF)


def sketch(hashes: np.ndarray, band: int, percent: int) -> bytes:
    """Chunks of a set in a band, 32 bits each: 16 parity bits, and 16 bits of XORed hashes."""
    out = np.zeros(band_chunks(band, percent)[1], np.uint32)
    flips = (np.uint64(1) << ((hashes >> np.uint64(40)) & np.uint64(15))) | ((hashes >> np.uint64(28)) & np.uint64(0xFFFF0000))
    np.bitwise_xor.at(out, (_mix(hashes) % np.uint64(len(out))).astype(np.int64), flips.astype(np.uint32))
    return out.tobytes()


def chunk_keys(bits: bytes, band: int, percent: int) -> np.ndarray:
    """Keys of a sketch's chunks in use, or of all, if those in use are too few; the top byte is the band."""
    values = np.frombuffer(bits, np.uint32)
    used = np.flatnonzero(values)
    if len(used) < band_chunks(band, percent)[0] + 2:
        used = np.arange(len(values))
    with np.errstate(over="ignore"):
        key = _mix(_mix(values[used].astype(np.uint64) + np.uint64(1)) + used.astype(np.uint64) * _ODD[0][1] + np.uint64(band))
    return (key >> np.uint64(8)) | (np.uint64(band) << np.uint64(56))


def keys_needed(bits: bytes, band: int, size: int, percent: int) -> int:
    """How many keys of a sketch, first in an order of all keys, hold two that any linked set of the band has as well.

    A linked set differs from one of ``size`` in no more chunks than in shingles, and
    below the set's own band it is no larger than that band allows. Sketches
    that give unused chunks too need all their keys.
    """
    if np.count_nonzero(np.frombuffer(bits, np.uint32)) < band_chunks(band, percent)[0] + 2:
        return len(bits) // 4
    other = size * 100 // percent
    if size >= EDGES[band + 1]:
        other = min(other, EDGES[band + 1] - 1)
    return (size + other) * (100 - percent) // (100 + percent) + 2


def _word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


_SETS = "n long, fp binary, sketches array<struct<band:int,bits:binary>>"


def _summarizer(words: int, percent: int):
    memo = _word_memo()

    def make(batch):
        sizes, prints, sketches = [], [], []
        for text in utf8(batch.column("text")):
            h = shingle_hashes(text, memo, words)
            sizes.append(len(h))
            prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            bands = [b for b in bands_of(len(h), percent) if band_chunks(b, percent)[1]] if len(h) else []
            sketches.append([{"band": b, "bits": sketch(h, b, percent)} for b in bands])
        return {"n": sizes, "fp": prints, "sketches": sketches}

    return make


def _printer(words: int, with_set: bool, wanted: Broadcast):
    """Fingerprints, and sets if asked for, of the rows whose ``hash`` may be in the bitmap; others have none."""
    memo = _word_memo()

    def make(batch):
        asked = maybe_in(wanted.value, batch.column("__hash").to_numpy())
        hashes = [shingle_hashes(t, memo, words) if yes else () for t, yes in zip(utf8(batch.column("text")), asked, strict=True)]
        out = {"maybe": asked, "fp": [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes]}
        return out | {"items": [h.view(np.int64) if len(h) else None for h in hashes]} if with_set else out

    return make


def _picked(key: np.ndarray, picks: int) -> np.ndarray:
    """For each of ``picks`` orders of all keys, the first of these; each once."""
    with np.errstate(over="ignore"):
        return key[np.unique([np.argmin(_mix(key ^ (_ODD[0][k % 3] * np.uint64(k + 1)))) for k in range(picks)])] if len(key) > picks else key


def _chunk_rows(batches, percent: int, within: Broadcast | None = None, without: Broadcast | None = None, large: Broadcast | None = None, picks: int | None = None, keep: tuple[str, ...] = ("node",)):
    """A row (key, ``keep``) for each key of each sketch that may be in the one bitmap and is not in the other.

    With ``large`` for those that may be in it and are needed, if it comes last in the order of keys;
    of ``picks`` of them, if given.
    """
    for batch in batches:
        keys, counts = [np.empty(0, np.uint64)], []
        for size, sketches in zip(batch.column("n").to_pylist(), batch.column("sketches").to_pylist(), strict=True):
            count = 0
            for s in sketches:
                key = chunk_keys(s["bits"], s["band"], percent)
                if large is not None:
                    last = np.sort(key[maybe_in(large.value, key)])
                    key = last[: max(0, keys_needed(s["bits"], s["band"], size, percent) - (len(key) - len(last)))]
                if within is not None:
                    key = key[maybe_in(within.value, key)]
                if without is not None:
                    key = key[~maybe_in(without.value, key)]
                key = key if picks is None else _picked(key, picks)
                keys.append(key)
                count += len(key)
            counts.append(count)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(c).take(rows) for c in keep)], names=["key", *keep])


def _near(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a block pair, and the matrix of those whose sketches allow a link."""
    node = table.column("node").to_numpy()
    n = table.column("n").to_numpy()
    side = table.column("block").to_numpy() == table.column("i")[0].as_py()
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint32).reshape(len(node), -1) & PARITY
    one_block = bool(side.all())
    near = np.zeros((len(node), len(node)), bool)
    step = max(1, (4 << 20) // max(1, bits.size))
    for lo in range(0, len(node), step):
        x = slice(lo, lo + step)
        apart = np.bitwise_count(bits[x, None, :] ^ bits[None, :, :]).sum(-1, dtype=np.int64)
        near[x] = apart * (100 + percent) <= (n[x, None] + n[None, :]) * (100 - percent)
    near &= (n[:, None] * 100 >= n[None, :] * percent) & (n[None, :] * 100 >= n[:, None] * percent)
    if not one_block:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    return node, near


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of what may be linked in a block pair, from the nodes with most neighbours outwards."""
    node, near = _near(table, percent)
    apart = np.ones(len(node), bool)
    a, b = [], []
    for start in np.argsort(-near.sum(1), kind="stable"):
        if not apart[start]:
            continue
        apart[start] = False
        queue = [start]
        for hub in queue:
            new = np.flatnonzero(near[hub] & apart)
            apart[new] = False
            a.append(np.full(len(new), node[hub]))
            b.append(node[new])
            queue.extend(new)
    return _pairs(np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)]))


def _across(table: pa.Table, percent: int) -> pa.Table:
    """What may be linked in a block pair but is in different components so far."""
    node, near = _near(table, percent)
    root = table.column("root").to_numpy()
    near &= root[:, None] != root[None, :]
    x, y = np.nonzero(np.triu(near))
    return _pairs(node[x], node[y])


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough.

    Sets are made from the texts of the classes in question only, one row a class,
    and meet the pairs by fingerprint in two equi-joins over one exchange.
    """
    pairs = cut_lineage(
        pairs.distinct().join(reps.select(F.col("node").alias("a"), F.col("fp").alias("a_fp"), F.col("label").alias("a_id")), "a")
        .join(reps.select(F.col("node").alias("b"), F.col("fp").alias("b_fp"), F.col("label").alias("b_id")), "b"))
    ids = pairs.select(F.xxhash64("a_id").alias("hash")).union(pairs.select(F.xxhash64("b_id"))).distinct()
    (asked,) = bitmaps(ids, "hash", F.lit(True), bits=MAP_BITS)
    made = extend(docs.withColumn("__hash", F.xxhash64("id")), partial(_printer, words, True, asked), "maybe boolean, fp binary, items array<long>", [])
    sets = made.where("__out.items is not null").select("__out.fp", "__out.items").dropDuplicates(["fp"])
    left = sets.select(F.col("fp").alias("a_fp"), F.col("items").alias("x"))
    right = sets.select(F.col("fp").alias("b_fp"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b", "a_fp", "b_fp").join(left, "a_fp").join(right, "b_fp").where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def _block_pairs(hot: DataFrame, first: Column, blocks: Column, others: Column) -> DataFrame:
    """Every member of a large bucket, dealt over ``blocks`` from ``first`` on, once for each pair of its block and one of ``others``."""
    dealt = hot.withColumn("block", (first + F.pmod(F.xxhash64("node", "key"), blocks)).cast("int")).withColumn("other", F.explode(others))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _near_first(hot: DataFrame) -> DataFrame:
    """Members of large buckets in pairs of blocks: each block with itself and with the bucket's first."""
    blocks, block = _blocks(F.col("size")), F.col("block")
    others = F.when(block == 0, F.sequence(F.lit(0), blocks - 1)).when(block > 0, F.array(F.lit(0), block))
    return _block_pairs(hot, F.lit(0), blocks, others)


def _near_others(hot: DataFrame) -> DataFrame:
    """Members of large buckets in pairs of blocks: those outside the bucket's largest component with all, the rest with those only."""
    outside, inside = _blocks(F.col("size") - F.col("most")), _blocks(F.col("most"))
    main = F.col("root") == F.col("main")
    return _block_pairs(hot, F.when(main, outside).otherwise(0), F.when(main, inside).otherwise(outside), F.sequence(F.lit(0), F.when(main, outside).otherwise(outside + inside) - 1))


def classes(docs: DataFrame, id_col: str, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sets of ``docs`` (columns ``id_col`` and ``text``) and the components of their classes.

    Returns ``sets(id, n, fp)``, one row per document, and ``classes(fp, label,
    root, component)``, one row per distinct set: its smallest id, the root of its
    component, and the smallest id of the component. Texts are read whole. A
    null text or one without words has no fingerprint and no class. Null and
    repeated ids are kept apart by their sets; a class that only null ids have
    gets a null label. Exact repeats fall in one class.
    """
    docs = docs.select(F.col(id_col).alias("id"), "text")
    summary = cut_lineage(extend(docs, partial(_summarizer, words, percent), _SETS, ["id"]).select("id", "__out.*"))
    reps = numbered(summary.where("fp is not null").groupBy("fp").agg(F.min("id").alias("label"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "node")
    slim = reps.select("node", "fp", "label")

    def chunks(of: DataFrame = reps, keep: tuple[str, ...] = ("node",), **which) -> DataFrame:
        return of.select(*keep, "n", "sketches").mapInArrow(partial(_chunk_rows, percent=percent, keep=keep, **which), ", ".join(["key long", *(f"{c} long" for c in keep)]))

    def in_buckets(members: DataFrame, buckets: DataFrame) -> DataFrame:
        """Members of ``buckets(key, size, x, y)`` with their sketches; of buckets with equal members one stays."""
        single = buckets.groupBy(*(c for c in buckets.columns if c != "key"), F.shiftright("key", 56).alias("band")).agg(F.min("key").alias("key"))
        return members.join(single.drop("x", "y"), "key").join(bits, ["node", "band"])

    told_apart = F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    bits = reps.select("node", "n", F.explode("sketches").alias("s")).select("node", "n", F.col("s.band").alias("band"), F.col("s.bits").alias("bits"))
    sizes = chunks().groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    repeated, large = bitmaps(sizes, "key", F.lit(True), F.col("size") > SMALL, bits=MAP_BITS)

    # What may be in a large bucket is compared in blocks, all else has few members.
    lists = chunks(within=repeated, without=large).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    listed = F.flatten(F.transform("m", lambda p, k: F.transform(F.slice("m", k + 2, F.greatest(F.size("m") - k - 1, F.lit(0))), lambda q: F.struct(p.alias("a"), q.alias("b")))))
    small = cut_lineage(lists.select(F.explode(listed).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight")).where("weight > 1"))
    repeated.destroy()
    nearest = small.groupBy("b").agg(F.min_by("a", F.struct(-F.col("weight"), F.col("a"))).alias("a")).select("a", "b")

    # Near copies pick the same large buckets mostly, so these few rows connect nearly all of a group.
    picked = cut_lineage(chunks(large=large, picks=PICKED))
    hot = in_buckets(picked, picked.groupBy("key").agg(*told_apart).where("size > 1"))
    forest = _near_first(hot).groupBy("key", "i", "j").applyInArrow(lambda t: _forest(t, percent), "a long, b long")
    first = cut_lineage(nearest.union(forest).distinct())
    links = cut_lineage(_verified(first, reps, docs, words, percent))

    # Only pairs between components that are still apart can add anything: of the large buckets those with members of several.
    root = cut_lineage(roots(links))
    ends = [root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    apart = small.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    placed = cut_lineage(reps.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "sketches"))
    shares = chunks(placed, ("node", "root"), large=large).groupBy("key", "root").agg(*told_apart)
    buckets = shares.groupBy("key").agg(F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max("size").alias("most"), F.max_by("root", F.struct("size", "root")).alias("main"))
    mixed = cut_lineage(buckets.where("size > most"))
    (some,) = bitmaps(mixed, "key", F.lit(True), bits=MAP_BITS)
    again = in_buckets(chunks(placed, ("node", "root"), large=large, within=some), mixed)
    across = _near_others(again).groupBy("key", "i", "j").applyInArrow(lambda t: _across(t, percent), "a long, b long")
    rest = cut_lineage(apart.union(across).distinct().join(first, ["a", "b"], "left_anti"))
    some.destroy()
    large.destroy()
    if not rest.isEmpty():
        links = links.union(_verified(rest, reps, docs, words, percent))
    linked = slim.join(roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = linked.groupBy("root").agg(F.min("label").alias("component"))
    return summary.select("id", "n", "fp"), cut_lineage(linked.join(lowest, "root").select("fp", "label", "root", "component"))


def components(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links (its own, where there are none)."""
    sets, found = classes(docs, id_col, words, percent)
    joined = sets.join(found.select("fp", "component"), "fp", "left")
    own = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, with all columns, one for each component: its smallest id.

    Rows without words all stay. Of rows that repeat an id and a set one stays.
    """
    sets, found = classes(docs, id_col, words, percent)
    first = found.groupBy("root").agg(F.min_by(F.struct("fp", "label"), F.struct(F.col("label").isNull(), "label", "fp")).alias("w"), F.count("*").alias("classes")).select("w.fp", "w.label", "classes")
    rows = sets.where("fp is not null").groupBy("fp", "id").agg(F.count("*").alias("rows"))
    ids = rows.groupBy("fp").agg(F.count("*").alias("ids"))
    own = cut_lineage(rows.join(first, "fp", "left").join(ids, "fp").withColumn("wins", F.col("classes").isNotNull() & F.col("id").eqNullSafe(F.col("label"))))
    doubtful = own.where("classes is null or classes > 1 or ids > 1 or rows > 1")
    (asked,) = bitmaps(doubtful.select(F.xxhash64("id").alias("hash")), "hash", F.lit(True), bits=MAP_BITS)
    printed = extend(docs.withColumn("__hash", F.xxhash64(id_col)), partial(_printer, words, False, asked), "maybe boolean, fp binary")
    sure = printed.where(F.col("__out.fp").isNull())
    winners = own.where("wins").select(F.col("fp").alias("__fp"), F.col("label").alias("__label"), (F.col("rows") > 1).alias("__repeated"))
    chosen = printed.where(F.col("__out.fp").isNotNull()).join(winners, F.col("__out.fp") == F.col("__fp")).where(F.col(id_col).eqNullSafe(F.col("__label")))
    parts = sure, chosen.where("not __repeated"), chosen.where("__repeated").dropDuplicates(["__fp"])
    return reduce(DataFrame.union, (p.select(docs.columns) for p in parts))
