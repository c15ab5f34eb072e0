"""What the operators of this package share: table access, row numbers and bounded word memos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from earwitness.session import cut_lineage

#: Entries a worker's word memo may hold before it starts anew. A memo only saves time; no result depends on it.
MEMO_ENTRIES = 300_000
#: Rows of an Arrow batch handled at once, which bounds what a task holds in Python besides the batch.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int")


def hash_share(share: Column, *cols: str) -> Column:
    """True for about ``share`` (0 to 1) of all rows, picked by the hash of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < share * float(1 << 30)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, written to the shared checkpoint folder.

    Ids may be null or repeated, so rows are told apart by number; the written
    table keeps the numbers when an executor is lost and a task runs again.
    """
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


class Memo(dict):
    """``memo[key]`` computes a missing value once; emptied when it has grown too large."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: Base of polynomial hashes, odd.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for.

    With them the polynomial hash of any part of an array comes from running sums.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(HASH_BASE), -1, 1 << 64))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (HASH_BASE, inverse))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums of (value + 1) times the power of its place, from 0."""
        self.reach(len(values) + 1)
        return np.concatenate([[np.uint64(0)], np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)])])

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _extend(batches: Iterator[pa.RecordBatch], start: Callable[[], Callable[[pa.RecordBatch], dict]], keep: list[str], kind: pa.StructType, name: str) -> Iterator[pa.RecordBatch]:
    make = start()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(at, SLICE_ROWS)
            made = make(batch)
            new = pa.StructArray.from_arrays([pa.array(made[f.name], f.type) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), new], names=[*keep, name])


def extend(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str, keep: list[str] | None = None, name: str = "__out") -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and a struct column made batch by batch, in place and without a shuffle.

    ``start`` runs once a task and returns the function that gives the struct's
    columns for an Arrow batch. Everything new sits in the one struct column, so
    columns of ``df`` may have any name but that one.
    """
    keep = df.columns if keep is None else keep
    kind = T.StructType.fromDDL(ddl)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])
    return df.mapInArrow(partial(_extend, start=start, keep=keep, kind=to_arrow_type(kind), name=name), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, where checkpoints go."""
    cut_lineage(spark.range(0))  # names the folder where the session has none yet
    return spark.sparkContext.getCheckpointDir()


#: Bits of a bitmap: 8 MB for every task, whatever the data.
BITMAP_BITS = 1 << 26


def bitmaps(values: DataFrame, column: str, *conditions: Column, bits: int = BITMAP_BITS) -> list[Broadcast]:
    """For each condition a bit for each hash in the long ``column``, sent to all tasks: what may be among the values.

    The size is fixed. Rows whose bit is not set are surely not among the values and
    need no join; a crowded bitmap only saves less.
    """
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    marked = values.select(F.shiftrightunsigned(place, 6).alias("word"), *(F.when(c, bit).otherwise(F.lit(0).cast("long")).alias(f"bit{k}") for k, c in enumerate(conditions)))
    found = marked.groupBy("word").agg(*(F.bit_or(f"bit{k}").alias(f"bit{k}") for k in range(len(conditions)))).toArrow()
    out = []
    for k in range(len(conditions)):
        words = np.zeros(bits >> 6, np.uint64)
        words[found.column("word").to_numpy()] = found.column(f"bit{k}").to_numpy().view(np.uint64)
        out.append(values.sparkSession.sparkContext.broadcast(words))
    del found
    pa.default_memory_pool().release_unused()  # the driver keeps the bitmaps only
    return out


def maybe_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among a bitmap's values."""
    place = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
