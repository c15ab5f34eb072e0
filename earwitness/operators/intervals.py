"""Time ranges: union length, islands, overlap joins, nearest point in a band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.operators.scan import scan, slice_of


def merged_duration(
    df: DataFrame, keys: Sequence[str], start: str, end: str, slice_width: float, output: str = "merged_duration"
) -> DataFrame:
    """Length of the union of intervals per key; touching intervals merge, empty ones are ignored.

    An interval adds only what lies beyond the furthest end seen so far, so the
    union length is a plain sum and islands need not be formed.
    """
    placed = scan(
        df.where(F.col(end) > F.col(start)), keys, [start, end], slice_of(start, slice_width),
        max_before={"__reach": F.col(end)},
    )
    fresh = F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("__reach"), F.col(start)))
    zero = F.lit(0).cast(df.schema[start].dataType)
    return placed.groupBy(*keys).agg(F.sum(F.greatest(zero, fresh)).alias(output))


def islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], slice_width: float,
    output: str = "island",
) -> DataFrame:
    """Mark rows with the start of their island: maximal runs linked by positive overlap."""
    reached = scan(df, keys, order, slice_of(start, slice_width), max_before={"__reach": F.col(end)})
    opens = F.col("__reach").isNull() | (F.col(start) >= F.col("__reach"))
    return scan(
        reached, keys, order, slice_of(start, slice_width),
        last_known={output: F.when(opens, F.col(start))},
    ).drop("__reach")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float,
) -> DataFrame:
    """Pairs with positive overlap: ``right.end > left.start`` and ``right.start < left.end``.

    Both sides are cut into slices of ``width`` so the join is an equi-join on
    (keys, slice); a pair is kept only in the first slice both sides share, so no
    deduplication is needed. The other columns of the two sides must differ.
    """
    (ls, le), (rs, re) = left_bounds, right_bounds

    def first(c: str) -> Column:
        return F.floor(F.col(c) / width).cast("long")

    a = left.where(F.col(le) > F.col(ls)).withColumn("__slice", F.explode(F.sequence(first(ls), first(le))))
    b = right.where(F.col(re) > F.col(rs)).withColumn("__slice", F.explode(F.sequence(first(rs), first(re))))
    return (
        a.join(b, [*keys, "__slice"])
        .where((F.col(re) > F.col(ls)) & (F.col(rs) < F.col(le)))
        .where(F.col("__slice") == F.greatest(first(ls), first(rs)))
        .drop("__slice")
    )


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2.0


def nearest_cut(
    targets: DataFrame, silences: DataFrame, keys: Sequence[str], width: float,
) -> DataFrame:
    """Closest point inside a silence for each wanted cut; ties go to the earlier cut.

    ``targets``: keys, target_id, target_sec, min_sec, max_sec, search_window_sec.
    ``silences``: keys, start_sec, end_sec. Targets without a usable silence keep NULLs.
    """
    low = F.greatest(F.col("min_sec"), F.col("target_sec") - F.col("search_window_sec"))
    high = F.least(F.col("max_sec"), F.col("target_sec") + F.col("search_window_sec"))
    banded = targets.select(*keys, "target_id", "target_sec", low.alias("__lo"), high.alias("__hi"))

    def first(c: str) -> Column:
        return F.floor(F.col(c) / width).cast("long")

    a = banded.where(F.col("__hi") >= F.col("__lo")).withColumn(
        "__slice", F.explode(F.sequence(first("__lo"), first("__hi"))))
    b = silences.select(*keys, F.col("start_sec").alias("__s"), F.col("end_sec").alias("__e")).where(
        F.col("__e") >= F.col("__s")).withColumn("__slice", F.explode(F.sequence(first("__s"), first("__e"))))
    usable_from = F.greatest(F.col("__s"), F.col("__lo"))
    usable_to = F.least(F.col("__e"), F.col("__hi"))
    cut = F.least(F.greatest(F.col("target_sec"), usable_from), usable_to)
    best = (
        a.join(b, [*keys, "__slice"]).where(usable_to >= usable_from)
        .groupBy(*keys, "target_id")
        .agg(F.min(F.struct(
            F.abs(cut - F.col("target_sec")).alias("distance"), cut.alias("cut"),
            F.col("__s").alias("s"), F.col("__e").alias("e"))).alias("__best"))
    )
    return targets.join(best, [*keys, "target_id"], "left").select(
        targets["*"], F.col("__best.cut").alias("cut_sec"),
        F.col("__best.s").alias("silence_start_sec"), F.col("__best.e").alias("silence_end_sec"),
    )
