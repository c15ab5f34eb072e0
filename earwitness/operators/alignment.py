"""Timeline candidates from provider documents, and their alignment into regions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from earwitness.operators.fold import sorted_groups
from earwitness.operators.intervals import islands
from earwitness.operators.scan import scan, slice_of
from earwitness.session import cut_lineage, spread

SLICE_SEC = 600.0
BOUND_TOLERANCE = 1e-6


def _chunk_bounds(chunk: Column) -> tuple[Column, Column]:
    start = F.coalesce(chunk["chunk_start_sec"], chunk["start_sec"])
    end = F.coalesce(chunk["chunk_end_sec"], chunk["end_sec"], start + chunk["duration_seconds"])
    return start, end


def _segment_times(seg: Column, chunk: Column | None) -> tuple[Column, Column]:
    """Global times win; otherwise plain times, moved by the chunk start when the scope is relative."""
    start, end = F.coalesce(seg["start_sec"], seg["start"]), F.coalesce(seg["end_sec"], seg["end"])
    if chunk is not None:
        scope = F.lower(F.trim(F.coalesce(
            F.nullif(seg["segment_timing_scope"], F.lit("")), chunk["segment_timing_scope"], F.lit(""))))
        shift = F.when(scope.isin("chunk", "chunk_relative", "relative"), _chunk_bounds(chunk)[0]).otherwise(F.lit(0.0))
        start, end = start + shift, end + shift
    both = seg["global_start_sec"].isNotNull() & seg["global_end_sec"].isNotNull()
    return F.when(both, seg["global_start_sec"]).otherwise(start), F.when(both, seg["global_end_sec"]).otherwise(end)


def _emit(text, start, end, chunk, kind, index, segment_id) -> Column:
    none = F.lit(None).cast("string")
    field = (lambda name: chunk[name]) if chunk is not None else (lambda name: none)
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"), start.alias("start"), end.alias("end"),
        F.lit(kind).alias("source_kind"), index.cast("long").alias("source_index"),
        segment_id.alias("segment_id"),
        (F.coalesce(F.nullif(chunk["chunk_filename"], F.lit("")), chunk["filename"]) if chunk is not None else none).alias("chunk_filename"),
        field("provider_code").alias("provider_code"), field("model").alias("model"), field("run_id").alias("run_id"),
    )


def timeline_candidates(documents: DataFrame) -> DataFrame:
    """Explode provider documents into timed candidates, in emission order.

    A chunk yields its timed root segments, else its timed embedded segments,
    else itself; root segments without a chunk come last. All of it is decided
    inside the document row, so no shuffle is needed. ``errors`` names what makes
    a candidate unusable (no times, bounds outside the recording).
    """
    chunks = F.coalesce(F.col("chunks"), F.array().cast(documents.schema["chunks"].dataType))
    roots = F.transform(
        F.coalesce(F.col("segments"), F.array().cast(documents.schema["segments"].dataType)),
        lambda s, i: F.struct(s.alias("seg"), i.alias("i")),
    )

    def timed(pair: Column, chunk: Column | None) -> Column:
        s, e = _segment_times(pair["seg"], chunk)
        return s.isNotNull() & e.isNotNull()

    def from_segment(pair: Column, chunk: Column | None, kind: str, relative: bool) -> Column:
        s, e = _segment_times(pair["seg"], chunk if relative else None)
        return _emit(pair["seg"]["text"], s, e, chunk, kind, pair["i"], pair["seg"]["segment_id"])

    def from_chunk(chunk: Column, index: Column) -> Column:
        name = F.coalesce(F.nullif(chunk["chunk_filename"], F.lit("")), chunk["filename"], F.lit(""))
        own = F.filter(F.col("__roots"), lambda p: (p["seg"]["chunk_filename"] == name) & (name != "") & timed(p, None))
        inner = F.transform(
            F.coalesce(chunk["segments"], F.array().cast(documents.schema["segments"].dataType)),
            lambda s, i: F.struct(s.alias("seg"), i.alias("i")))
        inner = F.filter(inner, lambda p: timed(p, chunk))
        start, end = _chunk_bounds(chunk)
        whole = F.array(_emit(chunk["text"], start, end, chunk, "chunk_fallback", index, F.lit(None).cast("string")))
        return (
            F.when(F.size(own) > 0, F.transform(own, lambda p: from_segment(p, chunk, "root_segment", False)))
            .when(F.size(inner) > 0, F.transform(inner, lambda p: from_segment(p, chunk, "chunk_segment", True)))
            .otherwise(whole)
        )

    loose = F.filter(
        F.col("__roots"), lambda p: F.coalesce(p["seg"]["chunk_filename"], F.lit("")).eqNullSafe("") & timed(p, None))
    emitted = F.concat(
        F.flatten(F.transform(F.col("__chunks"), from_chunk)),
        F.transform(loose, lambda p: from_segment(p, None, "root_segment", False)),
    )
    rows = documents.select("*", chunks.alias("__chunks"), roots.alias("__roots")).select(
        "job_id", "provider", "provider_ord", "timeline_offset_sec", "recording_duration_sec", "source_sha256",
        F.posexplode(emitted).alias("pos", "c"),
    )
    return rows.select(
        "job_id", "provider", "provider_ord",
        F.concat("provider", F.format_string(":%05d", F.col("pos") + 1)).alias("candidate_id"),
        (F.col("timeline_offset_sec") + F.col("c.start")).alias("start_sec"),
        (F.col("timeline_offset_sec") + F.col("c.end")).alias("end_sec"),
        F.col("c.text").alias("text"), "source_sha256", "recording_duration_sec",
        "c.source_kind", "c.source_index", "c.segment_id", "c.chunk_filename", "c.provider_code", "c.model", "c.run_id",
    ).withColumn("errors", bound_errors(F.col("start_sec"), F.col("end_sec"), F.col("recording_duration_sec")))


def bound_errors(start: Column, end: Column, duration: Column) -> Column:
    return F.array_compact(F.array(
        F.when(start.isNull() | end.isNull(), F.lit("chunk lacks usable timestamps")),
        F.when((start < -BOUND_TOLERANCE) | (end < start - BOUND_TOLERANCE), F.lit("invalid timestamp interval")),
        F.when(end > duration + BOUND_TOLERANCE, F.lit("timestamp exceeds recording duration")),
    ))


def _assign(island: pd.DataFrame) -> pd.DataFrame:
    """Place every candidate once: best positive overlap, then nearest midpoint, then oldest region.

    Rows arrive by provider, then start, end, id. While one provider is placed, a
    region it has joined is closed to it and the others keep their bounds, so each
    provider is one sweep over regions in time order.
    """
    low: list[float] = []
    high: list[float] = []
    anchor: list[str] = []
    placed: list[int] = []
    provider, waiting, live = None, [], []
    for p, s, e, name in zip(island["provider_ord"], island["start_sec"], island["end_sec"], island["candidate_id"]):
        if p != provider:
            provider, live = p, []
            waiting = sorted(range(len(low)), key=low.__getitem__, reverse=True)
        while waiting and low[waiting[-1]] < e:
            live.append(waiting.pop())
        live = [i for i in live if high[i] > s]
        middle, best, at = (s + e) / 2.0, None, len(low)
        for i in live:
            overlap = min(high[i], e) - max(low[i], s)
            rank = (overlap, -abs(middle - (low[i] + high[i]) / 2.0), -i)
            if overlap > 0 and (best is None or rank > best):
                best, at = rank, i
        if best is None:
            low.append(s), high.append(e), anchor.append(name)
        else:
            low[at], high[at], anchor[at] = min(low[at], s), max(high[at], e), min(anchor[at], name)
            live.remove(at)
        placed.append(at)
    return island.assign(
        region_start_sec=[low[i] for i in placed], region_end_sec=[high[i] for i in placed],
        region_anchor=[anchor[i] for i in placed])


def align(candidates: DataFrame, slice_sec: float = SLICE_SEC) -> DataFrame:
    """Assign candidates to regions and number the regions.

    The greedy pass is order-dependent, but only candidates linked by a chain of
    positive overlaps can influence each other. So a recording is first cut at
    every silence all providers share, and each island is folded on its own:
    parallel within a recording, and bounded by unbroken speech. Islands are found
    on the bounds alone; texts are shuffled once for the fold and once for the
    numbering, which reads the fold from a checkpoint instead of repeating it.
    """
    order = ["start_sec", "end_sec", "candidate_id"]
    bounds = candidates.select("job_id", *order)
    marks = islands(bounds, ["job_id"], "start_sec", "end_sec", order, slice_sec)
    cut = candidates.join(marks.select("job_id", "candidate_id", "island"), ["job_id", "candidate_id"])
    schema = StructType([
        *cut.schema.fields,
        StructField("region_start_sec", DoubleType()), StructField("region_end_sec", DoubleType()),
        StructField("region_anchor", StringType()),
    ])
    assigned = cut_lineage(sorted_groups(
        cut, ["job_id", "island"], ["provider_ord", *order], _assign, schema).drop("island"))
    first = F.col("candidate_id") == F.col("region_anchor")
    numbered = scan(
        assigned, ["job_id"],
        ["region_start_sec", "region_end_sec", "region_anchor", (~first).cast("int").alias("after"), "provider_ord"],
        slice_of("region_start_sec", slice_sec), sums={"region_no": first.cast("long")},
    )
    return numbered.withColumn("region_id", F.format_string("region-%05d", "region_no"))


def representation_errors(candidates: DataFrame, aligned: DataFrame) -> DataFrame:
    """Candidates that alignment lost, invented or used twice; empty when it is sound."""
    a = candidates.groupBy("job_id", "candidate_id").agg(F.count(F.lit(1)).alias("expected"))
    b = aligned.groupBy("job_id", "candidate_id").agg(F.count(F.lit(1)).alias("represented"))
    return a.join(b, ["job_id", "candidate_id"], "full").where(
        ~(F.col("expected").eqNullSafe(1) & F.col("represented").eqNullSafe(1)))


def gather_regions(long: DataFrame, keys: Sequence[str], provider_order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per region with a provider map; absent providers get a ``missing`` placeholder.

    A region holds at most one candidate per provider, so the collected list is
    bounded by the registry. ``spread`` keeps the scoring that follows on all cores.
    """
    present = F.map_from_entries(F.collect_list(F.struct(
        "provider", F.struct(F.col("missing"), *[F.col(f) for f in fields]))))
    regions = spread(long, *keys).groupBy(*keys).agg(present.alias("candidates"))
    blanks = F.map_from_arrays(
        F.array(*[F.lit(p) for p in provider_order]),
        F.array_repeat(
            F.struct(F.lit(True).alias("missing"), *[F.lit(None).cast(long.schema[f].dataType).alias(f) for f in fields]),
            len(provider_order)),
    )
    full = F.map_zip_with(blanks, F.col("candidates"), lambda _, blank, found: F.coalesce(found, blank))
    return regions.withColumn("candidates", full)


def region_rows(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Provider map back to one row per candidate, placeholders included."""
    return regions.select(*keys, F.explode("candidates").alias("provider", "c")).select(*keys, "provider", "c.*")


def alignment_statistics(aligned: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Per recording: segments by provider, total, regions, regions seen by one provider only."""
    per_region = aligned.groupBy("job_id", "region_no").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("provider") == p).alias(f"n_{p}") for p in provider_order],
    )
    return per_region.groupBy("job_id").agg(
        *[F.sum(f"n_{p}").alias(f"segments_{p}") for p in provider_order],
        F.sum("n").alias("total_source_segments"),
        F.count(F.lit(1)).alias("aligned_regions"),
        F.count_if(F.col("n") == 1).alias("unaligned_segments"),
    )
