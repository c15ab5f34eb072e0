"""Cutting recordings into request-sized chunks."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from earwitness.operators.fold import Fold, sorted_fold
from earwitness.operators.scan import scan, slice_of
from earwitness.operators.skew import lookup


def effective_policy(recordings: DataFrame) -> DataFrame:
    """Fit the wished durations to the byte limit.

    ``recordings``: target_sec, min_sec, max_sec, bytes_per_second, max_bytes. The
    size cap may push the minimum down; 44 bytes are kept for the header.
    """
    by_size = F.when(F.col("bytes_per_second") > 0, F.greatest(
        F.lit(1.0), F.try_divide(F.greatest(F.lit(0), F.col("max_bytes") - 44).cast("double"), F.col("bytes_per_second"))))
    cap = F.least(F.col("max_sec"), F.coalesce(by_size, F.col("max_sec")))
    roomy = cap >= F.col("min_sec")
    target = F.least(F.col("target_sec"), cap)
    return recordings.withColumns({
        "max_sec": cap,
        "target_sec": F.when(roomy, F.greatest(F.col("min_sec"), target)).otherwise(target),
        "min_sec": F.when(roomy, F.col("min_sec")).otherwise(cap)})


class _Planner(Fold):
    """Cuts one recording left to right, reading silences only as far as the next cut can see."""

    def __init__(self) -> None:
        self.silences: deque[tuple[float, float]] = deque()
        self.r = None

    def feed(self, row):
        if self.r is None:
            self.r, self.start, self.done = row, 0, row.total_frames <= 0
            rate, target = row.framerate, row.target_sec
            self.total = row.total_frames / rate
            self.overlap = min(round(row.overlap_sec * rate), max(0, round(target * rate) - 1))
        if self.done:
            return []
        out = []
        if not math.isnan(row.silence_start_sec):
            # Everything that starts up to here is now known.
            while not self.done and self._reach() < row.silence_start_sec:
                out.append(self._cut())
            self.silences.append((row.silence_start_sec, row.silence_end_sec))
        return out

    def finish(self):
        out = []
        while self.r is not None and not self.done:
            out.append(self._cut())
        return out

    def _band(self):
        r, at = self.r, self.start / self.r.framerate
        target = min(self.total, at + r.target_sec)
        low = at + r.min_sec
        high = min(self.total, at + r.max_sec, self.total + self.overlap / r.framerate - r.min_sec)
        if high < low:
            high = min(self.total, at + r.max_sec)
        return at, target, low, high

    def _reach(self) -> float:
        """Latest silence start the next cut may use."""
        _, target, _, high = self._band()
        return min(high, target + self.r.search_window_sec)

    def _cut(self):
        r, rate = self.r, self.r.framerate
        at, target, low, high = self._band()
        left = self.total - at
        begin, silence = self.start, None
        short_tail = left <= r.max_sec and left <= r.target_sec + r.min_sec - r.overlap_sec
        if left <= r.target_sec or short_tail:
            end, how = r.total_frames, "source_end"
        else:
            near, far = max(low, target - r.search_window_sec), min(high, target + r.search_window_sec)
            found = []
            for s, e in self.silences:
                first, last = max(s, near), min(e, far)
                if first <= last:
                    cut = min(max(target, first), last)
                    found.append((abs(cut - target), cut, s, e))
            if found:
                _, cut, *silence = min(found)
                how = "silence"
            else:
                cut, how = min(max(target, low), high), "time_fallback"
            end = min(r.total_frames, max(begin + 1, round(cut * rate)))
        if end >= r.total_frames:
            self.done = True
        else:
            step = end - self.overlap
            self.start = step if step > begin else begin + max(1, (end - begin) // 10)
            # Silences that end before every later band can begin are no longer needed.
            floor = self.start / rate + min(r.min_sec, r.target_sec - r.search_window_sec)
            while self.silences and self.silences[0][1] < floor:
                self.silences.popleft()
        return (r.recording_id, begin, end, rate, target, how,
                *(silence if silence else (None, None)))


def plan_chunks(recordings: DataFrame, silences: DataFrame) -> DataFrame:
    """Chunk ranges of each recording, cut at silences where one is near the target.

    Each start depends on the previous end, so a recording is a sequential fold,
    but over sorted silences with only the nearby ones in memory.

    ``recordings``: recording_id, total_frames, framerate, target_sec, min_sec,
    max_sec, overlap_sec, search_window_sec. ``silences``: recording_id, start_sec, end_sec.
    """
    quiet = silences.select("recording_id", F.col("start_sec").alias("silence_start_sec"), F.col("end_sec").alias("silence_end_sec"))
    rows = recordings.select(
        "recording_id", F.col("total_frames").cast("long"), F.col("framerate").cast("long"),
        *[F.col(c).cast("double") for c in ("target_sec", "min_sec", "max_sec", "overlap_sec", "search_window_sec")],
    ).join(quiet, "recording_id", "left")
    schema = StructType([
        StructField("recording_id", recordings.schema["recording_id"].dataType),
        StructField("start_frame", LongType()), StructField("end_frame", LongType()), StructField("framerate", LongType()),
        StructField("target_end_sec", DoubleType()), StructField("strategy", StringType()),
        StructField("silence_start_sec", DoubleType()), StructField("silence_end_sec", DoubleType())])
    planned = sorted_fold(rows, ["recording_id"], ["silence_start_sec", "silence_end_sec"], _Planner, schema)
    return with_overlaps(planned)


def with_overlaps(planned: DataFrame) -> DataFrame:
    """Number chunks and add seconds and the overlap with both neighbours."""
    numbered = scan(
        planned, ["recording_id"], ["start_frame"], slice_of("start_frame", 1 << 32), row_number="chunk_index",
        previous={"__prev_end": F.col("end_frame")}, following={"__next_start": F.col("start_frame")})
    rate = F.col("framerate").cast("double")
    return numbered.select(
        "recording_id", "chunk_index", F.format_string("chunk-%05d.wav", "chunk_index").alias("filename"),
        "start_frame", "end_frame", (F.col("start_frame") / rate).alias("start_sec"), (F.col("end_frame") / rate).alias("end_sec"),
        (F.greatest(F.lit(0), F.coalesce("__prev_end", "start_frame") - F.col("start_frame")) / rate).alias("overlap_before_sec"),
        (F.greatest(F.lit(0), F.col("end_frame") - F.coalesce("__next_start", "end_frame")) / rate).alias("overlap_after_sec"),
        "target_end_sec", "strategy", "silence_start_sec", "silence_end_sec")


def _fixed_steps() -> tuple[Column, Column]:
    """Number of evenly stepped chunks of a recording and their step."""
    overlap = F.least(F.greatest(F.lit(0), F.col("overlap_sec")), F.greatest(F.lit(0), F.col("chunk_sec") - 1)).cast("long")
    step = F.greatest(F.lit(1), F.col("chunk_sec") - overlap)
    n = F.when(F.col("duration_sec") <= 0, 0).when(F.col("duration_sec") <= F.col("chunk_sec"), 1).otherwise(
        F.ceil((F.col("duration_sec") - F.col("chunk_sec")) / step) + 1).cast("long")
    return n, step


def fixed_totals(recordings: DataFrame) -> DataFrame:
    """Chunks, billable seconds and longest chunk of ``fixed_chunks`` without making a chunk row.

    All chunks but the last are whole, so sums need neither rows nor an aggregate.
    """
    n, step = _fixed_steps()
    rows = recordings.select("*", n.alias("chunk_count"), step.alias("__step")).where(F.col("chunk_count") > 0)
    whole, last = F.col("chunk_count") - 1, F.ceil(F.col("duration_sec") - (F.col("chunk_count") - 1) * F.col("__step")).cast("long")
    return rows.select(
        *recordings.columns, "chunk_count", (whole * F.col("chunk_sec") + last).alias("billable_seconds"),
        F.when(whole > 0, F.greatest(F.col("chunk_sec").cast("long"), last)).otherwise(last).alias("longest_sec"))


def fixed_chunks(recordings: DataFrame) -> DataFrame:
    """Evenly stepped chunks in closed form.

    ``recordings``: recording_id, duration_sec, chunk_sec, overlap_sec (whole
    seconds). The step is chunk minus overlap and at least a second.
    """
    n, step = _fixed_steps()
    rows = recordings.select("*", n.alias("__n"), step.alias("__step")).where(F.col("__n") > 0).withColumn(
        "__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = F.col("__k") * F.col("__step")
    end = F.least(F.col("duration_sec"), start + F.col("chunk_sec"))
    before = F.when(F.col("__k") > 0, F.greatest(F.lit(0), F.col("chunk_sec") - F.col("__step"))).otherwise(0)
    after = F.when(F.col("__k") < F.col("__n") - 1, F.greatest(F.lit(0), end - (start + F.col("__step")))).otherwise(0)
    return rows.select(
        *[c for c in recordings.columns], (F.col("__k") + 1).alias("chunk_id"),
        start.alias("start_sec"), end.alias("end_sec"), F.ceil(end - start).cast("long").alias("billable_seconds"),
        before.cast("long").alias("overlap_before_sec"), after.cast("long").alias("overlap_after_sec"))


def fixed_pieces(chunks: DataFrame, piece_sec: int = 5) -> DataFrame:
    """Split each chunk (start_sec, end_sec) into equal pieces; the last may be short."""
    n = F.ceil((F.col("end_sec") - F.col("start_sec")) / piece_sec).cast("long")
    rows = chunks.withColumn("__n", n).where(F.col("__n") > 0).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = F.col("start_sec") + F.col("piece") * piece_sec
    return rows.withColumns({
        "piece_start_sec": start, "piece_end_sec": F.least(F.col("end_sec"), start + piece_sec)}).drop("__n")


def contiguity_errors(windows: DataFrame, keys: list[str], ends: DataFrame, gap_sec: float = 0.001, end_sec: float = 0.1) -> DataFrame:
    """Windows that leave a gap or overlap, or whose last one misses the end.

    ``windows``: keys, start_sec, end_sec. ``ends``: keys, region_start_sec, region_end_sec.
    """
    placed = scan(windows, keys, ["start_sec", "end_sec"], slice_of("start_sec", 600),
                  previous={"__prev": F.col("end_sec")}, following={"__next": F.col("start_sec")})
    joined = lookup(placed, ends, keys, "inner")
    return joined.withColumn("errors", F.array_compact(F.array(
        F.when(F.abs(F.coalesce("__prev", "region_start_sec") - F.col("start_sec")) > gap_sec, F.lit("windows must be contiguous")),
        F.when(F.col("__next").isNull() & (F.abs(F.col("end_sec") - F.col("region_end_sec")) > end_sec), F.lit("windows do not reach the end")),
    ))).where(F.size("errors") > 0).drop("__prev", "__next")


def consecutive_parts(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Offsets of consecutive parts and whether they cover the whole within tolerance.

    ``parts``: job_id, part_no, duration_sec; ``totals``: job_id, total_sec. The
    tolerance is a twentieth of a second per part, at least a quarter.
    """
    placed = scan(parts, ["job_id"], ["part_no"], slice_of("part_no", 1024), sums_before={"start_sec": F.col("duration_sec")})
    whole = parts.groupBy("job_id").agg(F.sum("duration_sec").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    delta = F.abs(F.col("__sum") - F.col("total_sec"))
    tolerance = F.greatest(F.lit(0.25), F.col("__n") * 0.05)
    return lookup(placed, whole.join(totals, "job_id"), "job_id", "inner").select(
        "job_id", "part_no", "duration_sec", "start_sec",
        F.least(F.col("total_sec"), F.col("start_sec") + F.col("duration_sec")).alias("end_sec"),
        delta.alias("duration_delta_sec"), (delta <= tolerance).alias("covers"))
