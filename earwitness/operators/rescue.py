"""Which regions are worth transcribing again, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.operators.chunking import plan_chunks
from earwitness.params import RescuePolicy


def first_red(classified: DataFrame) -> DataFrame:
    """First RED region of each recording; recordings without one are absent."""
    red = classified.where(F.col("agreement_status") == "RED")
    best = red.groupBy("job_id").agg(F.min_by(
        F.struct("region_id", "start_sec", "end_sec"), "region_no").alias("r"))
    return best.select(
        "job_id", "r.*",
        F.when(~F.coalesce(F.col("r.end_sec") > F.col("r.start_sec"), F.lit(False)), F.lit("invalid bounds")).alias("error"))


def rescue_windows(selected: DataFrame, silences: DataFrame, policy: RescuePolicy = RescuePolicy(), framerate: int = 1000) -> DataFrame:
    """Cut each selected region into contiguous windows near silences, in recording time.

    ``selected``: job_id, region_id, start_sec, end_sec (from ``first_red``).
    ``silences``: job_id, start_sec, end_sec in recording time. Windows do not overlap.
    """
    length = F.col("end_sec") - F.col("start_sec")
    regions = selected.where(F.col("error").isNull()).select(
        F.col("job_id").alias("recording_id"), F.bround(length * framerate).cast("long").alias("total_frames"),
        F.lit(framerate).cast("long").alias("framerate"), F.lit(policy.target_sec).alias("target_sec"),
        F.lit(policy.min_sec).alias("min_sec"), F.lit(policy.max_sec).alias("max_sec"),
        F.lit(0.0).alias("overlap_sec"), F.lit(policy.search_window_sec).alias("search_window_sec"))
    bounds = selected.select("job_id", "region_id", F.col("start_sec").alias("__rs"), F.col("end_sec").alias("__re"))
    local = silences.join(bounds, "job_id").where(
        (F.col("end_sec") > F.col("__rs")) & (F.col("start_sec") < F.col("__re"))).select(
        F.col("job_id").alias("recording_id"),
        F.greatest(F.lit(0.0), F.col("start_sec") - F.col("__rs")).alias("start_sec"),
        (F.least(F.col("end_sec"), F.col("__re")) - F.col("__rs")).alias("end_sec"))
    planned = plan_chunks(regions, local).withColumnRenamed("recording_id", "job_id")
    return planned.join(bounds, "job_id").select(
        "job_id", "region_id", F.format_string("rescue-window-%05d", "chunk_index").alias("window_id"), "chunk_index",
        (F.col("__rs") + F.col("start_sec")).alias("start_sec"),
        F.least(F.col("__re"), F.col("__rs") + F.col("end_sec")).alias("end_sec"), "strategy")


def route(classified: DataFrame, windows: DataFrame, policy: RescuePolicy = RescuePolicy()) -> DataFrame:
    """What to do with each recording: pass through, rescue, defer, or refuse.

    Refused are too many windows and a first RED region with invalid bounds. The
    windows themselves are whole in ``rescue_windows``, whatever the route.
    """
    invalid = first_red(classified).where("error is not null").select("job_id", F.lit(True).alias("invalid"))
    jobs = classified.groupBy("job_id").agg(F.count_if(F.col("agreement_status") == "RED").alias("red_regions"))
    counts = windows.groupBy("job_id").agg(F.count(F.lit(1)).alias("windows"))
    n = F.coalesce("windows", F.lit(0))
    return jobs.join(counts, "job_id", "left").join(invalid, "job_id", "left").select(
        "job_id", "red_regions", n.alias("rescue_windows"),
        F.when(F.col("red_regions") == 0, "pass_through").when(F.col("invalid") | (n > policy.hard_windows), "error")
        .when(n > policy.auto_windows, "deferred").otherwise("rescue").alias("route"))


def window_statistics(windows: DataFrame) -> DataFrame:
    """Windows and their exact median duration."""
    length = F.col("end_sec") - F.col("start_sec")
    return windows.agg(F.count(F.lit(1)).alias("rescue_windows"), round_exact(F.median(length), 3).alias("median_window_duration_sec"))


def pass_through(classified: DataFrame) -> DataFrame:
    """Regions of recordings without RED, kept as review windows with their own bounds."""
    red = classified.where(F.col("agreement_status") == "RED").select("job_id").distinct()
    return classified.join(red, "job_id", "left_anti").withColumn("boundary_strategy", F.lit("existing_comparison_region"))
