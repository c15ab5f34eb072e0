"""Job manifests as a table: inbox items, resumability, stages, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.operators.skew import lookup

JOB_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
# Stage order of the quality workflow.
STAGES = ("INGEST", "CHUNK", "TRANSCRIBE", "COMPARE", "RESCUE", "FINAL_DRAFT", "REVIEW")
# Message fragments that mark a provider failure as worth retrying.
RETRYABLE = ("http 429", "http 5", "rate/quota", "timeout", "timed out", "connection", "temporarily unavailable")


def valid_job_id(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(JOB_ID), F.lit(False))


def display_state(state: Column) -> Column:
    s = F.lower(F.coalesce(F.nullif(state, F.lit("")), F.lit("queued")))
    return (F.when(s.isin("completed", "complete"), "ready")
            .when(s.isin("review_required", "failed", "cancelled"), s).otherwise("processing"))


def list_items(manifests: DataFrame) -> DataFrame:
    """Inbox projection of manifests (schema ``earwitness.schemas.JOB``)."""
    def filled(*cols: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])

    return manifests.select(
        "job_id",
        F.coalesce(filled(F.col("source.original_filename"), F.col("source.filename"), F.col("job_id")), F.lit("Untitled recording")).alias("title"),
        F.coalesce(filled(F.col("state")), F.lit("queued")).alias("state"), display_state(F.col("state")).alias("display_state"),
        "created_at", "updated_at",
        F.coalesce("preprocess.blob_duration_seconds", "preprocess.duration_seconds").alias("duration_seconds"),
        F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("estimated_cost_usd"),
        F.coalesce("actual_cost_usd", F.lit(0.0)).alias("actual_cost_usd"),
        F.coalesce("quality.unresolved_windows", F.lit(0).cast("long")).alias("review_required_count"),
        F.array_sort(F.coalesce(F.map_keys("quality.providers"), F.array().cast("array<string>"))).alias("provider_codes"),
        F.coalesce(F.try_element_at("outputs", F.lit("full_transcript_json")) != "", F.lit(False)).alias("has_transcript"),
        F.coalesce(F.col("quality.review_url") != "", F.lit(False)).alias("has_quality_review"))


def recent(items: DataFrame, limit: int = 24, most: int = 50) -> DataFrame:
    """Newest jobs first; ``limit`` is between 1 and the inbox's ceiling ``most``."""
    if not 1 <= int(limit) <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return items.orderBy(F.coalesce("updated_at", "created_at").desc(), "job_id").limit(int(limit))


def manifest_summary(manifests: DataFrame) -> DataFrame:
    """Counts, outputs and all errors of each manifest."""
    none = F.array().cast(manifests.schema["errors"].dataType)
    return manifests.select(
        "job_id", "state", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"),
        F.coalesce(F.size("transcripts"), F.lit(0)).alias("transcript_count"),
        F.filter(F.transform(F.col("transcripts"), lambda t: t["transcript_path"]), lambda p: F.coalesce(p, F.lit("")) != "").alias("transcript_paths"),
        "outputs", F.concat(F.coalesce("errors", none), F.coalesce("output_errors", none)).alias("all_errors"),
        F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("estimated_cost_usd"),
        F.coalesce("actual_cost_usd", F.lit(0.0)).alias("actual_cost_usd"))


def transcript_entries(transcripts: DataFrame) -> DataFrame:
    """Manifest entries of chunk transcripts."""
    fields = ("chunk_sha256", "duration_seconds", "provider", "provider_code", "model", "run_id", "response_format")
    return transcripts.select("job_id", "chunk_filename", "transcript_path", *[f for f in fields if f in transcripts.columns])


def retryable(message: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in RETRYABLE]), lambda m: F.contains(F.lower(message), m))


def resumable(manifests: DataFrame) -> DataFrame:
    """Jobs whose transcription can pick up where it stopped."""
    t = F.col("transcription")
    open_ = t["state"].isin("queued", "running") | ((t["state"] == "failed") & F.coalesce(t["retryable"], F.lit(False)))
    return manifests.where((F.size("chunks") > 0) & F.col("state").isin("failed", "transcription") & open_)


def newest_failed(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each source hash, the newest failed quality job to resume (largest folder name)."""
    failed = manifests.where(F.col("quality.overall_status") == "failed").groupBy("source.sha256").agg(
        F.max_by("job_id", "dir_name").alias("resume_job_id")).withColumnRenamed("sha256", "source_sha256")
    return lookup(sources, failed, "source_sha256", "inner")


def error_rollup(manifests: DataFrame) -> DataFrame:
    """Error counts by step and type over all manifests."""
    return manifests.select(F.inline("errors")).groupBy("step", "type").agg(F.count(F.lit(1)).alias("n"))


def attempt_rollup(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.explode("attempts").alias("step", "attempts")).groupBy("step").agg(
        F.sum("attempts").alias("attempts"), F.max("attempts").alias("most"))


def stage_report(manifests: DataFrame) -> DataFrame:
    """Jobs by stage and status, in workflow order; stages a job never reached are pending."""
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    rows = manifests.select("quality.stages", F.inline(stages))
    status = F.coalesce(F.try_element_at("stages", F.col("stage")), F.lit("pending"))
    return rows.groupBy("stage_no", "stage", status.alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def overall_status(windows_needing_attention: Column) -> Column:
    return F.when(windows_needing_attention > 0, "REVIEW_REQUIRED").otherwise("COMPLETE")


def duration_errors(seconds: Column, cap_seconds: float) -> Column:
    return F.array_compact(F.array(
        F.when(~F.coalesce(seconds > 0, F.lit(False)), F.lit("invalid_duration")),
        F.when(seconds > cap_seconds, F.lit("duration_limit_exceeded"))))


def job_summary(transcripts: DataFrame) -> DataFrame:
    """Words, chunks and segments per recording from chunk rows (job_id, text, segment_count)."""
    from earwitness.functions.text import word_count

    return transcripts.groupBy("job_id").agg(
        F.sum(word_count(F.col("text"))).alias("word_count"), F.count(F.lit(1)).alias("chunk_count"),
        F.sum("segment_count").alias("segment_count"))
