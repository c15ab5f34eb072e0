"""Reuse of finished work, and guards on what may be reused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.operators.skew import lookup

CHUNK_KEYS = ("job_id", "chunk_filename", "chunk_sha256", "model", "provider_code")


def split_work(work: DataFrame, done: DataFrame, keys: Sequence[str] = CHUNK_KEYS) -> tuple[DataFrame, DataFrame]:
    """(reused, remaining): work whose key already completed, and the rest."""
    finished = done.where(F.col("status") == "completed").select(*keys).distinct()
    return work.join(finished, list(keys), "left_semi"), work.join(finished, list(keys), "left_anti")


def reuse_counters(work: DataFrame, done: DataFrame, keys: Sequence[str] = CHUNK_KEYS) -> DataFrame:
    finished = done.where(F.col("status") == "completed").select(*keys).distinct().withColumn("__done", F.lit(True))
    return lookup(work, finished, keys).groupBy("job_id").agg(
        F.count_if("__done").alias("reused"), F.count_if(F.col("__done").isNull()).alias("new"))


def usable_evidence(requests: DataFrame, retained: DataFrame) -> DataFrame:
    """Reuse requests with their faults: wrong source audio, or provider not in the evidence.

    ``requests``: job_id, provider_code, source_sha256, evidence_id.
    ``retained``: evidence_id, evidence_sha256, evidence_providers (array).
    """
    joined = lookup(requests, retained, "evidence_id")
    return joined.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("evidence_sha256").isNull(), F.lit("reused evidence is incomplete")),
        F.when(F.col("evidence_sha256") != F.col("source_sha256"), F.lit("evidence belongs to a different source audio")),
        F.when(~F.array_contains("evidence_providers", F.col("provider_code")), F.lit("evidence does not contain the provider")))))


def usable_rescue(requests: DataFrame, first_red: DataFrame) -> DataFrame:
    """A reused rescue must come from the same audio and match the present first RED bounds exactly.

    ``requests``: job_id, source_sha256, rescue_sha256, rescue_start_sec, rescue_end_sec.
    """
    joined = requests.join(first_red.select("job_id", "start_sec", "end_sec"), "job_id", "left")
    same = F.coalesce((F.col("rescue_start_sec") == F.col("start_sec")) & (F.col("rescue_end_sec") == F.col("end_sec")), F.lit(False))
    return joined.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("rescue_sha256") != F.col("source_sha256"), F.lit("rescue belongs to a different source audio")),
        F.when(~same, F.lit("rescue region does not match the current first RED region")))))
