"""Inputs for assisted reconciliation and what its proposals become."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.functions.hashing import canonical_json, sha256_text
from earwitness.functions.text import is_blank


def matched_inputs(chunks: DataFrame, transcripts: DataFrame, providers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks with every provider's unchanged text, and chunks that cannot be matched.

    ``chunks``: job_id, filename, chunk_sha256, chunk_index, start_sec, end_sec.
    ``transcripts``: job_id, filename, provider_code, chunk_sha256, text. The
    providers are pivoted by conditional aggregation, one shuffle for all of them.
    """
    def pick(p: str, column: str):
        return F.max(F.when(F.col("provider_code") == p, F.col(column)))

    wide = transcripts.groupBy("job_id", "filename").agg(
        *[pick(p, "text").alias(f"text_{p}") for p in providers],
        *[pick(p, "chunk_sha256").alias(f"sha_{p}") for p in providers])
    joined = chunks.join(wide, ["job_id", "filename"], "left")
    checks = [F.when(F.coalesce("chunk_sha256", F.lit("")) == "", F.lit("chunk identity is incomplete")),
              F.when(~(F.col("end_sec") > F.col("start_sec")), F.lit("chunk has invalid bounds"))]
    for p in providers:
        sha, text = F.col(f"sha_{p}"), F.col(f"text_{p}")
        checks.append(F.when(sha.isNull(), F.lit(f"{p} has no retained result"))
                      .when(sha != F.col("chunk_sha256"), F.lit(f"{p} result does not match"))
                      .when(is_blank(text), F.lit(f"{p} retained empty text")))
    identity = {"chunk_filename": F.col("filename"), "chunk_sha256": F.col("chunk_sha256"), **{p: F.col(f"text_{p}") for p in providers}}
    rows = joined.withColumns({
        "errors": F.array_compact(F.array(*checks)),
        "window_id": F.format_string("reconcile-chunk-%05d", "chunk_index"),
        "input_sha256": sha256_text(canonical_json(identity))}).drop(*[f"sha_{p}" for p in providers])
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def proposal_errors(proposals: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Check proposals: text, string lists, evidence within the provider set; derive ``review_required``."""
    evidence = F.col("evidence_provider_codes")
    known = F.array(*[F.lit(p) for p in providers])
    reasons = F.col("uncertainty_reasons")
    return proposals.select(
        "*",
        F.array_compact(F.array(
            F.when(is_blank(F.col("proposed_text")), F.lit("proposed_text is empty")),
            F.when(reasons.isNull() | F.exists(reasons, lambda r: r.isNull()), F.lit("uncertainty_reasons is invalid")),
            F.when(evidence.isNull() | (F.size(evidence) == 0) | F.exists(evidence, lambda e: ~F.coalesce(F.array_contains(known, e), F.lit(False))),
                   F.lit("evidence_provider_codes is invalid")))).alias("errors"),
        (F.coalesce("review_flag", F.lit(False)) | (F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0)).alias("review_required"),
        F.array_distinct(evidence).alias("evidence"))


def apply_proposals(inputs: DataFrame, proposals: DataFrame) -> DataFrame:
    """Draft windows from legal proposals made for exactly these inputs: flagged ones are AMBER without text."""
    legal = proposals.where(F.size("errors") == 0).select("job_id", "window_id", "input_sha256", "proposed_text", "review_required", "evidence")
    review = F.col("review_required")
    return inputs.join(legal, ["job_id", "window_id", "input_sha256"]).select(
        *inputs.columns, F.when(review, "AMBER").otherwise("GREEN").alias("derived_status"),
        F.when(~review, F.col("proposed_text")).alias("final_text"), (~review).alias("auto_accepted"), review, "evidence")
