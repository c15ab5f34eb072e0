"""Human review of draft windows: legality of decisions, current state, verification summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.functions.text import is_blank
from earwitness.operators.intervals import merged_duration
from earwitness.operators.latest import latest
from earwitness.operators.skew import lookup

# Decision vocabularies.
DECISION_TYPES = ("provider_candidate", "manual_correction", "unclear")
SPEAKER_STATUSES = ("confirmed", "uncertain", "overlap", "not_applicable")
KEYS = ["job_id", "window_id"]


def current_source_only(saved: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split saved rows into those made against the job's present draft and stale ones."""
    now = drafts.select("job_id", F.col("source_sha256").alias("__now"))
    marked = saved.join(now, "job_id", "left")
    fresh = F.coalesce(F.col("source_sha256") == F.col("__now"), F.lit(False))
    return marked.where(fresh).drop("__now"), marked.where(~fresh).drop("__now")


def check_decisions(decisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``errors`` and the text a decision accepts.

    ``decisions``: job_id, window_id, seq, decision_type, selected_provider, final_text.
    """
    w = windows.select(*KEYS, "review_required", "provider_candidates")
    kind = F.col("decision_type")
    offered = F.try_element_at("provider_candidates", F.col("selected_provider"))["text"]
    joined = lookup(decisions, w, KEYS)
    errors = F.array_compact(F.array(
        F.when(F.col("review_required").isNull(), F.lit("unknown review window")),
        F.when(F.col("review_required") == F.lit(False), F.lit("window does not require a decision")),
        F.when(~F.coalesce(kind.isin(*DECISION_TYPES), F.lit(False)), F.lit("unsupported decision_type")),
        F.when((kind == "provider_candidate") & F.col("review_required").isNotNull() & offered.isNull(),
               F.lit("selected provider candidate is unavailable")),
        F.when((kind == "manual_correction") & is_blank(F.col("final_text")), F.lit("manual_correction needs text")),
    ))
    accepted = F.when(kind == "provider_candidate", offered).when(kind == "manual_correction", F.col("final_text"))
    return joined.select(
        *[c for c in decisions.columns if c not in ("final_text", "selected_provider")],
        F.when(kind == "provider_candidate", F.col("selected_provider")).alias("selected_provider"),
        accepted.alias("final_text"),
        F.when(kind == "unclear", F.lit("audio_still_unclear")).alias("reason_code"),
        errors.alias("errors"),
    )


def check_speaker_decisions(decisions: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` carries review_required and speaker_selected."""
    w = windows.select(*KEYS, "review_required", "speaker_selected")
    joined = lookup(decisions, w, KEYS)
    return joined.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("review_required").isNull(), F.lit("unknown review window")),
        F.when(~(F.col("review_required") | F.col("speaker_selected")), F.lit("window is not selected for speaker verification")),
        F.when(~F.coalesce(F.col("speaker_status").isin(*SPEAKER_STATUSES), F.lit(False)), F.lit("unsupported speaker_status")),
    ))).drop("review_required", "speaker_selected")


def reviewed(windows: DataFrame, decisions: DataFrame, speaker_decisions: DataFrame) -> DataFrame:
    """Windows with their current resolution; all joins are on (job, window), so a large job spreads out.

    ``windows``: job_id, window_id, derived_status, final_text, selected_provider,
    auto_accepted, review_required, speaker_selected and bounds.
    ``decisions`` / ``speaker_decisions``: legal rows with ``seq``.
    """
    content = latest(decisions, KEYS, ["seq"]).select(
        *KEYS, F.col("decision_type").alias("__kind"), F.col("final_text").alias("__text"),
        F.col("selected_provider").alias("__provider"))
    speaker = latest(speaker_decisions, KEYS, ["seq"]).select(*KEYS, F.col("speaker_status").alias("__speaker"))
    auto, kind = F.col("auto_accepted"), F.col("__kind")
    settled = kind.isin("provider_candidate", "manual_correction")
    w = windows.join(content, KEYS, "left").join(speaker, KEYS, "left")
    return w.select(
        *[c for c in windows.columns if c not in ("final_text", "review_required", "selected_provider")],
        F.when(auto, F.col("final_text")).when(F.coalesce(settled, F.lit(False)), F.col("__text")).alias("final_text"),
        F.when(auto, F.col("selected_provider")).otherwise(F.col("__provider")).alias("selected_provider"),
        F.col("review_required").alias("content_selected"),
        (F.col("review_required") & ~F.coalesce(settled, F.lit(False))).alias("review_required"),
        F.when(auto, F.lit("auto_accepted_provider_candidate")).otherwise(kind).alias("resolution_type"),
        (auto | F.coalesce(settled, F.lit(False))).alias("resolved"),
        kind.alias("decision_type"), F.col("__speaker").alias("speaker_status"),
    )


def reviewed_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_windows"), F.count_if("resolved").alias("resolved_windows"),
        F.count_if(~F.col("resolved")).alias("unresolved_windows"),
        F.count("decision_type").alias("human_review_decisions"))


def selected() -> Column:
    return F.col("content_selected") | F.col("speaker_selected")


def speaker_required(targeted: bool) -> Column:
    """All selected windows when verification was requested, else only those already judged."""
    return selected() if targeted else selected() & F.col("speaker_status").isNotNull()


def needs_attention(targeted: bool) -> Column:
    content = F.col("content_selected") & ~F.coalesce(
        F.col("decision_type").isin("provider_candidate", "manual_correction"), F.lit(False))
    speaker = speaker_required(targeted) & ~F.coalesce(
        F.col("speaker_status").isin("confirmed", "not_applicable"), F.lit(False))
    return selected() & (content | speaker)


def verification_summary(
    rows: DataFrame, slice_width: float, *, targeted: bool, source_seconds: DataFrame | None = None, unit: float = 1.0,
) -> DataFrame:
    """Per-recording review summary. ``rows`` come from ``reviewed`` with ``start``/``end`` in ``unit`` seconds.

    ``source_seconds``: job_id, source_audio_seconds; where absent or zero the
    union of all windows stands in.
    """
    sel, need_speaker = selected(), speaker_required(targeted)
    kind, status = F.col("decision_type"), F.col("speaker_status")
    counts = rows.groupBy("job_id").agg(
        F.count_if(sel).alias("selected_window_count"),
        *[F.count_if(sel & (F.col("derived_status") == s)).alias(f"selected_{s.lower()}") for s in ("RED", "AMBER")],
        F.count_if("content_selected").alias("content_review_window_count"),
        F.count_if("speaker_selected").alias("speaker_sensitive_window_count"),
        *[F.count_if(sel & (kind == d)).alias(f"content_{d}") for d in DECISION_TYPES],
        *[F.count_if(sel & (status == s)).alias(f"speaker_{s}") for s in SPEAKER_STATUSES],
        F.count_if(need_speaker & status.isNull()).alias("speaker_pending"),
        F.count_if(need_speaker & (status.isNull() | status.isin("uncertain", "overlap"))).alias("speaker_attention_required"),
        F.count_if(needs_attention(targeted)).alias("windows_requiring_attention"),
    )
    chosen = merged_duration(rows.where(sel), ["job_id"], "start", "end", slice_width, "__sel")
    whole = merged_duration(rows, ["job_id"], "start", "end", slice_width, "__all")
    joined = counts.join(chosen, "job_id", "left").join(whole, "job_id", "left")
    given = F.lit(None).cast("double")
    if source_seconds is not None:
        joined = joined.join(source_seconds.select("job_id", F.col("source_audio_seconds").alias("__src")), "job_id", "left")
        given = F.when(F.col("__src") > 0, F.col("__src"))
    sel_sec = F.coalesce(F.col("__sel"), F.lit(0)) * F.lit(unit)
    src_sec = F.coalesce(given, F.coalesce(F.col("__all"), F.lit(0)) * F.lit(unit))
    resolved = F.col("content_provider_candidate") + F.col("content_manual_correction")
    reviewed_content = resolved + F.col("content_unclear")
    reviewed_speaker = sum((F.col(f"speaker_{s}") for s in SPEAKER_STATUSES[1:]), F.col(f"speaker_{SPEAKER_STATUSES[0]}"))
    unresolved = F.col("content_review_window_count") - resolved
    label = (
        F.when((reviewed_content == 0) & (reviewed_speaker == 0), "Automated transcript")
        .when((unresolved > 0) | (F.col("speaker_attention_required") > 0),
              "Selected-window human reviewed with unresolved items")
        .otherwise("Selected-window human confirmed"))
    return joined.select(
        *counts.columns,
        reviewed_content.alias("content_reviewed"), resolved.alias("content_resolved"),
        reviewed_speaker.alias("speaker_reviewed"), unresolved.alias("unresolved_selected_windows"),
        round_exact(sel_sec, 3).alias("selected_audio_seconds"), round_exact(src_sec, 3).alias("source_audio_seconds"),
        F.when(src_sec > 0, round_exact(F.try_divide(sel_sec, src_sec) * 100.0, 2)).alias("selected_audio_share_percent"),
        label.alias("completion_label"),
        F.when(F.col("windows_requiring_attention") > 0, "REVIEW_REQUIRED").otherwise("COMPLETE").alias("overall_status"),
    )


def inbox(rows: DataFrame, view: str, *, targeted: bool) -> DataFrame:
    """Windows of one inbox view: all, unresolved, resolved, RED, AMBER or GREEN."""
    need = (selected() & F.lit(targeted)) | F.col("speaker_status").isNotNull()
    settled = ~need | F.coalesce(F.col("speaker_status").isin("confirmed", "not_applicable"), F.lit(False))
    open_ = (F.col("content_selected") & F.col("review_required")) | ~settled
    if view == "all":
        return rows
    if view == "unresolved":
        return rows.where(open_)
    if view == "resolved":
        return rows.where(~open_)
    return rows.where(F.col("derived_status") == view)
