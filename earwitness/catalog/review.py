"""Review queries: windows from words, decisions from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.operators import review as rv
from earwitness.operators.latest import latest
from earwitness.sources import tables as t


def draft(spark, sf):
    n = F.col("word_count")
    status = F.when(n >= 55, "GREEN").when(n >= 30, "AMBER").otherwise("RED")
    text = F.col("text")
    return t.windows(spark, sf).select(
        "job_id", "window_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), status.alias("derived_status"),
        F.create_map(F.lit("alpha"), F.struct(text.alias("text")), F.lit("bravo"), F.struct(F.lower(text).alias("text"))).alias("provider_candidates"),
        F.when(status == "GREEN", text).alias("final_text"), F.when(status == "GREEN", F.lit("alpha")).alias("selected_provider"),
        (status == "GREEN").alias("auto_accepted"), (status != "GREEN").alias("review_required"), (n >= 60).alias("speaker_selected"))


def content_decisions(spark, sf):
    e = t.events(spark, sf).where(F.col("event_type").isin("click", "purchase", "view"))
    return e.select(
        F.col("user_id").alias("job_id"), F.format_string("window-%05d", F.floor(F.col("k") / 10).cast("long") + 1).alias("window_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "provider_candidate").when(F.col("event_type") == "purchase", "manual_correction")
        .otherwise("unclear").alias("decision_type"),
        F.when(F.col("k") < 90, "bravo").otherwise("charlie").alias("selected_provider"),
        F.when(F.col("cents") > 1000, F.concat(F.lit("fixed "), F.col("cents").cast("string"))).otherwise(" ").alias("final_text"))


def speaker_decisions(spark, sf):
    e = t.events(spark, sf).where(F.col("event_type").isin("signup", "error"))
    return e.select(
        F.col("user_id").alias("job_id"), F.format_string("window-%05d", F.floor(F.col("k") / 10).cast("long") + 1).alias("window_id"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "confirmed").otherwise("overlap").alias("speaker_status"))


def legal(spark, sf):
    w = draft(spark, sf)
    content = rv.check_decisions(content_decisions(spark, sf), w).where(F.size("errors") == 0)
    speaker = rv.check_speaker_decisions(speaker_decisions(spark, sf), w).where(F.size("errors") == 0)
    return w, content, speaker


DRAFT_SQL = t.WINDOWS_SQL + "," + t.EVENTS_SQL + """,
draft AS (SELECT *, CASE WHEN word_count >= 55 THEN 'GREEN' WHEN word_count >= 30 THEN 'AMBER' ELSE 'RED' END AS status,
  word_count >= 60 AS speaker_selected FROM windows),
content AS (SELECT user_id AS job_id, format('window-{:05d}', k // 10 + 1) AS window_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'provider_candidate' WHEN 'purchase' THEN 'manual_correction' ELSE 'unclear' END AS decision_type,
  k, cents FROM ev WHERE event_type IN ('click', 'purchase', 'view')),
checked AS (SELECT c.*, lower(d.text) AS offered, list_filter([
    CASE WHEN d.status IS NULL THEN 'unknown review window' END,
    CASE WHEN d.status = 'GREEN' THEN 'window does not require a decision' END,
    CASE WHEN decision_type = 'provider_candidate' AND d.status IS NOT NULL AND k >= 90 THEN 'selected provider candidate is unavailable' END,
    CASE WHEN decision_type = 'manual_correction' AND cents <= 1000 THEN 'manual_correction needs text' END], lambda x: x IS NOT NULL) AS errors
  FROM content c LEFT JOIN draft d USING (job_id, window_id)),
lc AS (SELECT job_id, window_id, max(seq) AS seq, arg_max(decision_type, seq) AS decision_type,
    arg_max(CASE decision_type WHEN 'provider_candidate' THEN offered WHEN 'manual_correction' THEN 'fixed ' || cents END, seq) AS final_text,
    arg_max(CASE decision_type WHEN 'provider_candidate' THEN offered WHEN 'manual_correction' THEN 'fixed ' || cents ELSE '' END, seq) AS t2
  FROM checked WHERE len(errors) = 0 GROUP BY ALL),
ls AS (SELECT user_id AS job_id, format('window-{:05d}', k // 10 + 1) AS window_id,
    arg_max(CASE event_type WHEN 'signup' THEN 'confirmed' ELSE 'overlap' END, event_id) AS speaker_status
  FROM ev JOIN draft d ON d.job_id = ev.user_id AND d.window_id = format('window-{:05d}', k // 10 + 1)
  WHERE event_type IN ('signup', 'error') AND (d.status <> 'GREEN' OR d.speaker_selected) GROUP BY ALL),
rows_ AS (SELECT d.job_id, d.window_id, d.start_ms, d.end_ms, d.status, d.speaker_selected, d.status <> 'GREEN' AS content_selected,
    lc.decision_type, ls.speaker_status,
    CASE WHEN d.status = 'GREEN' THEN d.text WHEN lc.decision_type IN ('provider_candidate', 'manual_correction') THEN lc.t2 END AS final_text,
    d.status = 'GREEN' OR coalesce(lc.decision_type IN ('provider_candidate', 'manual_correction'), false) AS resolved
  FROM draft d LEFT JOIN lc USING (job_id, window_id) LEFT JOIN ls USING (job_id, window_id))
"""


@query("decision_errors", sql=f"WITH {DRAFT_SQL} SELECT job_id, window_id, seq, array_to_string(errors, '|') AS errors FROM checked")
def decision_errors(spark, sf):
    return rv.check_decisions(content_decisions(spark, sf), draft(spark, sf)).select(
        "job_id", "window_id", "seq", F.array_join("errors", "|").alias("errors"))


@query("latest_decision", sql=f"WITH {DRAFT_SQL} SELECT job_id, window_id, seq, decision_type, nullif(t2, '') AS final_text FROM lc")
def latest_decision(spark, sf):
    _, content, _ = legal(spark, sf)
    return latest(content, rv.KEYS, ["seq"]).select("job_id", "window_id", "seq", "decision_type", "final_text")


@query("reviewed_windows", sql=f"""
WITH {DRAFT_SQL} SELECT job_id, window_id, status AS derived_status, final_text, decision_type, speaker_status, resolved FROM rows_
""")
def reviewed_windows(spark, sf):
    return rv.reviewed(*legal(spark, sf)).select(
        "job_id", "window_id", "derived_status", "final_text", "decision_type", "speaker_status", "resolved")


@query("review_inbox_unresolved", sql=f"""
WITH {DRAFT_SQL} SELECT job_id, window_id FROM rows_
WHERE (content_selected AND NOT resolved) OR ((content_selected OR speaker_selected OR speaker_status IS NOT NULL) AND coalesce(speaker_status, '') <> 'confirmed')
""")
def review_inbox_unresolved(spark, sf):
    return rv.inbox(rv.reviewed(*legal(spark, sf)), "unresolved", targeted=True).select("job_id", "window_id")


@query("review_summary", sql=f"""
WITH {DRAFT_SQL}, s AS (SELECT *, content_selected OR speaker_selected AS sel FROM rows_),
a AS (SELECT job_id, count(*) FILTER (sel) AS selected_window_count, count(*) FILTER (content_selected) AS content_review_window_count,
  count(*) FILTER (sel AND decision_type = 'provider_candidate') AS pc, count(*) FILTER (sel AND decision_type = 'manual_correction') AS mc,
  count(*) FILTER (sel AND decision_type = 'unclear') AS un, count(*) FILTER (sel AND speaker_status = 'confirmed') AS confirmed,
  count(*) FILTER (sel AND speaker_status = 'overlap') AS overlap_, count(*) FILTER (sel AND speaker_status IS NULL) AS pending,
  count(*) FILTER (sel AND coalesce(speaker_status, '') <> 'confirmed') AS attention_s,
  count(*) FILTER (sel AND ((content_selected AND NOT resolved) OR coalesce(speaker_status, '') <> 'confirmed')) AS attention,
  count(*) FILTER (sel) * 24.0 AS sel_sec, count(*) * 24.0 AS src_sec FROM s GROUP BY ALL)
SELECT job_id, selected_window_count, content_review_window_count, pc AS content_provider_candidate, mc AS content_manual_correction,
  un AS content_unclear, confirmed AS speaker_confirmed, overlap_ AS speaker_overlap, pending AS speaker_pending,
  attention_s AS speaker_attention_required, attention AS windows_requiring_attention, content_review_window_count - pc - mc AS unresolved_selected_windows,
  CAST(sel_sec AS DOUBLE) AS selected_audio_seconds, CAST(src_sec AS DOUBLE) AS source_audio_seconds,
  round_even(CAST(sel_sec AS DOUBLE) / CAST(src_sec AS DOUBLE) * 100.0, 2) AS selected_audio_share_percent,
  CASE WHEN pc + mc + un = 0 AND confirmed + overlap_ = 0 THEN 'Automated transcript'
    WHEN content_review_window_count - pc - mc > 0 OR attention_s > 0 THEN 'Selected-window human reviewed with unresolved items'
    ELSE 'Selected-window human confirmed' END AS completion_label
FROM a
""")
def review_summary(spark, sf):
    out = rv.verification_summary(rv.reviewed(*legal(spark, sf)), 600_000, targeted=True, unit=0.001)
    return out.select(
        "job_id", "selected_window_count", "content_review_window_count", "content_provider_candidate", "content_manual_correction",
        "content_unclear", "speaker_confirmed", "speaker_overlap", "speaker_pending", "speaker_attention_required",
        "windows_requiring_attention", "unresolved_selected_windows", "selected_audio_seconds", "source_audio_seconds",
        "selected_audio_share_percent", "completion_label")
