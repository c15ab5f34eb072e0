"""Full transcripts, captions and corrections; every turn is one chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness import schemas
from earwitness.catalog.registry import query
from earwitness.functions.text import words
from earwitness.operators import corrections as co, transcripts as tr
from earwitness.sinks import documents
from earwitness.sources import tables as t


def payloads(spark, sf):
    """Chunk transcripts of all providers, shaped like the retained documents."""
    seg = schemas.ddl(f"x array<{schemas.SEGMENT}>")["x"].dataType
    rows = t.region_candidates(spark, sf).where(~F.col("missing"))
    return rows.select(
        F.col("job_id"), F.format_string("chunk-%05d", F.col("ord") + 1).alias("chunk_filename"),
        F.sha2(F.format_string("%d/%d", "job_id", "ord"), 256).alias("chunk_sha256"), F.sha2(F.col("job_id").cast("string"), 256).alias("source_sha256"),
        F.format_string("/t/%d/%d/%s", "job_id", "ord", "provider").alias("transcript_path"), F.col("provider_ord").alias("ordinal"),
        "provider", F.col("provider").alias("provider_code"), F.concat("provider", F.lit("-1")).alias("model"), F.lit("run-1").alias("run_id"),
        F.lit("chunk").alias("segment_timing_scope"), (F.col("start_ms") / 1000.0).alias("chunk_start_sec"), "text",
        F.lit(None).cast(seg).alias("segments"))


def selected(spark, sf):
    records = tr.chunk_records(payloads(spark, sf))
    decisions = tr.reconcile(records)
    return records, decisions, tr.selected_chunks(records, decisions)


@query("chunk_reconcile")
def chunk_reconcile(spark, sf):
    return tr.reconcile(tr.chunk_records(payloads(spark, sf))).select(
        "job_id", "chunk_key", "grade", "reason", "candidate_count", "independent_provider_count", "selected_ordinal",
        "minimum_pairwise_lexical_similarity", "review_recommendation", "selection_reason")


@query("chunk_selection", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}, c AS (SELECT * FROM region_candidates WHERE NOT missing)
SELECT job_id, format('chunk/chunk-{{:05d}}', ord + 1) AS chunk_key, count(*) AS candidate_count,
  count(DISTINCT provider) AS independent_provider_count, arg_min(provider_ord, (text = '', provider_ord)) AS selected_ordinal
FROM c GROUP BY job_id, ord
""")
def chunk_selection(spark, sf):
    return tr.reconcile(tr.chunk_records(payloads(spark, sf))).select(
        "job_id", "chunk_key", "candidate_count", "independent_provider_count", "selected_ordinal")


@query("transcript_summary")
def transcript_summary(spark, sf):
    records, _, chosen = selected(spark, sf)
    out = tr.transcript_summary(chosen, records)
    return out.select(*[F.array_join(c, ",").alias(c) if c in ("providers", "models", "run_ids", "source_hashes") else F.col(c) for c in out.columns])


def plain_chunks(spark, sf):
    return t.segments(spark, sf).select("job_id", (F.col("ord") + 1).alias("chunk_no"), "text")


def parts_sql(rows: str, key: str, line: str, separator: str, head: str = "''", tail: str = "''") -> str:
    """Documents in parts of 2000 lines; ``rows`` has ``ord`` from 0 without gaps per key."""
    return f"""
, doc AS (SELECT *, ord // 2000 AS part, max(ord) OVER (PARTITION BY {key}) AS final FROM {rows})
SELECT {key}, part, CASE WHEN part = 0 THEN {head} ELSE '' END || string_agg(CASE WHEN ord > 0 THEN {separator} ELSE '' END || {line}, '' ORDER BY ord)
  || CASE WHEN max(ord) = any_value(final) THEN {tail} ELSE '' END AS body
FROM doc GROUP BY {key}, part
"""


BLANK = "chr(10) || chr(10)"


@query("full_transcript", sql=f"WITH {t.SEGMENTS_SQL}" + parts_sql("segments", "job_id", "text", BLANK))
def full_transcript(spark, sf):
    return documents.plain_text(plain_chunks(spark, sf)).select("job_id", "part", "body")


@query("overlap_dedup")
def overlap_dedup(spark, sf):
    """Chunks that start with the last dozen words of the turn before: the repeat is found and removed."""
    from earwitness.operators.scan import scan, slice_of

    seg = scan(t.segments(spark, sf), ["job_id"], ["ord"], slice_of("ord", 1024), previous={"before": F.col("text")})
    tail = words(F.coalesce("before", F.lit("")))
    head = F.array_join(F.slice(tail, F.greatest(F.lit(1), F.size(tail) - 11), 12), " ")
    chunks = seg.select("job_id", (F.col("ord") + 1).cast("long").alias("chunk_no"), F.lit(False).alias("labelled"),
                        F.trim(F.concat_ws(" ", F.nullif(head, F.lit("")), "text")).alias("text"))
    spans = tr.boundary_overlaps(chunks)
    return chunks.join(spans, ["job_id", "chunk_no"]).select(
        "job_id", "chunk_no", "removal_start", "removal_end", "removed_tokens", "match_mode",
        tr.without_span(F.col("text"), F.col("removal_start"), F.col("removal_end")).alias("text"))


def caption_rows(spark, sf):
    return t.segments(spark, sf).select(
        "job_id", "ord", (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"), "speaker", "text")


_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _cue(sep: str) -> str:
    start, end = _CLOCK.format(sep=sep, ms="start_ms"), _CLOCK.format(sep=sep, ms="end_ms")
    text = "replace(replace(replace(speaker || ': ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"(ord + 1) || chr(10) || {start} || ' --> ' || {end} || chr(10) || {text}"


@query("srt_cues", sql=f"WITH {t.SEGMENTS_SQL}" + parts_sql("segments", "job_id", _cue(","), BLANK, tail="chr(10)"))
def srt_cues(spark, sf):
    return documents.srt(caption_rows(spark, sf)).select("job_id", "part", "body")


@query("vtt_cues", sql=f"WITH {t.SEGMENTS_SQL}" + parts_sql("segments", "job_id", _cue("."), BLANK, "'WEBVTT' || " + BLANK, "chr(10)"))
def vtt_cues(spark, sf):
    return documents.vtt(caption_rows(spark, sf)).select("job_id", "part", "body")


_ROW = """'<tr><td><span class="' || speaker || '">' || speaker || '</span></td><td>' || replace(replace(replace(replace(replace(
  text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#x27;') || '</td></tr>'"""


@query("html_report", sql=f"WITH {t.SEGMENTS_SQL}" + parts_sql(
    "segments", "job_id", _ROW, "chr(10)", "'<table><thead><tr><th>Speaker</th><th>Text</th></tr></thead><tbody>' || chr(10)", "chr(10) || '</tbody></table>'"))
def html_report(spark, sf):
    rows = t.segments(spark, sf).withColumn("no", F.col("ord") + 1)
    cells = [documents.html_badge(F.col("speaker")), documents.html_cell(F.col("text"), "MISSING")]
    return documents.html_table(rows, ["job_id"], "no", ["Speaker", "Text"], cells).select("job_id", "part", "body")


def correction_events(spark, sf):
    e = t.events(spark, sf)
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.format_string("seg-%05d", F.floor(F.col("k") / 10).cast("long")).alias("segment_id"),
        F.concat_ws(" ", "event_type", F.col("cents").cast("string")).alias("accepted_text"), F.lit("heard again").alias("reason"),
        F.when(F.col("event_type") == "error", " ").otherwise("reviewer-1").alias("reviewer"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("corrected_at"),
        F.when(F.col("event_type") == "signup", F.lit("stale")).alias("expected_original_sha256"))


def corrected_source(spark, sf):
    return t.segments(spark, sf).select(
        "job_id", F.format_string("seg-%05d", "ord").alias("segment_id"), F.col("ord"), "speaker", "text",
        F.format_string("chunk-%05d", F.floor(F.col("ord") / 2).cast("long") + 1).alias("chunk_filename"))


CORRECTED_SQL = t.SEGMENTS_SQL + "," + t.EVENTS_SQL + """,
last AS (SELECT user_id AS job_id, k // 10 AS ord, arg_max(event_type || ' ' || cents, event_id) AS accepted, count(*) AS n
  FROM ev WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL),
corrected AS (SELECT s.job_id, s.ord, s.speaker, coalesce(l.accepted, s.text) AS text, coalesce(l.n, 0) AS correction_count
  FROM segments s LEFT JOIN last l USING (job_id, ord))
"""


@query("corrections_applied", sql=f"""
WITH {CORRECTED_SQL} SELECT job_id, format('seg-{{:05d}}', ord) AS segment_id, text, correction_count FROM corrected
""")
def corrections_applied(spark, sf):
    segments = corrected_source(spark, sf)
    history = co.correction_history(co.check_corrections(correction_events(spark, sf), segments))
    return co.corrected_segments(segments, history).select("job_id", "segment_id", "text", "correction_count")


@query("corrected_chunks", sql=f"""
WITH {CORRECTED_SQL}
SELECT job_id, format('chunk-{{:05d}}', ord // 2 + 1) AS chunk_filename, string_agg(speaker || ': ' || text, chr(10) ORDER BY ord) AS text
FROM corrected GROUP BY job_id, ord // 2
""")
def corrected_chunks(spark, sf):
    segments = corrected_source(spark, sf)
    history = co.correction_history(co.check_corrections(correction_events(spark, sf), segments))
    chunks = segments.select("job_id", "chunk_filename").distinct().withColumn("text", F.lit(""))
    return co.rebuilt_chunks(chunks, co.corrected_segments(segments, history))


@query("correction_rejects", sql=f"""
WITH {t.SEGMENTS_SQL}, {t.EVENTS_SQL}
SELECT user_id AS job_id, event_id AS seq, array_to_string(list_filter([
  CASE WHEN event_type = 'error' THEN 'reviewer must be a non-empty string' END,
  CASE WHEN s.job_id IS NULL THEN 'unknown segment_id' END,
  CASE WHEN event_type = 'signup' AND s.job_id IS NOT NULL THEN 'expected original hash is stale or does not match' END], lambda x: x IS NOT NULL), '|') AS errors
FROM ev LEFT JOIN segments s ON s.job_id = user_id AND s.ord = k // 10
WHERE event_type IN ('error', 'signup') OR s.job_id IS NULL
""")
def correction_rejects(spark, sf):
    checked = co.check_corrections(correction_events(spark, sf), corrected_source(spark, sf))
    return checked.where(F.size("errors") > 0).select("job_id", "seq", F.array_join("errors", "|").alias("errors"))


def provider_results(spark, sf):
    return t.region_candidates(spark, sf).select(
        "job_id", F.col("provider").alias("provider_code"), (F.col("ord") + 1).alias("chunk_no"), F.concat("provider", F.lit("-1")).alias("model"),
        F.concat(F.lit("run-"), "speaker").alias("run_id"), "text")


@query("retained_documents", sql=f"WITH {t.REGION_CANDIDATES_SQL}, heard AS (SELECT job_id, provider AS provider_code, ord, text FROM region_candidates)"
       + parts_sql("heard", "job_id, provider_code", "text", BLANK))
def retained_documents(spark, sf):
    return tr.retained_documents(provider_results(spark, sf)).select("job_id", "provider_code", "part", "body")


@query("retained_index", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}
SELECT job_id, provider AS provider_code, count(*) AS chunk_count, array_to_string(list_sort(list(DISTINCT 'run-' || speaker)), ',') AS run_ids,
  provider || '-1' AS requested_model, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS character_count
FROM region_candidates GROUP BY job_id, provider
""")
def retained_index(spark, sf):
    return tr.retained_index(provider_results(spark, sf)).withColumn("run_ids", F.array_join("run_ids", ","))


@query("job_summary", sql=r"""
SELECT conv_id AS job_id, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS word_count, count(*) AS chunk_count, count(*) AS segment_count FROM conversations GROUP BY ALL
""")
def job_summary(spark, sf):
    from earwitness.operators.jobs import job_summary as summarise

    return summarise(t.segments(spark, sf).select("job_id", "text", F.lit(1).cast("long").alias("segment_count")))
