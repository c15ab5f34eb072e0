"""Job inbox and workflow reports: one job per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.operators import jobs, media
from earwitness.sources import tables as t

STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'Completed' ELSE 'quality_chunk' END"


def manifests(spark, sf):
    o = t.read(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "Completed").otherwise("quality_chunk")
    high = F.startswith("o_orderpriority", F.lit("1"))
    failure = F.array(F.struct(F.lit("t").alias("ts"), F.col("o_orderpriority").alias("step"), F.lit("StepFailed").alias("type"), F.lit("x").alias("message")))
    none = failure.cast("array<struct<ts:string,step:string,type:string,message:string>>")
    key = F.format_string("job-%08d", "o_orderkey")
    return o.select(
        key.alias("job_id"), key.alias("dir_name"), state.alias("state"), F.col("o_orderdate").alias("created_at"),
        F.when(high, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        F.struct(F.lit(None).cast("string").alias("original_filename"), F.concat("o_orderpriority", F.lit(".wav")).alias("filename"),
                 F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256")).alias("source"),
        F.struct((F.col("o_totalprice") / 10).alias("duration_seconds"), F.lit(None).cast("double").alias("blob_duration_seconds")).alias("preprocess"),
        F.struct(F.when(state == "failed", "failed").otherwise("running").alias("overall_status"), F.lit(None).cast("string").alias("review_url"),
                 F.lit(None).cast("long").alias("unresolved_windows"), F.create_map(F.lit("bravo"), F.lit("x"), F.lit("alpha"), F.lit("y")).alias("providers"),
                 F.create_map(F.lit("INGEST"), F.lit("completed"), F.lit("CHUNK"), F.when(state == "failed", "failed").otherwise("completed")).alias("stages")).alias("quality"),
        F.create_map(F.lit("full_transcript_json"), F.when(state == "Completed", "p").otherwise("")).alias("outputs"),
        F.when(state == "failed", none).otherwise(F.slice(none, 1, 0)).alias("errors"), F.slice(none, 1, 0).alias("output_errors"),
        F.create_map(F.lit("CHUNK"), F.when(high, 2).otherwise(1)).alias("attempts"),
        F.array(F.struct(F.lit("c").alias("filename"))).alias("chunks"), F.array(F.struct(F.lit("p").alias("transcript_path"))).alias("transcripts"),
        F.struct(F.lit("failed").alias("state"), high.alias("retryable")).alias("transcription"),
        F.lit(0.5).alias("estimated_cost_usd"), F.lit(None).cast("double").alias("actual_cost_usd"))


@query("job_inbox", sql=f"""
SELECT format('job-{{:08d}}', o_orderkey) AS job_id, o_orderpriority || '.wav' AS title,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready' ELSE 'processing' END AS display_state,
  o_totalprice / 10 AS duration_seconds, 'alpha,bravo' AS provider_codes, o_orderstatus = 'O' AS has_transcript
FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END DESC, 1 LIMIT 24
""")
def job_inbox(spark, sf):
    """The top of the inbox is the feature, so the limit stays."""
    return jobs.recent(jobs.list_items(manifests(spark, sf))).select(
        "job_id", "title", "display_state", "duration_seconds", F.array_join("provider_codes", ",").alias("provider_codes"), "has_transcript")


@query("job_items", sql=f"SELECT format('job-{{:08d}}', o_orderkey) AS job_id, {STATE_SQL} AS state, 0.5::DOUBLE AS estimated_cost_usd, 0.0::DOUBLE AS actual_cost_usd FROM orders")
def job_items(spark, sf):
    return jobs.list_items(manifests(spark, sf)).select("job_id", "state", "estimated_cost_usd", "actual_cost_usd")


@query("manifest_summary", sql="""
SELECT format('job-{:08d}', o_orderkey) AS job_id, 1 AS chunk_count, 1 AS transcript_count, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS error_count FROM orders
""")
def manifest_summary(spark, sf):
    return jobs.manifest_summary(manifests(spark, sf)).select("job_id", "chunk_count", "transcript_count", F.size("all_errors").alias("error_count"))


@query("error_rollup", sql="SELECT o_orderpriority AS step, 'StepFailed' AS type, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def error_rollup(spark, sf):
    return jobs.error_rollup(manifests(spark, sf))


@query("attempt_rollup", sql="""
SELECT 'CHUNK' AS step, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) AS BIGINT) AS attempts, max(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) AS most FROM orders
""")
def attempt_rollup(spark, sf):
    return jobs.attempt_rollup(manifests(spark, sf))


@query("resumable_jobs", sql="SELECT format('job-{:08d}', o_orderkey) AS job_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def resumable_jobs(spark, sf):
    return jobs.resumable(manifests(spark, sf)).select("job_id")


@query("newest_failed_job", sql="""
SELECT c_custkey AS request_id, format('job-{:08d}', max(o_orderkey)) AS resume_job_id
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL
""")
def newest_failed_job(spark, sf):
    sources = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("source_sha256"))
    return jobs.newest_failed(sources, manifests(spark, sf)).select("request_id", "resume_job_id")


@query("stage_report", sql="""
WITH s AS (SELECT * FROM (VALUES (0, 'INGEST'), (1, 'CHUNK'), (2, 'TRANSCRIBE'), (3, 'COMPARE'), (4, 'RESCUE'), (5, 'FINAL_DRAFT'), (6, 'REVIEW')) v(stage_no, stage))
SELECT stage_no, stage, CASE WHEN stage_no > 1 THEN 'pending' WHEN stage_no = 1 AND o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status, count(*) AS jobs
FROM orders, s GROUP BY ALL
""")
def stage_report(spark, sf):
    return jobs.stage_report(manifests(spark, sf))


@query("duration_rejects", sql="""
SELECT o_orderkey, CASE WHEN o_totalprice - 20000 <= 0 THEN 'invalid_duration' ELSE 'duration_limit_exceeded' END AS errors
FROM orders WHERE o_totalprice - 20000 <= 0 OR o_totalprice - 20000 > 14400
""")
def duration_rejects(spark, sf):
    o = t.read(spark, sf, "orders").select("o_orderkey", jobs.duration_errors(F.col("o_totalprice") - 20000, 14400.0).alias("e"))
    return o.where(F.size("e") > 0).select("o_orderkey", F.array_join("e", "|").alias("errors"))


@query("retryable_failures", sql="""
SELECT event_type, CASE WHEN event_type IN ('error', 'signup') THEN true ELSE false END AS retryable, count(*) AS n FROM events GROUP BY ALL
""")
def retryable_failures(spark, sf):
    messages = {"error": "Provider said HTTP 503", "signup": "Read Timed Out", "click": "HTTP 404", "view": "bad request", "purchase": "invalid audio"}
    said = F.create_map(*[F.lit(x) for kv in messages.items() for x in kv])[F.col("event_type")]
    return t.read(spark, sf, "events").groupBy("event_type", jobs.retryable(said).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query("probe_profiles", sql="""
SELECT p_partkey AS file, p_size * 1000 AS sample_rate_hz, CASE WHEN p_size < 12 THEN 'narrowband' WHEN p_size < 32 THEN 'wideband' ELSE 'fullband' END AS sampling_band,
  CASE WHEN p_size < 16 THEN 'NARROWBAND' WHEN p_size < 32 THEN 'WIDEBAND' ELSE 'FULLBAND' END AS nominal_bandwidth_class,
  CASE WHEN p_size <= 8 THEN 'LEGACY_NARROWBAND' WHEN p_size >= 12 THEN 'WIDEBAND_MODERN' ELSE 'UNKNOWN' END AS legacy_quality_classification, p_retailprice AS duration_seconds
FROM part
""")
def probe_profiles(spark, sf):
    stream = F.struct(F.lit("audio").alias("codec_type"), F.col("p_brand").alias("codec_name"), (F.col("p_size") * 1000).cast("string").alias("sample_rate"),
                      F.lit(1).alias("channels"), F.col("p_retailprice").cast("string").alias("duration"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit("1").alias("sample_rate"), F.lit(9).alias("channels"), F.lit("N/A").alias("duration"))
    raw = F.to_json(F.struct(F.array(video, stream).alias("streams"), F.struct(F.lit("wav").alias("format_name")).alias("format")))
    rows = t.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), raw.alias("raw"))
    return media.probe_profiles(rows).select(
        "file", "sample_rate_hz", "sampling_band", "nominal_bandwidth_class", "legacy_quality_classification", "duration_seconds")


@query("signal_structure", sql="""
WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS u FROM documents),
n AS (SELECT doc_id, len(u) AS n, len(list_filter(u, lambda x: x <= 104)) AS q, list_max(u) AS m FROM c)
SELECT doc_id AS path, n AS sample_count, round(q / n, 8) AS near_silence_ratio, round(20 * log10(m / 32767.0), 4) AS peak_dbfs,
  CASE WHEN q / n >= 0.95 THEN 'pass_with_warnings' ELSE 'pass' END AS status FROM n
""")
def signal_structure(spark, sf):
    """Texts as 16-bit mono audio: each UTF-16 unit is a sample behind a RIFF header."""
    body = F.encode("text", "UTF-16LE")
    size = F.octet_length(body)

    def le32(n):
        return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])

    head = F.unhex(F.concat(
        F.lit("52494646"), le32(size + 36), F.lit("57415645666d74201000000001000100803e0000007d00000200100064617461"), le32(size)))
    rows = t.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(head, body).alias("content"))
    return media.pcm_statistics(rows).select(
        F.col("path").cast("long").alias("path"), "sample_count", "near_silence_ratio", "peak_dbfs", "status")


@query("file_identity", sql="SELECT doc_id AS path, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
def file_identity(spark, sf):
    rows = t.read(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return media.file_identity(rows)


@query("signal_log", sql="""
WITH f AS (SELECT vec_id, label, embedding[1] AS a, embedding[2] AS b FROM embeddings)
SELECT vec_id AS file, CASE WHEN label = 0 THEN 'analysis_failed' ELSE 'success' END AS status, round(CAST(a AS DOUBLE), 4) AS peak_level_dbfs,
  CASE WHEN label <> 0 THEN round(CAST(b AS DOUBLE), 4) END AS rms_level_dbfs, 1 AS channel_count, round(CAST(a AS DOUBLE), 4) >= -0.1 AS possible_clipping FROM f
""")
def signal_log(spark, sf):
    """Captured statistics logs: channel 1, then overall; label 0 never reports its overall RMS."""
    e = t.read(spark, sf, "embeddings")
    a, b = (F.round(F.col("embedding")[i].cast("double"), 4).cast("string") for i in (0, 1))
    head = F.lit("[Parsed_astats_0 @ 0x2] ")
    said = F.array(F.lit("Channel: 1"), F.lit("Peak level dB: -1.5"), F.lit("RMS level dB: -inf"), F.lit("Overall"),
                   F.concat(F.lit("Peak level dB: "), a), F.when(F.col("label") != 0, F.concat(F.lit("RMS level dB: "), b)).otherwise("Other: 1"))
    lines = e.select(F.col("vec_id").alias("file"), F.posexplode(said).alias("at", "p")).select(
        "file", F.col("at").cast("long").alias("line_no"), F.concat(head, "p").alias("line"))
    return media.signal_statistics(lines).select("file", "status", "peak_level_dbfs", "rms_level_dbfs", "channel_count", "possible_clipping")
