"""Chunk plans and rescue windows over recordings made of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.agreement import classified
from earwitness.catalog.registry import query
from earwitness.operators import chunking, intervals, media, rescue
from earwitness.session import cut_lineage
from earwitness.sources import tables as t


def silences(spark, sf):
    """The pause after every segment."""
    return t.segments(spark, sf).select(
        F.col("job_id").alias("recording_id"), (F.col("end_ms") / 1000.0).alias("start_sec"), ((F.col("end_ms") + t.GAP_MS) / 1000.0).alias("end_sec"))


def recordings(spark, sf):
    total = t.segments(spark, sf).groupBy(F.col("job_id").alias("recording_id")).agg(F.max("end_ms").alias("total_frames"))
    return total.select("*", F.lit(1000).alias("framerate"), F.lit(20.0).alias("target_sec"), F.lit(10.0).alias("min_sec"),
                        F.lit(30.0).alias("max_sec"), F.lit(2.0).alias("overlap_sec"), F.lit(5.0).alias("search_window_sec"))


@query("chunk_plan_silence")
def chunk_plan_silence(spark, sf):
    return chunking.plan_chunks(recordings(spark, sf), silences(spark, sf))


@query("nearest_silence", sql=f"""
WITH {t.SEGMENTS_SQL}, tg AS (SELECT job_id, ord, (start_ms + end_ms) // 2 AS tms FROM segments),
si AS (SELECT job_id, end_ms AS s, end_ms + 400 AS e FROM segments),
c AS (SELECT tg.job_id, tg.ord, tms, s, e, least(greatest(tms, greatest(s, tms - 20000)), least(e, tms + 20000)) AS cut
  FROM tg JOIN si ON si.job_id = tg.job_id AND least(e, tms + 20000) >= greatest(s, tms - 20000)),
b AS (SELECT job_id, ord, arg_min(cut, (abs(cut - tms), cut, s, e)) AS cut, arg_min(s, (abs(cut - tms), cut, s, e)) AS s FROM c GROUP BY ALL)
SELECT tg.job_id, tg.ord, b.cut AS cut_ms, b.s AS silence_start_ms FROM tg LEFT JOIN b USING (job_id, ord)
""")
def nearest_silence(spark, sf):
    seg = t.segments(spark, sf)
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    targets = seg.select("job_id", F.col("ord").alias("target_id"), middle.alias("target_sec"), F.lit(0).cast("long").alias("min_sec"),
                         F.lit(1 << 50).cast("long").alias("max_sec"), F.lit(20_000).alias("search_window_sec"))
    quiet = seg.select("job_id", F.col("end_ms").alias("start_sec"), (F.col("end_ms") + t.GAP_MS).alias("end_sec"))
    return intervals.nearest_cut(targets, quiet, ["job_id"], 60_000).select(
        "job_id", F.col("target_id").alias("ord"), F.col("cut_sec").alias("cut_ms"), F.col("silence_start_sec").alias("silence_start_ms"))


@query("fixed_pieces", sql=f"""
WITH {t.SEGMENTS_SQL}, n AS (SELECT *, unnest(range(CAST(ceil(dur_ms / 5000.0) AS BIGINT))) AS piece FROM segments)
SELECT job_id, ord, piece, start_ms + piece * 5000 AS piece_start_ms, least(end_ms, start_ms + (piece + 1) * 5000) AS piece_end_ms FROM n
""")
def fixed_pieces(spark, sf):
    chunks = t.segments(spark, sf).select("job_id", "ord", F.col("start_ms").alias("start_sec"), F.col("end_ms").alias("end_sec"))
    return chunking.fixed_pieces(chunks, 5000).select(
        "job_id", "ord", "piece", F.col("piece_start_sec").alias("piece_start_ms"), F.col("piece_end_sec").alias("piece_end_ms"))


@query("consecutive_parts", sql=f"""
WITH {t.SEGMENTS_SQL}, w AS (SELECT job_id, CAST(sum(dur_ms) AS BIGINT) AS s, max(end_ms) AS total, count(*) AS n FROM segments GROUP BY ALL)
SELECT job_id, ord + 1 AS part_no, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  abs(s - total) AS delta_ms FROM segments JOIN w USING (job_id)
""")
def consecutive_parts(spark, sf):
    seg = t.segments(spark, sf)
    parts = seg.select("job_id", (F.col("ord") + 1).alias("part_no"), F.col("dur_ms").alias("duration_sec"))
    totals = seg.groupBy("job_id").agg(F.max("end_ms").alias("total_sec"))
    return chunking.consecutive_parts(parts, totals).select(
        "job_id", "part_no", F.col("start_sec").alias("start_ms"), F.col("duration_delta_sec").alias("delta_ms"))


@query("window_contiguity", sql=f"""
WITH {t.SEGMENTS_SQL}, l AS (SELECT job_id, ord, start_ms, lag(end_ms) OVER w AS p FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY ord))
SELECT job_id, start_ms, 'windows must be contiguous' AS errors FROM l WHERE p IS NOT NULL
""")
def window_contiguity(spark, sf):
    """Segments are 0.4 s apart, so each but the first breaks contiguity."""
    seg = t.segments(spark, sf)
    windows = seg.select("job_id", (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"), "start_ms")
    ends = windows.groupBy("job_id").agg(F.min("start_sec").alias("region_start_sec"), F.max("end_sec").alias("region_end_sec"))
    return chunking.contiguity_errors(windows, ["job_id"], ends).select("job_id", "start_ms", F.array_join("errors", "|").alias("errors"))


def rescue_plan(spark, sf):
    regions = cut_lineage(classified(spark, sf))  # scored once, read by selection and routing
    return regions, rescue.rescue_windows(rescue.first_red(regions), silences(spark, sf).withColumnRenamed("recording_id", "job_id"))


@query("rescue_windows")
def rescue_windows(spark, sf):
    return rescue_plan(spark, sf)[1]


@query("rescue_routes")
def rescue_routes(spark, sf):
    return rescue.route(*rescue_plan(spark, sf))


@query("rescue_median")
def rescue_median(spark, sf):
    return rescue.window_statistics(rescue_plan(spark, sf)[1])


def _lines(spark, sf):
    """Detector log of each recording: a start and an end line per pause; the last start stays open."""
    seg = t.segments(spark, sf)
    text = lambda what, ms: F.format_string("[silencedetect @ 0x1] silence_" + what + ": %s", (ms / 1000.0).cast("string"))
    pair = F.array(F.struct((F.col("ord") * 2 + 1).alias("line_no"), text("start", F.col("end_ms")).alias("line")),
                   F.struct((F.col("ord") * 2 + 2).alias("line_no"), text("end", F.col("end_ms") + t.GAP_MS).alias("line")))
    last = seg.groupBy("job_id").agg(F.max("ord").alias("last"))
    rows = seg.join(last, "job_id").select(F.col("job_id").alias("file"), "ord", "last", F.inline(pair))
    return rows.where((F.col("ord") < F.col("last")) | (F.col("line_no") == F.col("ord") * 2 + 1)).select("file", "line_no", "line")


@query("silence_log", sql=f"""
WITH {t.SEGMENTS_SQL}, l AS (SELECT *, max(ord) OVER (PARTITION BY job_id) AS last FROM segments)
SELECT job_id AS file, end_ms AS start_ms, CASE WHEN ord < last THEN end_ms + 400 ELSE end_ms + 1000 END AS end_ms FROM l
""")
def silence_log(spark, sf):
    durations = t.segments(spark, sf).groupBy(F.col("job_id").alias("file")).agg(((F.max("end_ms") + 1000) / 1000.0).alias("duration_sec"))
    out = media.silence_intervals(_lines(spark, sf), durations)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return out.select("file", ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"))
