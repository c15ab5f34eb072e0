"""Queries over timed words, turns and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.operators import intervals, speakers as sp
from earwitness.sources import tables as t


def turns(spark, sf):
    words = t.native_words(spark, sf).select(
        "job_id", (F.col("ord") * 1_000_000 + F.col("pos")).alias("word_no"), F.col("word").alias("text"), "speaker",
        "run_id", "chunk_filename", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return sp.speaker_turns(words, 600_000)


TURNS_SQL = t.NATIVE_WORDS_SQL + """,
marked AS (
  SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND chunk_filename IS NOT DISTINCT FROM lag(chunk_filename) OVER w
                  AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh,
    lag(word) OVER w AS before
  FROM native_words WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, end_ms, ord, pos)),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, ord, pos) AS BIGINT) AS turn_no FROM marked),
turns AS (
  SELECT job_id, turn_no, speaker, run_id, chunk_filename, min(start_ms) AS start_ms,
    arg_max(end_ms, (start_ms, end_ms, ord, pos)) AS end_ms, count(*) AS word_count,
    string_agg(CASE WHEN fresh = 0 AND regexp_matches(before, '[A-Za-z0-9]$') AND regexp_matches(word, '^[A-Za-z0-9]')
               THEN ' ' ELSE '' END || word, '' ORDER BY start_ms, end_ms, ord, pos) AS text
  FROM numbered GROUP BY ALL)
"""


@query("speaker_turns", sql=f"WITH {TURNS_SQL} SELECT job_id, turn_no, speaker, chunk_filename, start_ms, end_ms, word_count, text FROM turns")
def speaker_turns(spark, sf):
    return turns(spark, sf).select(
        "job_id", "turn_no", "speaker", "chunk_filename", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "word_count", "text")


def _windows(spark, sf):
    return t.windows(spark, sf).select("job_id", "window_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


@query("speaker_overlap_join", sql=f"""
WITH {TURNS_SQL}, wins AS (SELECT DISTINCT job_id, start_ms // 24000 AS idx FROM native_words),
found AS (SELECT w.job_id, w.idx, turn_no, speaker FROM wins w JOIN turns t
  ON t.job_id = w.job_id AND t.end_ms > w.idx * 24000 AND t.start_ms < (w.idx + 1) * 24000),
firsts AS (SELECT job_id, idx, speaker, min(turn_no) AS f FROM found WHERE speaker IS NOT NULL GROUP BY ALL),
names AS (SELECT job_id, idx, string_agg(speaker, ',' ORDER BY f) AS speaker_ids FROM firsts GROUP BY ALL),
nos AS (SELECT job_id, idx, string_agg(CAST(turn_no AS VARCHAR), ',' ORDER BY turn_no) AS turn_nos FROM found GROUP BY ALL)
SELECT w.job_id, format('window-{{:05d}}', w.idx + 1) AS window_id, coalesce(speaker_ids, '') AS speaker_ids, coalesce(turn_nos, '') AS turn_nos
FROM wins w LEFT JOIN names USING (job_id, idx) LEFT JOIN nos USING (job_id, idx)
""")
def speaker_overlap_join(spark, sf):
    out = sp.attach_evidence(_windows(spark, sf), turns(spark, sf), 24_000)
    return out.select("job_id", "window_id", F.array_join("speaker_ids", ",").alias("speaker_ids"),
                      F.array_join(F.transform("turn_nos", lambda x: x.cast("string")), ",").alias("turn_nos"))


@query("speaker_sensitive", sql=f"""
WITH {TURNS_SQL}, wins AS (SELECT DISTINCT job_id, start_ms // 24000 AS idx FROM native_words)
SELECT w.job_id, format('window-{{:05d}}', w.idx + 1) AS window_id, count(DISTINCT speaker) AS speaker_count,
  count(*) FILTER (speaker IS NULL) AS unlabelled_turns
FROM wins w JOIN turns t ON t.job_id = w.job_id AND t.end_ms > w.idx * 24000 AND t.start_ms < (w.idx + 1) * 24000
GROUP BY ALL HAVING count(DISTINCT speaker) > 1 OR count(*) FILTER (speaker IS NULL) > 0
""")
def speaker_sensitive(spark, sf):
    return sp.sensitive_windows(sp.window_evidence(_windows(spark, sf), turns(spark, sf), 24_000))


@query("overlapping_turns", sql=f"""
WITH {TURNS_SQL}
SELECT l.job_id, l.turn_no AS left_turn, r.turn_no AS right_turn, l.speaker AS left_speaker, r.speaker AS right_speaker
FROM turns l JOIN turns r ON l.job_id = r.job_id AND l.turn_no < r.turn_no
  AND l.end_ms + 700 > r.start_ms AND l.start_ms < r.end_ms + 700 AND l.speaker IS DISTINCT FROM r.speaker
""")
def overlapping_turns(spark, sf):
    longer = turns(spark, sf).withColumn("end", F.col("end") + 700)
    return sp.overlapping_turns(longer, 60_000)


@query("speaker_statistics", sql=f"""
WITH {TURNS_SQL}, firsts AS (SELECT job_id, speaker, min(turn_no) AS f FROM turns WHERE speaker IS NOT NULL GROUP BY ALL),
names AS (SELECT job_id, string_agg(speaker, ',' ORDER BY f) AS speaker_ids, count(*) AS speaker_count FROM firsts GROUP BY ALL)
SELECT t.job_id, coalesce(speaker_ids, '') AS speaker_ids, coalesce(speaker_count, 0) AS speaker_count,
  CAST(sum(word_count) AS BIGINT) AS word_count, count(*) AS segment_count
FROM turns t LEFT JOIN names USING (job_id) GROUP BY ALL
""")
def speaker_statistics(spark, sf):
    return sp.timeline_statistics(turns(spark, sf)).withColumn("speaker_ids", F.array_join("speaker_ids", ","))


@query("speaker_first_seen_rank", sql="""
WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL),
r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS k FROM f)
SELECT c.conv_id AS job_id, c.turn AS pos, 'Speaker ' || k AS speaker FROM conversations c JOIN r USING (conv_id, role)
""")
def speaker_first_seen_rank(spark, sf):
    rows = t.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.lit("chunk-1").alias("chunk_filename"), F.col("turn").alias("pos"), F.col("role").alias("provider_speaker"))
    return sp.first_seen_labels(rows).select("job_id", "pos", "speaker")


@query("merged_duration", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}, i AS (SELECT job_id, start_ms AS s, end_ms AS e FROM region_candidates WHERE NOT missing),
m AS (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
u AS (SELECT job_id, isl, max(e) - min(s) AS d FROM g GROUP BY ALL)
SELECT job_id, CAST(sum(d) AS BIGINT) AS merged_ms FROM u GROUP BY ALL
""")
def merged_duration(spark, sf):
    heard = t.region_candidates(spark, sf).where(~F.col("missing"))
    return intervals.merged_duration(heard, ["job_id"], "start_ms", "end_ms", 600_000, "merged_ms")


@query("local_speakers", sql=f"""
WITH {TURNS_SQL}
SELECT job_id, 'local-speaker-' || substr(sha256('{{"chunk_filename":"' || chunk_filename || '","provider_code":"alpha","provider_speaker_id":"'
  || speaker || '","run_id":"' || run_id || '"}}'), 1, 16) AS local_speaker_key, speaker AS provider_speaker_id, chunk_filename, min(turn_no) AS first_turn
FROM turns WHERE speaker IS NOT NULL GROUP BY ALL
""")
def local_speakers(spark, sf):
    return sp.local_speakers(turns(spark, sf), F.lit("alpha")).select(
        "job_id", "local_speaker_key", "provider_speaker_id", "chunk_filename", "first_turn")


def naming_events(spark, sf):
    """People naming a provider speaker (event type) in their job; some give the id themselves."""
    return t.events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("local_speaker_key"),
        F.lit(None).cast("string").alias("canonical_speaker_id"), F.format_string("Person %d", "k").alias("display_name"))


@query("speaker_mapping", sql=f"""
WITH {t.EVENTS_SQL}, f AS (SELECT user_id, event_type, min(event_id) AS first, arg_max(k, event_id) AS k FROM ev GROUP BY ALL)
SELECT user_id AS job_id, event_type AS local_speaker_key,
  format('canonical-speaker-{{:03d}}', row_number() OVER (PARTITION BY user_id ORDER BY first)) AS canonical_speaker_id,
  format('Person {{}} [{{}}]', k, event_type) AS display_label
FROM f
""")
def speaker_mapping(spark, sf):
    mapped = sp.canonical_ids(naming_events(spark, sf))
    known = mapped.select("job_id", "local_speaker_key").distinct().withColumn("provider_speaker_id", F.col("local_speaker_key"))
    return sp.display_labels(known, mapped).select("job_id", "local_speaker_key", "canonical_speaker_id", "display_label")


@query("overlay_text_guard", sql="SELECT conv_id AS job_id, CAST(turn AS VARCHAR) AS window_id FROM conversations WHERE role = 'system'")
def overlay_text_guard(spark, sf):
    """An overlay that rewrote the system turns is caught, window by window."""
    before = t.segments(spark, sf).select("job_id", F.col("ord").cast("string").alias("window_id"), "text", "speaker")
    after = before.withColumn("text", F.when(F.col("speaker") == "system", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sp.changed_texts(before, after, ["text"]).select("job_id", "window_id")
