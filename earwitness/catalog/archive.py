"""Archive names and revisions, retained objects, reuse of finished work."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.functions.text import safe_suffix
from earwitness.operators import archive, cache
from earwitness.operators.scan import slice_of
from earwitness.sources import tables as t


def meetings(spark, sf):
    e = t.events(spark, sf)
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("meeting_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("meeting_start"),
        F.when(F.col("event_type") != "view", F.format_string("%s / %d?", "event_type", "k")).alias("project"),
        F.format_string("user <%d>.", "user_id").alias("content"), F.when(F.col("k") < 50, "con").otherwise("sync  up").alias("short_name"))


@query("archive_names", sql=f"""
WITH {t.EVENTS_SQL}
SELECT event_id, CASE WHEN event_type = 'error' THEN 'UnknownDateTime UnknownDate' ELSE strftime(ts, '%y%m%d%H%M %d%b%Y') END
  || ' ' || CASE WHEN event_type = 'view' THEN 'Unknown Project' ELSE format('{{}} {{}}', event_type, k) END || format(' user {{}}', user_id) AS desired_name,
  CASE WHEN event_type = 'error' THEN 'UnknownDateTime' ELSE strftime(ts, '%y%m%d%H%M') END || CASE WHEN k < 50 THEN ' _con' ELSE ' sync up' END AS stem
FROM ev
""")
def archive_names(spark, sf):
    return archive.names(meetings(spark, sf)).select("event_id", "desired_name", "stem")


@query("archive_folders", sql=f"""
WITH {t.EVENTS_SQL}, w AS (SELECT event_id, event_type || ' ' || k AS n, k, row_number() OVER (PARTITION BY event_type, k ORDER BY event_id) AS r FROM ev)
SELECT event_id, CASE WHEN k < 20 THEN CASE r WHEN 1 THEN n || ' (2)' ELSE n || ' (' || (r + 2) || ')' END
  ELSE CASE r WHEN 1 THEN n ELSE n || ' (' || r || ')' END END AS folder FROM w
""")
def archive_folders(spark, sf):
    """Names under k = 20 are taken, and so is their third folder."""
    wanted = t.events(spark, sf).select("event_id", F.format_string("%s %d", "event_type", "k").alias("desired_name"))
    names = t.events(spark, sf).where(F.col("k") < 20).select(F.format_string("%s %d", "event_type", "k").alias("folder")).distinct()
    taken = names.unionByName(names.select(F.concat("folder", F.lit(" (3)")).alias("folder")))
    return archive.collision_safe(wanted, taken, "event_id", slice_of("event_id", 100_000)).select("event_id", "folder")


@query("archive_revisions", sql=f"""
WITH {t.EVENTS_SQL}, h AS (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY ALL),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + coalesce(h.n, 0) AS revision
  FROM ev LEFT JOIN h USING (user_id) WHERE event_type <> 'signup')
SELECT user_id AS meeting_id, event_id AS seq, revision, CASE WHEN revision = 1 THEN 'stem' ELSE format('stem rev{{:02d}}', revision) END AS final_stem FROM r
""")
def archive_revisions(spark, sf):
    from earwitness.operators.scan import scan

    e = t.events(spark, sf).select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("seq"), "event_type", F.lit("stem").alias("stem"))
    bucket = slice_of("seq", 100_000)
    had = scan(e.where(F.col("event_type") == "signup"), ["meeting_id"], ["seq"], bucket, row_number="revision").select("meeting_id", "revision")
    return archive.next_revisions(e.where(F.col("event_type") != "signup"), had, bucket).select("meeting_id", "seq", "revision", "final_stem")


@query("archive_final", sql=f"""
WITH {t.WINDOWS_SQL}, u AS (SELECT job_id FROM windows GROUP BY ALL HAVING count(*) FILTER (word_count < 3) = 0),
s AS (SELECT w.job_id, w.idx, n.speaker, min(n.ord) AS f FROM windows w JOIN native_words n ON n.job_id = w.job_id AND n.start_ms // 24000 = w.idx
  WHERE n.speaker IS NOT NULL GROUP BY ALL),
l AS (SELECT job_id, idx, string_agg(speaker, ' / ' ORDER BY f) AS speaker FROM s GROUP BY ALL)
SELECT w.job_id, w.window_id, w.text AS final_text, l.speaker FROM windows w JOIN u USING (job_id) LEFT JOIN l USING (job_id, idx)
""")
def archive_final(spark, sf):
    """Windows of fewer than three words are unresolved; their recordings stay out."""
    w = t.windows(spark, sf).select("job_id", "window_id", F.when(F.col("word_count") >= 3, F.col("text")).alias("final_text"))
    labels = t.native_words(spark, sf).where(F.col("speaker").isNotNull()).groupBy(
        "job_id", F.format_string("window-%05d", F.floor(F.col("start_ms") / t.WINDOW_MS).cast("long") + 1).alias("window_id"),
        F.col("speaker").alias("display_label")).agg(F.min("ord").alias("turn_no"))
    return archive.final_segments(w, labels).select("job_id", "window_id", "final_text", "speaker")


def _of_window(sep: str) -> str:
    clock = "format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
    return f"{clock.format(sep=sep, ms='start_ms')} || ' --> ' || {clock.format(sep=sep, ms='end_ms')}"


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_QUOTED = "replace(replace(" + _ESCAPED + """, '"', '&quot;'), '\'\'', '&#x27;')"""
_IN_JSON = """'"' || replace(replace({0}, '\\', '\\\\'), '"', '\\"') || '"'"""
_SECONDS = "CAST(CAST({0} / 1000 AS DOUBLE) AS VARCHAR)"


@query("archive_files", sql=f"""
WITH {t.WINDOWS_SQL}, u AS (SELECT job_id FROM windows GROUP BY ALL HAVING count(*) FILTER (word_count < 2) = 0),
s AS (SELECT w.job_id, w.idx, n.speaker, min(n.ord) AS f FROM windows w JOIN native_words n ON n.job_id = w.job_id AND n.start_ms // 24000 = w.idx
  WHERE n.speaker IS NOT NULL GROUP BY ALL),
l AS (SELECT job_id, idx, string_agg(speaker, ' / ' ORDER BY f) AS speaker FROM s GROUP BY ALL),
d AS (SELECT w.*, l.speaker, row_number() OVER (PARTITION BY w.job_id ORDER BY w.idx) AS no, row_number() OVER (PARTITION BY w.job_id ORDER BY w.idx) - 1 AS z
  FROM windows w JOIN u USING (job_id) LEFT JOIN l USING (job_id, idx)),
b AS (SELECT job_id, (no - 1) // 2000 AS part, max(no) AS upto,
  string_agg(CASE WHEN no > 1 THEN repeat(chr(10), 2) ELSE '' END || text, '' ORDER BY no) AS txt,
  string_agg(CASE WHEN no > 1 THEN repeat(chr(10), 2) ELSE '' END || no || chr(10) || {_of_window(',')} || chr(10) || {_ESCAPED.format("coalesce(speaker || ': ', '') || text")}, '' ORDER BY no) AS srt,
  string_agg(CASE WHEN no > 1 THEN chr(10) ELSE '' END || '<tr><td>' || {_of_window('.').split(' ||')[0]} || '</td><td>' || {_QUOTED.format("coalesce(speaker, '')")} || '</td><td>' || {_QUOTED.format('text')} || '</td></tr>', '' ORDER BY no) AS html,
  string_agg(CASE WHEN no > 1 THEN ',' || chr(10) ELSE '' END || '{{"window_id":"' || window_id || '","start_sec":' || {_SECONDS.format('start_ms')} || ',"end_sec":' || {_SECONDS.format('end_ms')}
    || ',"speaker":' || coalesce({_IN_JSON.format('speaker')}, 'null') || ',"text":' || {_IN_JSON.format('text')} || '}}', '' ORDER BY no) AS json
  FROM d GROUP BY ALL),
e AS (SELECT job_id, max(part) AS last FROM b GROUP BY ALL),
f AS (SELECT b.job_id, part, last, unnest(['txt', 'srt', 'html', 'json']) AS ext, unnest([
  txt || CASE WHEN part = last THEN chr(10) ELSE '' END, srt || CASE WHEN part = last THEN chr(10) ELSE '' END,
  CASE WHEN part = 0 THEN '<table><thead><tr><th>Start</th><th>Speaker</th><th>Text</th></tr></thead><tbody>' || chr(10) ELSE '' END || html || CASE WHEN part = last THEN chr(10) || '</tbody></table>' ELSE '' END,
  CASE WHEN part = 0 THEN '{{"segments":[' || chr(10) ELSE '' END || json || CASE WHEN part = last THEN chr(10) || ']}}' || chr(10) ELSE '' END]) AS body FROM b JOIN e USING (job_id)),
r AS (SELECT job_id, job_id // 3 AS meeting_id, row_number() OVER (PARTITION BY job_id // 3 ORDER BY job_id) AS revision FROM e)
SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, revision, ext, part, 'M' || CASE WHEN revision > 1 THEN format(' rev{{:02d}}', revision) ELSE '' END || ' FINAL'
  || CASE WHEN last > 0 THEN format(' part{{:05d}}', part + 1) ELSE '' END || '.' || ext AS name, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size_bytes
FROM f JOIN r USING (job_id)
""")
def archive_files(spark, sf):
    """Files of new archives, with hashes: three recordings a meeting, a revision each. A window of one word is unresolved."""
    w = t.windows(spark, sf)
    finals = w.select("job_id", F.col("idx").alias("ord"), "window_id", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"),
                      F.when(F.col("word_count") >= 2, F.col("text")).alias("final_text"))
    labels = t.native_words(spark, sf).where(F.col("speaker").isNotNull()).groupBy(
        "job_id", F.format_string("window-%05d", F.floor(F.col("start_ms") / t.WINDOW_MS).cast("long") + 1).alias("window_id"),
        F.col("speaker").alias("display_label")).agg(F.min("ord").alias("turn_no"))
    segments = archive.final_segments(finals, labels)
    jobs = segments.select("job_id").distinct().select(
        "job_id", F.floor(F.col("job_id") / 3).cast("string").alias("meeting_id"), F.col("job_id").alias("seq"), F.lit("M").alias("stem"))
    none = spark.createDataFrame([], "meeting_id string, revision long")
    revisions = archive.next_revisions(jobs, none, slice_of("seq", 100_000))
    made = archive.revision_files(revisions, archive.final_documents(segments).where("ext <> 'vtt'"))
    return made.drop("body")


def files(spark, sf):
    d = t.read(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), "source",
        safe_suffix(F.concat(F.lit("call."), F.when(F.col("lang") == "de", "WAV").otherwise(F.col("lang")))).alias("ext"))


@query("object_retention", sql="""
WITH f AS (SELECT doc_id AS file_id, sha256(text) AS sha256, source, CASE WHEN lang = 'de' THEN '.wav' ELSE '.' || lang END AS ext FROM documents),
o AS (SELECT DISTINCT sha256, ext FROM f WHERE source = 'src0'),
n AS (SELECT sha256, ext, min(file_id) AS first FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.sha256 = f.sha256 AND o.ext = f.ext) GROUP BY ALL)
SELECT f.file_id, f.sha256, f.ext, n.first IS DISTINCT FROM f.file_id AS reused FROM f LEFT JOIN n USING (sha256, ext)
""")
def object_retention(spark, sf):
    f = files(spark, sf)
    stored = f.where(F.col("source") == "src0").select("sha256", "ext").distinct()
    _, report = archive.retain_objects(f.drop("source"), stored)
    return report.select("file_id", "sha256", "ext", "reused")


@query("retained_verification", sql="""
WITH f AS (SELECT doc_id AS file_id, source FROM documents)
SELECT file_id, CASE source WHEN 'src1' THEN 'size verification failed' WHEN 'src2' THEN 'retained object is missing' ELSE 'SHA-256 verification failed' END AS errors
FROM f WHERE source IN ('src1', 'src2', 'src3')
""")
def retained_verification(spark, sf):
    f = files(spark, sf)
    stored = f.where(F.col("source") != "src2").select(
        F.col("file_id").alias("object_id"), F.when(F.col("source") == "src3", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"), "size_bytes")
    copies = f.select("file_id", F.col("file_id").alias("object_id"), "sha256",
                      (F.col("size_bytes") + F.when(F.col("source") == "src1", 1).otherwise(0)).alias("size_bytes"))
    return archive.retained_errors(copies, stored).select("file_id", F.array_join("errors", "|").alias("errors"))


def _work(spark, sf):
    seg = t.segments(spark, sf)
    work = seg.select("job_id", F.format_string("chunk-%05d", "ord").alias("chunk_filename"), F.sha2("text", 256).alias("chunk_sha256"),
                      F.lit("m1").alias("model"), F.lit("alpha").alias("provider_code"), "speaker", F.char_length("text").alias("n"))
    done = work.select("job_id", "chunk_filename", F.when(F.col("n") > 800, F.lit("old")).otherwise(F.col("chunk_sha256")).alias("chunk_sha256"),
                       "model", "provider_code", F.when(F.col("speaker") == "user", "completed").otherwise("failed").alias("status"))
    return work, done


@query("cache_reuse", sql="""
SELECT conv_id AS job_id, count(*) FILTER (role = 'user' AND length(text) <= 800) AS reused, count(*) FILTER (NOT (role = 'user' AND length(text) <= 800)) AS new
FROM conversations GROUP BY ALL
""")
def cache_reuse(spark, sf):
    return cache.reuse_counters(*_work(spark, sf))


@query("cache_remaining", sql="""
SELECT conv_id AS job_id, format('chunk-{:05d}', turn) AS chunk_filename FROM conversations WHERE NOT (role = 'user' AND length(text) <= 800)
""")
def cache_remaining(spark, sf):
    return cache.split_work(*_work(spark, sf))[1].select("job_id", "chunk_filename")


@query("evidence_reuse", sql="""
SELECT c_custkey AS job_id, array_to_string(list_filter([
  CASE WHEN n_name IS NULL THEN 'reused evidence is incomplete' END,
  CASE WHEN c_acctbal < 0 THEN 'evidence belongs to a different source audio' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'evidence does not contain the provider' END], lambda x: x IS NOT NULL), '|') AS errors
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def evidence_reuse(spark, sf):
    c = t.read(spark, sf, "customer")
    n = t.read(spark, sf, "nation")
    requests = c.select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("provider_code"), F.col("c_nationkey").alias("evidence_id"),
                        F.when(F.col("c_acctbal") < 0, "other").otherwise("same").alias("source_sha256"))
    retained = n.select(F.col("n_nationkey").alias("evidence_id"), F.lit("same").alias("evidence_sha256"),
                        F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("evidence_providers"))
    return cache.usable_evidence(requests, retained).select("job_id", F.array_join("errors", "|").alias("errors"))
