"""The given parquet tables, and assurance inputs derived from them.

Every derivation is integer arithmetic and plain string work, so the same rule
can be written in any SQL engine; the SQL twins are the ``*_SQL`` texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earwitness.functions.text import words as split_words
from earwitness.operators.scan import scan, slice_of

PROVIDERS = ("alpha", "bravo", "charlie")
GAP_MS = 400
TURNS_PER_SLICE = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spoken segment per conversation turn, laid end to end with short pauses."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text",
        F.greatest(F.lit(1000), 66 * F.char_length("text")).cast("long").alias("dur_ms"),
    )
    placed = scan(
        turns, ["job_id"], ["ord"], slice_of("ord", TURNS_PER_SLICE),
        sums_before={"start_ms": F.col("dur_ms") + GAP_MS},
    )
    return placed.select(
        "job_id", "ord", "speaker", "text", "dur_ms",
        F.col("start_ms").cast("long").alias("start_ms"),
        (F.col("start_ms") + F.col("dur_ms")).cast("long").alias("end_ms"),
    )


SEGMENTS_SQL = """
segments AS (
  SELECT job_id, ord, speaker, text, dur_ms, start_ms, start_ms + dur_ms AS end_ms FROM (
    SELECT conv_id AS job_id, turn AS ord, role AS speaker, text,
      CAST(greatest(1000, 66 * length(text)) AS BIGINT) AS dur_ms,
      CAST(coalesce(sum(greatest(1000, 66 * length(text)) + 400) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM conversations))
"""


def provider_text(text: Column, provider: str) -> Column:
    if provider == "alpha":
        return text
    if provider == "bravo":
        return F.lower(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("")))
    return F.array_join(F.filter(split_words(text), lambda w: F.char_length(w) > 2), " ")


def region_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers' hearing of each segment.

    ``bravo`` drops case and punctuation; ``charlie`` loses short words, hears
    nothing in system turns and returns blank text for very short ones.
    """
    seg = segments(spark, sf_dir)
    charlie = provider_text(F.col("text"), "charlie")
    names = ("provider", "provider_ord", "missing", "text", "start_ms", "end_ms")

    def heard(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    unheard = F.col("speaker") == "system"
    rows = F.array(
        heard(F.lit("alpha"), F.lit(0), F.lit(False), F.col("text"), F.col("start_ms"), F.col("end_ms")),
        heard(F.lit("bravo"), F.lit(1), F.lit(False), provider_text(F.col("text"), "bravo"),
              F.col("start_ms") + 120, F.col("end_ms") + 150),
        heard(F.lit("charlie"), F.lit(2), unheard,
              F.when(unheard, F.lit(None).cast("string"))
              .when(F.char_length("text") < 60, F.lit("")).otherwise(charlie),
              F.greatest(F.lit(0), F.col("start_ms") - 100), F.col("end_ms") - 50),
    )
    return seg.select("job_id", "ord", "speaker", F.inline(rows))


REGION_CANDIDATES_SQL = SEGMENTS_SQL + """,
region_candidates AS (
  SELECT job_id, ord, speaker, 'alpha' AS provider, 0 AS provider_ord, false AS missing, text, start_ms, end_ms FROM segments
  UNION ALL
  SELECT job_id, ord, speaker, 'bravo', 1, false, lower(replace(replace(text, '.', ''), ',', '')), start_ms + 120, end_ms + 150 FROM segments
  UNION ALL
  SELECT job_id, ord, speaker, 'charlie', 2, speaker = 'system',
    CASE WHEN speaker = 'system' THEN NULL WHEN length(text) < 60 THEN ''
         ELSE array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: length(w) > 2), ' ') END,
    greatest(0, start_ms - 100), end_ms - 50 FROM segments)
"""


def native_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words: a segment's words share its duration evenly.

    The last quarter of a segment of more than 40 words belongs to a second,
    unlabelled voice; two consecutive turns make one chunk.
    """
    seg = segments(spark, sf_dir).withColumn("ws", split_words(F.col("text"))).withColumn("n", F.size("ws").cast("long"))
    rows = seg.select("job_id", "ord", "speaker", "start_ms", "dur_ms", "n", F.posexplode("ws").alias("pos", "word"))
    return rows.select(
        "job_id", "ord", F.col("pos").cast("long").alias("pos"), "word",
        F.when((F.col("n") > 40) & (F.col("pos") * 4 >= F.col("n") * 3), F.lit(None).cast("string"))
        .otherwise(F.col("speaker")).alias("speaker"),
        F.lit("run-1").alias("run_id"),
        F.format_string("chunk-%05d", F.floor(F.col("ord") / 2).cast("long") + 1).alias("chunk_filename"),
        (F.col("start_ms") + F.expr("pos * dur_ms div n")).alias("start_ms"),
        (F.col("start_ms") + F.expr("(pos + 1) * dur_ms div n")).alias("end_ms"),
    )


NATIVE_WORDS_SQL = SEGMENTS_SQL + """,
native_words AS (
  SELECT job_id, ord, pos, ws[pos + 1] AS word,
    CASE WHEN n > 40 AND pos * 4 >= n * 3 THEN NULL ELSE speaker END AS speaker,
    'run-1' AS run_id, format('chunk-{:05d}', ord // 2 + 1) AS chunk_filename,
    start_ms + (pos * dur_ms) // n AS start_ms, start_ms + ((pos + 1) * dur_ms) // n AS end_ms
  FROM (SELECT *, CAST(unnest(range(n)) AS BIGINT) AS pos FROM (
    SELECT *, CAST(len(ws) AS BIGINT) AS n FROM (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM segments))))
"""

WINDOW_MS = 24_000


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed 24 s windows wherever somebody speaks, with the words begun in them as draft text."""
    w = native_words(spark, sf_dir).withColumn("idx", F.floor(F.col("start_ms") / WINDOW_MS).cast("long"))
    return w.groupBy("job_id", "idx").agg(
        F.count(F.lit(1)).alias("word_count"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "ord", "pos", "word"))), lambda x: x["word"]), " "
        ).alias("text"),
    ).select(
        "job_id", "idx", F.format_string("window-%05d", F.col("idx") + 1).alias("window_id"),
        (F.col("idx") * WINDOW_MS).alias("start_ms"), ((F.col("idx") + 1) * WINDOW_MS).alias("end_ms"),
        "word_count", "text",
    )


WINDOWS_SQL = NATIVE_WORDS_SQL + """,
windows AS (
  SELECT job_id, idx, format('window-{:05d}', idx + 1) AS window_id, idx * 24000 AS start_ms, (idx + 1) * 24000 AS end_ms,
    word_count, text
  FROM (SELECT job_id, start_ms // 24000 AS idx, count(*) AS word_count,
          string_agg(word, ' ' ORDER BY start_ms, ord, pos) AS text
        FROM native_words GROUP BY 1, 2))
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its unit count and value in cents."""
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)
"""
