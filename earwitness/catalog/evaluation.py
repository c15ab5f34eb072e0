"""Error-rate queries: alpha's text is the reference, the others are hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.operators import evaluation as ev
from earwitness.sources import tables as t


def cases(spark, sf):
    heard = F.array(*[
        F.struct(F.lit(p).alias("provider"), F.when(skip, F.lit(None).cast("string")).otherwise(text).alias("hypothesis"))
        for p, skip, text in (
            ("bravo", F.lit(False), t.provider_text(F.col("text"), "bravo")),
            ("charlie", F.col("speaker") == "system", t.provider_text(F.col("text"), "charlie")))])
    return t.segments(spark, sf).select(
        F.format_string("%d/%d", "job_id", "ord").alias("id"), F.col("speaker").alias("language"),
        F.col("text").alias("reference"), F.col("dur_ms"), F.inline(heard)).select(
        "id", "language", "reference", "hypothesis", "provider", F.lit("m1").alias("model"),
        (F.col("dur_ms") / 1000.0).alias("duration_seconds"), (F.ceil(F.col("dur_ms") / 1000) * 0.0045 / 60).alias("cost_usd"),
        F.when(F.col("hypothesis").isNull(), F.array(F.lit("text must be a string"))).otherwise(
            F.array().cast("array<string>")).alias("contract_errors"))


# The SQL engine counts bytes in levenshtein, so accented letters become unused capitals first.
_PLAIN = "translate(replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), ' ', ''), 'àáâäçèéêëíîïñóôöùúûüß¿¡', 'ABCDEFGHIJKLMNOPQRSTUVW')"
# Word distance row by row: each word of the reference turns the row of the words before it into its own.
_WORD_DISTANCE = """list_reduce(r, lambda row, w: list_reduce(range(1, len(h) + 1),
    lambda new, j: list_append(new, least(new[j] + 1, row[j + 1] + 1, row[j] + CASE WHEN w = h[j] THEN 0 ELSE 1 END)), [row[1] + 1]), range(len(h) + 1))[len(h) + 1]"""
_WORDS_SQL = f"""{t.SEGMENTS_SQL}, heard AS (
  SELECT job_id, ord, speaker, dur_ms, 'bravo' AS provider, text AS r, lower(replace(replace(text, '.', ''), ',', '')) AS h FROM segments
  UNION ALL
  SELECT job_id, ord, speaker, dur_ms, 'charlie', text,
    CASE WHEN speaker = 'system' THEN '' ELSE array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: length(w) > 2), ' ') END
  FROM segments),
spoken AS (SELECT * EXCLUDE (r, h), regexp_extract_all(lower(r), '\\S+') AS r, regexp_extract_all(lower(h), '\\S+') AS h FROM heard),
wer AS (SELECT job_id, ord, provider, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST({_WORD_DISTANCE} AS DOUBLE) / len(r) END AS wer FROM spoken)"""


@query("wer_words", sql=f"""
WITH {_WORDS_SQL}
SELECT format('{{}}/{{}}', job_id, ord) AS id, provider, wer AS word_error_rate FROM wer
""")
def wer_words(spark, sf):
    return ev.evaluate(cases(spark, sf)).select("id", "provider", "word_error_rate")




@query("cer_characters", sql=f"""
WITH {t.SEGMENTS_SQL},
pairs AS (
  SELECT job_id, ord, 'bravo' AS provider, text AS r, lower(replace(replace(text, '.', ''), ',', '')) AS h FROM segments
  UNION ALL
  SELECT job_id, ord, 'charlie', text,
    CASE WHEN speaker = 'system' THEN '' ELSE array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: length(w) > 2), ' ') END
  FROM segments),
plain AS (SELECT job_id, ord, provider, {_PLAIN.format('r')} AS r, {_PLAIN.format('h')} AS h FROM pairs)
SELECT format('{{}}/{{}}', job_id, ord) AS id, provider,
  CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END
       ELSE CAST(levenshtein(r, h) AS DOUBLE) / length(r) END AS character_error_rate
FROM plain
""")
def cer_characters(spark, sf):
    return ev.evaluate(cases(spark, sf)).select("id", "provider", "character_error_rate")


_CARDS_SQL = f"""{_WORDS_SQL},
letters AS (SELECT job_id, ord, provider, speaker, dur_ms, {_PLAIN.format('r')} AS r, {_PLAIN.format('h')} AS h FROM heard),
results AS (SELECT l.*, w.wer, CASE WHEN length(l.r) = 0 THEN CASE WHEN length(l.h) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(levenshtein(l.r, l.h) AS DOUBLE) / length(l.r) END AS cer,
  CAST(l.provider = 'charlie' AND speaker = 'system' AS BIGINT) AS errors FROM letters l JOIN wer w USING (job_id, ord, provider)),
cards AS (SELECT provider, 'm1' AS model, count(*) AS case_count, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS languages,
  round(avg(wer), 9) AS mean_word_error_rate, round(avg(cer), 9) AS mean_character_error_rate, round(max(wer), 9) AS max_word_error_rate, round(max(cer), 9) AS max_character_error_rate,
  CAST(sum(errors) AS BIGINT) AS contract_error_count, round(sum(dur_ms) / 1000.0, 6) AS duration_seconds, round(sum(ceil(dur_ms / 1000.0) * 0.0045::DOUBLE / 60), 9) AS total_cost_usd,
  round(sum(ceil(dur_ms / 1000.0) * 0.0045::DOUBLE / 60) / (sum(dur_ms) / 1000.0 / 60), 9) AS cost_per_audio_minute_usd,
  CASE WHEN sum(errors) > 0 OR avg(wer) > 0.30 OR avg(cer) > 0.20 THEN 'fail' WHEN avg(wer) > 0.15 OR avg(cer) > 0.10 THEN 'warn' ELSE 'pass' END AS qualification
  FROM results GROUP BY provider)"""
#: Means and sums of doubles depend on the order of addition in the last digits, so both sides are rounded.
_ROUNDED = ("mean_word_error_rate", "mean_character_error_rate", "max_word_error_rate", "max_character_error_rate", "duration_seconds", "total_cost_usd", "cost_per_audio_minute_usd")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6 if c == "duration_seconds" else 9) for c in _ROUNDED if c in df.columns})


@query("scorecards", sql=f"WITH {_CARDS_SQL} SELECT * FROM cards")
def scorecards(spark, sf):
    return _rounded(ev.scorecards(ev.evaluate(cases(spark, sf)))).withColumn("languages", F.array_join("languages", ","))


@query("release_gate", sql=f"""
WITH {_CARDS_SQL}
SELECT CASE WHEN count(*) = 0 OR count(*) FILTER (qualification = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (qualification = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS status,
  count(*) AS provider_scorecard_count FROM cards
""")
def release_gate(spark, sf):
    return ev.release_gate(ev.scorecards(ev.evaluate(cases(spark, sf))))


@query("eval_report", sql=f"""
WITH {_CARDS_SQL}
SELECT count(*) AS case_count, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS languages, round(avg(wer), 9) AS mean_word_error_rate, round(avg(cer), 9) AS mean_character_error_rate,
  round(max(wer), 9) AS max_word_error_rate, round(max(cer), 9) AS max_character_error_rate, CAST(sum(errors) AS BIGINT) AS contract_error_count FROM results
""")
def eval_report(spark, sf):
    return _rounded(ev.report(ev.evaluate(cases(spark, sf)))).withColumn("languages", F.array_join("languages", ","))


@query("contract_errors", sql=f"""
WITH {t.SEGMENTS_SQL}
SELECT job_id, ord, array_to_string(list_filter([
  CASE WHEN speaker = 'system' THEN 'unsupported or missing schema_version' END,
  CASE WHEN length(text) < 60 THEN 'text must be a string' END,
  CASE WHEN length(text) > 1500 THEN 'segments[0] is missing a speaker label' END,
  CASE WHEN length(text) < 200 THEN 'segments[0] must have numeric start_sec and end_sec'
       WHEN speaker = 'user' AND length(text) > 1000 THEN 'segments[0] start_sec exceeds end_sec' END
], lambda x: x IS NOT NULL), '|') AS errors FROM segments
""")
def contract_errors(spark, sf):
    n = F.char_length("text")
    start = F.col("start_ms") / 1000.0
    end = F.when(n >= 200, F.when((F.col("speaker") == "user") & (n > 1000), start - 1).otherwise(F.col("end_ms") / 1000.0))
    seg = F.struct(F.when(n > 1500, F.lit("")).otherwise(F.col("speaker")).alias("speaker"),
                   F.lit(None).cast("string").alias("provider_speaker"), start.alias("start_sec"), end.alias("end_sec"))
    version = F.when(F.col("speaker") == "system", "ours.transcript.draft.v1").otherwise("ours.transcript.chunk.v1")
    errors = ev.contract_errors(version, F.when(n >= 60, F.col("text")), F.array(seg), F.lit(True))
    return t.segments(spark, sf).select("job_id", "ord", F.array_join(errors, "|").alias("errors"))
