"""Error rates of transcripts against references, scorecards and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.similarity import character_error_rate, word_error_rate
from earwitness.functions.text import is_blank
from earwitness.params import ScorecardThresholds
from earwitness.session import spread


def evaluate(cases: DataFrame) -> DataFrame:
    """Add word and character error rates; optional columns get their defaults.

    Edit distance costs far more per byte than reading, so cases are spread first.
    """
    optional = {
        "provider": F.lit("fixture"), "model": F.lit("synthetic"), "duration_seconds": F.lit(0.0),
        "cost_usd": F.lit(0.0), "contract_errors": F.array().cast("array<string>"),
    }
    filled = cases.select(
        "id", "language", F.coalesce("reference", F.lit("")).alias("reference"),
        F.coalesce("hypothesis", F.lit("")).alias("hypothesis"),
        *[(F.coalesce(F.col(n), d) if n in cases.columns else d).alias(n) for n, d in optional.items()],
    )
    return spread(filled, "id", "provider", "model").select(
        "id", "language", *optional,
        word_error_rate(F.col("reference"), F.col("hypothesis")).alias("word_error_rate"),
        character_error_rate(F.col("reference"), F.col("hypothesis")).alias("character_error_rate"),
    )


def qualification(mean_wer: Column, mean_cer: Column, errors: Column, t: ScorecardThresholds) -> Column:
    fails = (mean_wer > t.fail_mean_word_error_rate) | (mean_cer > t.fail_mean_character_error_rate)
    warns = (mean_wer > t.pass_mean_word_error_rate) | (mean_cer > t.pass_mean_character_error_rate)
    return F.when(errors > 0, "fail").when(fails, "fail").when(warns, "warn").otherwise("pass")


def scorecards(results: DataFrame, thresholds: ScorecardThresholds = ScorecardThresholds()) -> DataFrame:
    """One card per provider and model. Everything combines map-side; languages are few by nature."""
    cards = results.groupBy(
        F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("model", F.lit("unknown")).alias("model"),
    ).agg(
        F.count(F.lit(1)).alias("case_count"),
        F.array_sort(F.collect_set(F.col("language"))).alias("languages"),
        F.avg("word_error_rate").alias("mean_word_error_rate"),
        F.avg("character_error_rate").alias("mean_character_error_rate"),
        F.max("word_error_rate").alias("max_word_error_rate"),
        F.max("character_error_rate").alias("max_character_error_rate"),
        F.sum(F.size("contract_errors")).alias("contract_error_count"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.sum("cost_usd").alias("total_cost_usd"),
    )
    minutes = F.col("duration_seconds") / 60.0
    return cards.select(
        "*", F.when(minutes > 0, F.try_divide(F.col("total_cost_usd"), minutes)).alias("cost_per_audio_minute_usd"),
        qualification(F.col("mean_word_error_rate"), F.col("mean_character_error_rate"),
                      F.col("contract_error_count"), thresholds).alias("qualification"),
    )


def release_gate(cards: DataFrame) -> DataFrame:
    """Fail without cards or with any failing card, else warn with any warning, else pass."""
    q = F.col("qualification")
    counts = cards.agg(
        F.count(F.lit(1)).alias("provider_scorecard_count"),
        F.count_if(q == "fail").alias("f"), F.count_if(q == "warn").alias("w"))
    return counts.select(
        F.when((F.col("provider_scorecard_count") == 0) | (F.col("f") > 0), "fail")
        .when(F.col("w") > 0, "warn").otherwise("pass").alias("status"),
        "provider_scorecard_count",
    )


def report(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.array_sort(F.collect_set("language")).alias("languages"),
        *[F.coalesce(f(m), F.lit(0.0)).alias(f"{n}_{m}")
          for n, f in (("mean", F.avg), ("max", F.max)) for m in ("word_error_rate", "character_error_rate")],
        F.coalesce(F.sum(F.size("contract_errors")), F.lit(0)).alias("contract_error_count"),
    )


# The payload kinds a contract check accepts, whatever the namespace before them.
TRANSCRIPT_KINDS = r"(^|\.)transcript\.(chunk|full)\.v1$"


def contract_errors(schema_version: Column, text: Column, segments: Column, diarized: Column) -> Column:
    """Transcript contract violations. ``segments`` items: speaker, provider_speaker, start_sec, end_sec (typed)."""
    def per_segment(s: Column, i: Column) -> Column:
        label = F.coalesce(F.nullif(s["speaker"], F.lit("")), s["provider_speaker"])
        head = F.concat(F.lit("segments["), i.cast("string"), F.lit("] "))
        timed = s["start_sec"].isNotNull() & s["end_sec"].isNotNull()
        return F.array_compact(F.array(
            F.when(s.isNull(), F.concat(head, F.lit("must be an object"))),
            F.when(s.isNotNull() & is_blank(label), F.concat(head, F.lit("is missing a speaker label"))),
            F.when(s.isNotNull() & ~timed, F.concat(head, F.lit("must have numeric start_sec and end_sec"))),
            F.when(timed & (s["start_sec"] > s["end_sec"]), F.concat(head, F.lit("start_sec exceeds end_sec"))),
        ))

    head = F.array_compact(F.array(
        F.when(~F.coalesce(schema_version.rlike(TRANSCRIPT_KINDS), F.lit(False)), F.lit("unsupported or missing schema_version")),
        F.when(text.isNull(), F.lit("text must be a string")),
        F.when(segments.isNull(), F.lit("segments must be a list")),
    ))
    body = F.when(F.coalesce(diarized, F.lit(False)) & segments.isNotNull(), F.flatten(F.transform(segments, per_segment)))
    return F.concat(head, F.coalesce(body, F.array().cast("array<string>")))
