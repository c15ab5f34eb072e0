"""Privacy-minimised pilot evidence: input contract, job metrics, ledger chain, cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.functions.hashing import canonical_json, sha256_text
from earwitness.functions.text import let
from earwitness.operators.latest import latest
from earwitness.operators.scan import BUCKET
from earwitness.session import cut_lineage

# The input contract.
CLASSIFICATIONS = ("synthetic", "consented_private")
TASK_STATUSES = ("completed", "abandoned", "failed")
USE_CASES = ("research_interview", "oral_history", "internal_meeting", "family_history", "service_evaluation", "other_evaluation")
LANGUAGES = ("hokkien", "singlish", "mandarin", "english", "teochew", "cantonese", "hakka", "hainanese", "malay", "tamil", "indonesian", "other")
BLOCKERS = ("none", "accuracy", "speaker_labels", "review_effort", "speed", "cost", "privacy", "usability", "other")
CONSENTS = ("purpose_notice_confirmed", "consent_confirmed", "provider_processing_disclosed", "withdrawal_route_disclosed")
COSTS = ("delivery_labor_cost_usd", "support_cost_usd", "price_charged_usd")
RATINGS = ("trust_before", "trust_after", "confidence_to_share")
REFERENCE = (
    "dialect_units_total", "dialect_units_correct", "meaning_units_total", "meaning_units_correct",
    "critical_terms_total", "critical_terms_correct", "speaker_turns_total", "speaker_attribution_errors",
    "unsupported_content_events", "omission_events")
FIELDS = (
    "cohort_code", "participant_code", "data_classification", "use_case", "language_mix", "task_status",
    "consent_record_id", *CONSENTS, "retention_review_due_on", "public_excerpt_authorized", "review_minutes",
    *COSTS, *RATINGS, "transcript_usable", "would_use_again", "primary_blocker", "reference_evaluation")
CODE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def input_errors(raw: Column) -> Column:
    """Every contract violation of one JSON input, read as VARIANT so types are checked, not coerced."""
    return let(F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("v")), lambda x: _input_errors(x["raw"], x["v"]))


def _input_errors(raw: Column, v: Column) -> Column:
    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))

    def number(path: str) -> Column:
        numeric = kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        return F.when(numeric, F.try_variant_get(v, path, "double"))

    def bad(cond: Column, message: str) -> Column:
        return F.when(~F.coalesce(cond, F.lit(False)), F.lit(message))

    def choice(name: str, allowed: tuple) -> Column:
        return bad(text(f"$.{name}").isin(*allowed), f"{name} must be one of the supported values")

    def code(name: str) -> Column:
        return bad(text(f"$.{name}").rlike(CODE), f"{name} must be a code of 1-64 characters")

    def bounded(name: str, high: float) -> Column:
        absent = kind(f"$.{name}") == "VOID"
        return F.when(~absent, bad(number(f"$.{name}").between(0, high), f"{name} is out of bounds"))

    def boolean(name: str, required: bool = False) -> Column:
        ok = kind(f"$.{name}") == "BOOLEAN"
        return bad(ok if required else ok | (kind(f"$.{name}") == "VOID"), f"{name} must be true or false")

    consented = F.coalesce(text("$.data_classification") == "consented_private", F.lit(False))
    due = text("$.retention_review_due_on")
    has_due = kind("$.retention_review_due_on") != "VOID"
    real_date = due.rlike(r"^\d{4}-\d{2}-\d{2}$") & due.try_cast("date").isNotNull()
    mix = F.try_variant_get(v, "$.language_mix", "array<string>")
    mix_ok = kind("$.language_mix").rlike("^ARRAY") & F.size(mix).between(1, 8) & F.forall(mix, lambda x: F.coalesce(x.isin(*LANGUAGES), F.lit(False)))

    def reference(name: str) -> Column:
        return F.coalesce(number(f"$.reference_evaluation.{name}"), F.lit(0.0))

    def integer(name: str) -> Column:
        k = kind(f"$.reference_evaluation.{name}")
        ok = (k == "VOID") | ((k == "BIGINT") & number(f"$.reference_evaluation.{name}").between(0, 1_000_000))
        return bad(ok, f"reference_evaluation.{name} is out of bounds")

    def at_most(part: str, whole: str) -> Column:
        return F.when(reference(part) > reference(whole), F.lit(f"{part} cannot exceed {whole}"))

    extra = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(f) for f in FIELDS]))
    ref_json = F.get_json_object(raw, "$.reference_evaluation")
    ref_extra = F.array_except(F.json_object_keys(ref_json), F.array(*[F.lit(f) for f in REFERENCE]))
    checks = [
        F.when(v.isNull() | F.json_object_keys(raw).isNull(), F.lit("input must be a JSON object")),
        F.when(F.size(extra) > 0, F.concat(F.lit("unsupported fields: "), F.array_join(F.array_sort(extra), ", "))),
        F.when(F.size(ref_extra) > 0, F.concat(F.lit("unsupported reference fields: "), F.array_join(F.array_sort(ref_extra), ", "))),
        choice("data_classification", CLASSIFICATIONS), code("cohort_code"), code("participant_code"),
        choice("use_case", USE_CASES), bad(mix_ok, "language_mix must contain 1-8 supported codes"),
        choice("task_status", TASK_STATUSES), F.when(consented, code("consent_record_id")),
        *[boolean(c) for c in CONSENTS], boolean("public_excerpt_authorized"),
        F.when(consented & ~F.coalesce(real_date, F.lit(False)), F.lit("retention_review_due_on must be a valid date")),
        F.when(~consented & has_due & (F.coalesce(due, F.lit("x")) != "") & ~F.coalesce(real_date, F.lit(False)),
               F.lit("retention_review_due_on must be a valid date")),
        bounded("review_minutes", 100_000), *[bounded(c, 1_000_000) for c in COSTS],
        *[bad((kind(f"$.{r}") == "BIGINT") & number(f"$.{r}").between(1, 5), f"{r} must be a rating of 1-5") for r in RATINGS],
        boolean("transcript_usable", True), boolean("would_use_again", True), choice("primary_blocker", BLOCKERS),
        *[integer(n) for n in REFERENCE],
        at_most("dialect_units_correct", "dialect_units_total"), at_most("meaning_units_correct", "meaning_units_total"),
        at_most("critical_terms_correct", "critical_terms_total"), at_most("speaker_attribution_errors", "speaker_turns_total"),
        *[F.when(consented & ~F.coalesce(F.try_variant_get(v, f"$.{c}", "boolean"), F.lit(False)), F.lit(f"consent requires {c}")) for c in CONSENTS],
        F.when(~consented & F.coalesce(F.try_variant_get(v, "$.public_excerpt_authorized", "boolean"), F.lit(False)),
               F.lit("synthetic records cannot authorise an excerpt")),
    ]
    return F.array_compact(F.array(*checks))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_exact(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, 3))


def per_hour(value: Column, hours: Column) -> Column:
    return F.when(hours > 0, round_exact(F.try_divide(value.cast("double"), hours.cast("double")), 6))


def job_metrics(rows: DataFrame) -> DataFrame:
    """Derived metrics of one recorded outcome.

    ``rows`` joins jobs, transcripts and pilot inputs: job_id, duration_seconds,
    actual_cost_usd, segment_count, correction_count, the cost, rating and
    reference fields.
    """
    provider = F.greatest(F.lit(0.0), F.coalesce("actual_cost_usd", F.lit(0.0)))
    seconds = F.greatest(F.lit(0.0), F.coalesce("duration_seconds", F.lit(0.0)))
    hours = seconds / 3600.0
    delivery = provider + F.col("delivery_labor_cost_usd") + F.col("support_cost_usd")
    revenue = F.col("price_charged_usd")
    return rows.select(
        "*", round_exact(hours, 9).alias("audio_hours"),
        percent(F.col("correction_count"), F.col("segment_count")).alias("corrections_per_100_segments"),
        per_hour(F.col("review_minutes"), hours).alias("review_minutes_per_audio_hour"),
        round_exact(provider, 6).alias("provider_cost_usd"), round_exact(delivery, 6).alias("total_delivery_cost_usd"),
        per_hour(delivery, hours).alias("cost_per_reviewed_audio_hour_usd"),
        round_exact(revenue - delivery, 6).alias("gross_margin_usd"), percent(revenue - delivery, revenue).alias("gross_margin_percent"),
        percent(F.col("dialect_units_correct"), F.col("dialect_units_total")).alias("dialect_reference_accuracy_percent"),
        percent(F.col("meaning_units_correct"), F.col("meaning_units_total")).alias("meaning_unit_accuracy_percent"),
        percent(F.col("critical_terms_correct"), F.col("critical_terms_total")).alias("critical_term_accuracy_percent"),
        percent(F.col("speaker_attribution_errors"), F.col("speaker_turns_total")).alias("speaker_attribution_error_percent"),
        per_hour(F.col("unsupported_content_events"), hours).alias("unsupported_content_events_per_audio_hour"),
        per_hour(F.col("omission_events"), hours).alias("omission_events_per_audio_hour"),
        (F.col("trust_after") - F.col("trust_before")).alias("trust_change"))


def own_hash(fields: dict[str, Column], previous: Column) -> Column:
    """Hash of one of our events: canonical JSON of its facts and the hash before it."""
    return sha256_text(canonical_json({**fields, "previous_event_sha256": previous}))


def chain_report(events: DataFrame, bucket: Column, recomputed: Column) -> DataFrame:
    """Hash-chain check per job: soundness, length, first bad position, last hash.

    ``events``: job_id, seq, previous_event_sha256, event_sha256. ``bucket`` slices
    seq so that a long ledger is checked in parallel; only neighbours meet.
    """
    rows = events.select(
        "job_id", "seq", bucket.alias(BUCKET), "previous_event_sha256", "event_sha256", F.col("event_sha256").eqNullSafe(recomputed).alias("__own"))
    inner, order = Window.partitionBy("job_id", BUCKET).orderBy("seq"), Window.partitionBy("job_id").orderBy(BUCKET)
    placed = rows.select("*", F.row_number().over(inner).alias("__no"), F.lag("event_sha256").over(inner).alias("__before"))
    # The first of a slice is held against the last of the slice before, one row a slice.
    bad = ~F.col("__own") | ((F.col("__no") > 1) & ~F.col("previous_event_sha256").eqNullSafe(F.col("__before")))
    slices = placed.groupBy("job_id", BUCKET).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.when(bad, F.col("__no"))).alias("__bad"),
        F.min_by(F.struct("previous_event_sha256"), "seq").alias("__first"), F.max_by(F.struct("event_sha256"), "seq").alias("__last"))
    met = slices.select(
        "*", F.lag("__last").over(order)["event_sha256"].alias("__before"),
        F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    apart = ~F.col("__first.previous_event_sha256").eqNullSafe(F.col("__before"))
    at = F.when(apart, F.lit(1)).otherwise(F.col("__bad"))
    out = met.groupBy("job_id").agg(
        F.sum("__n").alias("event_count"), F.min(F.col("__earlier") + at - 1).alias("invalid_index"),
        F.max_by("__last", BUCKET)["event_sha256"].alias("__last"))
    ok = F.col("invalid_index").isNull()
    return out.select("job_id", ok.alias("ok"), "event_count", "invalid_index", F.when(ok, F.col("__last")).alias("latest_event_sha256"))


def eligible_records(recorded: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest record per job, and those that count: consented, flagged eligible, chain intact."""
    now = latest(recorded, ["job_id"], ["seq"])
    sound = chains.where("ok").select("job_id")
    good = now.where((F.col("data_classification") != "synthetic") & F.col("evidence_eligible")).join(sound, "job_id", "left_semi")
    return now, good


_SUMS = ("review_minutes", "audio_hours", "provider_cost_usd", "total_delivery_cost_usd", "price_charged_usd")
_COUNTS = ("segment_count", "correction_count", "dialect_units_total", "dialect_units_correct", "meaning_units_total",
           "meaning_units_correct", "critical_terms_total", "critical_terms_correct", "speaker_turns_total", "speaker_attribution_errors")


def cohort_summary(eligible: DataFrame, generated_on: Column, *, rollup: bool = False) -> DataFrame:
    """Cohort report; with ``rollup`` one row per cohort plus one over all (cohort_code NULL).

    Rows are first reduced per cohort and participant, so a participant with a
    third of all records is one row before the second step. Participants are
    counted again for the total, where cohorts may share them. The total is there
    without any record too, with zero counts and sums and NULL rates.
    """
    one = F.count(F.lit(1))

    def totals(keys: list[str]) -> DataFrame:
        people = eligible.groupBy(*keys, "participant_code").agg(
            one.alias("jobs"), F.count_if(F.col("task_status") == "completed").alias("completed"),
            F.count_if("transcript_usable").alias("usable"), F.count_if("would_use_again").alias("reuse"),
            *[F.sum(c).alias(c) for c in (*_SUMS, *_COUNTS)],
            *[F.sum(c).alias(f"sum_{c}") for c in (*RATINGS, "trust_change")],
            F.count_if(F.col("retention_review_due_on") < generated_on).alias("overdue"),
            F.count_if("public_excerpt_authorized").alias("excerpts"))
        none = F.lit(0)
        whole = people.groupBy(*keys).agg(
            F.coalesce(F.sum("jobs"), none).alias("eligible_jobs"), one.alias("participants"), F.count_if(F.col("jobs") >= 2).alias("repeat_participants"),
            *[F.coalesce(F.sum(c), none).alias(c) for c in ("completed", "usable", "reuse", *_SUMS, *_COUNTS, "overdue", "excerpts")],
            *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in (*RATINGS, "trust_change")])
        blockers = eligible.groupBy(*keys, "primary_blocker").agg(one.alias("n")).groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("primary_blocker", "n"))),
                                     lambda b: F.concat(b["primary_blocker"], F.lit("="), b["n"].cast("string"))), ",").alias("blocker_counts"))
        if keys:
            return whole.join(blockers, keys, "left")
        return whole.withColumn("__one", F.lit(1)).join(blockers.withColumn("__one", F.lit(1)), "__one").drop("__one")

    # Read four times below; already reduced to one row per job.
    eligible = cut_lineage(eligible)
    rows = totals([]).withColumn("cohort_code", F.lit(None).cast("string"))
    if rollup:
        rows = totals(["cohort_code"]).unionByName(rows)
    jobs, hours, cost, revenue = (F.col(c) for c in ("eligible_jobs", "audio_hours", "total_delivery_cost_usd", "price_charged_usd"))

    def mean3(name: str) -> Column:
        return round_exact(F.try_divide(F.col(f"sum_{name}").cast("double"), jobs.cast("double")), 3)

    return rows.select(
        "cohort_code", F.coalesce(jobs, F.lit(0)).alias("eligible_jobs"), "participants", "repeat_participants",
        percent(F.col("completed"), jobs).alias("completion_rate_percent"),
        percent(F.col("usable"), jobs).alias("transcript_usable_rate_percent"),
        percent(F.col("reuse"), jobs).alias("would_use_again_rate_percent"),
        percent(F.col("repeat_participants"), F.col("participants")).alias("repeat_participant_rate_percent"),
        round_exact(F.col("review_minutes"), 3).alias("total_review_minutes"),
        per_hour(F.col("review_minutes"), hours).alias("review_minutes_per_audio_hour"),
        F.col("correction_count").alias("total_corrections"),
        percent(F.col("correction_count"), F.col("segment_count")).alias("corrections_per_100_segments"),
        percent(F.col("dialect_units_correct"), F.col("dialect_units_total")).alias("dialect_reference_accuracy_percent"),
        percent(F.col("meaning_units_correct"), F.col("meaning_units_total")).alias("meaning_unit_accuracy_percent"),
        percent(F.col("critical_terms_correct"), F.col("critical_terms_total")).alias("critical_term_accuracy_percent"),
        percent(F.col("speaker_attribution_errors"), F.col("speaker_turns_total")).alias("speaker_attribution_error_percent"),
        round_exact(hours, 6).alias("total_audio_hours"), round_exact(F.col("provider_cost_usd"), 6).alias("provider_cost_usd"),
        round_exact(cost, 6).alias("total_delivery_cost_usd"), per_hour(cost, hours).alias("cost_per_reviewed_audio_hour_usd"),
        round_exact(revenue, 6).alias("revenue_usd"), round_exact(revenue - cost, 6).alias("gross_margin_usd"),
        percent(revenue - cost, revenue).alias("gross_margin_percent"),
        mean3("trust_before").alias("average_trust_before"), mean3("trust_after").alias("average_trust_after"),
        mean3("trust_change").alias("average_trust_change"), mean3("confidence_to_share").alias("average_confidence_to_share"),
        "blocker_counts", F.col("overdue").alias("retention_reviews_overdue"), F.col("excerpts").alias("public_excerpt_authorizations"))


def scan_counts(now: DataFrame) -> DataFrame:
    """Records seen and synthetic ones among them, before any cohort filter."""
    return now.agg(F.count(F.lit(1)).alias("records_scanned"),
                   F.count_if(F.col("data_classification") == "synthetic").alias("synthetic_records_excluded"))
