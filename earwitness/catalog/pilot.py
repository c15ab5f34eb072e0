"""Pilot evidence queries: a ledger per job from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.functions.numbers import round_exact_sql
from earwitness.operators import pilot, recording
from earwitness.operators.scan import scan, slice_of
from earwitness.sources import tables as t

TYPES = ("click", "error", "purchase", "signup", "view")
BLOCKER = {"error": "accuracy", "click": "speed", "signup": "cost", "purchase": "none", "view": "other"}
TODAY = "2024-02-15"


def outcomes(spark, sf):
    k, cents, kind = F.col("k"), F.col("cents"), F.col("event_type")
    blocker = F.create_map(*[F.lit(x) for kv in BLOCKER.items() for x in kv])
    return t.events(spark, sf).select(
        F.format_string("%d-%d", "user_id", F.floor(k / 10).cast("long")).alias("job_id"), F.col("event_id").alias("seq"),
        F.format_string("cohort-%d", F.floor(k / 25).cast("long")).alias("cohort_code"), F.col("user_id").cast("string").alias("participant_code"),
        F.when(kind == "view", "synthetic").otherwise("consented_private").alias("data_classification"),
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("abandoned").alias("task_status"),
        (kind != "view").alias("evidence_eligible"),
        (k * 60.0).alias("duration_seconds"), (cents / 1000.0).alias("actual_cost_usd"), (k + 10).alias("segment_count"),
        F.floor(k / 7).cast("long").alias("correction_count"), (k * 1.0).alias("review_minutes"), (cents / 100.0).alias("delivery_labor_cost_usd"),
        F.lit(1.0).alias("support_cost_usd"), (k * 2.0).alias("price_charged_usd"),
        (F.floor(k / 25) + 1).cast("int").alias("trust_before"), (5 - F.floor(k / 25)).cast("int").alias("trust_after"),
        (F.floor(k / 33) + 1).cast("int").alias("confidence_to_share"),
        (cents > 3000).alias("transcript_usable"), (cents > 5000).alias("would_use_again"), blocker[kind].alias("primary_blocker"),
        F.date_add(F.col("ts").cast("date"), F.floor(k / 3).cast("int")).alias("retention_review_due_on"), (k > 90).alias("public_excerpt_authorized"),
        k.alias("dialect_units_total"), F.floor(k / 2).cast("long").alias("dialect_units_correct"),
        (k + 5).alias("meaning_units_total"), k.alias("meaning_units_correct"),
        F.floor(k / 4).cast("long").alias("critical_terms_total"), F.floor(k / 5).cast("long").alias("critical_terms_correct"),
        k.alias("speaker_turns_total"), F.floor(k / 9).cast("long").alias("speaker_attribution_errors"),
        F.floor(k / 30).cast("long").alias("unsupported_content_events"), F.floor(k / 20).cast("long").alias("omission_events"))


def ledger(spark, sf):
    """Chained rows; one event in a hundred names a wrong predecessor."""
    rows = t.events(spark, sf).select(
        F.format_string("%d-%d", "user_id", F.floor(F.col("k") / 10).cast("long")).alias("job_id"), F.col("event_id").alias("seq"), "cents", "k")

    def digest(cents, seq):
        return F.sha2(F.format_string('{"cents":%d,"event_id":%d}', cents, seq), 256)

    # Facts are moved, not hashes: four times smaller.
    placed = scan(rows, ["job_id"], ["seq"], slice_of("seq", 100_000), previous={"last": F.struct("cents", "seq")})
    linked = placed.select(
        "job_id", "seq", "cents", "k", digest("cents", "seq").alias("event_sha256"),
        F.when(F.col("last").isNotNull(), digest("last.cents", "last.seq")).alias("before"))
    return linked.withColumn("previous_event_sha256", F.when((F.col("k") == 13) & (F.col("cents") > 9000), "tampered").otherwise(F.col("before")))


def chains(spark, sf):
    from earwitness.functions.hashing import canonical_json, sha256_text

    again = sha256_text(canonical_json({"event_id": F.col("seq"), "cents": F.col("cents")}))
    return pilot.chain_report(ledger(spark, sf), slice_of("seq", 100_000), again)


CHAIN_SQL = """
lg AS (SELECT format('{}-{}', user_id, k // 10) AS job_id, event_id AS seq, cents, k, sha256(format('{{"cents":{},"event_id":{}}}', cents, event_id)) AS h FROM ev),
ln AS (SELECT *, lag(h) OVER w AS b, row_number() OVER w - 1 AS i FROM lg WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
ch AS (SELECT job_id, count(*) AS event_count, min(i) FILTER (k = 13 AND cents > 9000) AS invalid_index, arg_max(h, seq) AS last_h FROM ln GROUP BY ALL)
"""


@query("chain_verify", sql=f"""
WITH {t.EVENTS_SQL}, {CHAIN_SQL}
SELECT job_id, invalid_index IS NULL AS ok, event_count, invalid_index, CASE WHEN invalid_index IS NULL THEN last_h END AS latest_event_sha256 FROM ch
""")
def chain_verify(spark, sf):
    return chains(spark, sf)


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {round_exact_sql(f'({a})::DOUBLE / ({b})::DOUBLE * 100.0::DOUBLE', 3)} END"


def _hour(a: str, h: str) -> str:
    return f"CASE WHEN {h} > 0 THEN {round_exact_sql(f'({a})::DOUBLE / ({h})::DOUBLE', 6)} END"


OUTCOMES_SQL = t.EVENTS_SQL + """,
oc AS (SELECT format('{}-{}', user_id, k // 10) AS job_id, event_id AS seq, format('cohort-{}', k // 25) AS cohort_code, user_id AS participant, event_type,
  k, cents, ts, k * 60.0::DOUBLE / 3600.0::DOUBLE AS hours, cents / 1000.0::DOUBLE AS provider, cents / 100.0::DOUBLE AS labor, k * 2.0::DOUBLE AS revenue,
  k + 10 AS segs, k // 7 AS corr, CAST(k // 25 + 1 AS INT) AS tb, CAST(5 - k // 25 AS INT) AS ta, CAST(k // 33 + 1 AS INT) AS cf FROM ev),
od AS (SELECT *, provider + labor + 1.0::DOUBLE AS delivery FROM oc)
"""


@query("pilot_job_metrics", sql=f"""
WITH {OUTCOMES_SQL}
SELECT job_id, seq, {round_exact_sql('hours', 9)} AS audio_hours, {_pct('corr', 'segs')} AS corrections_per_100_segments, {_hour('k', 'hours')} AS review_minutes_per_audio_hour,
  {round_exact_sql('delivery', 6)} AS total_delivery_cost_usd, {_hour('delivery', 'hours')} AS cost_per_reviewed_audio_hour_usd, {round_exact_sql('revenue - delivery', 6)} AS gross_margin_usd,
  {_pct('revenue - delivery', 'revenue')} AS gross_margin_percent, {_pct('k // 2', 'k')} AS dialect_reference_accuracy_percent,
  {_pct('k // 9', 'k')} AS speaker_attribution_error_percent, {_hour('k // 20', 'hours')} AS omission_events_per_audio_hour, ta - tb AS trust_change
FROM od
""")
def pilot_job_metrics(spark, sf):
    return pilot.job_metrics(outcomes(spark, sf)).select(
        "job_id", "seq", "audio_hours", "corrections_per_100_segments", "review_minutes_per_audio_hour", "total_delivery_cost_usd",
        "cost_per_reviewed_audio_hour_usd", "gross_margin_usd", "gross_margin_percent",
        "dialect_reference_accuracy_percent", "speaker_attribution_error_percent", "omission_events_per_audio_hour", "trust_change")


def summary_sql(grouping: str) -> str:
    return f"""
WITH {OUTCOMES_SQL}, {CHAIN_SQL},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM od) WHERE rn = 1),
el AS (SELECT l.* FROM latest l JOIN ch USING (job_id) WHERE event_type <> 'view' AND invalid_index IS NULL),
pp AS (SELECT {grouping} AS grp, participant, count(*) AS n FROM el GROUP BY ALL),
pr AS (SELECT grp, count(*) AS participants, count(*) FILTER (n >= 2) AS repeats FROM pp GROUP BY ALL),
bl AS (SELECT {grouping} AS grp, CASE event_type WHEN 'error' THEN 'accuracy' WHEN 'click' THEN 'speed' WHEN 'signup' THEN 'cost' WHEN 'purchase' THEN 'none' ELSE 'other' END AS b, count(*) AS n FROM el GROUP BY ALL),
bs AS (SELECT grp, string_agg(b || '=' || n, ',' ORDER BY b) AS blocker_counts FROM bl GROUP BY ALL),
g AS (SELECT {grouping} AS grp, count(*) AS eligible_jobs, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (cents > 3000) AS usable,
  count(*) FILTER (cents > 5000) AS reuse, sum(k) AS k, sum(segs) AS segs, sum(corr) AS corr, sum(k // 2) AS dc, sum(k // 9) AS se, sum(hours) AS hours,
  sum(delivery) AS delivery, sum(revenue) AS revenue, avg(tb) AS tb, avg(ta - tb) AS tc,
  count(*) FILTER (CAST(ts AS DATE) + CAST(k // 3 AS INT) < DATE '{TODAY}') AS overdue, count(*) FILTER (k > 90) AS excerpts FROM el GROUP BY ALL)
SELECT g.grp AS cohort_code, eligible_jobs, participants, repeats AS repeat_participants, {_pct('done', 'eligible_jobs')} AS completion_rate_percent,
  {_pct('usable', 'eligible_jobs')} AS transcript_usable_rate_percent, {_pct('repeats', 'participants')} AS repeat_participant_rate_percent,
  {_pct('corr', 'segs')} AS corrections_per_100_segments, {_pct('dc', 'k')} AS dialect_reference_accuracy_percent,
  {_pct('se', 'k')} AS speaker_attribution_error_percent, round_even(hours, 4) AS total_audio_hours, round_even(delivery, 4) AS total_delivery_cost_usd,
  round_even(revenue, 4) AS revenue_usd, {_pct('revenue - delivery', 'revenue')} AS gross_margin_percent,
  round_even(tb, 3) AS average_trust_before, round_even(tc, 3) AS average_trust_change, blocker_counts,
  overdue AS retention_reviews_overdue, excerpts AS public_excerpt_authorizations
FROM g JOIN pr ON g.grp IS NOT DISTINCT FROM pr.grp JOIN bs ON g.grp IS NOT DISTINCT FROM bs.grp
"""


def _summary(spark, sf, rollup):
    _, good = pilot.eligible_records(pilot.job_metrics(outcomes(spark, sf)), chains(spark, sf))
    out = pilot.cohort_summary(good, F.lit(TODAY).cast("date"), rollup=rollup)
    return out.select(
        "cohort_code", "eligible_jobs", "participants", "repeat_participants", "completion_rate_percent", "transcript_usable_rate_percent",
        "repeat_participant_rate_percent", "corrections_per_100_segments", "dialect_reference_accuracy_percent", "speaker_attribution_error_percent",
        F.bround("total_audio_hours", 4).alias("total_audio_hours"), F.bround("total_delivery_cost_usd", 4).alias("total_delivery_cost_usd"),
        F.bround("revenue_usd", 4).alias("revenue_usd"), "gross_margin_percent", "average_trust_before", "average_trust_change", "blocker_counts",
        "retention_reviews_overdue", "public_excerpt_authorizations")


@query("pilot_summary", sql=summary_sql("NULL::VARCHAR"))
def pilot_summary(spark, sf):
    return _summary(spark, sf, False)


@query("pilot_rollup", sql=f"({summary_sql('cohort_code')}) UNION ALL ({summary_sql('NULL::VARCHAR')})")
def pilot_rollup(spark, sf):
    return _summary(spark, sf, True)


@query("pilot_scan_counts", sql=f"""
WITH {OUTCOMES_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM od)
SELECT count(*) AS records_scanned, count(*) FILTER (event_type = 'view') AS synthetic_records_excluded FROM latest WHERE rn = 1
""")
def pilot_scan_counts(spark, sf):
    now, _ = pilot.eligible_records(outcomes(spark, sf), chains(spark, sf))
    return pilot.scan_counts(now)


@query("pilot_rejects", sql=f"""
WITH {t.EVENTS_SQL}
SELECT event_id, array_to_string(list_filter([
  CASE WHEN event_type = 'purchase' THEN 'unsupported fields: note' END,
  CASE WHEN event_type = 'error' THEN 'cohort_code must be a code of 1-64 characters' END,
  CASE WHEN k < 10 THEN 'language_mix must contain 1-8 supported codes' END,
  CASE WHEN event_type = 'signup' THEN 'retention_review_due_on must be a valid date' END,
  CASE WHEN cents > 10000 THEN 'review_minutes is out of bounds' END,
  CASE WHEN k // 12 NOT BETWEEN 1 AND 5 THEN 'trust_before must be a rating of 1-5' END,
  CASE WHEN k > 60 THEN 'transcript_usable must be true or false' END,
  CASE WHEN k > 50 THEN 'dialect_units_correct cannot exceed dialect_units_total' END,
  CASE WHEN event_type = 'click' THEN 'consent requires consent_confirmed' END], lambda x: x IS NOT NULL), '|') AS errors
FROM ev
""")
def pilot_rejects(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    yes = F.lit(True)
    fields = dict(
        cohort_code=F.when(kind == "error", "two words").otherwise("c-1"), participant_code=F.col("user_id").cast("string"),
        data_classification=F.lit("consented_private"), use_case=F.lit("oral_history"),
        language_mix=F.when(k < 10, F.array(F.lit("klingon"))).otherwise(F.array(F.lit("malay"), F.lit("english"))),
        task_status=F.lit("completed"), consent_record_id=F.lit("r1"), purpose_notice_confirmed=yes, consent_confirmed=kind != "click",
        provider_processing_disclosed=yes, withdrawal_route_disclosed=yes,
        retention_review_due_on=F.when(kind == "signup", "2026-02-30").otherwise("2026-02-28"), public_excerpt_authorized=F.lit(False),
        review_minutes=F.when(F.col("cents") > 10000, 100001.5).otherwise(2.5), trust_before=F.floor(k / 12).cast("int"), trust_after=F.lit(3),
        confidence_to_share=F.lit(5), would_use_again=yes, primary_blocker=F.lit("none"),
        reference_evaluation=F.struct(F.lit(50).alias("dialect_units_total"), k.alias("dialect_units_correct")),
        transcript_usable=F.when(k <= 60, yes), note=F.when(kind == "purchase", "free text"))
    raw = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return t.events(spark, sf).select("event_id", F.array_join(pilot.input_errors(raw), "|").alias("errors"))


def _event(prefix: str, previous: str) -> str:
    """Hash of an event, as SQL."""
    body = f"""'{{"event":{{"cents":' || {prefix}cents || ',"k":' || {prefix}k || '}},"event_id":"e' || {prefix}seq || '","previous_event_sha256":'"""
    return f"""sha256({body} || coalesce('"' || {previous} || '"', 'null') || '}}')"""


RECORD_SQL = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS n FROM
  (SELECT format('{{}}-{{}}', user_id, k // 10) AS job_id, user_id, event_id AS seq, cents, k FROM ev)),
g0 AS (SELECT job_id, user_id % 7 = 0 AS broken, {_event('', 'NULL::VARCHAR')} AS h0 FROM ordered WHERE n = 0),
g1 AS (SELECT g0.*, {_event('o.', 'h0')} AS h1 FROM g0 LEFT JOIN ordered o ON o.job_id = g0.job_id AND o.n = 1),
g2 AS (SELECT g1.*, {_event('o.', 'h1')} AS h2 FROM g1 LEFT JOIN ordered o ON o.job_id = g1.job_id AND o.n = 2),
asked AS (SELECT o.*, g2.broken, CASE n WHEN 2 THEN h1 WHEN 3 THEN h2 WHEN 4 THEN h2 ELSE h0 END AS previous FROM ordered o JOIN g2 USING (job_id) WHERE n > 0),
recorded AS (SELECT job_id, seq, {_event('', 'previous')} AS event_sha256, CASE WHEN NOT broken AND n <= 3 THEN n END AS position,
  CASE WHEN broken THEN '{recording.BROKEN}' WHEN n > 3 THEN '{recording.STALE}' END AS reason FROM asked)
"""


def recorded(spark, sf):
    """A ledger of one event a job, and requests: the first three build on each other, the rest name a head that is gone.

    The ledger of every seventh user was tampered with.
    """
    rows = t.events(spark, sf).select(
        F.format_string("%d-%d", "user_id", F.floor(F.col("k") / 10).cast("long")).alias("job_id"), F.col("event_id").alias("seq"),
        F.format_string("e%d", "event_id").alias("event_id"), F.struct("cents", "k").alias("event"), (F.col("user_id") % 7 == 0).alias("broken"))
    placed = scan(rows, ["job_id"], ["seq"], slice_of("seq", 100_000), row_number="n")

    def nth(n: int):
        return placed.where(F.col("n") == n).select("job_id", "event_id", "event", "broken")

    known = nth(1).withColumn("previous_event_sha256", F.lit(None).cast("string"))
    known = known.withColumn("h0", recording.event_sha256(known))
    for n in (1, 2):
        after = nth(n + 1).drop("broken").join(known.select("job_id", F.col(f"h{n - 1}").alias("previous_event_sha256")), "job_id")
        known = known.join(after.select("job_id", recording.event_sha256(after).alias(f"h{n}")), "job_id", "left")
    ledger = known.select("job_id", F.lit(0).cast("long").alias("position"), "event_id", "event", "previous_event_sha256", F.when(F.col("broken"), F.lit("0" * 64)).otherwise(F.col("h0")).alias("event_sha256"))
    heads = pilot.chain_report(ledger.withColumnRenamed("position", "seq"), F.lit(0), recording.event_sha256(ledger))
    named = F.when(F.col("n") == 3, F.col("h1")).when(F.col("n").isin(4, 5), F.col("h2")).otherwise(F.col("h0"))
    requests = placed.where("n > 1").join(known.select("job_id", "h0", "h1", "h2"), "job_id").select("job_id", "seq", "event_id", named.alias("previous_event_sha256"), "event")
    return ledger, recording.record_events(requests, heads)


@query("pilot_record", sql=f"WITH {t.EVENTS_SQL}, {RECORD_SQL} SELECT * FROM recorded")
def pilot_record(spark, sf):
    return recorded(spark, sf)[1].select("job_id", "seq", "event_sha256", "position", "reason")


@query("pilot_record_chains", sql=f"""
WITH {t.EVENTS_SQL}, {RECORD_SQL},
both_ AS (SELECT job_id, position, event_sha256 FROM recorded WHERE reason IS NULL UNION ALL SELECT job_id, 0, h0 FROM g0 WHERE NOT broken)
SELECT job_id, true AS ok, count(*) AS event_count, NULL::BIGINT AS invalid_index, arg_max(event_sha256, position) AS latest_event_sha256 FROM both_ GROUP BY job_id
UNION ALL SELECT job_id, false, 1, 0, NULL FROM g0 WHERE broken
""")
def pilot_record_chains(spark, sf):
    """The chains after recording: sound wherever they were."""
    ledger, made = recorded(spark, sf)
    rows = ledger.unionByName(made.where("reason is null").select(*ledger.columns))
    return pilot.chain_report(rows.withColumnRenamed("position", "seq"), slice_of("seq", 1000), recording.event_sha256(rows))
