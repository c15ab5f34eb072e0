"""Cost preflights, caps, execution plans, token budgets, runnable routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.functions.text import text_tokens
from earwitness.operators.scan import scan

RESERVE = 0.15
CAP_SLACK = 1e-12
MODEL_SHARDS = 4


def route_status(models: DataFrame) -> DataFrame:
    """Which registered models can run, and the first reason why not. Flags arrive as data."""
    free = ~F.col("cost_cap_included")
    reason = (
        F.when(~F.col("adapter_ready"), "Live adapter is not implemented; setup is required.")
        .when(~F.col("gate_enabled"), "Provider live gate is disabled.")
        .when(~F.col("credential_available"), "Provider credential is not available in the server environment.")
        .when(F.col("price_per_minute_usd").isNull(), "Provider pricing is not configured.")
        .when(free, "Ready for an explicitly confirmed, quota-limited trial run.")
        .otherwise("Ready for an explicitly confirmed, cost-capped live run."))
    runnable = F.col("adapter_ready") & F.col("gate_enabled") & F.col("credential_available") & F.col("price_per_minute_usd").isNotNull()
    return models.withColumns({"runnable": runnable, "readiness_reason": reason})


def registry_errors(models: DataFrame) -> DataFrame:
    """Registry rows whose model id or provider code is not unique."""
    ids = models.groupBy("model_id").agg(F.count(F.lit(1)).alias("__ids"))
    codes = models.groupBy("provider_code").agg(F.count(F.lit(1)).alias("__codes"))
    return models.join(ids, "model_id").join(codes, "provider_code").withColumn("errors", F.array_compact(F.array(
        F.when(F.col("__ids") > 1, F.lit("duplicate model_id")), F.when(F.col("__codes") > 1, F.lit("duplicate provider_code")),
    ))).drop("__ids", "__codes").where(F.size("errors") > 0)


def with_every_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Each row with each registered model.

    One plan at every size: the registry is dealt over ``MODEL_SHARDS`` shards, each
    row meets every shard, and the sides join on the shard. Spark sends a registry
    that its own size check finds small to all tasks, so that rows stay where they are.
    """
    left = rows.withColumn("__shard", F.explode(F.sequence(F.lit(0), F.lit(MODEL_SHARDS - 1))))
    right = models.withColumn("__shard", F.pmod(F.xxhash64("model_id"), F.lit(MODEL_SHARDS)).cast("int"))
    return left.join(right, "__shard").drop("__shard")


def request_envelope(models: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Chunk limits each model allows: the least of the defaults and its own.

    ``models``: model_id, provider_code, safe_duration_sec, request_limit_bytes.
    """
    least = lambda name, limit: F.least(F.lit(defaults[name]), F.col(limit))
    target = least("target_sec", "safe_duration_sec")
    hard = least("hard_bytes", "request_limit_bytes")
    return models.select(
        "model_id", "provider_code", target.alias("target_sec"), least("max_sec", "safe_duration_sec").alias("max_sec"),
        F.least(F.lit(defaults["min_sec"]), F.greatest(F.lit(1), F.floor(target / 2).cast("int"))).alias("min_sec"),
        F.least(least("target_bytes", "request_limit_bytes"), hard).alias("target_bytes"), hard.alias("hard_bytes"),
        F.array_compact(F.array(
            F.when(F.col("safe_duration_sec") <= 0, F.lit("safe duration must be positive")),
            F.when(F.col("request_limit_bytes") <= 0, F.lit("request byte limit is not positive")))).alias("errors"))


def tightest_envelope(envelopes: DataFrame) -> DataFrame:
    """The limits every listed provider can accept."""
    return envelopes.agg(*[F.min(c).alias(c) for c in ("target_sec", "max_sec", "min_sec", "target_bytes", "hard_bytes")])


def billed(seconds: Column, price: Column) -> Column:
    return F.ceil(seconds).cast("double") / 60.0 * price


def authorization(amount: Column, reserve: float = RESERVE) -> Column:
    return amount * (1.0 + reserve)


def cost_preflight(chunks: DataFrame, models: DataFrame, cap_usd: float) -> DataFrame:
    """Estimated cost of every recording on every model, with reserve and cap.

    Billable seconds are summed per recording first; only those sums meet the
    models, so the chunk rows are never multiplied.
    """
    jobs = chunks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.ceil("duration_sec")).alias("billable_seconds"),
        F.max(F.ceil("duration_sec")).alias("longest_sec"))
    return preflight_of_totals(jobs, models, cap_usd)


def preflight_of_totals(jobs: DataFrame, models: DataFrame, cap_usd: float) -> DataFrame:
    """The same from one row per recording: job_id, chunk_count, billable_seconds, longest_sec."""
    price, capped = F.col("price_per_minute_usd"), F.col("cost_cap_included")
    estimate = F.col("billable_seconds") * price / 60.0
    guard = F.when(capped, F.col("chunk_count") * price / 60.0).when(price.isNotNull(), F.lit(0.0))
    budget = F.when(capped, authorization(estimate + guard)).otherwise(estimate + guard)
    rows = with_every_model(jobs, route_status(models))
    return rows.select(
        "job_id", "model_id", "provider_code", "chunk_count", "billable_seconds", "cost_cap_included", "runnable",
        estimate.alias("estimated_cost_usd"), guard.alias("rounding_guard_usd"), budget.alias("run_budget_cap_usd"),
        (F.col("longest_sec") * price / 60.0 + F.when(capped, price / 60.0).otherwise(F.lit(0.0))).alias("max_chunk_cost_usd"),
        (F.col("runnable") & F.coalesce(budget <= cap_usd + CAP_SLACK, F.lit(False))).alias("within_cap"))


def preflight_totals(preflight: DataFrame, cap_usd: float) -> DataFrame:
    """Paid total per recording, counted only where the cap applies."""
    capped = F.col("cost_cap_included")
    totals = preflight.groupBy("job_id").agg(
        F.sum(F.when(capped, F.col("estimated_cost_usd"))).alias("paid"), F.bool_and("runnable").alias("all_runnable"))
    paid = F.coalesce("paid", F.lit(0.0))
    return totals.select(
        "job_id", paid.alias("paid_provider_total_usd"), authorization(paid).alias("paid_authorization_usd"),
        (authorization(paid) > cap_usd + CAP_SLACK).alias("over_cap"), "all_runnable")


def totals_of_jobs(jobs: DataFrame, models: DataFrame, cap_usd: float) -> DataFrame:
    """``preflight_totals`` from one row per recording: job_id, billable_seconds.

    The registry meets a recording as one row of arrays, so nothing is grouped by
    recording again and a task holds no table of them.
    """
    registered = route_status(models).agg(
        F.count(F.lit(1)).alias("__n"), F.bool_and("runnable").alias("all_runnable"),
        F.array_sort(F.collect_list(F.when(F.col("cost_cap_included"), F.col("price_per_minute_usd")))).alias("__prices"))
    paid = F.aggregate("__prices", F.lit(0.0), lambda total, price: total + F.col("billable_seconds") * price / 60.0)
    return jobs.crossJoin(registered.where("__n > 0")).select(
        "job_id", paid.alias("paid_provider_total_usd"), authorization(paid).alias("paid_authorization_usd"),
        (authorization(paid) > cap_usd + CAP_SLACK).alias("over_cap"), "all_runnable")


def ordered_models(requests: DataFrame) -> DataFrame:
    """Distinct model ids per request in first-asked order, blanks dropped: request_id, position, model_id."""
    asked = requests.withColumn("model_id", F.trim("model_id")).where(F.col("model_id") != "")
    first = asked.groupBy("request_id", "model_id").agg(F.min("position").alias("__at"))
    return first.withColumn("route_index", (F.row_number().over(
        Window.partitionBy("request_id").orderBy("__at")) - 1).cast("long")).drop("__at")


def one_per_provider(models: DataFrame, primary_provider: str) -> DataFrame:
    """First model (by registry ``position``) of every provider but the primary's."""
    rest = models.where(F.col("provider") != primary_provider)
    return rest.groupBy("provider").agg(F.min_by("model_id", "position").alias("model_id"))


def execution_plans(jobs: DataFrame, routes: DataFrame, mode: str, cap_usd: float) -> DataFrame:
    """Initial and worst-case cost of one route list for every recording.

    ``jobs``: one row per job_id, with duration_minutes. ``routes``: model columns of
    ``route_status`` plus route_index (0 is primary). A route list is short; it meets
    a recording as one row of arrays, so nothing is grouped by recording.
    """
    if mode not in ("economy", "recommended", "max_quality"):
        raise ValueError(f"unsupported quality mode {mode!r}")
    used = routes.where(F.col("route_index") == 0) if mode == "economy" else routes
    primary = F.col("route_index") == 0
    listed = used.agg(
        F.count(F.lit(1)).alias("route_count"), F.bool_and(F.col("price_per_minute_usd").isNotNull()).alias("__priced"),
        F.collect_list(F.when(primary, F.col("price_per_minute_usd"))).alias("__first"),
        F.array_sort(F.collect_list(F.when(F.col("cost_cap_included"), F.col("price_per_minute_usd")))).alias("__capped"),
        F.bool_or(primary & F.col("runnable")).alias("__primary_ok"), F.bool_and("runnable").alias("__all_ok"),
        F.array_sort(F.collect_list(F.when(~F.col("runnable"), F.struct(
            "route_index", F.concat("provider_code", F.lit(": "), "readiness_reason").alias("why"))))).alias("__why"))
    minutes = F.col("duration_minutes")

    def estimate(price: Column) -> Column:
        return round_exact(minutes * price, 9)

    plans = jobs.crossJoin(listed.where("route_count > 0")).select(
        "*", F.array_max(F.transform("__first", estimate)).alias("initial_estimated_cost_usd"),
        (F.col("__priced") & minutes.isNotNull()).alias("__known"),
        F.aggregate(F.transform("__capped", estimate), F.lit(0.0), lambda total, e: total + F.coalesce(e, F.lit(0.0))).alias("__worst"))
    first, worst = F.col("initial_estimated_cost_usd"), F.when(F.col("__known"), round_exact(F.col("__worst"), 9))
    first_ok, worst_ok = F.coalesce(first <= cap_usd, F.lit(False)), F.coalesce(worst <= cap_usd, F.lit(False))
    return plans.select(
        "job_id", F.lit(mode).alias("quality_mode"), "route_count", first, worst.alias("maximum_estimated_cost_usd"),
        first_ok.alias("initial_cost_cap_passed"), worst_ok.alias("maximum_cost_cap_passed"),
        (F.col("__primary_ok") & first_ok).alias("initial_execution_allowed"), (F.col("__all_ok") & worst_ok).alias("full_plan_ready"),
        F.array_join(F.transform("__why", lambda w: w["why"]), "; ").alias("mode_readiness_reasons"))


def spend_guard(costs: DataFrame, caps: DataFrame, bucket: Column, earlier: DataFrame | None = None) -> DataFrame:
    """Stop each job before the first chunk that its budget no longer allows.

    ``costs``: job_id, seq, estimated, actual, cached. ``caps``: job_id, cap.
    ``earlier``: job_id, spent by runs before this one (none by default); it counts
    against the cap from the start. A new chunk needs an estimate within what is
    left. Once a chunk has taken actual spend past the cap nothing after it runs,
    cached or not. ``spent_before`` is the running sum of actual costs, with what
    was spent earlier.
    """
    first = costs.groupBy("job_id").agg(F.min("seq").alias("__first"))
    caps = caps.join(first, "job_id")
    if earlier is None:
        caps = caps.withColumn("__earlier", F.lit(0))
    else:
        before = earlier.groupBy("job_id").agg(F.sum("spent").alias("__earlier"))
        caps = caps.join(before, "job_id", "left").fillna(0, ["__earlier"])
    spent = scan(
        costs, ["job_id"], ["seq"], bucket,
        sums_before={"spent_before": F.when(F.col("cached"), F.lit(0)).otherwise(F.col("actual"))})
    spent = spent.join(caps, "job_id").withColumn("spent_before", F.col("spent_before") + F.col("__earlier"))
    left = F.greatest(F.lit(0), F.col("cap") - F.col("spent_before"))
    overspent = (F.col("spent_before") > F.col("cap")) & (F.col("seq") > F.col("__first"))
    breach = overspent | (~F.col("cached") & (F.col("estimated") > left))
    marked = spent.withColumn("__breach", breach)
    stops = marked.groupBy("job_id").agg(F.min(F.when(F.col("__breach"), F.col("seq"))).alias("__stop"))
    return marked.join(stops, "job_id").select(
        *costs.columns, "cap", "spent_before", F.coalesce(F.col("seq") < F.col("__stop"), F.lit(True)).alias("runs"))


def spend_summary(guarded: DataFrame) -> DataFrame:
    runs, paid = F.col("runs"), ~F.col("cached")
    return guarded.groupBy("job_id").agg(
        F.count_if(runs & paid).alias("new_chunks"), F.count_if(runs & F.col("cached")).alias("reused_chunks"),
        F.count_if(~runs).alias("stopped_chunks"),
        F.coalesce(F.sum(F.when(runs & paid, F.col("actual"))), F.lit(0)).alias("spent"), F.max("cap").alias("cap"),
    ).withColumn("state", F.when(F.col("stopped_chunks") > 0, "cost_limit_exceeded").otherwise("completed"))


def _json_string(text: Column) -> Column:
    """JSON text of a string the way Python writes it with non-ASCII kept."""
    body = F.to_json(F.struct(text.alias("v")))
    return F.substring(body, F.lit(6), F.char_length(body) - 6)


def window_tokens(windows: DataFrame, providers: list[str]) -> DataFrame:
    """Token budget of each window from its provider texts (columns named after providers).

    A provider without a text has an empty one, which still has its name in the request. ASCII is budgeted at three characters a token, anything else at two tokens a character.
    """
    text = {p: F.coalesce(F.col(p), F.lit("")) for p in providers}
    parts = [F.concat(F.lit(f'"{p}": '), _json_string(text[p])) for p in providers]
    serialized = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    out = windows.withColumn("__s", serialized)
    ascii_count = F.char_length(F.regexp_replace("__s", r"[^\x00-\x7F]", ""))
    other = F.char_length("__s") - ascii_count
    needed = F.greatest(text_tokens(F.col("__s")), F.floor((ascii_count + 2) / 3).cast("long") + other * 2) + 500
    longest = F.array_max(F.array(*[text_tokens(text[p]) for p in providers]))
    return out.select(
        *windows.columns, needed.cast("long").alias("estimated_input_tokens"),
        F.greatest(F.lit(900), F.least(F.lit(6000), longest + 1200)).cast("long").alias("max_output_tokens")).drop("__s")


def token_budget(windows: DataFrame, input_price: float, output_price: float, cap_usd: float) -> DataFrame:
    """Cost of a job's windows at prices per million tokens."""
    sums = windows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("window_count"), F.sum("estimated_input_tokens").alias("estimated_input_tokens"),
        F.sum("max_output_tokens").alias("maximum_output_tokens"))
    cost = F.col("estimated_input_tokens") / 1e6 * input_price + F.col("maximum_output_tokens") / 1e6 * output_price
    return sums.select("*", cost.alias("estimated_cost_usd"), authorization(cost).alias("run_budget_cap_usd"),
                       (authorization(cost) <= cap_usd + CAP_SLACK).alias("within_cap"))


def minutes_cost(transcripts: DataFrame, output_tokens_by_style: dict[str, int], input_price: float, output_price: float) -> DataFrame:
    """Estimate for writing minutes: job_id, text, style. An unknown style is ``standard``."""
    styles = F.create_map(*[F.lit(x) for kv in output_tokens_by_style.items() for x in kv])
    style = F.replace(F.lower(F.trim(F.coalesce("style", F.lit("standard")))), F.lit("-"), F.lit("_"))
    known = F.when(F.try_element_at(styles, style).isNotNull(), style).otherwise(F.lit("standard"))
    rows = transcripts.select("job_id", known.alias("style"), text_tokens(F.col("text")).alias("estimated_input_tokens"))
    out = F.try_element_at(styles, F.col("style")).cast("long")
    return rows.select("*", out.alias("estimated_output_tokens"),
                       (F.col("estimated_input_tokens") / 1e6 * input_price + out / 1e6 * output_price).alias("estimated_cost_usd"))
