"""Strict draft: GREEN regions take one provider's text verbatim, the rest wait for a person."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.similarity import all_pair_scores, mean6
from earwitness.functions.text import is_blank
from earwitness.operators.agreement import check_order, text_of


def representatives(classified: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Add the medoid candidate of GREEN regions and every provider's mean similarity.

    The ratio depends on argument order, so each candidate is compared as the
    left side with every other. The left-to-right halves are already in
    ``pairwise``; only the reverse direction is scored here, and only for GREEN.
    """
    order = check_order(provider_order)
    c, green = F.col("candidates"), F.col("agreement_status") == "GREEN"
    usable = [~is_blank(text_of(c, p)) for p in order]
    kept = F.array(*[F.when(u, text_of(c, p)) for u, p in zip(usable, order)])
    formed = classified.withColumn("__back", all_pair_scores(F.when(green, kept), F.lit(True)))
    position = {pair: n for n, pair in enumerate(combinations(range(len(order)), 2))}

    def similarity(a: int, b: int) -> Column:
        source = F.col("__back") if a > b else F.col("pairwise")
        return F.when(usable[a] & usable[b], source[position[min(a, b), max(a, b)]]["derived_similarity"])

    scores = []
    for i in range(len(order)):
        others = [similarity(i, j) for j in range(len(order)) if j != i]
        seen = F.array_compact(F.array(*others)) if others else F.array().cast("array<double>")
        scores.append(F.when(green & usable[i], F.coalesce(mean6(seen), F.lit(1.0))))
    names = F.array(*[F.lit(p) for p in order])
    means = F.map_filter(F.map_from_arrays(names, F.array(*scores)), lambda _, v: v.isNotNull())
    formed = formed.withColumn("representative_scores", means)
    best = F.array_max(F.transform(F.map_entries("representative_scores"), lambda e: F.struct(
        e["value"].alias("score"), (-F.array_position(names, e["key"])).alias("rank"))))
    return formed.withColumn("__best", best).select(
        *classified.columns, "representative_scores",
        F.when(green, F.try_element_at(names, (-F.col("__best.rank")).cast("int"))).alias("selected_provider"))


def final_draft(classified: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Draft windows. Needs job_id, region_id, start_sec, end_sec, candidates and the agreement columns."""
    picked = representatives(classified, provider_order)
    accepted = F.col("agreement_status") == "GREEN"
    chosen = F.when(accepted, F.try_element_at(F.col("candidates"), F.col("selected_provider"))["text"])
    return picked.select(
        "job_id", F.col("region_id").alias("window_id"), "start_sec", "end_sec",
        (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
        F.col("agreement_status").alias("derived_status"), F.col("candidates").alias("provider_candidates"),
        chosen.alias("final_text"), chosen.alias("selected_text"), "selected_provider",
        F.when(accepted, F.lit("deterministic_representative")).alias("selection_method"),
        F.when(accepted, F.col("representative_scores")).alias("representative_scores"),
        accepted.alias("auto_accepted"), (~accepted).alias("review_required"),
    )


def draft_errors(regions: DataFrame) -> DataFrame:
    """Regions a draft cannot be built from: blank or repeated id, bad bounds, unknown status."""
    counts = regions.groupBy("job_id", "region_id").agg(F.count(F.lit(1)).alias("__n"))
    return regions.join(counts, ["job_id", "region_id"]).withColumn("errors", F.array_compact(F.array(
        F.when(is_blank(F.col("region_id")) | (F.col("__n") > 1), F.lit("region_id must be present and unique")),
        F.when(~(F.col("end_sec") > F.col("start_sec")), F.lit("invalid bounds")),
        F.when(~F.coalesce(F.col("agreement_status").isin("GREEN", "AMBER", "RED"), F.lit(False)), F.lit("unsupported status")),
    ))).drop("__n").where(F.size("errors") > 0)


def draft_statistics(draft: DataFrame) -> DataFrame:
    return draft.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("auto_accepted").alias("auto_accepted"),
        F.count_if("review_required").alias("review_required"),
        *[F.count_if(F.col("derived_status") == s).alias(s.lower()) for s in ("GREEN", "AMBER", "RED")],
    )
