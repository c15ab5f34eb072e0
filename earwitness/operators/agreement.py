"""How far providers agree on a region, and what status follows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.functions.similarity import SCORE_FIELDS, all_pair_scores, compact_lengths, mean6
from earwitness.functions.text import is_blank
from earwitness.params import AgreementThresholds

def check_order(provider_order: Sequence[str]) -> tuple[str, ...]:
    order = tuple(provider_order)
    if not order or len(set(order)) != len(order):
        raise ValueError("provider_order must hold unique provider codes")
    return order


def missing_in(candidates: Column, provider: str) -> Column:
    return F.coalesce(candidates[provider]["missing"], F.lit(True))


def text_of(candidates: Column, provider: str) -> Column:
    """Text of a present candidate; NULL when the provider is missing."""
    return F.when(~missing_in(candidates, provider), F.coalesce(candidates[provider]["text"], F.lit("")))


def texts_in_order(candidates: Column, order: Sequence[str]) -> Column:
    return F.array(*[text_of(candidates, p) for p in order])


def with_pairwise(regions: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Add ``pairwise``: one entry per unordered provider pair, in provider order.

    Pairs come from the fixed provider list, inside the region row: no self-join
    and no shuffle. A pair with a missing side keeps NULL scores.
    """
    order = check_order(provider_order)
    scored = regions.withColumn("__scores", all_pair_scores(texts_in_order(F.col("candidates"), order), F.lit(False)))
    names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in combinations(order, 2)])
    if len(order) == 1:
        names = F.array().cast("array<array<string>>")
    pairwise = F.zip_with(names, "__scores", lambda pair, score: F.struct(
        pair.alias("providers"), score["derived_similarity"].isNull().alias("missing"),
        *[score[f].alias(f) for f in SCORE_FIELDS]))
    return scored.withColumn("pairwise", pairwise).drop("__scores")


def with_length_ratio(regions: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """Add ``min_length_ratio``: the least length ratio over pairs of present candidates, as ``pairwise`` has it.

    NULL where fewer than two are present. Only lengths are taken; nothing is compared.
    """
    sized = regions.withColumn("__lengths", F.array_compact(compact_lengths(texts_in_order(F.col("candidates"), check_order(provider_order)))))
    # The shortest and the longest text have the least ratio.
    short, long = F.array_min("__lengths").cast("double"), F.array_max("__lengths").cast("double")
    least = F.when(long == 0, F.lit(1.0)).otherwise(round_exact(F.try_divide(short, long), 6))
    return sized.withColumn("min_length_ratio", F.when(F.size("__lengths") > 1, least)).drop("__lengths")


def classify(
    regions: DataFrame, provider_order: Sequence[str], thresholds: AgreementThresholds = AgreementThresholds(),
) -> DataFrame:
    """Add agreement status, score, reasons and pairwise scores; candidate text is untouched."""
    order = check_order(provider_order)
    c = F.col("candidates")
    present = F.filter(F.col("pairwise"), lambda p: ~p["missing"])
    derived = F.transform(present, lambda p: p["derived_similarity"])
    lengths = F.transform(present, lambda p: p["length_ratio"])
    scored = with_pairwise(regions, order).select(
        "*",
        F.array_compact(F.array(*[F.when(missing_in(c, p), F.lit(p)) for p in order])).alias("__missing"),
        F.array_compact(F.array(*[F.when(~missing_in(c, p) & is_blank(text_of(c, p)), F.lit(p)) for p in order])).alias("__empty"),
        F.coalesce(mean6(derived), F.lit(0.0)).alias("__mean"),
        F.coalesce(F.array_min(derived), F.lit(0.0)).alias("__min"),
        F.coalesce(F.array_min(lengths), F.lit(0.0)).alias("__len"),
    )
    missing, empty = F.size("__missing") > 0, F.size("__empty") > 0
    short = F.col("__len") < thresholds.red_length_ratio
    apart = (F.col("__min") < thresholds.red_min_pairwise) | (F.col("__mean") < thresholds.red_mean_pairwise)
    close = (F.col("__min") >= thresholds.green_min_pairwise) & (F.col("__mean") >= thresholds.green_mean_pairwise)
    status = F.when(missing | empty | short | apart, "RED").when(close, "GREEN").otherwise("AMBER")

    def said(text: str) -> Column:
        return F.format_string(text + "; minimum pair %.3f, mean %.3f.", "__min", "__mean")

    reason = (
        F.when(missing, F.concat(F.lit("Missing provider candidate: "), F.array_join("__missing", ", "), F.lit(".")))
        .when(empty, F.concat(F.lit("Empty provider candidate: "), F.array_join("__empty", ", "), F.lit(".")))
        .when(short, F.format_string("Substantial text-length difference; minimum pair length ratio %.3f.", "__len"))
        .when(apart, said("Major derived disagreement"))
        .when(close, said("Substantial derived agreement"))
        .otherwise(said("Meaningful derived differences"))
    )
    return scored.select(
        "*", status.alias("agreement_status"),
        F.when(missing, F.lit(0.0)).otherwise(F.col("__mean")).alias("derived_agreement_score"),
        F.array(reason).alias("agreement_reasons"),
    ).drop("__missing", "__empty", "__mean", "__min", "__len")


def status_counts(classified: DataFrame) -> DataFrame:
    """GREEN / AMBER / RED per recording, zeros kept."""
    return classified.groupBy("job_id").agg(
        *[F.count_if(F.col("agreement_status") == s).alias(s.lower()) for s in ("GREEN", "AMBER", "RED")],
        F.count(F.lit(1)).alias("regions"),
    )
