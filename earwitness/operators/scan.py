"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(job)`` puts a whole recording into one task. Here a
key is first cut into buckets along its own order (time slices, ordinal ranges):

1. every bucket is reduced to one summary row (map-side combined),
2. a window runs over the *summaries* only, giving each bucket its carry-in,
3. the carry-in is joined back and a window runs inside (key, bucket).

Rows are shuffled once, on (key, bucket); the join and the inner window share
that partitioning. Results equal the one-window form exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    *,
    row_number: str | None = None,
    sums_before: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``bucket`` must not decrease along ``order`` and must be non-null, as must
    ``keys``; ``order`` must be total within a key.

    * ``row_number``  1-based position within the key
    * ``sums_before`` sum over all earlier rows (0 at the start)
    * ``sums``        sum over earlier rows and this one
    * ``max_before``  maximum over all earlier rows (NULL at the start)
    * ``previous``    the value on the preceding row (NULL at the start)
    * ``following``   the value on the next row (NULL at the end)
    * ``last_known``  latest non-null value up to and including this row
    """
    keys = list(keys)
    ordering = _order(order)
    ordinal = F.struct(*ordering)
    sums_before, sums = dict(sums_before or {}), dict(sums or {})
    max_before, previous = dict(max_before or {}), dict(previous or {})
    following, last_known = dict(following or {}), dict(last_known or {})

    rows = df.withColumn(BUCKET, bucket)
    totals: list[Column] = []
    carries: list[Column] = []
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)

    def total(name: str, expr: Column) -> None:
        totals.append(expr.alias(f"__t_{name}"))

    if row_number:
        total(row_number, F.count(F.lit(1)))
        carries.append(F.coalesce(F.sum(f"__t_{row_number}").over(before), F.lit(0)).alias(f"__c_{row_number}"))
    for name, expr in {**sums_before, **sums}.items():
        total(name, F.sum(expr))
        carries.append(F.sum(f"__t_{name}").over(before).alias(f"__c_{name}"))
    for name, expr in max_before.items():
        total(name, F.max(expr))
        carries.append(F.max(f"__t_{name}").over(before).alias(f"__c_{name}"))
    for name, expr in previous.items():
        total(name, F.max_by(F.struct(expr.alias("v")), ordinal))
        carries.append(F.lag(f"__t_{name}").over(by_bucket).alias(f"__c_{name}"))
    for name, expr in following.items():
        total(name, F.min_by(F.struct(expr.alias("v")), ordinal))
        carries.append(F.lead(f"__t_{name}").over(by_bucket).alias(f"__c_{name}"))
    for name, expr in last_known.items():
        total(name, F.max_by(F.when(expr.isNotNull(), F.struct(expr.alias("v"))),
                             F.when(expr.isNotNull(), ordinal)))
        carries.append(F.last(f"__t_{name}", ignorenulls=True).over(before).alias(f"__c_{name}"))

    carry = rows.groupBy(*keys, BUCKET).agg(*totals).select(*keys, BUCKET, *carries)
    joined = rows.join(carry, [*keys, BUCKET])

    inner = Window.partitionBy(*keys, BUCKET).orderBy(*ordering)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    if row_number:
        out[row_number] = (F.row_number().over(inner) + F.col(f"__c_{row_number}")).cast("long")
    for name, expr in sums_before.items():
        out[name] = F.coalesce(F.sum(expr).over(earlier), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))
    for name, expr in sums.items():
        out[name] = F.coalesce(F.sum(expr).over(upto), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))
    for name, expr in max_before.items():
        out[name] = F.greatest(F.max(expr).over(earlier), F.col(f"__c_{name}"))
    for name, expr in previous.items():
        out[name] = F.coalesce(F.lag(F.struct(expr.alias("v"))).over(inner), F.col(f"__c_{name}"))["v"]
    for name, expr in following.items():
        out[name] = F.coalesce(F.lead(F.struct(expr.alias("v"))).over(inner), F.col(f"__c_{name}"))["v"]
    for name, expr in last_known.items():
        out[name] = F.coalesce(
            F.last(F.when(expr.isNotNull(), F.struct(expr.alias("v"))), ignorenulls=True).over(upto),
            F.col(f"__c_{name}"),
        )["v"]
    result = joined.select("*", *[c.alias(n) for n, c in out.items()])
    return result.drop(BUCKET, *[c for c in result.columns if c.startswith("__c_")])


def slice_of(column: str | Column, width: int) -> Column:
    """Bucket number of a non-negative numeric position."""
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / F.lit(width)).cast("long")
