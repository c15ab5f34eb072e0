"""Joining one-row-per-key facts to rows whose keys may be very unevenly filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str] | str, how: str = "left") -> DataFrame:
    """``rows`` with the facts of their key; ``facts`` holds at most one row per key.

    A plain equi-join: Spark sends facts that its size check finds small to all
    tasks, and splits the partition of a key with many rows at run time. Nothing is
    copied for a skew that may not be there. ``how`` keeps or drops rows of the left side.
    """
    return rows.join(facts, [keys] if isinstance(keys, str) else list(keys), how)
