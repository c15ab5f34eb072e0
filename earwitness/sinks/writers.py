"""Writing results; the file committer makes each write all-or-nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An existing target is an error."""
    df.write.mode("errorifexists").format(fmt).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append ledger events as JSON lines with nulls kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_documents(parts: DataFrame, path: str, key: str = "job_id") -> None:
    """Document parts as text files under one folder per key, in part order.

    Parts are ranged over (key, part), so a very long document is spread over
    tasks and its files still sort in reading order. The text writer ends every
    file with a newline; the newline that opens the next part, or closes the
    document, is left to it, so the files joined give the document.
    """
    last = parts.groupBy(key).agg(F.max("part").alias("__last"))
    body = F.when(F.col("part") > 0, F.regexp_replace("body", r"\A\n", "")).otherwise(F.col("body"))
    body = F.when(F.col("part") == F.col("__last"), F.regexp_replace(body, r"\n\z", "")).otherwise(body)
    (
        parts.join(last, key).select(key, "part", body.alias("value"))
        .repartitionByRange(F.col(key), F.col("part")).sortWithinPartitions(key, "part").select(key, "value")
        .write.mode("errorifexists").partitionBy(key).text(path))
