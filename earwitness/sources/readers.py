"""Readers for the documents of a transcription workspace."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earwitness import schemas
from earwitness.operators.jobs import valid_job_id


def _documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document per file, unreadable ones kept aside in ``_corrupt_record``."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return whole.select(F.from_json("value", schema, options).alias("d"), "file_path").select("d.*", "file_path")


def manifests(spark: SparkSession, glob: str) -> DataFrame:
    """Job manifests; folders starting with ``_``, unreadable files and rows without an id are left out."""
    folder = F.element_at(F.split("file_path", "/"), -2)
    rows = _documents(spark, glob, schemas.job()).withColumn("dir_name", folder)
    return rows.where(
        F.col("_corrupt_record").isNull() & ~F.startswith("dir_name", F.lit("_")) & valid_job_id(F.col("job_id"))
    ).drop("_corrupt_record")


def chunk_transcripts(spark: SparkSession, glob: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Chunk transcripts inside the folder ``root`` and files refused (unreadable or elsewhere)."""
    rows = _documents(spark, glob, schemas.chunk_transcript())
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    folder = posixpath.normpath(re.sub(scheme, "", root)).rstrip("/") + "/"
    inside = F.startswith(F.regexp_replace("file_path", scheme, ""), F.lit(folder)) & ~F.contains("file_path", F.lit("/../"))
    good = inside & F.col("_corrupt_record").isNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good)


def provider_documents(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Retained provider documents and those without a chunk list."""
    rows = _documents(spark, glob, schemas.provider_document())
    good = F.col("_corrupt_record").isNull() & F.col("chunks").isNotNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good)


def raw_responses(spark: SparkSession, glob: str) -> DataFrame:
    """Provider responses as they came, one per file, with whether they parse."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw"))
    return rows.withColumn("readable", F.try_parse_json("raw").isNotNull())


def numbered_lines(spark: SparkSession, glob: str, wanted: Column | None = None) -> DataFrame:
    """Lines of text files with their true numbers: file, line_no, line; those where ``wanted`` holds, if it is given.

    Files are read in byte ranges, so one of any length is the work of many tasks.
    Lines are counted per range, the counts of earlier ranges of a file are added
    up, and a line's number is that sum and its place in its range. Lines end with
    a line feed; a carriage return before it belongs to neither line.
    """
    place = F.monotonically_increasing_id().alias("__place")
    read = spark.read.option("lineSep", "\n").text(glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__range"), place, F.regexp_replace("value", "\r$", "").alias("line"))
    ranges = read.groupBy("file", "__range").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    earlier = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("file", "__range", "__first", F.coalesce(F.sum("__lines").over(earlier), F.lit(0)).alias("__before"))
    lines = read if wanted is None else read.where(wanted)
    return lines.join(offsets, ["file", "__range"]).select("file", (F.col("__place") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "line")


def ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Append-only JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ledger_rejects(spark: SparkSession, glob: str) -> DataFrame:
    """Ledger lines that are neither blank nor a JSON object, with file and number."""
    return numbered_lines(spark, glob, (F.trim("line") != "") & F.json_object_keys("line").isNull())


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation cases, one row each."""
    return spark.read.schema(schemas.eval_case()).option("multiLine", True).json(path)


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob)


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Model registry from configuration; ids and codes must be unique."""
    for name, at in (("model_id", 0), ("provider_code", 2)):
        values = [r[at] for r in rows]
        if len(set(values)) != len(values):
            raise ValueError(f"duplicate {name} in the model registry")
    return spark.createDataFrame(rows, schemas.model_registry())
