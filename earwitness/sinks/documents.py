"""Captions, plain text and HTML tables from ordered rows.

A document is emitted as numbered parts of bounded size. Parts joined in order
give the file byte for byte, so even the longest recording never has to fit into
one row or one task; an ordinary one has a single part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.text import html_escape, speaker_line, strip, timecode, to_ms
from earwitness.operators.scan import scan, slice_of

LINES_PER_PART = 2000


def document_parts(
    rows: DataFrame, keys: Sequence[str], no: str, separator: str, lines_per_part: int = LINES_PER_PART,
) -> DataFrame:
    """Join ``body`` in the order of ``no`` (1, 2, ...): one row per (keys, part)."""
    led = rows.select(
        *keys, no, F.floor((F.col(no) - 1) / lines_per_part).cast("long").alias("part"),
        F.concat(F.when(F.col(no) > 1, F.lit(separator)).otherwise(F.lit("")), F.col("body")).alias("__line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(no, "__line"))), lambda x: x["__line"]), "")
    return led.groupBy(*keys, "part").agg(text.alias("body"), F.count(F.lit(1)).alias("lines"))


def plain_text(chunks: DataFrame) -> DataFrame:
    """Non-empty chunk texts joined by a blank line (``chunk_no`` order)."""
    full = chunks.where(F.col("text") != "").withColumn("body", F.col("text"))
    numbered = scan(full.select("job_id", "chunk_no", "body"), ["job_id"], ["chunk_no"], slice_of("chunk_no", 1024), row_number="line_no")
    return document_parts(numbered, ["job_id"], "line_no", "\n\n")


def cues(segments: DataFrame) -> DataFrame:
    """Segments that can be captions: text, finite ordered times, still ordered after rounding to ms.

    ``segments``: job_id, ord, start_sec, end_sec, speaker, text.
    """
    start, end = F.col("start_sec"), F.col("end_sec")
    finite = (start >= 0) & (start < float("inf")) & (end < float("inf")) & (end > start)
    timed = segments.where(F.coalesce(strip(F.col("text")) != "", F.lit(False)) & finite).withColumns(
        {"start_ms": to_ms(start), "end_ms": to_ms(end)}).where(F.col("end_ms") > F.col("start_ms"))
    return scan(timed, ["job_id"], ["ord"], slice_of("ord", 1024), row_number="cue_no")


def cue_body(separator: str) -> Column:
    return F.concat(
        F.col("cue_no").cast("string"), F.lit("\n"), timecode(F.col("start_ms"), separator), F.lit(" --> "),
        timecode(F.col("end_ms"), separator), F.lit("\n"),
        html_escape(speaker_line(F.col("speaker"), F.col("text")), quote=False))


def srt(segments: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """SubRip parts; recordings without captions have none."""
    return _captions(segments, ",", lines_per_part)


def vtt(segments: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """WebVTT parts; every recording starts with the header, captions or not."""
    body = _captions(segments, ".", lines_per_part, header="WEBVTT\n\n")
    bare = segments.select("job_id").distinct().join(body.select("job_id").distinct(), "job_id", "left_anti")
    return body.unionByName(bare.select(
        "job_id", F.lit(0).cast("long").alias("part"), F.lit("WEBVTT\n").alias("body"), F.lit(0).cast("long").alias("lines")))


def _captions(segments: DataFrame, separator: str, lines_per_part: int, header: str = "") -> DataFrame:
    numbered = cues(segments).withColumn("body", cue_body(separator))
    parts = document_parts(numbered, ["job_id"], "cue_no", "\n\n", lines_per_part)
    last = parts.groupBy("job_id").agg(F.max("part").alias("__last"))
    return parts.join(last, "job_id").select(
        "job_id", "part",
        F.concat(F.when(F.col("part") == 0, F.lit(header)).otherwise(F.lit("")), F.col("body"),
                 F.when(F.col("part") == F.col("__last"), F.lit("\n")).otherwise(F.lit(""))).alias("body"), "lines")


def html_row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def html_cell(value: Column, marker: str = "") -> Column:
    """Escaped text, or an escaped marker where there is none."""
    return html_escape(F.coalesce(F.nullif(value, F.lit("")), F.lit(marker)))


def html_badge(status: Column) -> Column:
    return F.concat(F.lit('<span class="'), html_escape(F.lower(status)), F.lit('">'), html_escape(status), F.lit("</span>"))


def html_table(rows: DataFrame, keys: Sequence[str], no: str, headers: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """Table parts per key: header and opening in the first part, closing in the last."""
    parts = document_parts(rows.withColumn("body", html_row(cells)), keys, no, "\n")
    last = parts.groupBy(*keys).agg(F.max("part").alias("__last"))
    head = "<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in headers) + "</tr></thead><tbody>\n"
    return parts.join(last, list(keys)).select(
        *keys, "part",
        F.concat(F.when(F.col("part") == 0, F.lit(head)).otherwise(F.lit("")), F.col("body"),
                 F.when(F.col("part") == F.col("__last"), F.lit("\n</tbody></table>")).otherwise(F.lit(""))).alias("body"), "lines")


def closed(parts: DataFrame, keys: Sequence[str], head: str, tail: str) -> DataFrame:
    """Parts with ``head`` before the first of a document and ``tail`` after the last."""
    last = parts.groupBy(*keys).agg(F.max("part").alias("__last"))
    body = F.concat(F.when(F.col("part") == 0, F.lit(head)).otherwise(F.lit("")), F.col("body"), F.when(F.col("part") == F.col("__last"), F.lit(tail)).otherwise(F.lit("")))
    return parts.join(last, list(keys)).select(*keys, "part", body.alias("body"), "lines")
