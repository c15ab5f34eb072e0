"""Evidence-preserving corrections of transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from earwitness.functions.hashing import correction_id, sha256_text
from earwitness.functions.text import is_blank, speaker_line, strip
from earwitness.operators.fold import Fold, sorted_fold
from earwitness.operators.latest import latest
from earwitness.operators.scan import scan, slice_of
from earwitness.operators.skew import lookup

KEYS = ["job_id", "segment_id"]


class _Replay(Fold):
    """Carries one hash: that of the segment's present text."""

    current: str | None = None

    def feed(self, row):
        if self.current is None:
            self.current = row.segment_sha256
        fresh = row.expected_original_sha256 is None or row.expected_original_sha256 == self.current
        if fresh:
            self.current = row.accepted_sha256
        return [(row.job_id, row.segment_id, row.seq, row.segment_sha256, row.accepted_sha256, fresh)]


def check_corrections(events: DataFrame, segments: DataFrame, seqs_per_slice: int = 100_000) -> DataFrame:
    """Add ``errors`` and the hash each event found. Only hashes pass through the replay.

    An event without an expected hash is accepted whatever came before, so the
    text after it is known: a segment's history is cut there and the pieces are
    replayed side by side.

    ``events``: job_id, seq, segment_id, accepted_text, reason, reviewer, corrected_at,
    expected_original_sha256. ``segments``: job_id, segment_id, text.
    """
    fields = ("segment_id", "accepted_text", "reason", "reviewer")
    known = segments.select(*KEYS, sha256_text(F.coalesce("text", F.lit(""))).alias("segment_sha256"))
    joined = lookup(events, known, KEYS).withColumn("errors", F.array_compact(F.array(
        *[F.when(is_blank(F.col(f)), F.lit(f"{f} must be a non-empty string")) for f in fields],
        F.when(F.col("segment_sha256").isNull(), F.lit("unknown segment_id")),
    )))
    legal = joined.where(F.size("errors") == 0).select(
        *KEYS, F.col("seq").cast("long").alias("seq"), "segment_sha256", "expected_original_sha256",
        sha256_text(strip(F.col("accepted_text"))).alias("accepted_sha256"))
    bucket = slice_of("seq", seqs_per_slice)
    runs = scan(legal, KEYS, ["seq"], bucket, sums={"run": F.col("expected_original_sha256").isNull().cast("long")})
    schema = StructType([
        StructField("job_id", events.schema["job_id"].dataType), StructField("segment_id", StringType()), StructField("seq", LongType()),
        StructField("segment_sha256", StringType()), StructField("accepted_sha256", StringType()), StructField("__fresh", BooleanType())])
    replayed = sorted_fold(runs, [*KEYS, "run"], ["seq"], _Replay, schema)
    found = scan(replayed, KEYS, ["seq"], bucket, max_before={"__last": F.when(
        F.col("__fresh"), F.struct(F.col("seq").alias("at"), F.col("accepted_sha256").alias("sha")))})
    verdicts = found.select(*KEYS, "seq", "__fresh", F.coalesce("__last.sha", "segment_sha256").alias("original_text_sha256"))
    stale = F.array(F.lit("expected original hash is stale or does not match"))
    return joined.drop("segment_sha256").join(verdicts, [*KEYS, "seq"], "left").withColumn(
        "errors", F.when(F.col("__fresh") == F.lit(False), F.concat("errors", stale)).otherwise(F.col("errors"))).drop("__fresh")


def correction_history(checked: DataFrame) -> DataFrame:
    """Accepted events with their content-derived id."""
    accepted = strip(F.col("accepted_text"))
    rows = checked.where(F.size("errors") == 0).withColumns({
        "accepted_text": accepted, "accepted_text_sha256": sha256_text(accepted)})
    identity = {c: F.col(c) for c in (
        "segment_id", "accepted_text", "reason", "reviewer", "corrected_at", "original_text_sha256", "accepted_text_sha256")}
    return rows.drop("errors").withColumn("correction_id", correction_id(identity))


def corrected_segments(segments: DataFrame, history: DataFrame) -> DataFrame:
    """Segments carrying the latest accepted text."""
    last = latest(history.select(*KEYS, "seq", "accepted_text"), KEYS, ["seq"])
    counts = history.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("correction_count"))
    return (
        segments.join(last.drop("seq"), KEYS, "left").join(counts, KEYS, "left")
        .withColumn("text", F.coalesce("accepted_text", "text")).drop("accepted_text")
        .withColumn("correction_count", F.coalesce("correction_count", F.lit(0).cast("long"))))


def rebuilt_chunks(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Chunk texts after correction: rendered segment lines, or the chunk's own text where it has no segments.

    ``segments``: job_id, chunk_filename, ord, speaker, text. One chunk's segments are bounded by its length.
    """
    lines = segments.groupBy("job_id", "chunk_filename").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", speaker_line(F.col("speaker"), F.col("text")).alias("line")))),
        lambda s: s["line"]), "\n").alias("__text"))
    return chunks.join(lines, ["job_id", "chunk_filename"], "left").withColumn(
        "text", F.coalesce("__text", "text")).drop("__text")
