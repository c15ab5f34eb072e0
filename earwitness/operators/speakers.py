"""Speaker turns from timed words, evidence on windows, local speakers and human names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from earwitness.functions.hashing import local_speaker_key
from earwitness.functions.text import is_blank, join_words, strip
from earwitness.operators.fold import Fold, sorted_fold
from earwitness.operators.intervals import overlap_join
from earwitness.operators.latest import latest
from earwitness.operators.scan import scan, slice_of
from earwitness.operators.skew import lookup

SLICE = 600.0


def speaker_turns(words: DataFrame, slice_width: float = SLICE) -> DataFrame:
    """Merge consecutive words of one speaker, run and chunk into turns.

    ``words``: job_id, word_no (input order), text, speaker, run_id,
    chunk_filename, start, end. A missing speaker is a speaker of its own (NULL
    equals NULL). A turn ends where its last word ends, even if an earlier word
    ran longer. A turn never leaves its chunk, which bounds the words collected.
    """
    order = ["start", "end", "word_no"]
    named = words.withColumn("speaker", F.nullif(strip(F.col("speaker")), F.lit("")))
    here = F.struct("speaker", "run_id", "chunk_filename")
    seen = scan(named, ["job_id"], order, slice_of("start", slice_width), previous={"__before": here})
    changed = (~F.col("__before").eqNullSafe(here)).cast("long")
    numbered = scan(
        seen.withColumn("__new", changed).drop("__before"), ["job_id"], order, slice_of("start", slice_width),
        sums={"turn_no": F.col("__new")})
    items = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return numbered.groupBy("job_id", "turn_no", "run_id", "chunk_filename", "speaker").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct(*order)).alias("end"),
        F.count(F.lit(1)).alias("word_count"), items.alias("__items"),
    ).withColumn("text", join_words(F.transform("__items", lambda w: w["text"]))).drop("__items").withColumn(
        "segment_id", F.format_string("speaker-segment-%05d", "turn_no"))


def word_errors(words: DataFrame) -> DataFrame:
    """Words with impossible times."""
    return words.where((F.col("start") < 0) | ~(F.col("end") > F.col("start")))


def timeline_statistics(turns: DataFrame) -> DataFrame:
    """Speakers in first-heard order, words and turns per recording.

    Speakers are reduced to one row each before they are collected.
    """
    heard = turns.where(F.col("speaker").isNotNull()).groupBy("job_id", "speaker").agg(F.min("turn_no").alias("first"))
    names = heard.groupBy("job_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda s: s["speaker"]).alias("speaker_ids"))
    totals = turns.groupBy("job_id").agg(F.sum("word_count").alias("word_count"), F.count(F.lit(1)).alias("segment_count"))
    none = F.array().cast("array<string>")
    return totals.join(names, "job_id", "left").select(
        "job_id", F.coalesce("speaker_ids", none).alias("speaker_ids"),
        F.size(F.coalesce("speaker_ids", none)).cast("long").alias("speaker_count"), "word_count", "segment_count")


def window_evidence(windows: DataFrame, turns: DataFrame, slice_width: float) -> DataFrame:
    """Turn rows that overlap each window (``start``/``end`` columns on both sides)."""
    w = windows.select("job_id", "window_id", F.col("start").alias("__ws"), F.col("end").alias("__we"))
    t = turns.select("job_id", "turn_no", "speaker", "run_id", "chunk_filename", "start", "end")
    return overlap_join(w, t, ["job_id"], ("__ws", "__we"), ("start", "end"), slice_width).drop("__ws", "__we")


def attach_evidence(windows: DataFrame, turns: DataFrame, slice_width: float) -> DataFrame:
    """Windows with their distinct speakers (first-heard order) and overlapping turn numbers; text untouched.

    A window is short, so what it collects is bounded by its own length.
    """
    found = window_evidence(windows, turns, slice_width).groupBy("job_id", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_no", "speaker"))).alias("__t"))
    speakers = F.array_distinct(F.filter(F.transform("__t", lambda x: x["speaker"]), lambda s: s.isNotNull()))
    evidence = found.select(
        "job_id", "window_id", speakers.alias("speaker_ids"), F.transform("__t", lambda x: x["turn_no"]).alias("turn_nos"))
    return windows.join(evidence, ["job_id", "window_id"], "left").withColumns({
        "speaker_ids": F.coalesce("speaker_ids", F.array().cast("array<string>")),
        "turn_nos": F.coalesce("turn_nos", F.array().cast("array<bigint>"))})


def sensitive_windows(evidence: DataFrame) -> DataFrame:
    """Windows whose diarisation needs a person: several speakers or an unlabelled turn.

    Overlapping turns of different speakers imply one of the two, so no pair has
    to be formed to decide; ``overlapping_turns`` lists such pairs on request.
    """
    return evidence.groupBy("job_id", "window_id").agg(
        F.count_distinct("speaker").alias("speaker_count"),
        F.count_if(is_blank(F.col("speaker"))).alias("unlabelled_turns"),
    ).where((F.col("speaker_count") > 1) | (F.col("unlabelled_turns") > 0))


def overlapping_turns(turns: DataFrame, slice_width: float) -> DataFrame:
    """Pairs of turns of different speakers that overlap in time, found slice by slice."""
    left = turns.select("job_id", F.col("turn_no").alias("left_turn"), F.col("speaker").alias("left_speaker"),
                        F.col("start").alias("__ls"), F.col("end").alias("__le"))
    right = turns.select("job_id", F.col("turn_no").alias("right_turn"), F.col("speaker").alias("right_speaker"),
                         F.col("start").alias("__rs"), F.col("end").alias("__re"))
    return overlap_join(left, right, ["job_id"], ("__ls", "__le"), ("__rs", "__re"), slice_width).where(
        (F.col("left_turn") < F.col("right_turn")) & ~F.col("left_speaker").eqNullSafe(F.col("right_speaker"))
    ).select("job_id", "left_turn", "right_turn", "left_speaker", "right_speaker")


def first_seen_labels(segments: DataFrame) -> DataFrame:
    """``Speaker n`` by first appearance inside a chunk. Needs job_id, chunk_filename, pos, provider_speaker.

    Ranks are given to the distinct speakers, then joined back to the rows.
    """
    from pyspark.sql import Window

    keys = ["job_id", "chunk_filename"]
    heard = segments.groupBy(*keys, "provider_speaker").agg(F.min("pos").alias("__first"))
    ranked = heard.withColumn("speaker_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__first")).cast("long"))
    return segments.join(ranked.drop("__first"), [*keys, "provider_speaker"]).withColumn(
        "speaker", F.concat(F.lit("Speaker "), F.col("speaker_rank").cast("string")))


def local_speakers(turns: DataFrame, provider_code: Column) -> DataFrame:
    """One row per provider speaker scope (provider, run, chunk, speaker) with its stable key."""
    keyed = turns.where(F.col("speaker").isNotNull()).withColumn(
        "local_speaker_key", local_speaker_key(provider_code, F.col("run_id"), F.col("chunk_filename"), F.col("speaker")))
    return keyed.groupBy("job_id", "local_speaker_key").agg(
        F.first("speaker").alias("provider_speaker_id"), F.first("run_id").alias("run_id"),
        F.first("chunk_filename").alias("chunk_filename"), F.min("turn_no").alias("first_turn"))


class _CanonicalIds(Fold):
    """Current mapping of one recording's speakers; state is one id per mapped speaker."""

    def __init__(self) -> None:
        self.current: dict[str, str] = {}

    def feed(self, row):
        chosen = (row.canonical_speaker_id or "").strip() or self.current.get(row.local_speaker_key)
        if not chosen:
            taken, n = set(self.current.values()), 1
            while f"canonical-speaker-{n:03d}" in taken:
                n += 1
            chosen = f"canonical-speaker-{n:03d}"
        self.current[row.local_speaker_key] = chosen
        return [(row.job_id, row.seq, row.local_speaker_key, chosen, row.display_name)]


MAPPING_EVENTS = StructType([
    StructField("job_id", LongType()), StructField("seq", LongType()), StructField("local_speaker_key", StringType()),
    StructField("canonical_speaker_id", StringType()), StructField("display_name", StringType()),
])


def mapping_errors(events: DataFrame, speakers: DataFrame) -> DataFrame:
    """Human naming events with their faults: unknown scope, blank name, malformed id."""
    known = speakers.select("job_id", "local_speaker_key", F.lit(True).alias("__known"))
    bad_id = (F.coalesce(F.col("canonical_speaker_id"), F.lit("")) != "") & ~F.col("canonical_speaker_id").rlike(
        r"^[\p{L}\p{N}._-]{1,128}$")
    return events.join(known, ["job_id", "local_speaker_key"], "left").withColumn("errors", F.array_compact(F.array(
        F.when(F.col("__known").isNull(), F.lit("unknown local provider speaker scope")),
        F.when(is_blank(F.col("display_name")), F.lit("display_name must contain a label")),
        F.when(bad_id, F.lit("canonical_speaker_id is malformed")),
    ))).drop("__known")


def canonical_ids(events: DataFrame, seqs_per_slice: int = 100_000) -> DataFrame:
    """Replay naming events in order: keep a speaker's id, else give the smallest free one.

    Only a speaker's first event and events that bring their own id can change
    the mapping, so only those are replayed; every other event takes the id its
    speaker had, found by a sliced scan.
    """
    job = events.schema["job_id"]
    schema = StructType([StructField("job_id", job.dataType), *MAPPING_EVENTS.fields[1:]])
    keys = ["job_id", "local_speaker_key"]
    clean = events.select(
        "job_id", F.col("seq").cast("long").alias("seq"), "local_speaker_key",
        F.nullif(strip(F.col("canonical_speaker_id")), F.lit("")).alias("canonical_speaker_id"), strip(F.col("display_name")).alias("display_name"))
    first = clean.groupBy(*keys).agg(F.min("seq").alias("__first"))
    marked = lookup(clean, first, keys, "inner")
    deciding = (F.col("seq") == F.col("__first")) | F.col("canonical_speaker_id").isNotNull()
    replayed = sorted_fold(marked.where(deciding).drop("__first"), ["job_id"], ["seq"], _CanonicalIds, schema)
    rest = marked.where(~deciding).drop("__first")
    return scan(
        replayed.unionByName(rest), keys, ["seq"], slice_of("seq", seqs_per_slice), last_known={"__id": F.col("canonical_speaker_id")},
    ).withColumn("canonical_speaker_id", F.col("__id")).drop("__id")


def display_labels(speakers: DataFrame, mappings: DataFrame) -> DataFrame:
    """Local speakers with ``Name [id]`` where a person named them, else the provider id."""
    now = latest(mappings, ["job_id", "local_speaker_key"], ["seq"]).select(
        "job_id", "local_speaker_key", "canonical_speaker_id", "display_name")
    label = F.when(
        F.col("display_name").isNotNull(),
        F.concat("display_name", F.lit(" ["), "provider_speaker_id", F.lit("]"))).otherwise(
        F.coalesce("provider_speaker_id", F.lit("UNLABELLED")))
    return speakers.join(now, ["job_id", "local_speaker_key"], "left").withColumn("display_label", label)


def changed_texts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Windows whose text an overlay altered, lost or added; must be empty."""
    def snap(df: DataFrame, side: str) -> DataFrame:
        digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        return df.select("job_id", "window_id", digest.alias(side))

    return snap(before, "b").join(snap(after, "a"), ["job_id", "window_id"], "full").where(~F.col("b").eqNullSafe(F.col("a")))
