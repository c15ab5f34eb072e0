"""Signal facts of binary audio, captured logs and probe output."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.numbers import round_exact
from earwitness.operators.scan import scan, slice_of
from earwitness.operators.skew import lookup
from earwitness.session import cut_lineage, spread

# Signal thresholds.
NEAR_SILENCE_DBFS = -50.0
CLIPPING_FRACTION = 0.99
POSSIBLE_CLIPPING_DBFS = -0.1


def sampling_band(rate: Column) -> Column:
    return (F.when(F.coalesce(rate, F.lit(0)) == 0, "unknown").when(rate < 12000, "narrowband")
            .when(rate < 32000, "wideband").otherwise("fullband"))


def nominal_bandwidth(rate: Column) -> Column:
    return (F.when(F.coalesce(rate, F.lit(0)) <= 0, "UNKNOWN").when(rate < 16000, "NARROWBAND")
            .when(rate < 32000, "WIDEBAND").otherwise("FULLBAND"))


def legacy_class(codec: Column, rate: Column) -> Column:
    r = F.coalesce(rate, F.lit(0))
    return (F.when((F.lower(F.coalesce(codec, F.lit(""))) == "amr_nb") | ((r != 0) & (r <= 8000)), "LEGACY_NARROWBAND")
            .when(r >= 12000, "WIDEBAND_MODERN").otherwise("UNKNOWN"))


def probe_profiles(probes: DataFrame) -> DataFrame:
    """Structural profile from probe JSON: file, raw. Files without an audio stream are marked."""
    v = F.try_parse_json("raw")
    streams = F.coalesce(F.try_variant_get(v, "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    audio = F.filter(streams, lambda s: F.try_variant_get(s, "$.codec_type", "string") == "audio")
    rows = probes.select("file", v.alias("v"), F.try_element_at(audio, F.lit(1)).alias("s"))

    def text(path: str) -> Column:
        return F.try_variant_get("s", f"$.{path}", "string")

    def whole(path: str) -> Column:
        return text(path).try_cast("double").cast("long")

    return rows.select(
        "file", F.when(F.col("s").isNull(), F.lit("audio_stream_missing")).alias("error"),
        F.try_variant_get("v", "$.format.format_name", "string").alias("container"),
        text("codec_name").alias("codec"), whole("sample_rate").alias("sample_rate_hz"), whole("channels").alias("channels"),
        text("channel_layout").alias("channel_layout"),
        F.coalesce(whole("bit_rate"), F.try_variant_get("v", "$.format.bit_rate", "string").try_cast("double").cast("long")).alias("bit_rate_bps"),
        F.coalesce(text("duration").try_cast("double"), F.try_variant_get("v", "$.format.duration", "string").try_cast("double")).alias("duration_seconds"),
        text("sample_fmt").alias("sample_format"), whole("bits_per_sample").alias("bits_per_sample"),
    ).withColumns({
        "sampling_band": sampling_band(F.col("sample_rate_hz")), "nominal_bandwidth_class": nominal_bandwidth(F.col("sample_rate_hz")),
        "legacy_quality_classification": legacy_class(F.col("codec"), F.col("sample_rate_hz"))})


def silence_intervals(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Silence intervals from detector log lines (file, line_no, line).

    An end without a start opens at 0; a start left open closes at the end of the
    recording. ``durations``: file, duration_sec.
    """
    pattern = r"{}:\s*([0-9]+(?:\.[0-9]+)?)"
    start = F.regexp_extract("line", pattern.format("silence_start"), 1).try_cast("double")
    end = F.regexp_extract("line", pattern.format("silence_end"), 1).try_cast("double")
    marks = lines.select("file", "line_no", start.alias("s"), end.alias("e")).where("s IS NOT NULL OR e IS NOT NULL")
    bucket = slice_of("line_no", 4096)
    # A start is consumed by the end that follows it: look back for the latest mark of either kind.
    seen = scan(marks, ["file"], ["line_no"], bucket, previous={"__last": F.when(F.col("e").isNull(), F.col("s"))},
                following={"__next": F.lit(True)})
    opened = F.coalesce("s", "__last", F.lit(0.0))
    closed = lookup(seen, durations, "file", "inner").select(
        "file", "line_no", "duration_sec", "e", "s", "__next", opened.alias("opened"))
    ended = closed.where("e IS NOT NULL").select(
        "file", "line_no", F.col("opened").alias("start_sec"), F.least("e", "duration_sec").alias("end_sec"))
    dangling = closed.where("e IS NULL AND __next IS NULL").select(
        "file", "line_no", F.col("s").alias("start_sec"), F.col("duration_sec").alias("end_sec"))
    return ended.unionByName(dangling).where("end_sec > start_sec")


def signal_statistics(lines: DataFrame) -> DataFrame:
    """Per-file statistics from captured signal logs (file, line_no, line).

    A section header applies to the lines after it until the next header. Files
    without overall peak and RMS failed.
    """
    payload = F.trim(F.substring(F.col("line"), F.position(F.lit("] "), F.col("line")) + 2, F.char_length("line")))
    rows = lines.where(F.contains("line", F.lit("] "))).select("file", "line_no", payload.alias("p"))
    channel = F.regexp_extract("p", r"^Channel: *(\d+)", 1)
    section = F.when(F.col("p") == "Overall", "overall").when(channel != "", F.concat(F.lit("channel_"), channel))
    placed = scan(rows, ["file"], ["line_no"], slice_of("line_no", 4096), last_known={"section": section})
    value = F.substring_index("p", ": ", -1).try_cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    labelled = placed.where("section IS NOT NULL").select(
        "file", "section", "line_no", F.substring_index("p", ": ", 1).alias("label"), finite.alias("value"))

    def stat(label: str) -> Column:
        return F.max_by(F.when(F.col("label") == label, F.struct(F.col("value").alias("v"))),
                        F.when(F.col("label") == label, F.col("line_no")))["v"]

    sections = labelled.groupBy("file", "section").agg(
        stat("Peak level dB").alias("peak_level_dbfs"), stat("RMS level dB").alias("rms_level_dbfs"),
        stat("Noise floor dB").alias("noise_floor_dbfs"))
    per_file = lines.select("file").distinct().join(
        sections.where("section = 'overall'").drop("section"), "file", "left")
    channels = sections.where("section != 'overall'").groupBy("file").agg(F.count(F.lit(1)).alias("channel_count"))
    ok = F.col("peak_level_dbfs").isNotNull() & F.col("rms_level_dbfs").isNotNull()
    return per_file.join(channels, "file", "left").select(
        "file", F.when(ok, "success").otherwise("analysis_failed").alias("status"),
        "peak_level_dbfs", "rms_level_dbfs", "noise_floor_dbfs", F.coalesce("channel_count", F.lit(0)).alias("channel_count"),
        F.coalesce(F.col("peak_level_dbfs") >= POSSIBLE_CLIPPING_DBFS, F.lit(False)).alias("possible_clipping"))


def file_identity(files: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of ``binaryFile`` rows."""
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


PCM_SCHEMA = (
    "path string, status string, sample_width_bytes int, sample_rate_hz int, channels int, frame_count long, "
    "sample_count long, peak_dbfs double, near_silence_ratio double, clipping_ratio double, warnings array<string>")
_BLOCK = 1 << 20


def _wav_layout(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(channels, rate, bits, data offset, data size) of a RIFF/WAVE file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            fmt = channels, rate, bits
        elif name == b"data" and fmt:
            return (*fmt, at + 8, min(size, len(data) - at - 8))
        at += 8 + size + (size & 1)
    return None


def _measure(path: str, data: bytes) -> tuple:
    layout = _wav_layout(data)
    if layout is None:
        return path, "not_wav", None, None, None, None, None, None, None, None, ["not_a_wav_file"]
    channels, rate, bits, offset, size = layout
    width = bits // 8
    frames = size // max(1, width * channels)
    if width != 2:
        return (path, "not_analyzed", width, rate, channels, frames, None, None, None, None,
                ["pcm_signal_analysis_requires_16_bit_wav"])
    quiet = max(1, round(32767 * 10 ** (NEAR_SILENCE_DBFS / 20.0)))
    loud = round(32767 * CLIPPING_FRACTION)
    peak = silent = clipped = total = 0
    end = offset + frames * width * channels
    for at in range(offset, end, 2 * _BLOCK):
        block = np.frombuffer(data, dtype="<i2", count=min(_BLOCK, (end - at) // 2), offset=at)
        level = np.minimum(np.abs(block.astype(np.int32)), 32767)
        total += level.size
        peak = max(peak, int(level.max(initial=0)))
        silent += int((level <= quiet).sum())
        clipped += int((level >= loud).sum())
    silent_ratio, clip_ratio = silent / max(1, total), clipped / max(1, total)
    warnings = ["possible_clipping"] * (clip_ratio >= 0.01) + ["mostly_near_silence"] * (silent_ratio >= 0.95)
    return (path, "pass_with_warnings" if warnings else "pass", width, rate, channels, frames, total,
            round(20.0 * math.log10(peak / 32767.0), 4) if peak else None, round(silent_ratio, 8), round(clip_ratio, 8), warnings)


def pcm_statistics(files: DataFrame) -> DataFrame:
    """Signal statistics of WAV files given as ``binaryFile`` rows; samples never become rows."""
    names = [part.split()[0] for part in PCM_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_measure(p, c) for p, c in zip(batch["path"], batch["content"])], columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, PCM_SCHEMA)


#: Bytes of a file that a task holds at once, and that one row of ranges stands for.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 128 << 20


def listed(files: DataFrame) -> DataFrame:
    """Paths and lengths of ``binaryFile`` rows; Spark lists files without reading what isn't asked for."""
    return files.select("path", "length")


def _opened(path: str):
    """A file of the shared store for reading at any place. Schemes are those that Arrow knows."""
    from pyarrow import fs

    if re.match("file:/|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:(//)?(?=/)", "", path))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            digest, size = hashlib.sha256(), 0
            with _opened(path) as file:
                while block := file.read(BLOCK_BYTES):
                    digest.update(block)
                    size += len(block)
            yield pa.RecordBatch.from_pydict({"path": [path], "size_bytes": [size], "sha256": [digest.hexdigest()]})


def streamed_identity(files: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of files of any length (``listed``): a task streams one file at a time, a block in memory."""
    return spread(listed(files), "path").select("path").mapInArrow(_hashed, "path string, size_bytes long, sha256 string")


def _streamed_layout(file, size: int) -> tuple[int, int, int, int, int] | None:
    """As ``_wav_layout``, from chunk headers alone."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt " and length >= 16:
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            fmt = channels, rate, bits
        elif name == b"data" and fmt:
            return (*fmt, at + 8, min(length, size - at - 8))
        at += 8 + length + (length & 1)
    return None


_LAYOUT = "path string, channels int, sample_rate_hz int, bits int, data_at long, data_bytes long"
_RANGE_STATS = "path string, peak long, silent long, clipped long, total long"


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _LAYOUT.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            with _opened(path) as file:
                rows.append((path, *(_streamed_layout(file, size) or (None,) * 5)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _range_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quiet, loud = max(1, round(32767 * 10 ** (NEAR_SILENCE_DBFS / 20.0))), round(32767 * CLIPPING_FRACTION)
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            peak = silent = clipped = total = 0
            with _opened(path) as file:
                file.seek(start)
                for at in range(start, end, BLOCK_BYTES):
                    level = np.minimum(np.abs(np.frombuffer(file.read(min(BLOCK_BYTES, end - at)), "<i2").astype(np.int32)), 32767)
                    peak, total = max(peak, int(level.max(initial=0))), total + level.size
                    silent, clipped = silent + int((level <= quiet).sum()), clipped + int((level >= loud).sum())
            yield pa.RecordBatch.from_pydict({"path": [path], "peak": [peak], "silent": [silent], "clipped": [clipped], "total": [total]})


def streamed_pcm_statistics(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of ``pcm_statistics`` for files of any length (``listed``).

    Headers are read by seeking; samples are measured range by range, each the work of
    any task, and the few numbers of the ranges add up. No file is a row, and memory
    is bounded by a block.
    """
    layouts = cut_lineage(spread(listed(files), "path").mapInArrow(_layouts, _LAYOUT))
    width = F.floor(F.col("bits") / 8).cast("int")
    frames = F.floor(F.col("data_bytes") / F.greatest(F.lit(1), width * F.col("channels"))).cast("long")
    known = layouts.select("path", F.col("channels").isNotNull().alias("__wav"), width.alias("sample_width_bytes"), "sample_rate_hz", "channels", frames.alias("frame_count"), "data_at")
    end = F.col("data_at") + F.col("frame_count") * 2 * F.col("channels")
    step = max(2, range_bytes // 2 * 2)
    whole = known.where("sample_width_bytes = 2 and frame_count > 0").select("path", end.alias("__end"), F.explode(F.sequence(F.col("data_at"), end - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = spread(whole.select("path", "start", F.least("__end", F.col("start") + step).alias("end")), "path", "start")
    sums = ranges.mapInArrow(_range_stats, _RANGE_STATS).groupBy("path").agg(F.max("peak").alias("peak"), *[F.sum(c).alias(c) for c in ("silent", "clipped", "total")])
    pcm = F.col("__wav") & (F.col("sample_width_bytes") == 2)

    def share(part: str) -> Column:
        return F.when(pcm, round_exact(F.coalesce(part, F.lit(0)).cast("double") / F.greatest(F.lit(1), F.coalesce("total", F.lit(0))).cast("double"), 8))

    out = known.join(sums, "path", "left").withColumns({"near_silence_ratio": share("silent"), "clipping_ratio": share("clipped")})
    raw = lambda part: F.coalesce(part, F.lit(0)) / F.greatest(F.lit(1), F.coalesce("total", F.lit(0)))
    warnings = F.when(~F.col("__wav"), F.array(F.lit("not_a_wav_file"))).when(~pcm, F.array(F.lit("pcm_signal_analysis_requires_16_bit_wav"))).otherwise(F.array_compact(F.array(
        F.when(raw("clipped") >= 0.01, F.lit("possible_clipping")), F.when(raw("silent") >= 0.95, F.lit("mostly_near_silence")))))
    status = F.when(~F.col("__wav"), F.lit("not_wav")).when(~pcm, F.lit("not_analyzed")).when(F.size("warnings") > 0, F.lit("pass_with_warnings")).otherwise(F.lit("pass"))
    peak = F.when(F.col("peak") > 0, round_exact(20.0 * F.log10(F.col("peak").cast("double") / 32767.0), 4))
    return out.withColumn("warnings", warnings).select(
        "path", status.alias("status"), "sample_width_bytes", "sample_rate_hz", "channels", "frame_count", F.when(pcm, F.coalesce("total", F.lit(0))).alias("sample_count"),
        peak.alias("peak_dbfs"), "near_silence_ratio", "clipping_ratio", "warnings")
