"""Per-chunk transcripts to one full transcript per recording."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from earwitness.functions.hashing import candidate_id
from earwitness.functions.numbers import round_exact
from earwitness.functions.similarity import ratio
from earwitness.functions.text import is_blank, lexical_form, speaker_line, strip, word_count
from earwitness.operators.fold import Fold, sorted_fold
from earwitness.operators.scan import scan, slice_of
from earwitness.session import cut_lineage, spread
from earwitness.sinks.documents import document_parts

CHUNK = ["job_id", "chunk_key"]
IDENTITY = ("chunk_filename", "chunk_sha256", "provider", "provider_code", "model", "run_id", "response_format")
REQUIRED = ("job_id", "chunk_filename", "provider", "provider_code", "model", "run_id", "response_format", "segment_timing_scope")
CHUNK_KIND = r"(^|\.)transcript\.chunk\.v1$"
ORDINALS_PER_SLICE = 1024

# What counts as one boundary token, what may follow a repeat, and the repeat limits.
TOKEN = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*|[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\W_]"
TOKEN_JVM = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[\p{L}\p{N}]"
SEPARATOR = r"[\s.,!?;:…，。！？；：、\-–—]+"
MIN_TOKENS, MIN_CHARS, MAX_TOKENS = 4, 12, 100
ANCHOR_TOKENS, ANCHOR_EDGE = 8, 25

_TOKEN = re.compile(TOKEN)
_SEPARATOR = re.compile(SEPARATOR)


def identity_errors(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Manifest entries joined to their payloads by path, with every identity conflict named."""
    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    e, p = entries.alias("e"), payloads.alias("p")
    joined = e.join(p, F.col("e.transcript_path") == F.col("p.transcript_path"), "left")
    canonical = F.coalesce(F.col("p.schema_version").rlike(CHUNK_KIND), F.lit(False))
    checks = [F.when(F.col("p.transcript_path").isNull(), F.lit("transcript payload is missing"))]
    checks += [F.when(canonical & blank(F.col(f"p.{f}")), F.lit(f"missing {f}")) for f in REQUIRED]
    checks.append(F.when(F.col("p.job_id").isNotNull() & (F.col("p.job_id") != F.col("e.job_id")), F.lit("mismatched job_id")))
    for f in IDENTITY:
        want, got = F.col(f"e.{f}"), F.col(f"p.{f}")
        checks.append(F.when(~blank(want) & ~blank(got) & (want != got), F.lit(f"mismatched {f}")))
        if f not in REQUIRED:
            checks.append(F.when(canonical & ~blank(want) & blank(got), F.lit(f"missing {f}")))
    return joined.select("e.*", F.array_compact(F.array(*checks)).alias("errors"))


def normalized_segments(payload: DataFrame) -> Column:
    """Segments of one payload row: blank ones dropped, ids from raw positions, absolute times.

    Needs chunk_filename, chunk_start_sec, segment_timing_scope, text, segments.
    A payload with only text yields one untimed segment.
    """
    chunk = F.coalesce("chunk_filename", F.lit("chunk"))
    offset = F.when(F.coalesce("segment_timing_scope", F.lit("chunk")) == "chunk",
                    F.coalesce("chunk_start_sec", F.lit(0.0))).otherwise(F.lit(0.0))

    def one(s: Column, i: Column) -> Column:
        speaker = s["speaker"]
        return F.struct(
            (i + 1).cast("long").alias("raw_no"),
            F.concat(chunk, F.format_string(":%04d", i + 1)).alias("segment_id"),
            (s["start_sec"] + offset).alias("start_sec"), (s["end_sec"] + offset).alias("end_sec"),
            speaker.alias("speaker"), F.coalesce(F.nullif(s["provider_speaker"], F.lit("")), speaker).alias("provider_speaker"),
            strip(F.coalesce(s["text"], F.lit(""))).alias("text"))

    body = strip(F.coalesce("text", F.lit("")))
    kept = F.filter(
        F.transform(F.coalesce(F.col("segments"), F.array().cast(payload.schema["segments"].dataType)), one),
        lambda s: s["text"] != "")
    none = F.lit(None)
    alone = F.array(F.struct(
        F.lit(1).cast("long").alias("raw_no"), F.concat(chunk, F.lit(":0001")).alias("segment_id"),
        none.cast("double").alias("start_sec"), none.cast("double").alias("end_sec"),
        none.cast("string").alias("speaker"), none.cast("string").alias("provider_speaker"), body.alias("text")))
    return F.when(F.size(kept) > 0, kept).when(body != "", alone).otherwise(F.slice(alone, 1, 0))


def chunk_records(payloads: DataFrame) -> DataFrame:
    """One record per candidate transcript of a chunk: normalised segments and rendered text.

    ``payloads`` adds ``ordinal`` (manifest position) and ``transcript_path`` to the chunk schema.
    """
    rows = payloads.withColumn("norm_segments", normalized_segments(payloads))
    text = F.array_join(F.transform("norm_segments", lambda s: speaker_line(s["speaker"], s["text"])), "\n")
    key = F.when(F.coalesce("chunk_filename", F.lit("")) != "", F.concat(F.lit("chunk/"), "chunk_filename")).otherwise(
        F.concat(F.lit("transcript/"), "transcript_path"))
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "segments")],
        text.alias("text"), key.alias("chunk_key"),
        F.coalesce("chunk_start_sec", F.lit(0.0)).alias("sort_start"))


@F.pandas_udf(DoubleType())
def _least_ratio(blocks: pd.Series) -> pd.Series:
    """Smallest ratio between the sides of one block pair, or within one block (side 2)."""
    def least(items) -> float | None:
        left = [(x["first_ordinal"], x["form"]) for x in items if x["side"] != 1]
        right = [(x["first_ordinal"], x["form"]) for x in items if x["side"] != 0]
        within = left == right
        found = [
            ratio(a, b) if i < j else ratio(b, a)
            for i, a in left for j, b in right if i != j and not (within and j < i)]
        return min(found, default=None)

    return blocks.map(least)


BLOCK = 64


def least_similarity(forms: DataFrame) -> DataFrame:
    """Exact minimum pairwise ratio among the distinct normalised texts of each chunk.

    Copies collapse to one text before anything is compared. Distinct texts are
    hashed into blocks of about ``BLOCK``; each pair of blocks is one small task,
    so no task and no row set grows with the size of a chunk's group. An ordinary
    chunk (a few providers) is a single block.
    """
    distinct = forms.groupBy(*CHUNK, "form").agg(F.min("ordinal").alias("first_ordinal"))
    sizes = distinct.groupBy(*CHUNK).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("texts"))
    placed = distinct.join(sizes.where(F.col("texts") > 1), CHUNK).withColumn(
        "b", F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int"))
    # Every text meets each block once: as the lower side, the upper side, or inside its own block (side 2).
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *CHUNK, "form", "first_ordinal", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"),
        F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"))
    pairs = spread(met, *CHUNK, "lo", "hi").groupBy(*CHUNK, "lo", "hi").agg(
        F.collect_list(F.struct("side", "first_ordinal", "form")).alias("items"))
    parts = pairs.select(*CHUNK, _least_ratio("items").alias("least"))
    return parts.groupBy(*CHUNK).agg(F.min("least").alias("least_ratio"))


def reconcile(records: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pick one existing candidate per chunk verbatim and grade the evidence.

    The chosen text is the first non-blank candidate by ordinal. Grades follow
    the ladder: no text / some blank -> red; single -> amber; all equal over two
    providers -> green, within one -> amber; every pair close -> amber; else red.
    """
    # Read twice below; folding costs far more per byte than reading, so it runs once and on all cores.
    used = [*CHUNK, "text", "ordinal", "provider", "chunk_sha256", "sort_start", "chunk_filename"]
    folded = cut_lineage(spread(records.select(*used), *CHUNK).withColumn("form", lexical_form(F.col("text"))).drop("text"))
    usable = F.col("form") != ""
    provider = F.nullif(strip(F.lower(F.coalesce("provider", F.lit("")))), F.lit(""))
    summary = folded.groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(usable).alias("usable_count"),
        F.count_distinct("form").alias("distinct_texts"), F.count_distinct(provider).alias("independent_provider_count"),
        F.count_distinct(F.nullif(F.col("chunk_sha256"), F.lit(""))).alias("hashes"),
        F.min_by("ordinal", F.struct((~usable).alias("blank"), F.col("ordinal"))).alias("selected_ordinal"),
        F.min("ordinal").alias("first_ordinal"),
        F.min(F.struct("sort_start", F.coalesce("chunk_filename", F.lit("")).alias("f"), "ordinal")).alias("sort_key"),
    )
    # A copy of another candidate scores 1.0 with it, so copies never lower the minimum.
    least = least_similarity(folded.select(*CHUNK, "ordinal", "form"))
    graded = summary.join(least, CHUNK, "left").withColumn(
        "least", F.when(F.col("candidate_count") > 1, round_exact(F.coalesce("least_ratio", F.lit(1.0)), 6)))
    equal = F.col("distinct_texts") == 1
    reason = (
        F.when(F.col("usable_count") == 0, "no_usable_candidate_text")
        .when(F.col("usable_count") != F.col("candidate_count"), "one_or_more_candidates_are_empty")
        .when(F.col("candidate_count") == 1, "single_candidate_only")
        .when(equal & (F.col("independent_provider_count") >= 2), "exact_normalized_agreement_across_independent_providers")
        .when(equal, "agreement_is_within_one_provider")
        .when(F.col("least") >= threshold, "close_lexical_agreement_with_unresolved_differences")
        .otherwise("material_candidate_disagreement"))
    grade = (
        F.when(F.col("reason").isin("exact_normalized_agreement_across_independent_providers"), "green")
        .when(F.col("reason").isin("single_candidate_only", "agreement_is_within_one_provider",
                                   "close_lexical_agreement_with_unresolved_differences"), "amber")
        .otherwise("red"))
    return graded.withColumn("reason", reason).withColumn("grade", grade).select(
        *CHUNK, "grade", "reason", "candidate_count", "independent_provider_count", "selected_ordinal", "sort_key",
        equal.alias("all_candidates_normalized_equal"), F.col("least").alias("minimum_pairwise_lexical_similarity"),
        F.when(F.col("grade") == "green", "generally_accepted").when(F.col("grade") == "amber", "review_consideration")
        .otherwise("strong_review_required").alias("review_recommendation"),
        F.when(F.col("selected_ordinal") != F.col("first_ordinal"), "first_nonempty_candidate_preserved")
        .otherwise("primary_candidate_preserved").alias("selection_reason"),
        F.when(F.col("hashes") > 1, F.array(F.lit("conflicting chunk hashes"))).otherwise(
            F.array().cast("array<string>")).alias("errors"))


def with_candidate_id(records: DataFrame) -> DataFrame:
    fields = ("chunk_filename", "chunk_sha256", "source_sha256", "provider", "provider_code", "model", "run_id", "transcript_path", "text")
    return records.withColumn("candidate_id", candidate_id({f: F.col(f) for f in fields}))


def selected_chunks(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The chosen record of each chunk, numbered in playing order."""
    picks = decisions.where(F.size("errors") == 0).select(*CHUNK, F.col("selected_ordinal").alias("ordinal"), "grade", "sort_key")
    chosen = records.join(picks, [*CHUNK, "ordinal"])
    return scan(
        chosen, ["job_id"], ["sort_key", "chunk_key"], slice_of(F.col("sort_key.sort_start"), 3600), row_number="chunk_no",
    ).drop("sort_key")


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().casefold(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def repeated_span(tail: list[str], text: str) -> tuple[int, int, int, str | None]:
    """Where ``text`` repeats the words just spoken: (start, end, tokens, how).

    ``tail`` holds the last hundred earlier tokens. First choice is the longest
    suffix of the tail that opens the text; otherwise the longest run within
    reach of both edges, nearest to the boundary.
    """
    head = _tokens(text)[:MAX_TOKENS]
    words = [h[0] for h in head]

    def stop(token: int) -> int:
        gap = _SEPARATOR.match(text, head[token][2])
        return gap.end() if gap else head[token][2]

    for size in range(min(len(tail), len(words)), MIN_TOKENS - 1, -1):
        if tail[-size:] == words[:size] and sum(map(len, words[:size])) >= MIN_CHARS:
            return 0, stop(size - 1), size, "suffix_prefix"

    best = None
    below = [0] * (len(words) + 1)
    for i in range(len(tail) - 1, -1, -1):
        runs = [0] * (len(words) + 1)
        for j in range(len(words) - 1, -1, -1):
            if tail[i] != words[j]:
                continue
            size = runs[j] = below[j + 1] + 1
            behind = len(tail) - i - size
            if size < ANCHOR_TOKENS or behind > ANCHOR_EDGE or j > ANCHOR_EDGE:
                continue
            if sum(map(len, words[j:j + size])) < MIN_CHARS:
                continue
            rank = (-size, behind + j, j, behind)
            if best is None or rank < best[0]:
                best = (rank, j, size)
        below = runs
    if best is None:
        return 0, 0, 0, None
    _, j, size = best
    return head[j][1], stop(j + size - 1), size, "anchored_exact_span"


class _Boundary(Fold):
    """Carries the last hundred tokens of what has been kept so far."""

    def __init__(self) -> None:
        self.tail: list[str] = []

    def feed(self, row):
        text = row.text or ""
        if row.seed:
            self.tail = [t[0] for t in _tokens(text)[-MAX_TOKENS:]]
            return ()
        start, end, count, how = (0, 0, 0, None) if row.labelled else repeated_span(self.tail, text)
        kept = [t[0] for t in _tokens(text) if not (t[1] >= start and t[2] <= end)]
        self.tail = (self.tail + kept)[-MAX_TOKENS:]
        return [(row.job_id, row.chunk_no, start, end, count, how)]


def boundary_overlaps(chunks: DataFrame) -> DataFrame:
    """Exact repeats at chunk boundaries: removal span per chunk.

    ``chunks``: job_id, chunk_no, text, labelled. A decision depends only on the
    hundred tokens kept before it, and removal touches only a chunk's first
    hundred tokens. So after any chunk of 200+ tokens the carry is known without
    the past: recordings are cut there and the pieces run in parallel, each seeded
    with the chunk before it.
    """
    sized = chunks.select(
        "job_id", "chunk_no", "text", "labelled",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN_JVM)).alias("__n"))
    cut = (F.col("__n") >= F.when(F.col("labelled"), MAX_TOKENS).otherwise(2 * MAX_TOKENS)).cast("long")
    runs = scan(
        sized.withColumn("__cut", cut), ["job_id"], ["chunk_no"], slice_of("chunk_no", ORDINALS_PER_SLICE),
        sums_before={"run": F.col("__cut")})
    roles = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("seed")))
    roles = F.when(F.col("__cut") == 1, F.concat(roles, F.array(F.struct((F.col("run") + 1).alias("run"), F.lit(True).alias("seed"))))).otherwise(roles)
    placed = runs.withColumn("__roles", roles).drop("run").select("job_id", "chunk_no", "text", "labelled", F.inline("__roles"))
    schema = StructType([
        StructField("job_id", chunks.schema["job_id"].dataType), StructField("chunk_no", LongType()),
        StructField("removal_start", IntegerType()), StructField("removal_end", IntegerType()),
        StructField("removed_tokens", IntegerType()), StructField("match_mode", StringType())])
    return sorted_fold(placed, ["job_id", "run"], ["chunk_no"], _Boundary, schema)


def without_span(text: Column, start: Column, end: Column) -> Column:
    left = F.regexp_replace(F.substring(text, F.lit(1), start), r"(?U)\s+$", "")
    right = F.regexp_replace(F.substring(text, end + 1, F.char_length(text)), r"(?U)^\s+", "")
    joined = F.when((left != "") & (right != ""), F.concat(left, F.lit(" "), right)).otherwise(F.concat(left, right))
    return F.when(end > start, joined).otherwise(text)


def trimmed_segments(segments: Column, start: Column, end: Column) -> Column:
    """Remove a known text span from unlabelled segments, keeping the rest of each."""
    lengths = F.transform(segments, lambda s: F.char_length(s["text"]) + 1)

    def trim(s: Column, i: Column) -> Column:
        at = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        lo = F.greatest(start, at) - at
        hi = F.least(end, at + F.char_length(s["text"])) - at
        return s.withField("text", F.when(hi > lo, strip(without_span(s["text"], lo, hi))).otherwise(s["text"]))

    cut = F.filter(F.transform(segments, trim), lambda s: s["text"] != "")
    labelled = F.exists(segments, lambda s: F.coalesce(s["speaker"], F.lit("")) != "")
    return F.when((end > start) & ~labelled, cut).otherwise(segments)


def full_transcript_chunks(chosen: DataFrame) -> DataFrame:
    """Chosen chunks with boundary repeats removed from text and segments."""
    labelled = F.exists("norm_segments", lambda s: F.coalesce(s["speaker"], F.lit("")) != "")
    spans = boundary_overlaps(chosen.select("job_id", "chunk_no", "text", labelled.alias("labelled")))
    return chosen.join(spans, ["job_id", "chunk_no"]).withColumns({
        "text": without_span(F.col("text"), F.col("removal_start"), F.col("removal_end")),
        "norm_segments": trimmed_segments(F.col("norm_segments"), F.col("removal_start"), F.col("removal_end"))})


def transcript_segments(chunks: DataFrame) -> DataFrame:
    """Segment rows with their place in the recording: untimed last, then start, end, id."""
    rows = chunks.select(
        "job_id", "chunk_no", "chunk_filename", "provider", "model", "run_id", F.inline("norm_segments"))
    untimed = F.col("start_sec").isNull()
    order = [untimed.cast("int").alias("u"), F.coalesce("start_sec", F.lit(0.0)).alias("s"),
             F.coalesce("end_sec", F.lit(0.0)).alias("e"), F.col("segment_id"), F.col("chunk_no")]
    last = 1 << 40
    return scan(rows, ["job_id"], order,
                F.when(untimed, F.lit(last) + slice_of("chunk_no", 64)).otherwise(slice_of("start_sec", 600)),
                row_number="ord")


def transcript_summary(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Counts, provenance and attention grade per recording.

    Sets are built from distinct values only. Words and characters are summed
    over chunk texts plus the blank-line joints, without assembling the text.
    """
    graded = chunks.groupBy("job_id").agg(
        *[F.count_if(F.col("grade") == g).alias(g) for g in ("green", "amber", "red")],
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(~is_blank(F.col("text"))).alias("__parts"),
        F.sum(word_count(F.col("text"))).alias("word_count"), F.sum(F.char_length("text")).alias("__chars"),
        F.sum(F.size("norm_segments")).alias("segment_count"))

    def distinct(column: str, name: str) -> Column:
        return F.array_sort(F.collect_set(F.nullif(F.col(column), F.lit("")))).alias(name)

    provenance = records.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), distinct("provider", "providers"), distinct("model", "models"),
        distinct("run_id", "run_ids"), distinct("source_sha256", "source_hashes"))
    return graded.join(provenance, "job_id").select(
        "job_id", "chunk_count", "candidate_count", "segment_count", "green", "amber", "red",
        F.when(F.col("red") > 0, "red").when(F.col("amber") > 0, "amber").when(F.col("green") > 0, "green").alias("highest_attention_grade"),
        ((F.col("amber") + F.col("red")) > 0).alias("human_review_recommended"), (F.col("red") > 0).alias("human_review_required"),
        "word_count", (F.col("__chars") + 2 * F.greatest(F.lit(0), F.col("__parts") - 1)).alias("character_count"),
        "providers", "models", "run_ids", "source_hashes")


def retained_index(results: DataFrame) -> DataFrame:
    """One entry per (job, provider): chunks, sorted run ids, requested model of the first chunk, text size.

    ``results``: job_id, provider_code, chunk_no, model, run_id, text.
    """
    return results.groupBy("job_id", "provider_code").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.array_sort(F.collect_set(F.nullif(F.col("run_id"), F.lit("")))).alias("run_ids"),
        F.min_by("model", "chunk_no").alias("requested_model"),
        (F.sum(F.char_length(F.coalesce("text", F.lit("")))) + 2 * (F.count(F.lit(1)) - 1)).alias("character_count"))


def missing_documents(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected (job, provider) pairs whose provider returned nothing at all."""
    return expected.join(results.select("job_id", "provider_code").distinct(), ["job_id", "provider_code"], "left_anti")


def retained_documents(results: DataFrame) -> DataFrame:
    """Retained text per (job, provider): chunk texts joined by a blank line, as document parts (chunk_no from 1)."""
    body = results.select("job_id", "provider_code", "chunk_no", F.coalesce("text", F.lit("")).alias("body"))
    return document_parts(body, ["job_id", "provider_code"], "chunk_no", "\n\n")
