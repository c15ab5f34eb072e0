"""User-level entry points: each takes tables and returns tables.

A stage that several later steps read is written once through ``cut_lineage``;
everything else stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from earwitness.operators import (
    agreement, alignment, archive as ar, chunking, corrections as co, costs, draft as dr, evaluation as ev, jobs, media,
    pilot, pricing, provider_json, reconcile as rc, recording, rescue, review as rv, speakers as sp, transcripts as tr)
from earwitness.operators.latest import latest
from earwitness.operators.scan import slice_of
from earwitness.params import AgreementThresholds, PriceBook, RescuePolicy, ScorecardThresholds
from earwitness.session import cut_lineage
from earwitness.sinks import commits, documents


def compare(docs: DataFrame, provider_order: Sequence[str], thresholds: AgreementThresholds = AgreementThresholds()) -> dict[str, DataFrame]:
    """Provider documents to aligned, classified regions with statistics and rejects.

    A recording with any unusable candidate is set aside whole: partial evidence
    would look like disagreement. ``rejects`` has all its candidates, those that are
    usable with the reason ``other candidate of the recording is unusable``.
    """
    order = agreement.check_order(provider_order)
    found = alignment.timeline_candidates(docs)
    spoilt = found.where(F.size("errors") > 0).select("job_id").distinct()
    good = found.join(spoilt, "job_id", "left_anti").withColumn("missing", F.lit(False)).drop("errors")
    bad = found.join(spoilt, "job_id", "left_semi").withColumn(
        "errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.lit("other candidate of the recording is unusable"))))
    aligned = alignment.align(good)
    keys = ["job_id", "region_no", "region_id", "region_start_sec", "region_end_sec"]
    fields = ["text", "candidate_id", "start_sec", "end_sec", "source_kind", "source_index", "segment_id", "chunk_filename", "model", "run_id"]
    regions = alignment.gather_regions(aligned, keys, order, fields).withColumnsRenamed(
        {"region_start_sec": "start_sec", "region_end_sec": "end_sec"})
    classified = cut_lineage(agreement.classify(regions, order, thresholds))
    return {"regions": classified, "rejects": bad, "status_counts": agreement.status_counts(classified),
            "statistics": alignment.alignment_statistics(aligned, order)}


def final_draft(regions: DataFrame, provider_order: Sequence[str]) -> dict[str, DataFrame]:
    rejects = dr.draft_errors(regions)
    good = regions.join(rejects.select("job_id").distinct(), "job_id", "left_anti")
    windows = dr.final_draft(good, provider_order)
    return {"windows": windows, "rejects": rejects, "statistics": dr.draft_statistics(windows)}


def review(windows: DataFrame, decisions: DataFrame, speaker_decisions: DataFrame, *, targeted: bool, slice_width: float,
           source_seconds: DataFrame | None = None) -> dict[str, DataFrame]:
    """``windows``: a draft with ``start``/``end`` seconds and ``speaker_selected``."""
    content = rv.check_decisions(decisions, windows)
    speaker = rv.check_speaker_decisions(speaker_decisions, windows)
    rows = rv.reviewed(windows, content.where(F.size("errors") == 0), speaker.where(F.size("errors") == 0))
    return {"windows": rows, "rejects": content.where(F.size("errors") > 0), "speaker_rejects": speaker.where(F.size("errors") > 0),
            "statistics": rv.reviewed_statistics(rows),
            "summary": rv.verification_summary(rows, slice_width, targeted=targeted, source_seconds=source_seconds)}


def aggregate(payloads: DataFrame) -> dict[str, DataFrame]:
    """Chunk transcripts to full transcripts, captions and provenance."""
    records = tr.with_candidate_id(tr.chunk_records(payloads))
    decisions = cut_lineage(tr.reconcile(records))
    chunks = cut_lineage(tr.full_transcript_chunks(tr.selected_chunks(records, decisions)))
    segments = tr.transcript_segments(chunks)
    return {"decisions": decisions, "chunks": chunks, "segments": segments, "summary": tr.transcript_summary(chunks, records),
            "text": documents.plain_text(chunks), "srt": documents.srt(segments), "vtt": documents.vtt(segments),
            "rejects": decisions.where(F.size("errors") > 0)}


def speaker_timeline(payloads: DataFrame, windows: DataFrame, provider_code: Column, slice_width: float, run_id: str = "run-1") -> dict[str, DataFrame]:
    """Raw timed payloads of one run to turns, window evidence and local speakers of that run."""
    timed = provider_json.native_timing(payloads)
    words = timed.where((F.col("collection") == "words") & F.col("warning").isNull()).select(
        "job_id", F.concat_ws("/", "chunk_filename", F.format_string("%010d", "index")).alias("word_no"), "text", "speaker",
        F.lit(run_id).alias("run_id"), "chunk_filename", F.col("global_start_sec").alias("start"), F.col("global_end_sec").alias("end"))
    turns = cut_lineage(sp.speaker_turns(words))
    return {"warnings": timed.where(F.col("warning").isNotNull()), "turns": turns, "statistics": sp.timeline_statistics(turns),
            "windows": sp.attach_evidence(windows, turns, slice_width),
            "sensitive": sp.sensitive_windows(sp.window_evidence(windows, turns, slice_width)),
            "speakers": sp.local_speakers(turns, provider_code)}


def map_speakers(speakers: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    checked = sp.mapping_errors(events, speakers)
    good = checked.where(F.size("errors") == 0).drop("errors")
    return {"speakers": sp.display_labels(speakers, sp.canonical_ids(good)), "rejects": checked.where(F.size("errors") > 0)}


def apply_corrections(segments: DataFrame, chunks: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    checked = cut_lineage(co.check_corrections(events, segments))
    history = co.correction_history(checked)
    now = co.corrected_segments(segments, history)
    return {"segments": now, "chunks": co.rebuilt_chunks(chunks, now), "history": history, "rejects": checked.where(F.size("errors") > 0)}


def scorecards(cases: DataFrame, thresholds: ScorecardThresholds = ScorecardThresholds()) -> dict[str, DataFrame]:
    results = cut_lineage(ev.evaluate(cases))
    cards = ev.scorecards(results, thresholds)
    return {"results": results, "scorecards": cards, "gate": ev.release_gate(cards), "report": ev.report(results)}


def record_pilot(spark: SparkSession, root: str, requests: DataFrame, *, attempts: int = 5) -> DataFrame:
    """Append pilot events to the ledger under ``root``; gives every request with its position or its reason.

    ``requests`` as for ``recording.record_events``. The ledger's chains are verified,
    winners are staged and published as one version. If another writer was faster,
    all is decided anew against the heads it left, and what named an old head is
    refused; so two writers of one job leave one sound chain.
    """
    shape = requests.select("job_id", "seq", "event_id", "previous_event_sha256", "event").schema
    shape = StructType([*shape, StructField("event_sha256", StringType()), StructField("position", LongType())])
    for _ in range(attempts):
        seen = commits.state(spark, root)
        done = recording.record_events(requests, ledger_chains(seen.read(spark, "events", shape)))
        made = cut_lineage(done)
        new = made.where("reason is null")
        if new.isEmpty():
            return made
        try:
            commits.publish(spark, root, seen, {"events": commits.stage(new.select(*shape.fieldNames()), root, "events")})
        except commits.StaleVersion:
            continue
        return made
    raise commits.StaleVersion(f"{root} changed in each of {attempts} attempts")


def ledger_chains(events: DataFrame, per_slice: int = 100_000) -> DataFrame:
    """Chain report of a ledger that ``record_pilot`` keeps."""
    return pilot.chain_report(events.drop("seq").withColumnRenamed("position", "seq"), slice_of("seq", per_slice), recording.event_sha256(events))


def pilot_summary(recorded: DataFrame, chains: DataFrame, generated_on: Column, *, rollup: bool = True) -> dict[str, DataFrame]:
    now, good = pilot.eligible_records(recorded, chains)
    return {"counts": pilot.scan_counts(now), "summary": pilot.cohort_summary(good, generated_on, rollup=rollup)}


def quote_orders(orders: DataFrame, book: PriceBook = PriceBook()) -> dict[str, DataFrame]:
    quotes, rejects = pricing.quote_orders(orders, book)
    return {"quotes": quotes, "rejects": rejects}


def cost_preflight(recordings: DataFrame, models: DataFrame, cap_usd: float) -> dict[str, DataFrame]:
    """``recordings``: job_id, duration_sec, chunk_sec, overlap_sec."""
    chunks = chunking.fixed_chunks(recordings)
    rows = costs.cost_preflight(chunks.select("job_id", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec")), models, cap_usd)
    return {"chunks": chunks, "preflight": rows, "totals": costs.preflight_totals(rows, cap_usd)}


def chunk_plan(recordings: DataFrame, log_lines: DataFrame) -> DataFrame:
    """``recordings`` as for ``plan_chunks``; detector log lines carry the recording id as ``file``."""
    length = recordings.select(F.col("recording_id").alias("file"), (F.col("total_frames") / F.col("framerate")).alias("duration_sec"))
    quiet = media.silence_intervals(log_lines, length).withColumnRenamed("file", "recording_id")
    return chunking.plan_chunks(recordings, quiet)


def rescue_select(classified: DataFrame, silences: DataFrame, policy: RescuePolicy = RescuePolicy()) -> dict[str, DataFrame]:
    first = rescue.first_red(classified)
    windows = cut_lineage(rescue.rescue_windows(first, silences, policy))
    ends = first.select("job_id", F.col("start_sec").alias("region_start_sec"), F.col("end_sec").alias("region_end_sec"))
    return {"first_red": first, "windows": windows, "routes": rescue.route(classified, windows, policy),
            "pass_through": rescue.pass_through(classified), "errors": chunking.contiguity_errors(windows, ["job_id"], ends)}


def reconcile(chunks: DataFrame, transcripts: DataFrame, proposals: DataFrame, providers: Sequence[str]) -> dict[str, DataFrame]:
    inputs, unmatched = rc.matched_inputs(chunks, transcripts, providers)
    checked = rc.proposal_errors(proposals, providers)
    return {"inputs": inputs, "unmatched": unmatched, "windows": rc.apply_proposals(inputs, checked),
            "rejects": checked.where(F.size("errors") > 0)}


def archive(meetings: DataFrame, revisions: DataFrame, taken: DataFrame, bucket: Column) -> dict[str, DataFrame]:
    """``meetings``: meeting_id, seq, meeting_start (text), meeting_datetime_source, project, content, short_name."""
    checked = meetings.withColumn("errors", ar.metadata_errors())
    good = checked.where(F.size("errors") == 0).drop("errors").withColumn("meeting_start", ar.meeting_start(F.col("meeting_start")))
    named = ar.names(good)
    return {"revisions": ar.next_revisions(named, revisions, bucket), "folders": ar.collision_safe(named, taken, "seq", bucket),
            "rejects": checked.where(F.size("errors") > 0)}


ARCHIVE_TABLES = {
    "revisions": "meeting_id string, revision long, job_id string, final_stem string",
    "folders": "meeting_id string, folder string, version long",
    "files": "meeting_id string, revision long, ext string, part long, name string, sha256 string, size_bytes long, body string"}


def archived(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What the newest version of an archive holds: revisions, files and folders, with the paths that are valid now."""
    seen = commits.state(spark, root)
    tables = {name: seen.read(spark, name, StructType.fromDDL(ddl)) for name, ddl in ARCHIVE_TABLES.items()}
    return tables | {"paths": ar.archived_files(tables["files"].drop("body"), tables["folders"])}


def archive_meetings(spark: SparkSession, root: str, meetings: DataFrame, windows: DataFrame, labels: DataFrame, bucket: Column, *, attempts: int = 5) -> dict[str, DataFrame]:
    """Archive reviewed recordings under ``root``: one more revision of each meeting, visible as a whole or not at all.

    ``meetings``: job_id, meeting_id, seq, meeting_start (text), meeting_datetime_source,
    project, content, short_name. ``windows`` and ``labels`` as for ``final_segments``, windows
    with ord, start_sec and end_sec. Recordings with an unresolved window or faulty
    metadata are rejects. Files of one call are staged and published as one version,
    with their hashes; a failed task or a faster writer leaves what was there.
    """
    checked = meetings.withColumn("errors", ar.metadata_errors())
    open_jobs = ar.unresolved_jobs(windows).select("job_id", F.lit(True).alias("__open"))
    checked = checked.join(open_jobs, "job_id", "left").join(windows.select("job_id", F.lit(True).alias("__any")).distinct(), "job_id", "left")
    checked = cut_lineage(checked.withColumn("errors", F.array_compact(F.concat("errors", F.array(
        F.when(F.col("__open"), F.lit("every window must be resolved")), F.when(F.col("__any").isNull(), F.lit("there are no windows")))))).drop("__open", "__any"))
    good = checked.where(F.size("errors") == 0).drop("errors").withColumn("meeting_start", ar.meeting_start(F.col("meeting_start")))
    named = ar.names(good)
    segments = ar.final_segments(windows.join(good.select("job_id"), "job_id", "left_semi"), labels)
    parts = ar.final_documents(segments)
    for _ in range(attempts):
        seen = commits.state(spark, root)
        had, folders = (seen.read(spark, name, StructType.fromDDL(ARCHIVE_TABLES[name])) for name in ("revisions", "folders"))
        numbered = cut_lineage(ar.next_revisions(named, had.select("meeting_id", "revision"), bucket))
        newcomers = numbered.where("revision = 1").join(folders.select("meeting_id"), "meeting_id", "left_anti")
        taken = latest(folders, ["meeting_id"], ["version"]).select("folder")
        placed = ar.collision_safe(newcomers, taken, "seq", bucket).select("meeting_id", "folder", F.lit(seen.version + 1).cast("long").alias("version"))
        tables = {"revisions": numbered, "folders": placed, "files": ar.revision_files(numbered, parts)}
        staged = {name: commits.stage(df.select(*StructType.fromDDL(ARCHIVE_TABLES[name]).fieldNames()), root, name) for name, df in tables.items()}
        try:
            commits.publish(spark, root, seen, staged)
        except commits.StaleVersion:
            continue
        return {"revisions": numbered, "rejects": checked.where(F.size("errors") > 0)}
    raise commits.StaleVersion(f"{root} changed in each of {attempts} attempts")


def rename_meetings(spark: SparkSession, root: str, meetings: DataFrame, bucket: Column, *, attempts: int = 5) -> dict[str, DataFrame]:
    """New readable names for archived meetings; ids, files and hashes stay.

    ``meetings`` as for ``archive_meetings``, without job_id. Unknown meetings and faulty
    metadata are rejects.
    """
    for _ in range(attempts):
        seen = commits.state(spark, root)
        folders = seen.read(spark, "folders", StructType.fromDDL(ARCHIVE_TABLES["folders"]))
        known = folders.select("meeting_id", F.lit(True).alias("__known")).distinct()
        checked = meetings.withColumn("errors", ar.metadata_errors()).join(known, "meeting_id", "left")
        checked = cut_lineage(checked.withColumn("errors", F.array_compact(F.concat("errors", F.array(F.when(F.col("__known").isNull(), F.lit("there is no such archive")))))).drop("__known"))
        good = ar.names(checked.where(F.size("errors") == 0).withColumn("meeting_start", ar.meeting_start(F.col("meeting_start"))))
        moved = ar.renamed_folders(good.select("meeting_id", "seq", "desired_name"), folders, bucket)
        staged = commits.stage(moved.select("meeting_id", "folder", F.lit(seen.version + 1).cast("long").alias("version")), root, "folders")
        try:
            commits.publish(spark, root, seen, {"folders": staged})
        except commits.StaleVersion:
            continue
        return {"folders": spark.read.parquet(staged), "rejects": checked.where(F.size("errors") > 0)}
    raise commits.StaleVersion(f"{root} changed in each of {attempts} attempts")


def media_qc(files: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """Files listed as ``binaryFile`` rows to identity, retention and signal statistics; files of any length are streamed."""
    from earwitness.functions.text import safe_suffix

    known = media.streamed_identity(files).withColumnsRenamed({"path": "file_id"}).withColumn("ext", safe_suffix(F.col("file_id")))
    new, report = ar.retain_objects(known, objects)
    return {"objects": new, "report": report, "signals": media.streamed_pcm_statistics(files)}


def job_inbox(manifests: DataFrame, limit: int = 24) -> dict[str, DataFrame]:
    return {"items": jobs.recent(jobs.list_items(manifests), limit), "stages": jobs.stage_report(manifests),
            "errors": jobs.error_rollup(manifests), "resumable": jobs.resumable(manifests)}
