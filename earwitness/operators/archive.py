"""Meeting archive: names, revisions, content-addressed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.text import is_blank, meeting_folder, meeting_prefix, safe_component, timecode, to_ms
from earwitness.operators.latest import latest
from earwitness.operators.scan import scan, slice_of
from earwitness.operators.skew import lookup
from earwitness.sinks import documents

# Where a meeting start may come from.
DATETIME_SOURCES = ("user", "source_metadata", "filename", "inferred", "unknown")


def meeting_start(value: Column) -> Column:
    """Timestamp from ISO text with an explicit hour and minute; a bare date gives NULL."""
    timed = value.rlike(r"[T ]\d{2}:\d{2}")
    return F.when(timed, F.try_to_timestamp(value))


def metadata_errors(sources: tuple[str, ...] = DATETIME_SOURCES) -> Column:
    """Faults of one metadata row (meeting_id, meeting_start as text, meeting_datetime_source)."""
    start, given = meeting_start(F.col("meeting_start")), F.coalesce("meeting_start", F.lit("")) != ""
    return F.array_compact(F.array(
        F.when(is_blank(F.col("meeting_id")), F.lit("meeting_id is required")),
        F.when(~F.coalesce(F.col("meeting_datetime_source").isin(*sources), F.lit(False)), F.lit("unsupported meeting_datetime_source")),
        F.when(given & start.isNull(), F.lit("meeting_start must be a datetime with hour and minute")),
        F.when(~given & (F.col("meeting_datetime_source") != "unknown"), F.lit("a missing meeting_start must use source unknown"))))


def names(meetings: DataFrame) -> DataFrame:
    """Folder and file-stem names wanted for each meeting (meeting_start as TIMESTAMP)."""
    return meetings.withColumns({
        "desired_name": meeting_folder(F.col("meeting_start"), F.col("project"), F.col("content")),
        "stem": F.concat(meeting_prefix(F.col("meeting_start")), F.lit(" "), safe_component(F.col("short_name"), "Meeting"))})


def collision_safe(wanted: DataFrame, taken: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Give each meeting a free folder: the name, or `` (2)``, `` (3)`` ... in order of arrival.

    ``taken``: folder names in use. Numbers already used for a base name are
    skipped: the k-th newcomer gets the k-th free number.
    """
    base = F.regexp_replace("folder", r" \((?:[2-9]|[1-9]\d+)\)$", "")
    number = F.coalesce(F.regexp_extract("folder", r" \(([2-9]|[1-9]\d+)\)$", 1).try_cast("long"), F.lit(1).cast("long"))
    # A folder occupies itself as a plain name and, if suffixed, as a number of its base.
    direct = taken.select(F.col("folder").alias("desired_name"), F.lit(1).cast("long").alias("used"))
    derived = taken.select(base.alias("desired_name"), number.alias("used")).where("used > 1")
    used = direct.unionByName(derived).distinct().join(wanted.select("desired_name").distinct(), "desired_name", "left_semi")
    ranked = scan(wanted, ["desired_name"], [order], bucket, row_number="__k")
    # free numbers below the i-th used number u: u - i, so the k-th free is k + |{i : u_i - i < k}|
    spread = F.floor(F.col("used") / 4096).cast("long")
    gaps = scan(used, ["desired_name"], ["used"], spread, row_number="__i").select(
        "desired_name", (F.col("used") - F.col("__i")).alias("__pos"), F.lit(1).cast("long").alias("__u"))
    both = ranked.withColumns({"__pos": F.col("__k"), "__u": F.lit(0).cast("long")}).unionByName(gaps, allowMissingColumns=True)
    placed = scan(
        both, ["desired_name"], ["__pos", F.when(F.col("__u") == 1, 1).otherwise(0).alias("late"), order],
        F.floor(F.col("__pos") / 4096).cast("long"), sums_before={"__skip": F.col("__u")})
    n = F.col("__k") + F.col("__skip")
    return placed.where(F.col("__u") == 0).withColumn(
        "folder", F.when(n == 1, F.col("desired_name")).otherwise(F.concat("desired_name", F.lit(" ("), n.cast("string"), F.lit(")")))
    ).drop("__k", "__pos", "__u", "__skip")


def unresolved_jobs(windows: DataFrame) -> DataFrame:
    """Recordings that cannot be archived yet: some window has no final text."""
    return windows.groupBy("job_id").agg(F.count_if(F.col("final_text").isNull()).alias("unresolved")).where("unresolved > 0")


def final_segments(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Archived lines of resolved recordings, speakers joined by `` / `` in first-heard order.

    ``labels``: job_id, window_id, turn_no, display_label; bounded by a window.
    """
    ready = windows.join(unresolved_jobs(windows).select("job_id"), "job_id", "left_anti")
    heard = labels.where(~is_blank(F.col("display_label"))).groupBy("job_id", "window_id").agg(F.array_join(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("turn_no", F.trim("display_label").alias("l")))), lambda x: x["l"])), " / ").alias("speaker"))
    return ready.join(heard, ["job_id", "window_id"], "left")


def next_revisions(requests: DataFrame, revisions: DataFrame, bucket: Column) -> DataFrame:
    """Number archive requests after the revisions a meeting already has; nothing is overwritten.

    ``requests``: meeting_id, seq, stem. ``revisions``: meeting_id, revision.
    """
    had = revisions.groupBy("meeting_id").agg(F.max("revision").alias("__had"))
    placed = scan(requests, ["meeting_id"], ["seq"], bucket, row_number="__k")
    placed = lookup(placed, had, "meeting_id")
    rows = placed.withColumn("revision", F.coalesce("__had", F.lit(0)) + F.col("__k")).drop("__had", "__k")
    return rows.withColumn("final_stem", F.when(F.col("revision") == 1, F.col("stem")).otherwise(
        F.concat("stem", F.format_string(" rev%02d", "revision"))))


def retain_objects(incoming: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One stored object per (sha256, extension).

    Returns (objects to add, report). The report has one row per incoming file:
    the first of a new object is stored, every other one reuses it. Copies are
    reduced with ``min`` map-side, so a million copies of one file cost one row.
    """
    keys = ["sha256", "ext"]
    firsts = incoming.groupBy(*keys).agg(F.min("file_id").alias("__first"), F.first("size_bytes").alias("size_bytes"))
    new = firsts.join(objects.select(*keys), keys, "left_anti")
    report = lookup(incoming, new.select(*keys, "__first"), keys).withColumn(
        "reused", ~F.col("file_id").eqNullSafe(F.col("__first"))).drop("__first")
    return new.drop("__first"), report


def retained_errors(copies: DataFrame, objects: DataFrame) -> DataFrame:
    """Copies whose stored object is missing or differs in size or hash."""
    stored = objects.select("object_id", F.col("sha256").alias("__sha"), F.col("size_bytes").alias("__size"))
    return copies.join(stored, "object_id", "left").withColumn("errors", F.array_compact(F.array(
        F.when(F.col("__sha").isNull(), F.lit("retained object is missing")),
        F.when(F.col("__size") != F.col("size_bytes"), F.lit("size verification failed")),
        F.when(F.col("__sha") != F.col("sha256"), F.lit("SHA-256 verification failed"))))).drop("__sha", "__size").where(F.size("errors") > 0)


def final_documents(segments: DataFrame) -> DataFrame:
    """The final documents of archived recordings, as parts: job_id, ext, part, body.

    ``segments`` as ``final_segments`` gives them: job_id, ord, window_id, start_sec,
    end_sec, final_text and speaker. The JSON is the canonical one; text, captions and
    HTML are made from the same rows.
    """
    rows = scan(segments, ["job_id"], ["ord"], slice_of("ord", 1024), row_number="no")
    record = F.to_json(F.struct("window_id", "start_sec", "end_sec", "speaker", F.col("final_text").alias("text")), {"ignoreNullFields": "false"})
    listed = documents.document_parts(rows.withColumn("body", record), ["job_id"], "no", ",\n")
    plain = documents.document_parts(rows.withColumn("body", F.col("final_text")), ["job_id"], "no", "\n\n")
    spoken = segments.select("job_id", "ord", "start_sec", "end_sec", "speaker", F.col("final_text").alias("text"))
    cells = [timecode(to_ms(F.col("start_sec")), "."), documents.html_cell(F.col("speaker")), documents.html_cell(F.col("final_text"))]
    made = {
        "json": documents.closed(listed, ["job_id"], '{"segments":[\n', "\n]}\n"), "txt": documents.closed(plain, ["job_id"], "", "\n"),
        "html": documents.html_table(rows, ["job_id"], "no", ("Start", "Speaker", "Text"), cells), "srt": documents.srt(spoken), "vtt": documents.vtt(spoken)}
    parts = [df.select("job_id", F.lit(ext).alias("ext"), "part", "body") for ext, df in made.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def revision_files(revisions: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each file of a revision: meeting_id, revision, ext, part, name, sha256, size_bytes and body.

    ``revisions``: job_id, meeting_id, revision, final_stem. A document of one part is
    one file; the parts of a longer one are numbered, and follow each other.
    """
    several = parts.groupBy("job_id", "ext").agg((F.max("part") > 0).alias("__several"))
    placed = parts.join(several, ["job_id", "ext"]).join(revisions.select("job_id", "meeting_id", "revision", "final_stem"), "job_id")
    name = F.concat(F.col("final_stem"), F.lit(" FINAL"), F.when(F.col("__several"), F.format_string(" part%05d", F.col("part") + 1)).otherwise(F.lit("")), F.lit("."), F.col("ext"))
    return placed.select("meeting_id", "revision", "ext", "part", name.alias("name"), F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("size_bytes"), "body")


def renamed_folders(renames: DataFrame, folders: DataFrame, bucket: Column) -> DataFrame:
    """New folders of renamed meetings: meeting_id, folder; those that keep theirs are left out.

    ``renames``: meeting_id, seq, desired_name. ``folders``: meeting_id, folder, version,
    of which the newest counts. A folder that another meeting gives up in the same
    batch is free. The newest of several renames of one meeting counts.
    """
    now = latest(folders, ["meeting_id"], ["version"]).select("meeting_id", F.col("folder").alias("__now"))
    asked = latest(renames, ["meeting_id"], ["seq"]).join(now, "meeting_id").where(F.col("desired_name") != F.col("__now"))
    staying = now.join(asked.select("meeting_id"), "meeting_id", "left_anti").select(F.col("__now").alias("folder"))
    placed = collision_safe(asked.select("meeting_id", "seq", "desired_name", "__now"), staying, "seq", bucket)
    return placed.where(F.col("folder") != F.col("__now")).select("meeting_id", "folder")


def archived_files(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files under the folders that their meetings have now; names change, hashes don't."""
    now = latest(folders, ["meeting_id"], ["version"]).select("meeting_id", "folder")
    return lookup(files, now, "meeting_id").withColumn("path", F.concat_ws("/", "folder", F.lit("final"), "name"))
