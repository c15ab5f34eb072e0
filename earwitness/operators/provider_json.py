"""Raw provider responses to one canonical shape, inside the response row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.hashing import foreign_json_sha256
from earwitness.functions.text import join_words, let, strip, utf8_span

EPSILON = 1e-6
CANONICAL = "struct<text:string,speaker:string,start_sec:double,end_sec:double>"


def seconds(value: Column) -> Column:
    """Seconds from a VARIANT number or text such as ``1.250s``; a boolean is not a number."""
    text = F.lower(F.trim(F.try_variant_get(value, "$", "string")))
    return F.when(F.schema_of_variant(value) != "BOOLEAN", F.regexp_replace(text, "s$", "").try_cast("double"))


def seconds_text(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "s$", "").try_cast("double")


def chat_payload(responses: DataFrame) -> DataFrame:
    """Chat-style responses: own text first, else the first choice with content, with its words and segments."""
    kind = ("text string, transcript string, words string, segments string, "
            "choices array<struct<message:struct<content:string,words:string,segments:string>>>")
    p = F.from_json("raw", kind)
    rows = responses.withColumn("p", p)
    own = F.col("p.text").isNotNull() | F.col("p.transcript").isNotNull()
    hit = F.try_element_at(F.filter("p.choices", lambda c: F.coalesce(c["message"]["content"], F.lit("")) != ""), F.lit(1))["message"]
    return rows.select(
        *responses.columns, F.coalesce(F.col("p.text"), F.col("p.transcript"), hit["content"]).alias("text"),
        F.when(own, F.col("p.words")).otherwise(F.coalesce(hit["words"], F.col("p.words"))).alias("words"),
        F.when(own, F.col("p.segments")).otherwise(F.coalesce(hit["segments"], F.col("p.segments"))).alias("segments"))


_WORD = "struct<type:string,text:string,word:string,speaker:string,start_offset:string,end_offset:string,start_index:int,end_index:int>"
_PARTS = (
    "candidates array<struct<content:struct<parts:array<struct<text:string,"
    "audioTranscription:struct<speakerLabel:string,words:array<struct<word:string,startOffset:string,endOffset:string>>>>>>>>, "
    f"steps array<struct<type:string,content:array<struct<text:string,annotations:array<{_WORD}>>>>>")


def _turns(text: Column, annotations: Column) -> Column:
    """Runs of word annotations with one speaker; text is the exact byte span where it is valid."""
    words = F.filter(F.coalesce(annotations, F.array().cast(f"array<{_WORD}>")), lambda a: a["type"] == "word_info")

    def cut(w: Column) -> Column:
        name = lambda a: strip(F.coalesce(a["speaker"], F.lit("")))
        starts = F.filter(
            F.sequence(F.lit(1), F.size(w)),
            lambda i: (i == 1) | (name(F.try_element_at(w, i)) != name(F.try_element_at(w, F.greatest(F.lit(1), i - 1)))))

        def turn(at: Column, s: Column, k: Column) -> Column:
            stop = F.coalesce(F.try_element_at(at, k + 2), F.size(w) + 1)
            first, last = F.try_element_at(w, s), F.try_element_at(w, stop - 1)
            span = utf8_span(text, first["start_index"], last["end_index"])
            joined = join_words(F.transform(F.slice(w, s, stop - s), lambda a: F.coalesce(a["text"], a["word"])))
            return F.struct(
                F.coalesce(span, joined).alias("text"), F.nullif(name(first), F.lit("")).alias("speaker"),
                seconds_text(first["start_offset"]).alias("start_sec"), seconds_text(last["end_offset"]).alias("end_sec"))

        return F.when(F.size(w) > 0, let(starts, lambda at: F.transform(at, lambda s, k: turn(at, s, k)))).otherwise(F.array().cast(f"array<{CANONICAL}>"))

    return let(words, cut)


def parts_payload(responses: DataFrame) -> DataFrame:
    """Parts/steps responses: texts joined by newline, annotated segments, embedded JSON text wins."""
    none = F.array().cast(f"array<{CANONICAL}>")
    rows = responses.withColumn("p", F.from_json("raw", _PARTS))
    parts = F.flatten(F.transform(F.coalesce("p.candidates", F.array()), lambda c: F.coalesce(c["content"]["parts"], F.array().cast(
        "array<struct<text:string,audioTranscription:struct<speakerLabel:string,words:array<struct<word:string,startOffset:string,endOffset:string>>>>>"))))
    outputs = F.flatten(F.transform(
        F.filter(F.coalesce("p.steps", F.array()), lambda s: s["type"] == "model_output"),
        lambda s: F.coalesce(s["content"], F.array().cast(f"array<struct<text:string,annotations:array<{_WORD}>>>"))))
    rows = rows.withColumns({"parts": parts, "outs": outputs})

    def spoken(part: Column) -> Column:
        t = part["audioTranscription"]
        said = F.filter(F.coalesce(t["words"], F.array()), lambda w: w["word"].isNotNull())
        return let(said, lambda w: F.struct(
            F.trim(F.array_join(F.transform(w, lambda x: x["word"]), " ")).alias("text"), F.coalesce(t["speakerLabel"], F.lit("")).alias("speaker"),
            seconds_text(F.try_element_at(w, F.lit(1))["startOffset"]).alias("start_sec"),
            seconds_text(F.try_element_at(w, F.lit(-1))["endOffset"]).alias("end_sec"), F.size(w).alias("n")))

    heard = F.transform(F.filter(F.transform("parts", spoken), lambda s: s["n"] > 0), lambda s: F.struct(
        s["text"].alias("text"), s["speaker"].alias("speaker"), s["start_sec"].alias("start_sec"), s["end_sec"].alias("end_sec")))
    stepped = F.flatten(F.transform(
        F.filter("outs", lambda o: o["text"].isNotNull()), lambda o: _turns(o["text"], o["annotations"])))
    texts = F.array_compact(F.concat(F.transform("parts", lambda x: x["text"]), F.transform("outs", lambda o: o["text"])))
    rows = rows.withColumns({"joined": F.array_join(texts, "\n"), "found": F.concat(F.coalesce(heard, none), F.coalesce(stepped, none))})
    bare = F.when(F.startswith(F.trim("joined"), F.lit("```")), F.regexp_replace(F.trim("joined"), r"(?is)^```(?:json)?\s*|\s*```$", "")).otherwise(F.trim("joined"))
    embedded = F.when(F.json_object_keys(bare).isNotNull(), F.from_json(bare, f"text string, transcript string, segments array<{CANONICAL}>"))
    rows = rows.withColumn("embedded", embedded)
    from_segments = F.array_join(F.transform("found", lambda s: s["text"]), "\n")
    return rows.select(
        *responses.columns,
        F.coalesce("embedded.text", "embedded.transcript", F.when(F.col("embedded").isNull() & (F.col("joined") != ""), F.col("joined")),
                   F.when(F.col("embedded").isNull() & (F.size("found") > 0), from_segments)).alias("text"),
        F.when(F.size("embedded.segments") > 0, F.col("embedded.segments")).otherwise(F.col("found")).alias("segments"))


_SENTENCES = (
    "transcripts array<struct<channel_id:int,text:string,sentences:array<struct<begin_time:double,end_time:double,text:string,speaker_id:string,"
    "words:array<struct<begin_time:double,end_time:double,text:string,punctuation:string>>>>>>")


def sentence_words(responses: DataFrame) -> DataFrame:
    """Word rows of transcripts > sentences > words, milliseconds to seconds, with their raw positions."""
    t = responses.select("job_id", "chunk_filename", F.posexplode(F.from_json("raw", _SENTENCES)["transcripts"]).alias("transcript_index", "t"))
    s = t.select("job_id", "chunk_filename", "transcript_index", F.col("t.channel_id").alias("channel_id"),
                 F.posexplode("t.sentences").alias("sentence_index", "s"))
    w = s.select("*", F.posexplode("s.words").alias("word_index", "w"))
    return w.select(
        "job_id", "chunk_filename", "transcript_index", "sentence_index", "word_index", "channel_id",
        F.coalesce("w.text", F.lit("")).alias("text"), F.col("w.punctuation").alias("punctuation"),
        (F.col("w.begin_time") / 1000.0).alias("start_sec"), (F.col("w.end_time") / 1000.0).alias("end_sec"),
        F.concat(F.lit("spk:"), F.col("s.speaker_id")).alias("speaker"))


def sentence_payload(responses: DataFrame) -> DataFrame:
    """Transcript texts joined by newline and their sentences as segments."""
    p = F.from_json("raw", _SENTENCES)
    rows = responses.withColumn("ts", F.coalesce(p["transcripts"], F.array()))
    segs = F.flatten(F.transform("ts", lambda t: F.transform(F.coalesce(t["sentences"], F.array()), lambda s: F.struct(
        F.coalesce(s["text"], F.lit("")).alias("text"), F.concat(F.lit("spk:"), s["speaker_id"]).alias("speaker"),
        (s["begin_time"] / 1000.0).alias("start_sec"), (s["end_time"] / 1000.0).alias("end_sec")))))
    return rows.select(*responses.columns, F.nullif(F.array_join(F.transform("ts", lambda t: t["text"]), "\n"), F.lit("")).alias("text"), segs.alias("segments"))


def diarized_segments(responses: DataFrame) -> DataFrame:
    """Diarised segments with ``Speaker n`` in first-heard order; blank texts are dropped.

    A response is one chunk, so the ranking happens inside its row.
    """
    item = ("struct<text:string,provider_speaker:string,speaker:string,speaker_id:string,label:string,"
            "start_sec:double,start:double,start_time:double,end_sec:double,end:double,end_time:double>")
    p = F.from_json("raw", f"segments array<{item}>, utterances array<{item}>")
    items = F.when(F.size(p["segments"]) > 0, p["segments"]).otherwise(F.coalesce(p["utterances"], F.array()))

    def one(s: Column) -> Column:
        first = F.coalesce(*[F.nullif(s[c], F.lit("")) for c in ("provider_speaker", "speaker", "speaker_id", "label")], F.lit("speaker"))
        return F.struct(
            strip(F.coalesce(s["text"], F.lit(""))).alias("text"),
            F.coalesce(F.nullif(strip(first), F.lit("")), F.lit("speaker")).alias("provider_speaker"),
            F.coalesce(s["start_sec"], s["start"], s["start_time"]).alias("start_sec"),
            F.coalesce(s["end_sec"], s["end"], s["end_time"]).alias("end_sec"))

    kept = F.filter(F.transform(items, one), lambda s: s["text"] != "")
    rows = responses.withColumn("k", kept).withColumn("names", F.array_distinct(F.transform("k", lambda s: s["provider_speaker"])))
    labelled = F.transform("k", lambda s: s.withField(
        "speaker", F.concat(F.lit("Speaker "), F.array_position(F.col("names"), s["provider_speaker"]).cast("string"))))
    rows = rows.withColumn("segments", labelled)
    body = F.array_join(F.transform("segments", lambda s: F.concat(s["speaker"], F.lit(": "), s["text"])), "\n")
    return rows.select(*responses.columns, "segments", body.alias("text"))


def canonical_responses(responses: DataFrame) -> DataFrame:
    """Candidate identity of a response: text, requested and resolved model, raw hash.

    ``responses``: job_id, run_id, provider, provider_code, model, chunk_filename, raw.
    """
    p = F.from_json("raw", "text string, transcript string, model string, modelVersion string, model_version string, version string, "
                           "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")
    rows = responses.withColumn("p", p)
    parts = F.flatten(F.transform(F.coalesce("p.candidates", F.array()), lambda c: F.coalesce(c["content"]["parts"], F.array().cast("array<struct<text:string>>"))))

    def filled(*names: str) -> list[Column]:
        return [F.nullif(F.col(f"p.{n}"), F.lit("")) for n in names]

    return rows.select(
        *[c for c in responses.columns if c not in ("raw", "model")], F.col("model").alias("requested_model"),
        F.coalesce(*filled("model"), "model").alias("resolved_model"),
        F.coalesce(*filled("modelVersion", "model_version", "version")).alias("resolved_model_version"),
        F.coalesce("p.text", "p.transcript", F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).alias("text"),
        foreign_json_sha256("raw").alias("raw_response_sha256"), F.try_parse_json("raw").alias("raw_response"))


def native_timing(payloads: DataFrame) -> DataFrame:
    """Provider-native words and segments with global times; unusable items keep a warning instead.

    ``payloads``: job_id, chunk_filename, chunk_start_sec, chunk_duration_sec, raw.
    Times are never inferred or clamped.
    """
    v = F.col("__v")

    def items(name: str) -> Column:
        found = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(found, lambda x, i: F.struct(F.lit(name).alias("collection"), i.cast("long").alias("index"), x.alias("item")))

    # Each step is its own projection: parsed once, and each time read once.
    parsed = payloads.withColumn("__v", F.try_parse_json("raw"))
    rows = parsed.select(*[c for c in payloads.columns if c != "raw"], F.inline(F.concat(items("words"), items("segments"))))

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get("item", f"$.{n}", "variant") for n in names])

    rows = rows.withColumns({"s": pick("start", "start_sec", "startOffset", "start_offset"), "e": pick("end", "end_sec", "endOffset", "end_offset")})
    rows = rows.withColumns({"local_start_sec": seconds(F.col("s")), "local_end_sec": seconds(F.col("e"))})
    start, end = F.col("local_start_sec"), F.col("local_end_sec")
    outside = (start < 0) | (end <= start) | (end > F.col("chunk_duration_sec") + EPSILON)
    spot = F.concat("collection", F.lit("["), F.col("index").cast("string"), F.lit("] omitted: "))
    warning = (
        F.when(~F.schema_of_variant("item").like("OBJECT%"), F.concat(spot, F.lit("provider item was not an object")))
        .when(start.isNull() | end.isNull(), F.concat(spot, F.lit("provider start/end was unavailable")))
        .when(outside, F.concat(spot, F.lit("provider timing was outside the chunk"))))
    label = F.coalesce(F.try_variant_get("item", "$.speaker", "string"), F.try_variant_get("item", "$.speakerLabel", "string"))
    return rows.select(
        "job_id", "chunk_filename", "collection", "index",
        F.coalesce(*[F.try_variant_get("item", f"$.{n}", "string") for n in ("word", "text", "display")], F.lit("")).alias("text"),
        start, end,
        (F.col("chunk_start_sec") + start).alias("global_start_sec"), (F.col("chunk_start_sec") + end).alias("global_end_sec"),
        F.try_variant_get("s", "$", "string").alias("provider_start"), F.try_variant_get("e", "$", "string").alias("provider_end"),
        label.alias("speaker"), F.col("item").alias("raw"), warning.alias("warning"))


def timing_capability(timed: DataFrame, requested: DataFrame) -> DataFrame:
    """Per chunk: whether native timing came back, and who was attributed.

    ``requested``: job_id, chunk_filename, timing_requested. One chunk's distinct speakers are few.
    """
    keys = ["job_id", "chunk_filename"]
    # The timed rows are read once, and no filter goes back through the reading of the times.
    rank = F.struct(F.when(F.col("collection") == "words", 0).otherwise(1).alias("c"), F.col("index").alias("i"))
    named = timed.withColumn("speaker", F.nullif(strip(F.col("speaker")), F.lit("")))
    firsts = named.groupBy(*keys, "speaker").agg(F.min(F.when(F.col("warning").isNull(), rank)).alias("__at"))
    good = F.col("__at").isNotNull()
    heard = F.when(good & F.col("speaker").isNotNull(), F.struct("__at", "speaker"))
    names = firsts.groupBy(*keys).agg(
        F.bool_or(good).alias("__good"), F.transform(F.array_sort(F.collect_list(heard)), lambda x: x["speaker"]).alias("provider_speaker_ids"))
    rows = requested.join(names, keys, "left")
    ids = F.coalesce("provider_speaker_ids", F.array().cast("array<string>"))
    return rows.select(
        *keys, F.when(F.col("__good"), "available").when(F.col("timing_requested"), "requested_but_not_returned")
        .otherwise("not_requested").alias("capability_status"), ids.alias("provider_speaker_ids"), F.size(ids).alias("speaker_count"))


def empty_reason(responses: DataFrame) -> DataFrame:
    """Why a response carries no text: finish reasons and block reason, else a fixed remark."""
    p = F.from_json("raw", "candidates array<struct<finishReason:string,finish_reason:string>>, "
                           "promptFeedback struct<blockReason:string,block_reason:string>, prompt_feedback struct<blockReason:string,block_reason:string>")
    rows = responses.withColumn("p", p)
    reasons = F.array_distinct(F.array_compact(F.transform(F.coalesce("p.candidates", F.array()), lambda c: F.nullif(F.coalesce(c["finishReason"], c["finish_reason"]), F.lit("")))))
    block = F.coalesce("p.promptFeedback.blockReason", "p.promptFeedback.block_reason", "p.prompt_feedback.blockReason", "p.prompt_feedback.block_reason")
    told = F.concat_ws("; ", F.when(F.size(reasons) > 0, F.concat(F.lit("finish reason="), F.array_join(reasons, ","))),
                       F.concat(F.lit("prompt block reason="), block))
    return rows.select(*responses.columns, F.when(told != "", told).otherwise("provider supplied no finish/block reason").alias("reason"))
