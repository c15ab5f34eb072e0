"""Readers, writers, captions, raw responses, media and streams on small files."""

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from earwitness.operators import media, provider_json as pj
from earwitness.sinks import documents, writers
from earwitness.sources import readers
from earwitness.streaming import ledger as ls, spend


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_manifest_scan_skips_what_it_must(spark, tmp_path):
    put(tmp_path / "j1/job_manifest.json", {"job_id": "j1", "state": "completed", "updated_at": "2026-09-11T00:00:00Z", "outputs": {"full_transcript_json": "x"}})
    put(tmp_path / "_tmp/job_manifest.json", {"job_id": "hidden"})
    put(tmp_path / "j2/job_manifest.json", "{broken")
    put(tmp_path / "j3/job_manifest.json", {"state": "failed"})
    put(tmp_path / "j4/job_manifest.json", {"job_id": "../x"})
    from earwitness.operators.jobs import list_items
    got = list_items(readers.manifests(spark, f"{tmp_path}/*/job_manifest.json")).collect()
    assert [(r["job_id"], r["display_state"], r["has_transcript"]) for r in got] == [("j1", "ready", True)]


def test_transcripts_outside_the_root_are_refused(spark, tmp_path):
    put(tmp_path / "in/a.json", {"job_id": "j", "text": "x", "segments": []})
    put(tmp_path / "out/b.json", {"job_id": "j", "text": "y"})
    good, bad = readers.chunk_transcripts(spark, f"{tmp_path}/*/*.json", f"{tmp_path}/in")
    assert [r["text"] for r in good.collect()] == ["x"] and bad.count() == 1
    docs, refused = readers.provider_documents(spark, f"{tmp_path}/*/*.json")
    assert docs.count() == 0 and refused.count() == 2


def test_ledger_lines(spark, tmp_path):
    put(tmp_path / "e.jsonl", '{"a":1}\n\n{"a":2}\n')
    assert sorted(r["a"] for r in readers.ledger(spark, f"{tmp_path}/e.jsonl", "a int").collect()) == [1, 2]
    put(tmp_path / "bad.jsonl", '{"a":1}\n\n[1]\nnope\n')
    assert [r["line_no"] for r in readers.ledger_rejects(spark, f"{tmp_path}/bad.jsonl").orderBy("line_no").collect()] == [3, 4]
    with pytest.raises(Exception):
        readers.ledger(spark, f"{tmp_path}/bad.jsonl", "a int").collect()


def test_eval_cases_raw_and_registry(spark, tmp_path):
    put(tmp_path / "cases.json", [{"id": "1", "language": "en", "reference": "a", "hypothesis": "a"}, {"id": "2"}])
    assert readers.eval_cases(spark, f"{tmp_path}/cases.json").count() == 2
    put(tmp_path / "raw/r.json", '{"x":\n1}')
    assert readers.raw_responses(spark, f"{tmp_path}/raw/*.json").first()["readable"]
    row = ("m", "p", "c", "t", "json", False, 0.1, True, True, True, True, 0)
    with pytest.raises(ValueError):
        readers.registry(spark, [row, row])
    assert readers.registry(spark, [row]).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("j", 0, "a"), ("j", 1, "\n\nb\n"), ("k", 0, "c")], "job_id string, part long, body string")
    writers.write_documents(df, f"{tmp_path}/docs")
    text = "".join(p.read_text() for p in sorted((tmp_path / "docs/job_id=j").glob("part-*")))
    assert text == "a\n\nb\n"
    writers.write_once(df, f"{tmp_path}/once")
    with pytest.raises(Exception):
        writers.write_once(df, f"{tmp_path}/once")
    writers.append_events(df, f"{tmp_path}/log")
    writers.append_events(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    writers.replace_table(df, f"{tmp_path}/t", ["job_id"])
    writers.replace_table(df.limit(1), f"{tmp_path}/t", ["job_id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_captions_in_parts_equal_one_document(spark):
    rows = [("j", i, i * 1.0, i + 0.5, "S" if i % 2 else None, f"t<{i}>") for i in range(1, 12)]
    rows += [("j", 12, 5.0, 5.0004, None, "too short"), ("j", 13, None, None, None, "untimed"), ("j", 14, 1.0, 2.0, None, "  "), ("empty", 1, None, None, None, "x")]
    df = spark.createDataFrame(rows, "job_id string, ord int, start_sec double, end_sec double, speaker string, text string")
    cues = [f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},500\n" + (f"S: t&lt;{i}&gt;" if i % 2 else f"t&lt;{i}&gt;") for i in range(1, 12)]
    parts = documents.srt(df, lines_per_part=4).orderBy("part").collect()
    assert len(parts) == 3 and "".join(p["body"] for p in parts) == "\n\n".join(cues) + "\n"
    vtt = {}
    for r in documents.vtt(df, lines_per_part=4).orderBy("job_id", "part").collect():
        vtt[r["job_id"]] = vtt.get(r["job_id"], "") + r["body"]
    assert vtt == {"j": "WEBVTT\n\n" + "\n\n".join(c.replace(",", ".") for c in cues) + "\n", "empty": "WEBVTT\n"}
    table = documents.html_table(df.where("job_id = 'empty'"), ["job_id"], "ord", ["Text"], [documents.html_cell(F.col("speaker"), "MISSING")])
    assert table.first()["body"] == "<table><thead><tr><th>Text</th></tr></thead><tbody>\n<tr><td>MISSING</td></tr>\n</tbody></table>"


def raw(spark, value, **extra):
    cols = {"job_id": "j", "chunk_filename": "c", "raw": value if isinstance(value, str) else json.dumps(value), **extra}
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_native_timing_never_clamps(spark):
    words = [{"word": "a", "start": "1.250s", "end": 2}, {"text": "b"}, {"word": "c", "start": 44, "end": 46}, {"word": "d", "start": True, "end": 2}, "x", {"word": "e", "startOffset": "3s", "end_offset": 45}]
    got = pj.native_timing(raw(spark, {"words": words}, chunk_start_sec=915.0, chunk_duration_sec=45.0)).orderBy("index").collect()
    assert [r["warning"] for r in got] == [
        None, "words[1] omitted: provider start/end was unavailable", "words[2] omitted: provider timing was outside the chunk",
        "words[3] omitted: provider start/end was unavailable", "words[4] omitted: provider item was not an object", None]
    assert (got[0]["global_start_sec"], got[0]["provider_start"], got[5]["global_end_sec"]) == (916.25, "1.250s", 960.0)


def test_response_shapes(spark):
    chat = {"choices": [{"message": {"content": ""}}, {"message": {"content": "hi", "words": [{"w": 1}]}}]}
    r = pj.chat_payload(raw(spark, chat)).first()
    assert r["text"] == "hi" and json.loads(r["words"]) == [{"w": 1}]
    fenced = {"candidates": [{"content": {"parts": [{"text": "```json\n{\"text\": \"inner\"}\n```"}]}}]}
    assert pj.parts_payload(raw(spark, fenced)).first()["text"] == "inner"
    spoken = {"candidates": [{"content": {"parts": [{"audioTranscription": {"speakerLabel": "A", "words": [{"word": "x", "startOffset": "1s", "endOffset": "1.5s"}, {"word": "y", "endOffset": "2s"}]}}]}}]}
    r = pj.parts_payload(raw(spark, spoken)).first()
    assert r["text"] == "x y" and (r["segments"][0]["speaker"], r["segments"][0]["start_sec"], r["segments"][0]["end_sec"]) == ("A", 1.0, 2.0)
    note = lambda t, s, a, b: {"type": "word_info", "text": t, "speaker": s, "start_index": a, "end_index": b}
    step = {"steps": [{"type": "model_output", "content": [{"text": "héllo you 福", "annotations": [note("hé", "1", 0, 6), note("you", "1", 7, 10), note("福", "2", 99, 102)]}]}]}
    r = pj.parts_payload(raw(spark, step)).first()
    assert [(s["text"], s["speaker"]) for s in r["segments"]] == [("héllo you", "1"), ("福", "2")]
    sent = {"transcripts": [{"channel_id": 0, "text": "T", "sentences": [{"begin_time": 500, "end_time": 900, "text": "S", "speaker_id": 3, "words": [{"begin_time": 500, "end_time": 700, "text": "w"}]}]}]}
    r = pj.sentence_payload(raw(spark, sent)).first()
    assert (r["text"], r["segments"][0]["speaker"], r["segments"][0]["start_sec"]) == ("T", "spk:3", 0.5)
    diar = {"utterances": [{"text": "b", "speaker_id": "z"}, {"text": " ", "speaker": "q"}, {"text": "a"}, {"text": "c", "label": "z"}]}
    assert pj.diarized_segments(raw(spark, diar)).first()["text"] == "Speaker 1: b\nSpeaker 2: a\nSpeaker 1: c"
    r = pj.canonical_responses(raw(spark, {"candidates": [{"content": {"parts": [{"text": "p"}, {"text": "q"}]}}], "modelVersion": "v2"}, model="m")).first()
    assert (r["text"], r["requested_model"], r["resolved_model"], r["resolved_model_version"]) == ("p\nq", "m", "m", "v2")
    assert pj.empty_reason(raw(spark, {"candidates": [{}]})).first()["reason"] == "provider supplied no finish/block reason"


def test_wav_statistics(spark, tmp_path):
    def write(name, samples, width=2):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(16000)
            w.writeframes(struct.pack(f"<{len(samples)}h", *samples) if width == 2 else bytes(samples))

    write("loud.wav", [32767, -32768, 100, 200]), write("quiet.wav", [0] * 100), write("eight.wav", [1, 2, 3], 1)
    got = {r["path"].rsplit("/", 1)[1]: r for r in media.pcm_statistics(readers.binary_files(spark, str(tmp_path))).collect()}
    assert got["loud.wav"]["peak_dbfs"] == 0.0 and got["loud.wav"]["clipping_ratio"] == 0.5 and got["loud.wav"]["warnings"] == ["possible_clipping"]
    assert got["quiet.wav"]["peak_dbfs"] is None and got["quiet.wav"]["warnings"] == ["mostly_near_silence"]
    assert got["eight.wav"]["status"] == "not_analyzed"


def test_silence_log_edges(spark):
    lines = ["silence_end: 2.0", "silence_start: 5.5", "noise", "silence_start: 6.0", "silence_end: 99", "silence_start: 8"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no long, line string")
    got = media.silence_intervals(df, spark.createDataFrame([("f", 10.0)], "file string, duration_sec double"))
    assert sorted((r["start_sec"], r["end_sec"]) for r in got.collect()) == [(0.0, 2.0), (6.0, 10.0), (8.0, 10.0)]


def test_ledger_stream_keeps_the_latest(spark, tmp_path):
    schema = "event_id string, job_id string, seq long, recorded_at timestamp, v int"
    src, ckpt = (str(tmp_path / n) for n in ("in", "ckpt"))

    def deliver(rows):
        spark.createDataFrame(rows, "event_id string, job_id string, seq long, t string, v int").select(
            "event_id", "job_id", "seq", F.col("t").cast("timestamp").alias("recorded_at"), "v").coalesce(1).write.mode("append").json(src)
        ls.maintain_latest(ls.ledger_stream(spark, src, ls.StructType.fromDDL(schema)), ckpt).awaitTermination(120)

    deliver([("e1", "j", 1, "2026-01-01", 1), ("e2", "k", 1, "2026-01-01", 5)])
    deliver([("e3", "j", 2, "2026-01-02", 2), ("e2", "k", 1, "2026-01-01", 5)])
    assert {(r["job_id"], r["v"]) for r in ls.current(spark, ckpt).collect()} == {("j", 2), ("k", 5)}


def test_spend_stream_matches_the_batch_guard(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id string, seq long, chunk_sha256 string, model string, provider_code string, estimated long, actual long, cached boolean"
    src = str(tmp_path / "in")
    rows = [("j", i, f"h{i}", "m", "p", 12, 10, i == 2) for i in range(1, 8)]
    for part in (rows[:3], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = (spend.guard_stream(spark.readStream.schema(schema).parquet(src), 40).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination(180)
    got = {r["seq"]: r["runs"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from earwitness.operators import costs
    from earwitness.operators.scan import slice_of
    df = spark.createDataFrame(rows, schema)
    want = {r["seq"]: r["runs"] for r in costs.spend_guard(df, spark.createDataFrame([("j", 40)], "job_id string, cap long"), slice_of("seq", 2)).collect()}
    assert got == want and not all(want.values())
