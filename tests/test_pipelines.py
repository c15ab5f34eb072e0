"""Every user-level pipeline end to end on a few rows."""

from pyspark.sql import functions as F

from earwitness.functions.hashing import register_sql_functions
from earwitness.operators import alignment, cache, costs, rescue
from earwitness.operators.scan import slice_of
from earwitness.plans import pipelines as pl
from tests.test_timeline import ORDER, documents
from tests.test_workflow import payloads


def compared(spark):
    chunk = lambda n, text: f'{{"chunk_filename":"{n}","chunk_start_sec":{n * 100},"chunk_end_sec":{n * 100 + 70},"text":"{text}"}}'
    rows = []
    for i, p in enumerate(ORDER):
        texts = ["we meet at the river at nine", ["all quite different words", "zzz yyy xxx", "purple elephants dance"][i]]
        rows.append(("j", p, i, 0.0, 500.0, "h", "[" + ",".join(chunk(n, t) for n, t in enumerate(texts)) + "]", None))
    rows.append(("late", "a", 0, 0.0, 10.0, "h", "[" + chunk(0, "too long") + "]", None))
    return pl.compare(documents(spark, rows), ORDER)


def test_compare_draft_rescue(spark):
    out = compared(spark)
    assert [r["agreement_status"] for r in out["regions"].orderBy("region_no").collect()] == ["GREEN", "RED"]
    assert out["rejects"].select("job_id").distinct().first()[0] == "late" and out["statistics"].first()["aligned_regions"] == 2
    assert alignment.region_rows(out["regions"], ["job_id", "region_no"]).count() == 6
    draft = pl.final_draft(out["regions"], ORDER)
    assert draft["statistics"].first()["auto_accepted"] == 1 and draft["rejects"].count() == 0
    quiet = spark.createDataFrame([("j", 123.0, 124.0), ("j", 145.0, 146.0)], "job_id string, start_sec double, end_sec double")
    res = pl.rescue_select(out["regions"], quiet)
    got = [(r["start_sec"], r["end_sec"], r["strategy"]) for r in res["windows"].orderBy("chunk_index").collect()]
    assert got == [(100.0, 124.0, "silence"), (124.0, 146.0, "silence"), (146.0, 170.0, "source_end")]
    assert res["routes"].first()["route"] == "rescue" and res["errors"].count() == 0 and res["pass_through"].count() == 0
    assert rescue.window_statistics(res["windows"]).first()["median_window_duration_sec"] == 24.0
    ask = spark.createDataFrame([("j", "s", "s", 100.0, 170.0), ("j", "s", "t", 100.0, 169.0)], "job_id string, source_sha256 string, rescue_sha256 string, rescue_start_sec double, rescue_end_sec double")
    assert sorted(len(r["errors"]) for r in cache.usable_rescue(ask, res["first_red"]).collect()) == [0, 2]


def test_speaker_pipeline(spark):
    raw = '{"words":[{"word":"hi","start":0.1,"end":0.4,"speaker":"s1"},{"word":"yo","start":0.5,"end":0.9,"speaker":"s2"},{"word":"bad","start":9,"end":8}]}'
    p = spark.createDataFrame([("j", "c1", 10.0, 5.0, raw)], "job_id string, chunk_filename string, chunk_start_sec double, chunk_duration_sec double, raw string")
    w = spark.createDataFrame([("j", "w1", 10.0, 12.0)], "job_id string, window_id string, start double, end double")
    out = pl.speaker_timeline(p, w, F.lit("a"), 30.0)
    assert out["windows"].first()["speaker_ids"] == ["s1", "s2"] and out["sensitive"].count() == 1 and out["warnings"].count() == 1
    key = out["speakers"].where("provider_speaker_id = 's1'").first()["local_speaker_key"]
    ev = spark.createDataFrame([("j", 1, key, None, "Ann"), ("j", 2, "nobody", None, "X")], "job_id string, seq long, local_speaker_key string, canonical_speaker_id string, display_name string")
    named = pl.map_speakers(out["speakers"], ev)
    assert {r["display_label"] for r in named["speakers"].collect()} == {"Ann [s1]", "s2"} and named["rejects"].count() == 1


def test_remaining_pipelines(spark, tmp_path):
    seg = spark.createDataFrame([("j", "s1", "c", 1, "A", "one")], "job_id string, segment_id string, chunk_filename string, ord int, speaker string, text string")
    ev = spark.createDataFrame([("j", 1, "s1", "uno", "r", "me", "t", None)], "job_id string, seq long, segment_id string, accepted_text string, reason string, reviewer string, corrected_at string, expected_original_sha256 string")
    out = pl.apply_corrections(seg, spark.createDataFrame([("j", "c", "A: one"), ("j", "d", "kept")], "job_id string, chunk_filename string, text string"), ev)
    assert {r["text"] for r in out["chunks"].collect()} == {"A: uno", "kept"}
    cards = pl.scorecards(spark.createDataFrame([("1", "en", "a", "a")], "id string, language string, reference string, hypothesis string"))
    assert cards["gate"].first()["status"] == "pass" and cards["report"].first()["case_count"] == 1
    meet = spark.createDataFrame([("m", 1, "2026-09-11T08:00:00Z", "user", "P", "C", "S"), ("m", 2, "2026-09-11T08:00:00Z", "user", "P", "C", "S"), ("x", 3, "2026-09-11", "user", "P", "C", "S")],
                                 "meeting_id string, seq long, meeting_start string, meeting_datetime_source string, project string, content string, short_name string")
    arch = pl.archive(meet, spark.createDataFrame([("m", 1)], "meeting_id string, revision long"), spark.createDataFrame([], "folder string"), slice_of("seq", 10))
    assert sorted(r["final_stem"] for r in arch["revisions"].collect()) == ["2609110800 S rev02", "2609110800 S rev03"] and arch["rejects"].count() == 1
    log = spark.createDataFrame([(1, 1, "silence_start: 8.8"), (1, 2, "silence_end: 9.2")], "file int, line_no long, line string")
    rec = spark.createDataFrame([(1, 2600, 100, 10.0, 6.0, 12.0, 2.0, 3.0)], "recording_id int, total_frames long, framerate int, target_sec double, min_sec double, max_sec double, overlap_sec double, search_window_sec double")
    assert pl.chunk_plan(rec, log).orderBy("chunk_index").first()["end_sec"] == 9.2
    (tmp_path / "a.wav").write_bytes(b"same"), (tmp_path / "b.wav").write_bytes(b"same")
    qc = pl.media_qc(spark.read.format("binaryFile").load(str(tmp_path)), spark.createDataFrame([], "sha256 string, ext string"))
    assert qc["objects"].count() == 1 and sorted(r["reused"] for r in qc["report"].collect()) == [False, True]
    assert {r["status"] for r in qc["signals"].collect()} == {"not_wav"}
    agg = pl.aggregate(payloads(spark, [("c0", 0, "a", "hello", "h")]))
    assert agg["srt"].count() == 0 and agg["vtt"].first()["body"] == "WEBVTT\n"


def test_envelopes(spark):
    models = spark.createDataFrame([("m1", "a", 300, 20), ("m2", "b", 100, 50), ("m3", "c", 0, 10)], "model_id string, provider_code string, safe_duration_sec int, request_limit_bytes int")
    limits = dict(target_sec=240, max_sec=360, min_sec=90, target_bytes=30, hard_bytes=40)
    rows = costs.request_envelope(models, limits)
    got = {r["model_id"]: r for r in rows.collect()}
    assert (got["m1"]["target_sec"], got["m1"]["max_sec"], got["m1"]["min_sec"], got["m1"]["target_bytes"]) == (240, 300, 90, 20)
    assert (got["m2"]["target_sec"], got["m2"]["min_sec"], got["m2"]["hard_bytes"]) == (100, 50, 40) and len(got["m3"]["errors"]) == 1
    assert costs.tightest_envelope(rows.where(F.size("errors") == 0)).first()["target_sec"] == 100
    first = costs.one_per_provider(spark.createDataFrame([("x", "p", 1), ("y", "p", 0), ("z", "q", 2)], "model_id string, provider string, position int"), "q")
    assert [r["model_id"] for r in first.collect()] == ["y"]


def test_sql_functions(spark):
    register_sql_functions(spark)
    assert spark.sql("SELECT seq_ratio('abcd', 'bcde') AS r, nfkc_casefold('Straße') AS f").first() == (0.75, "strasse")


def test_timings_are_read_once_and_byte_spans_are_not_added_up_again(spark):
    from earwitness.catalog import all_queries
    from earwitness.operators import provider_json as pj

    raw = '{"words": [{"text": "a", "start": 1, "end": 2, "speaker": "x"}, {"text": "b", "start": 9, "end": 99, "speaker": "y"}, {"text": "c", "start": 3, "end": 4}], "segments": [{"text": "d", "start": "1s", "end": "4s", "speaker": " z "}]}'
    late = '{"words": [{"text": "b", "start": 9, "end": 99, "speaker": "y"}]}'
    p = spark.createDataFrame([("j", "c1", 10.0, 5.0, raw), ("j", "c2", 10.0, 5.0, late)], "job_id string, chunk_filename string, chunk_start_sec double, chunk_duration_sec double, raw string")
    asked = spark.createDataFrame([("j", "c1", True), ("j", "c2", True), ("j", "c3", False)], "job_id string, chunk_filename string, timing_requested boolean")
    out = pj.timing_capability(pj.native_timing(p), asked)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
    got = {r["chunk_filename"]: tuple(r)[2:] for r in out.collect()}
    assert got == {"c1": ("available", ["x", "z"], 2), "c2": ("requested_but_not_returned", [], 0), "c3": ("not_requested", [], 0)}
    plan = all_queries()["parts_turns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(slice(" not in plan and "lambdafunction((octet_length" not in plan


def test_a_chain_is_checked_over_slices_without_joining_its_events(spark):
    from pyspark.sql import functions as F
    from earwitness.operators import pilot
    from earwitness.operators.scan import slice_of

    rows, want = [], {}
    for job, wrong in (("a", None), ("b", 0), ("c", 4), ("d", 3), ("e", 7), ("f", 5)):
        before = None
        for i in range(8):  # slices of three: 0-2, 3-5, 6-7
            named = "tampered" if i == wrong and job != "f" else before
            rows.append((job, i, named, f"{job}{i}", f"{job}{i}" if job != "f" or i != wrong else "other"))
            before = f"{job}{i}"
        want[job] = (wrong is None, 8, wrong, before if wrong is None else None)
    df = spark.createDataFrame(rows, "job_id string, seq long, previous_event_sha256 string, event_sha256 string, again string")
    for width in (1, 3, 100):
        out = pilot.chain_report(df, slice_of("seq", width), F.col("again"))
        assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
