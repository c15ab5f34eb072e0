"""Review, speakers, transcripts, corrections, pilot, pricing, chunking, costs and archive."""

import difflib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from earwitness import schemas
from earwitness.operators import archive, chunking, corrections, costs, evaluation, pilot, pricing, review, speakers, transcripts
from earwitness.operators.scan import slice_of
from earwitness.params import PriceBook


def review_windows(spark, speaker_on_green=False):
    rows = [(1, f"w{i}", 915.0 + 24 * i, 939.0 + 24 * i, s, s == "GREEN", s != "GREEN", speaker_on_green and s == "GREEN", f"text {i}")
            for i, s in enumerate(["RED", "GREEN", "AMBER", "RED", "AMBER"])]
    df = spark.createDataFrame(rows, "job_id int, window_id string, start double, end double, derived_status string, auto_accepted boolean, review_required boolean, speaker_selected boolean, t string")
    return df.select(*df.columns[:8], F.create_map(F.lit("a"), F.struct(F.col("t").alias("text"))).alias("provider_candidates"),
                     F.when(F.col("auto_accepted"), F.col("t")).alias("final_text"), F.when(F.col("auto_accepted"), F.lit("a")).alias("selected_provider"))


def test_review_confirms_the_selected_share(spark):
    w = review_windows(spark)
    made = [(1, "w0", 1, "unclear", None, None), (1, "w0", 2, "provider_candidate", "a", None), (1, "w2", 3, "manual_correction", None, "fixed"),
            (1, "w3", 4, "provider_candidate", "a", None), (1, "w4", 5, "provider_candidate", "a", None),
            (1, "w1", 6, "unclear", None, None), (1, "w9", 7, "unclear", None, None), (1, "w2", 8, "manual_correction", None, " "),
            (1, "w2", 9, "provider_candidate", "z", None), (1, "w2", 10, "nope", None, None)]
    checked = review.check_decisions(spark.createDataFrame(made, "job_id int, window_id string, seq int, decision_type string, selected_provider string, final_text string"), w)
    assert {r["seq"] for r in checked.where(F.size("errors") > 0).collect()} == {6, 7, 8, 9, 10}
    spoken = spark.createDataFrame([(1, f"w{i}", i, "confirmed" if i else "not_applicable") for i in (0, 2, 3, 4)], "job_id int, window_id string, seq int, speaker_status string")
    rows = review.reviewed(w, checked.where(F.size("errors") == 0), spoken)
    source = spark.createDataFrame([(1, 120.0)], "job_id int, source_audio_seconds double")
    s = review.verification_summary(rows, 60.0, targeted=True, source_seconds=source).first()
    assert (s["selected_window_count"], s["selected_audio_seconds"], s["selected_audio_share_percent"]) == (4, 96.0, 80.0)
    assert s["completion_label"] == "Selected-window human confirmed" and s["windows_requiring_attention"] == 0 and s["overall_status"] == "COMPLETE"
    assert review.inbox(rows, "unresolved", targeted=True).count() == 0 and review.inbox(rows, "AMBER", targeted=True).count() == 2
    stats = review.reviewed_statistics(rows).first()
    assert (stats["total_windows"], stats["resolved_windows"], stats["human_review_decisions"]) == (5, 5, 4)


def test_speaker_sensitive_green_window_joins_the_selection(spark):
    w = review_windows(spark, speaker_on_green=True)
    none = spark.createDataFrame([], "job_id int, window_id string, seq int, decision_type string, selected_provider string, final_text string")
    nobody = spark.createDataFrame([], "job_id int, window_id string, seq int, speaker_status string")
    s = review.verification_summary(review.reviewed(w, none, nobody), 60.0, targeted=True).first()
    assert s["selected_window_count"] == 5 and s["completion_label"] == "Automated transcript" and s["speaker_pending"] == 5
    assert s["selected_audio_share_percent"] == 100.0


def test_stale_decisions_are_set_aside(spark):
    saved = spark.createDataFrame([(1, "w", "old"), (2, "w", "now"), (3, "w", "now")], "job_id int, window_id string, source_sha256 string")
    drafts = spark.createDataFrame([(1, "now"), (2, "now")], "job_id int, source_sha256 string")
    good, bad = review.current_source_only(saved, drafts)
    assert [r[0] for r in good.collect()] == [2] and sorted(r[0] for r in bad.collect()) == [1, 3]


def test_turns_follow_speaker_changes(spark):
    rows = [(1, i, t, s, "r", "c", 915.0 + a, 915.0 + b) for i, (t, s, a, b) in enumerate(
        [("你", "spk_1", .1, .5), ("hello", "spk_2", .5, .9), ("ok", "spk_1", .9, 1.2), ("then", "spk_1", 1.2, 1.6)])]
    df = spark.createDataFrame(rows, "job_id int, word_no int, text string, speaker string, run_id string, chunk_filename string, start double, end double")
    turns = speakers.speaker_turns(df)
    got = turns.orderBy("turn_no").collect()
    assert [(r["speaker"], r["start"], r["end"], r["text"]) for r in got] == [
        ("spk_1", 915.1, 915.5, "你"), ("spk_2", 915.5, 915.9, "hello"), ("spk_1", 915.9, 916.6, "ok then")]
    stats = speakers.timeline_statistics(turns).first()
    assert (stats["speaker_ids"], stats["word_count"], stats["segment_count"]) == (["spk_1", "spk_2"], 4, 3)


def test_canonical_ids_reuse_and_fill_gaps(spark):
    events = [(1, 1, "x", None, "X"), (1, 2, "y", None, "Y"), (1, 3, "x", "host", "X"), (1, 4, "z", None, "Z"), (1, 5, "y", None, "Y2"), (2, 6, "x", None, "Q")]
    df = spark.createDataFrame(events, "job_id int, seq long, local_speaker_key string, canonical_speaker_id string, display_name string")
    got = {r["seq"]: r["canonical_speaker_id"] for r in speakers.canonical_ids(df).collect()}
    assert got == {1: "canonical-speaker-001", 2: "canonical-speaker-002", 3: "host", 4: "canonical-speaker-001", 5: "canonical-speaker-002", 6: "canonical-speaker-001"}
    known = df.select("job_id", "local_speaker_key").distinct()
    bad = df.withColumns({"display_name": F.lit(" "), "canonical_speaker_id": F.lit("a b")})
    assert all(len(r["errors"]) == 2 for r in speakers.mapping_errors(bad, known).collect())


def payloads(spark, rows):
    """rows: chunk, ordinal, provider, text, sha"""
    full = schemas.chunk_transcript()["segments"].dataType
    df = spark.createDataFrame([("j", c, o, p, t, s) for c, o, p, t, s in rows], "job_id string, chunk_filename string, ordinal int, provider string, text string, chunk_sha256 string")
    return df.select("*", F.lit("s").alias("source_sha256"), F.concat_ws("/", "chunk_filename", "ordinal").alias("transcript_path"), F.col("provider").alias("provider_code"),
                     F.lit("m").alias("model"), F.lit("r").alias("run_id"), F.lit("chunk").alias("segment_timing_scope"),
                     (F.regexp_extract("chunk_filename", r"(\d+)", 1).cast("double") * 10).alias("chunk_start_sec"), F.lit(None).cast(full).alias("segments"))


def test_reconcile_ladder(spark):
    rows = [("c1", 0, "a", "Hello there world", "h"), ("c1", 1, "b", "hello  THERE world", "h"), ("c2", 0, "a", "", "h"), ("c2", 1, "b", "x", "h"),
            ("c3", 0, "a", "one", "h"), ("c4", 0, "a", "same", "h"), ("c4", 1, "A ", "same", "h"), ("c5", 0, "a", "the quick brown fox jumps", "h"),
            ("c5", 1, "b", "the quick brown fox jumped", "h"), ("c6", 0, "a", "alpha", "h"), ("c6", 1, "b", "omega zzz", "h"), ("c7", 0, "a", "q", "h"), ("c7", 1, "b", "q", "g")]
    got = {r["chunk_key"][-2:]: r for r in transcripts.reconcile(transcripts.chunk_records(payloads(spark, rows))).collect()}
    assert [got[f"c{i}"]["grade"] for i in range(1, 7)] == ["green", "red", "amber", "amber", "amber", "red"]
    assert got["c2"]["selected_ordinal"] == 1 and got["c2"]["selection_reason"] == "first_nonempty_candidate_preserved"
    assert got["c6"]["selected_ordinal"] == 0 and got["c7"]["errors"] == ["conflicting chunk hashes"]
    want = round(difflib.SequenceMatcher(None, "the quick brown fox jumps", "the quick brown fox jumped", autojunk=False).ratio(), 6)
    assert got["c5"]["minimum_pairwise_lexical_similarity"] == want and got["c3"]["minimum_pairwise_lexical_similarity"] is None


def test_chunk_texts_are_folded_once(spark, monkeypatch):
    cut = []
    plain = transcripts.cut_lineage
    monkeypatch.setattr(transcripts, "cut_lineage", lambda df: cut.append(plain(df)) or cut[-1])
    rows = [("j", f"k{i}", o, t, "p%d" % o, "h", 0.0, "f") for i in range(3) for o, t in enumerate(["Straße", "STRASSE", "other"])]
    df = spark.createDataFrame(rows, "job_id string, chunk_key string, ordinal int, text string, provider string, chunk_sha256 string, sort_start double, chunk_filename string")
    graded = transcripts.reconcile(df)
    assert len(cut) == 1 and "form" in cut[0].columns
    assert "nfkc_casefold" not in graded._jdf.queryExecution().executedPlan().toString()
    assert {r["reason"] for r in graded.collect()} == {"material_candidate_disagreement"}


def test_least_similarity_over_many_blocks(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(5)) for _ in range(150)]
    rows = [("j", "k", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "job_id string, chunk_key string, ordinal int, form string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    distinct = sorted(first, key=first.get)
    want = min(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for i, a in enumerate(distinct) for b in distinct[i + 1:])
    assert len(distinct) > transcripts.BLOCK
    assert transcripts.least_similarity(df).first()["least_ratio"] == want


def test_boundary_repeat_is_removed_once(spark):
    a = "we agreed that the budget will be reviewed next Monday morning"
    b = "the budget will be reviewed next Monday, morning. Then the team left."
    assert transcripts.repeated_span([t[0] for t in transcripts._tokens(a)], b)[2:] == (8, "suffix_prefix")
    c = "uh yes the budget will be reviewed next Monday morning okay Current unique continuation remains."
    start, end, n, how = transcripts.repeated_span([t[0] for t in transcripts._tokens(a + " thanks")], c)
    assert how == "anchored_exact_span" and c[:start].rstrip() + " " + c[end:].lstrip() == "uh yes okay Current unique continuation remains."
    assert transcripts.repeated_span(["a", "b"], "nothing in common here") == (0, 0, 0, None)


def test_parallel_dedup_equals_the_whole_history(spark):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(400)]
    rows, want = [], {}
    for job in range(6):
        history, last = [], []
        for n in range(1, 30):
            fresh = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 230, 300]))]
            body = (last[-rng.choice([0, 5, 12, 40]):] if rng.random() < 0.7 and last else []) + fresh
            labelled = rng.random() < 0.15
            text = " ".join(body)
            span = (0, 0, 0, None) if labelled else transcripts.repeated_span(history[-100:], text)
            history += [t[0] for t in transcripts._tokens(text) if not (t[1] >= span[0] and t[2] <= span[1])]
            want[job, n] = span
            rows.append((job, n, text, labelled))
            last = body
    df = spark.createDataFrame(rows, "job_id int, chunk_no long, text string, labelled boolean")
    got = {(r["job_id"], r["chunk_no"]): (r["removal_start"], r["removal_end"], r["removed_tokens"], r["match_mode"]) for r in transcripts.boundary_overlaps(df).collect()}
    assert got == want and sum(v[2] > 0 for v in want.values()) > 30


def test_full_transcript_end_to_end(spark):
    from earwitness.plans.pipelines import aggregate

    a = "we agreed that the budget will be reviewed next Monday morning"
    rows = [("c0", 0, "a", a, "h"), ("c0", 1, "b", a, "h"), ("c1", 0, "a", "the budget will be reviewed next Monday morning. Then we left.", "h"), ("c1", 1, "b", "unrelated words entirely", "h")]
    out = aggregate(payloads(spark, rows))
    s = out["summary"].first()
    assert (s["green"], s["red"], s["highest_attention_grade"], s["candidate_count"], s["providers"]) == (1, 1, "red", 4, ["a", "b"])
    text = out["text"].first()["body"]
    assert text == a + "\n\nThen we left." and s["character_count"] == len(text) and s["word_count"] == len(text.split())
    assert [r["text"] for r in out["segments"].orderBy("ord").collect()] == [a, "Then we left."]


def test_segment_normalisation(spark):
    seg = '[{"start_sec":1,"end_sec":2,"speaker":"S","text":" hi "},{"text":"  "},{"start_sec":3,"end_sec":4,"text":"yo"}]'
    p = payloads(spark, [("c1", 0, "a", "ignored", "h")])
    p = p.withColumn("segments", F.from_json(F.lit(seg), p.schema["segments"].dataType))
    r = transcripts.chunk_records(p).first()
    assert [(s["segment_id"], s["start_sec"], s["speaker"]) for s in r["norm_segments"]] == [("c1:0001", 11.0, "S"), ("c1:0003", 13.0, None)]
    assert r["text"] == "S: hi\nyo"
    given = F.from_json(F.lit('[{"text":"abc"},{"text":"def ghi"}]'), "array<struct<text:string,speaker:string>>")
    cut = spark.createDataFrame([(2, 8)], "s int, e int").select(transcripts.trimmed_segments(given, F.col("s"), F.col("e")).alias("x")).first()["x"]
    assert [s["text"] for s in cut] == ["ab", "ghi"]


def test_identity_conflicts(spark):
    full = "job_id string, transcript_path string, chunk_filename string, chunk_sha256 string, provider string, provider_code string, model string, run_id string, response_format string"
    e = spark.createDataFrame([("j", "p1", "c", "h", "a", "A", "m", "r", "f"), ("j", "p2", "c", "h", "a", "A", "m", "r", "f")], full)
    p = spark.createDataFrame([("x", "p1", "c", None, "b", "A", "m", "r", "f", "ours.transcript.chunk.v1", None)], full + ", schema_version string, segment_timing_scope string")
    got = {r["transcript_path"]: set(r["errors"]) for r in transcripts.identity_errors(e, p).collect()}
    assert got["p1"] == {"mismatched job_id", "mismatched provider", "missing chunk_sha256", "missing segment_timing_scope"}
    assert got["p2"] == {"transcript payload is missing"}


def test_corrections_see_the_text_before_them(spark):
    from hashlib import sha256

    h = lambda s: sha256(s.encode()).hexdigest()
    seg = spark.createDataFrame([(1, "s1", "one"), (1, "s2", "two")], "job_id int, segment_id string, text string")
    ev = [(1, 1, "s1", " uno ", "r", "me", "t", h("one")), (1, 2, "s1", "eins", "r", "me", "t", h("one")), (1, 3, "s1", "ein", "r", "me", "t", h("uno")),
          (1, 4, "s9", "x", "r", "me", "t", None), (1, 5, "s2", "", "r", "me", "t", None)]
    df = spark.createDataFrame(ev, "job_id int, seq long, segment_id string, accepted_text string, reason string, reviewer string, corrected_at string, expected_original_sha256 string")
    checked = corrections.check_corrections(df, seg)
    assert {r["seq"] for r in checked.where(F.size("errors") > 0).collect()} == {2, 4, 5}
    hist = corrections.correction_history(checked).orderBy("seq").collect()
    assert [r["original_text_sha256"] for r in hist] == [h("one"), h("uno")] and hist[0]["accepted_text_sha256"] == h("uno")
    assert all(r["correction_id"].startswith("corr-") and len(r["correction_id"]) == 25 for r in hist)
    now = {r["segment_id"]: (r["text"], r["correction_count"]) for r in corrections.corrected_segments(seg, corrections.correction_history(checked)).collect()}
    assert now == {"s1": ("ein", 2), "s2": ("two", 0)}


def test_scorecards_and_gate(spark):
    df = spark.createDataFrame([("1", "en", "a b", "a b", "p", 60.0, 0.0045), ("2", "id", "x y", "q r s", "bad", 0.0, 0.0)],
                               "id string, language string, reference string, hypothesis string, provider string, duration_seconds double, cost_usd double")
    cards = evaluation.scorecards(evaluation.evaluate(df))
    got = {r["provider"]: r for r in cards.collect()}
    assert got["p"]["qualification"] == "pass" and got["p"]["cost_per_audio_minute_usd"] == 0.0045 and got["p"]["model"] == "synthetic"
    assert got["bad"]["qualification"] == "fail" and got["bad"]["cost_per_audio_minute_usd"] is None
    assert evaluation.release_gate(cards).first()["status"] == "fail"
    assert evaluation.release_gate(cards.where("provider = 'p'")).first()["status"] == "pass"
    assert evaluation.release_gate(cards.where("false")).first()["status"] == "fail"


def outcome(**kw):
    base = dict(job_id="j1", seq=1, cohort_code="c", participant_code="p", data_classification="consented_private", task_status="completed", evidence_eligible=True,
                duration_seconds=3600.0, actual_cost_usd=1.6, segment_count=10, correction_count=2, review_minutes=12.0, delivery_labor_cost_usd=4.0, support_cost_usd=1.0,
                price_charged_usd=10.0, trust_before=2, trust_after=4, confidence_to_share=4, transcript_usable=True, would_use_again=True, primary_blocker="accuracy",
                retention_review_due_on="2026-01-01", public_excerpt_authorized=False, dialect_units_total=10, dialect_units_correct=8, meaning_units_total=0, meaning_units_correct=0,
                critical_terms_total=0, critical_terms_correct=0, speaker_turns_total=0, speaker_attribution_errors=0, unsupported_content_events=0, omission_events=0)
    return {**base, **kw}


def test_pilot_metrics_and_summary(spark):
    rows = [outcome(), outcome(job_id="j2", correction_count=1, transcript_usable=False), outcome(job_id="j3", data_classification="synthetic", evidence_eligible=False)]
    df = spark.createDataFrame(rows).withColumn("retention_review_due_on", F.col("retention_review_due_on").cast("date"))
    m = pilot.job_metrics(df)
    one = m.where("job_id = 'j1'").first()
    assert (one["corrections_per_100_segments"], one["dialect_reference_accuracy_percent"], one["total_delivery_cost_usd"], one["gross_margin_percent"]) == (20.0, 80.0, 6.6, 34.0)
    assert one["meaning_unit_accuracy_percent"] is None
    chains = spark.createDataFrame([("j1", True), ("j2", True), ("j3", True)], "job_id string, ok boolean")
    now, good = pilot.eligible_records(m, chains)
    counts = pilot.scan_counts(now).first()
    assert (counts["records_scanned"], counts["synthetic_records_excluded"]) == (3, 1)
    s = pilot.cohort_summary(good, F.lit("2026-01-02").cast("date")).first()
    assert (s["eligible_jobs"], s["participants"], s["transcript_usable_rate_percent"], s["repeat_participant_rate_percent"]) == (2, 1, 50.0, 100.0)
    assert (s["corrections_per_100_segments"], s["average_trust_change"], s["blocker_counts"], s["retention_reviews_overdue"]) == (15.0, 2.0, "accuracy=2", 2)


GOOD = dict(cohort_code="c", participant_code="p", data_classification="consented_private", use_case="oral_history", language_mix=["malay", "malay"], task_status="completed",
            consent_record_id="r", purpose_notice_confirmed=True, consent_confirmed=True, provider_processing_disclosed=True, withdrawal_route_disclosed=True,
            retention_review_due_on="2026-02-28", trust_before=1, trust_after=5, confidence_to_share=3, transcript_usable=True, would_use_again=False, primary_blocker="none")


@pytest.mark.parametrize("change,message", [
    ({}, None), ({"email": "x"}, "unsupported fields: email"), ({"review_minutes": "NaN"}, "review_minutes is out of bounds"), ({"review_minutes": True}, "review_minutes is out of bounds"),
    ({"reference_evaluation": {"meaning_units_total": 1, "meaning_units_correct": 2}}, "meaning_units_correct cannot exceed meaning_units_total"),
    ({"retention_review_due_on": "2026-02-30"}, "retention_review_due_on must be a valid date"), ({"consent_confirmed": False}, "consent requires consent_confirmed"),
    ({"trust_before": True}, "trust_before must be a rating of 1-5"), ({"language_mix": []}, "language_mix must contain 1-8 supported codes"),
    ({"reference_evaluation": {"secret": 1}}, "unsupported reference fields: secret"),
    ({"data_classification": "synthetic", "public_excerpt_authorized": True}, "synthetic records cannot authorise an excerpt")])
def test_pilot_input_contract(spark, change, message):
    raw = json.dumps({**GOOD, **change})
    got = spark.createDataFrame([(raw,)], "raw string").select(pilot.input_errors(F.col("raw")).alias("e")).first()["e"]
    assert got == ([message] if message else [])


def test_chain_breaks_are_located(spark):
    import hashlib

    rows, prev = [], None
    for i in range(9):
        h = hashlib.sha256(json.dumps({"previous_event_sha256": prev, "v": i}, separators=(",", ":")).encode()).hexdigest()
        rows.append(("ok", i, i, prev, h))
        rows.append(("bad", i, i if i != 6 else 99, prev, h))
        prev = h
    df = spark.createDataFrame(rows, "job_id string, seq int, v int, previous_event_sha256 string, event_sha256 string")
    again = pilot.own_hash({"v": F.col("v")}, F.col("previous_event_sha256"))
    got = {r["job_id"]: r for r in pilot.chain_report(df, slice_of("seq", 2), again).collect()}
    assert got["ok"]["ok"] and got["ok"]["latest_event_sha256"] == prev and got["ok"]["event_count"] == 9
    assert not got["bad"]["ok"] and got["bad"]["invalid_index"] == 6


def quote(spark, plan, pay, seconds=None, minutes=None, **book):
    df = spark.createDataFrame([("q", plan, pay, seconds and Decimal(str(seconds)), minutes and Decimal(str(minutes)), "2026-09-11")],
                               "quote_id string, plan_id string, payment_method string, duration_seconds decimal(18,3), requested_review_minutes decimal(18,3), created_at string")
    return pricing.quote_orders(df.withColumn("created_at", F.col("created_at").cast("timestamp")), PriceBook(**book))


def test_price_goldens(spark):
    q = quote(spark, "dialect_draft", "card", 60)[0].first()
    assert str(q["price_pre_gst"]) == "5.90" and q["billed_audio_minutes"] == 1
    q = quote(spark, "dialect_draft", "paynow", 3600.1)[0].first()
    assert q["billed_audio_minutes"] == 61 and str(q["list_price_pre_gst"]) == "6.00"
    q = quote(spark, "compare_and_flag", "card", 3600)[0].first()
    assert (str(q["price_pre_gst"]), str(q["delivery_cost"])) == ("9.90", "6.09")
    q = quote(spark, "human_review_budget", "card", None, 12)[0].first()
    assert (q["billed_review_minutes"], str(q["price_pre_gst"]), str(q["delivery_cost"])) == (30, "27.00", "20.00")
    q = quote(spark, "compare_and_flag", "card", 3600, gst_registered=True)[0].first()
    assert (str(q["gst_amount"]), str(q["customer_total"])) == ("0.89", "10.79")
    for n in (1, 77, 599, 1441):
        for plan in PriceBook().plans:
            assert quote(spark, plan, "card", n * 60, n)[0].first()["after_tax_margin"] >= Decimal("0.15")


def test_price_rejects(spark):
    assert quote(spark, "nope", "card", 60)[1].first()["errors"] == ["unsupported plan"]
    assert quote(spark, "dialect_draft", "cash", 60)[1].first()["errors"] == ["unsupported payment method"]
    assert quote(spark, "dialect_draft", "card")[1].count() == 1
    assert "gst_rate must be at least 0 and below 1" in quote(spark, "dialect_draft", "card", 60, gst_rate=Decimal("1"))[1].first()["errors"]


def recording(spark, seconds, target, lo, hi, overlap, window, quiet):
    r = spark.createDataFrame([(1, int(seconds * 100), 100, target, lo, hi, overlap, window)],
                              "recording_id int, total_frames long, framerate int, target_sec double, min_sec double, max_sec double, overlap_sec double, search_window_sec double")
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in quiet], "recording_id int, start_sec double, end_sec double")
    return chunking.plan_chunks(r, s).orderBy("chunk_index").collect()


def test_chunk_plans(spark):
    got = recording(spark, 25, 10.0, 2.0, 12.0, 4.0, 3.0, [])
    assert [(r["start_sec"], r["end_sec"]) for r in got] == [(0, 10), (6, 16), (12, 22), (18, 25)]
    assert [r["overlap_before_sec"] for r in got] == [0, 4, 4, 4] and [r["overlap_after_sec"] for r in got] == [4, 4, 4, 0]
    got = recording(spark, 26, 10.0, 6.0, 12.0, 2.0, 3.0, [(8.8, 9.2), (16.8, 17.0)])
    assert [(r["end_sec"], r["strategy"]) for r in got] == [(9.2, "silence"), (17.0, "silence"), (26.0, "source_end")]
    got = recording(spark, 25, 10.0, 6.0, 12.0, 2.0, 3.0, [])
    assert [(r["start_sec"], r["end_sec"]) for r in got] == [(0, 10), (8, 18), (16, 25)]


def naive_plan(total, target, lo, hi, overlap, window, quiet, rate=100):
    start, out, length = 0, [], total / rate
    ov = min(round(overlap * rate), max(0, round(target * rate) - 1))
    while start < total:
        at = start / rate
        t = min(length, at + target)
        if length - at <= target or (length - at <= hi and length - at <= target + lo - overlap):
            end = total
        else:
            a, b = at + lo, min(length, at + hi, length + ov / rate - lo)
            b = b if b >= a else min(length, at + hi)
            near, far = max(a, t - window), min(b, t + window)
            c = [(abs(min(max(t, max(s, near)), min(e, far)) - t), min(max(t, max(s, near)), min(e, far))) for s, e in quiet if min(e, far) >= max(s, near)]
            cut = min(c)[1] if c and far >= near else min(max(t, a), b)
            end = min(total, max(start + 1, round(cut * rate)))
        out.append((start, end))
        if end >= total:
            return out
        nxt = end - ov
        start = nxt if nxt > start else start + max(1, (end - start) // 10)
    return out


def test_streamed_plan_equals_the_full_search(spark):
    rng = random.Random(21)
    recs, quiet, want = [], [], {}
    for i in range(60):
        total = rng.randint(1, 30_000)
        p = (rng.choice([10.0, 20.0]), rng.choice([2.0, 6.0]), rng.choice([12.0, 30.0]), rng.choice([0.0, 2.0, 4.0]), rng.choice([1.0, 5.0]))
        q = sorted((s, s + rng.choice([0.1, 0.4, 3.0])) for s in (rng.uniform(0, total / 100) for _ in range(rng.randint(0, 40))))
        recs.append((i, total, 100, *p))
        quiet += [(i, *x) for x in q]
        want[i] = naive_plan(total, *p, q)
    r = spark.createDataFrame(recs, "recording_id int, total_frames long, framerate int, target_sec double, min_sec double, max_sec double, overlap_sec double, search_window_sec double")
    s = spark.createDataFrame(quiet, "recording_id int, start_sec double, end_sec double")
    got = {}
    for x in chunking.plan_chunks(r, s).orderBy("recording_id", "chunk_index").collect():
        got.setdefault(x["recording_id"], []).append((x["start_frame"], x["end_frame"]))
    assert got == want


def test_preflight_budget(spark):
    chunks = spark.createDataFrame([("j", 60.0), ("j", 30.5)], "job_id string, duration_sec double")
    models = spark.createDataFrame([("m", "o", "c", 0.006, True, True, True, True), ("free", "p", "f", 0.0, True, True, True, False), ("none", "q", "n", None, True, True, True, True)],
                                   "model_id string, provider string, provider_code string, price_per_minute_usd double, adapter_ready boolean, gate_enabled boolean, credential_available boolean, cost_cap_included boolean")
    rows = costs.cost_preflight(chunks, models, 1.0)
    got = {r["model_id"]: r for r in rows.collect()}
    assert got["m"]["run_budget_cap_usd"] == pytest.approx((91 / 60 * 0.006 + 2 / 60 * 0.006) * 1.15)
    assert got["free"]["within_cap"] and got["none"]["estimated_cost_usd"] is None and not got["none"]["runnable"]
    assert costs.preflight_totals(rows, 0.001).first()["over_cap"]
    dup = models.unionByName(models.limit(1).withColumn("provider_code", F.lit("f")))
    assert {tuple(r["errors"]) for r in costs.registry_errors(dup).collect()} == {("duplicate model_id",), ("duplicate model_id", "duplicate provider_code"), ("duplicate provider_code",)}


def test_totals_without_chunk_rows_and_without_grouping_again(spark):
    from pyspark.sql import functions as F

    rec = spark.createDataFrame([(f"j{i}", d, c, o) for i, (d, c, o) in enumerate([(0, 300, 4), (300, 300, 4), (301, 300, 4), (896, 300, 4), (897, 300, 4), (7, 2, 5), (50, 7, 0)])],
                                "job_id string, duration_sec long, chunk_sec int, overlap_sec int")
    chunks = chunking.fixed_chunks(rec).select("job_id", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"))
    models = spark.createDataFrame([("m", "o", "c", 0.006, True, True, True, True, 0), ("free", "p", "f", 0.0, True, True, True, False, 1), ("none", "q", "n", None, True, True, False, True, 2)],
                                   "model_id string, provider string, provider_code string, price_per_minute_usd double, adapter_ready boolean, gate_enabled boolean, credential_available boolean, cost_cap_included boolean, route_index int")
    jobs = chunking.fixed_totals(rec)
    assert sorted(costs.preflight_of_totals(jobs, models, 1.0).collect(), key=str) == sorted(costs.cost_preflight(chunks, models, 1.0).collect(), key=str)
    totals = costs.totals_of_jobs(jobs, models, 0.005)
    assert sorted(totals.collect()) == sorted(costs.preflight_totals(costs.cost_preflight(chunks, models, 1.0), 0.005).collect())
    minutes = rec.select("job_id", (F.col("duration_sec") / 60).alias("duration_minutes"))
    plans = costs.execution_plans(minutes, costs.route_status(models), "max_quality", 0.5)
    for out in (totals, plans):  # one row of the registry, and no aggregate by recording
        assert "keys=[job_id" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["job_id"]: r for r in plans.collect()}
    assert got["j6"]["route_count"] == 3 and got["j6"]["initial_estimated_cost_usd"] == 0.005 and got["j6"]["maximum_estimated_cost_usd"] is None
    assert got["j6"]["mode_readiness_reasons"] == "n: Provider credential is not available in the server environment."
    assert costs.execution_plans(minutes, costs.route_status(models).where("false"), "max_quality", 0.5).count() == 0


def test_every_row_meets_every_model(spark):
    jobs = spark.createDataFrame([(f"j{i}",) for i in range(9)], "job_id string")
    models = spark.createDataFrame([(f"m{i}", i) for i in range(7)], "model_id string, p int")
    rows = [tuple(r) for r in costs.with_every_model(jobs, models).select("job_id", "model_id", "p").collect()]
    assert sorted(rows) == [(f"j{i}", f"m{k}", k) for i in range(9) for k in range(7)]


def test_folder_collisions(spark):
    wanted = [(i, n) for i, n in enumerate(["a", "b", "a", "a", "c", "a", "b (2)"])]
    taken = {"a (3)", "b", "b (2)"}
    want, used = {}, set(taken)
    for i, n in wanted:
        name, k = n, 2
        while name in used:
            name, k = f"{n} ({k})", k + 1
        used.add(name)
        want[i] = name
    df = spark.createDataFrame(wanted, "seq int, desired_name string")
    got = {r["seq"]: r["folder"] for r in archive.collision_safe(df, spark.createDataFrame([(t,) for t in taken], "folder string"), "seq", slice_of("seq", 3)).collect()}
    assert got == want


def test_archive_metadata(spark):
    rows = [("m", "2026-09-11T08:00:00Z", "user"), ("", "2026-09-11", "user"), ("m", None, "user"), ("m", None, "unknown"), ("m", "2026-09-11 08:00", "guess")]
    df = spark.createDataFrame(rows, "meeting_id string, meeting_start string, meeting_datetime_source string")
    got = [r["e"] for r in df.select(archive.metadata_errors().alias("e")).collect()]
    assert [len(e) for e in got] == [0, 2, 1, 0, 1]


def test_hot_keys_give_the_same_answers(spark):
    """Most rows under one key, many slices: replayed corrections and ids equal a plain loop."""
    from hashlib import sha256

    rng = random.Random(31)
    h = lambda s: sha256(s.encode()).hexdigest()
    rows, state, want = [], {"hot": h("t"), "cold": h("t")}, {}
    for i in range(400):
        seg = "hot" if rng.random() < 0.9 else "cold"
        expected = rng.choice([None, state[seg], h("other")])
        text = f"text {rng.randint(0, 3)}"
        want[i] = (expected is not None and expected != state[seg], state[seg])
        if not want[i][0]:
            state[seg] = h(text)
        rows.append((1, i, seg, text, "r", "me", "t", expected))
    df = spark.createDataFrame(rows, "job_id int, seq long, segment_id string, accepted_text string, reason string, reviewer string, corrected_at string, expected_original_sha256 string")
    seg = spark.createDataFrame([(1, "hot", "t"), (1, "cold", "t")], "job_id int, segment_id string, text string")
    got = {r["seq"]: (len(r["errors"]) > 0, r["original_text_sha256"]) for r in corrections.check_corrections(df, seg, seqs_per_slice=16).collect()}
    assert got == want

    events, mapping, ids = [], {}, {}
    for i in range(300):
        who, own = rng.choice("abcde"), rng.choice([None, None, None, "host", "canonical-speaker-002"])
        chosen = own or mapping.get(who)
        n = 1
        while not chosen:
            name = f"canonical-speaker-{n:03d}"
            chosen, n = (None if name in mapping.values() else name), n + 1
        mapping[who] = ids[i] = chosen
        events.append((1, i, who, own, "N"))
    df = spark.createDataFrame(events, "job_id int, seq long, local_speaker_key string, canonical_speaker_id string, display_name string")
    assert {r["seq"]: r["canonical_speaker_id"] for r in speakers.canonical_ids(df, seqs_per_slice=16).collect()} == ids
