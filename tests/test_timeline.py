"""Scans, intervals, alignment, agreement and drafts against brute force and known results."""

import random

import pytest
from pyspark.sql import functions as F

from earwitness import schemas
from earwitness.operators import agreement, alignment, draft, intervals
from earwitness.operators.scan import scan, slice_of
from earwitness.params import AgreementThresholds

ORDER = ("a", "b", "c")


def test_scan_equals_a_plain_pass(spark):
    rng = random.Random(1)
    rows = [(j, i, rng.choice([None, 1, 2, 5]), rng.randint(0, 50)) for j in range(4) for i in range(rng.choice([1, 7, 90]))]
    df = spark.createDataFrame(rows, "k int, i int, x int, y int").repartition(5)
    got = scan(
        df, ["k"], ["i"], slice_of("i", 4), row_number="n", sums_before={"sb": F.col("y")}, sums={"s": F.col("y")},
        max_before={"m": F.col("y")}, previous={"p": F.col("x")}, following={"f": F.col("x")}, last_known={"l": F.col("x")})
    for k in range(4):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        out = {r["i"]: r for r in got.where(F.col("k") == k).collect()}
        total, top, known = 0, None, None
        for n, (i, x, y) in enumerate(mine):
            r = out[i]
            known = x if x is not None else known
            want = (n + 1, total, total + y, top, mine[n - 1][1] if n else None, mine[n + 1][1] if n + 1 < len(mine) else None, known)
            assert (r["n"], r["sb"], r["s"], r["m"], r["p"], r["f"], r["l"]) == want
            total, top = total + y, y if top is None else max(top, y)


def test_merged_duration_and_overlaps(spark):
    rng = random.Random(2)
    rows = []
    for n in range(300):
        s = rng.randint(0, 900)
        rows.append((rng.randint(0, 2), n, s, s + rng.randint(0, 25)))
    df = spark.createDataFrame(rows, "job_id int, n int, s int, e int")
    got = {r["job_id"]: r["d"] for r in intervals.merged_duration(df, ["job_id"], "s", "e", 40, "d").collect()}
    for j in range(3):
        covered = {x for (k, _, s, e) in rows if k == j for x in range(s, e)}
        assert got[j] == len(covered)
    right = df.select("job_id", F.col("n").alias("m"), F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = {(r["n"], r["m"]) for r in intervals.overlap_join(df, right, ["job_id"], ("s", "e"), ("rs", "re"), 10).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and b[3] > a[2] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2]}
    assert pairs == want


def naive_align(cands):
    regions = []
    for p in sorted({c[0] for c in cands}):
        for c in sorted((c for c in cands if c[0] == p), key=lambda c: (c[2], c[3], c[1])):
            best = None
            for i, r in enumerate(regions):
                o = min(c[3], r["e"]) - max(c[2], r["s"])
                if o > 0 and p not in r["by"]:
                    rank = (o, -abs((c[2] + c[3]) / 2 - (r["s"] + r["e"]) / 2), -i)
                    if best is None or rank > best[0]:
                        best = rank, r
            if best:
                r = best[1]
                r["s"], r["e"] = min(r["s"], c[2]), max(r["e"], c[3])
            else:
                r = {"s": c[2], "e": c[3], "by": {}}
                regions.append(r)
            r["by"][p] = c[1]
    regions.sort(key=lambda r: (r["s"], r["e"], min(r["by"].values())))
    return {(f"region-{i:05d}", name, r["s"], r["e"]) for i, r in enumerate(regions, 1) for name in r["by"].values()}


def test_align_equals_the_sequential_definition(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for job in range(40):
        cands = []
        for p in range(3):
            at = 0.0
            for n in range(rng.randint(0, 14)):
                at += rng.choice([0, 0.5, 1, 3, 40])
                length = rng.choice([0.5, 1, 2, 4, 7])
                cands.append((p, f"{ORDER[p]}:{n:05d}", at, at + length))
                at += rng.choice([0.5, length])
        rows += [(job, ORDER[c[0]], c[0], c[1], c[2], c[3], "t") for c in cands]
        want[job] = naive_align(cands)
    df = spark.createDataFrame(rows, "job_id int, provider string, provider_ord int, candidate_id string, start_sec double, end_sec double, text string")
    got = alignment.align(df, slice_sec=20.0)
    found = {}
    for r in got.collect():
        found.setdefault(r["job_id"], set()).add((r["region_id"], r["candidate_id"], r["region_start_sec"], r["region_end_sec"]))
    assert all(found.get(j, set()) == want[j] for j in want)
    assert alignment.representation_errors(df, got).count() == 0


def documents(spark, rows):
    full = schemas.provider_document()
    fields = "chunks", "segments"
    types = {f: full[f].dataType for f in fields}
    base = spark.createDataFrame(rows, "job_id string, provider string, provider_ord int, timeline_offset_sec double, recording_duration_sec double, source_sha256 string, c string, s string")
    return base.select(*base.columns[:6], F.from_json("c", types["chunks"]).alias("chunks"), F.from_json("s", types["segments"]).alias("segments"))


def test_chunk_fallback_gives_two_regions(spark):
    chunks = '[{"chunk_filename":"1","chunk_start_sec":0,"chunk_end_sec":10,"text":" A "},{"chunk_filename":"2","chunk_start_sec":9,"chunk_end_sec":20,"text":"B"}]'
    docs = documents(spark, [("j", p, i, 100.0, 200.0, "h", chunks, None) for i, p in enumerate(ORDER)])
    found = alignment.timeline_candidates(docs)
    assert found.where(F.size("errors") > 0).count() == 0
    aligned = alignment.align(found.drop("errors"))
    stats = alignment.alignment_statistics(aligned, ORDER).first()
    assert (stats["total_source_segments"], stats["aligned_regions"], stats["unaligned_segments"]) == (6, 2, 0)
    rows = aligned.select("region_id", "region_start_sec", "text").distinct().collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {("region-00001", 100.0, " A "), ("region-00002", 109.0, "B")}


def test_candidate_sources_in_priority_order(spark):
    chunks = ('[{"chunk_filename":"1","chunk_start_sec":0,"chunk_end_sec":10,"text":"x","segments":[{"start":1,"end":2,"text":"never"}]},'
              '{"chunk_filename":"2","chunk_start_sec":10,"duration_seconds":5,"segment_timing_scope":"chunk","segments":[{"start":1,"end":2,"text":"rel"},{"text":"untimed"}]},'
              '{"chunk_filename":"3","chunk_start_sec":20,"text":"no end"}]')
    roots = '[{"chunk_filename":"1","start_sec":3,"end_sec":4,"text":"root","segment_id":"s"},{"start_sec":30,"end_sec":31,"text":"loose"},{"chunk_filename":"9","start":1,"end":2,"text":"orphan"}]'
    got = alignment.timeline_candidates(documents(spark, [("j", "a", 0, 0.0, 30.5, "h", chunks, roots)])).orderBy("candidate_id").collect()
    assert [(r["candidate_id"], r["text"], r["start_sec"], r["source_kind"], len(r["errors"])) for r in got] == [
        ("a:00001", "root", 3.0, "root_segment", 0), ("a:00002", "rel", 11.0, "chunk_segment", 0),
        ("a:00003", "no end", 20.0, "chunk_fallback", 1), ("a:00004", "loose", 30.0, "root_segment", 1)]


def regions(spark, triples):
    rows = [(1, n, p, i, text is None, text) for n, texts in enumerate(triples) for i, (p, text) in enumerate(zip(ORDER, texts))]
    long = spark.createDataFrame(rows, "job_id int, region_no int, provider string, provider_ord int, missing boolean, text string")
    g = alignment.gather_regions(long.where(~F.col("missing")), ["job_id", "region_no"], ORDER, ["text"])
    return g.select("job_id", "region_no", F.format_string("region-%05d", "region_no").alias("region_id"),
                    F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), "candidates")


SAME = "we will meet at the river at nine"
CASES = [
    (SAME, SAME + "!", SAME.upper()), (SAME, SAME, "we might meet near a river at ten"), (SAME, "purple elephants dance", "zzz qqq xxx yyy www"),
    (SAME, None, SAME), (SAME, "  ", SAME), (SAME, "we", SAME)]


def test_status_ladder(spark):
    out = agreement.classify(regions(spark, CASES), ORDER).orderBy("region_no").collect()
    assert [r["agreement_status"] for r in out] == ["GREEN", "AMBER", "RED", "RED", "RED", "RED"]
    assert out[0]["derived_agreement_score"] == 1.0 and out[3]["derived_agreement_score"] == 0.0
    assert out[3]["agreement_reasons"] == ["Missing provider candidate: b."]
    assert out[4]["agreement_reasons"] == ["Empty provider candidate: b."]
    assert "length ratio" in out[5]["agreement_reasons"][0]
    assert [p["missing"] for p in out[3]["pairwise"]] == [True, False, True]
    counts = agreement.status_counts(agreement.classify(regions(spark, CASES), ORDER)).first()
    assert (counts["green"], counts["amber"], counts["red"]) == (1, 1, 4)


def test_thresholds_are_checked_and_used(spark):
    with pytest.raises(ValueError):
        AgreementThresholds(red_min_pairwise=0.9)
    loose = AgreementThresholds(green_min_pairwise=0.33, green_mean_pairwise=0.43)
    assert agreement.classify(regions(spark, CASES[1:2]), ORDER, loose).first()["agreement_status"] == "GREEN"
    with pytest.raises(ValueError):
        agreement.check_order(("a", "a"))


def test_draft_takes_the_medoid_verbatim(spark):
    from earwitness.functions.similarity import text_pair

    texts = ("we will meet at the river at nine", "we will meet at the rivers at nine", "we will meat at the rivers at nine")
    windows = draft.final_draft(agreement.classify(regions(spark, [texts, CASES[2]]), ORDER), ORDER).orderBy("window_id").collect()
    scores = [round(sum(text_pair(texts[i], texts[j])[3] for j in range(3) if j != i) / 2, 6) for i in range(3)]
    best = scores.index(max(scores))
    assert windows[0]["selected_provider"] == ORDER[best] and windows[0]["final_text"] == texts[best]
    assert windows[0]["representative_scores"] == dict(zip(ORDER, scores))
    assert windows[1]["final_text"] is None and windows[1]["review_required"] and not windows[1]["auto_accepted"]


def test_single_provider_is_red(spark):
    long = spark.createDataFrame([(1, 0, "a", 0, False, "hi")], "job_id int, region_no int, provider string, provider_ord int, missing boolean, text string")
    g = alignment.gather_regions(long, ["job_id", "region_no"], ("a",), ["text"])
    assert agreement.classify(g, ("a",)).first()["agreement_status"] == "RED"


def test_nearest_cut_ties_go_to_the_earlier(spark):
    t = spark.createDataFrame([(1, 1, 10.0, 0.0, 99.0, 5.0), (1, 2, 50.0, 0.0, 99.0, 5.0)], "job_id int, target_id int, target_sec double, min_sec double, max_sec double, search_window_sec double")
    s = spark.createDataFrame([(1, 7.0, 8.0), (1, 12.0, 13.0), (1, 30.0, 31.0)], "job_id int, start_sec double, end_sec double")
    got = intervals.nearest_cut(t, s, ["job_id"], 4.0).orderBy("target_id").collect()
    assert (got[0]["cut_sec"], got[0]["silence_start_sec"]) == (8.0, 7.0) and got[1]["cut_sec"] is None
