"""Rules that stop, refuse or report where there is nothing to report."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from earwitness.operators import costs, pilot, rescue
from earwitness.operators.scan import slice_of
from earwitness.sources import readers
from earwitness.streaming import ledger
from tests.test_workflow import outcome

COSTS = "job_id string, seq long, estimated long, actual long, cached boolean"
CAPS = "job_id string, cap long"


def sequential(rows, cap, earlier=0):
    """The rule as a loop: once spend has passed the cap nothing runs, cached or not."""
    spent, stopped, out = earlier, False, {}
    for _, seq, estimated, actual, cached in sorted(rows, key=lambda r: r[1]):
        stopped = stopped or (not cached and estimated > max(0, cap - spent))
        out[seq] = not stopped
        if not stopped:
            spent += 0 if cached else actual
            stopped = spent > cap
    return out


@pytest.mark.parametrize(("rows", "cap", "earlier"), [
    ([("j", 1, 50, 120, False), ("j", 2, 10, 0, True), ("j", 3, 10, 0, True)], 100, 0),
    ([("j", 1, 30, 30, False), ("j", 2, 30, 30, False), ("j", 3, 5, 5, True)], 100, 60),
    ([("j", 1, 1, 1, True), ("j", 2, 1, 1, True)], 100, 140),
    ([("j", 1, 101, 0, False), ("j", 2, 1, 1, False)], 100, 0),
    ([("j", 1, 100, 100, False), ("j", 2, 0, 0, False), ("j", 3, 1, 1, False)], 100, 0)])
def test_spend_guard(spark, rows, cap, earlier):
    before = spark.createDataFrame([("j", earlier)], "job_id string, spent long") if earlier else None
    got = costs.spend_guard(spark.createDataFrame(rows, COSTS), spark.createDataFrame([("j", cap)], CAPS), slice_of("seq", 2), before)
    assert {r.seq: r.runs for r in got.collect()} == sequential(rows, cap, earlier)
    assert got.agg(F.min("spent_before")).first()[0] == earlier


def test_invalid_first_red_is_refused(spark):
    regions = spark.createDataFrame(
        [("a", 1, "r1", 5.0, 5.0, "RED"), ("b", 1, "r1", 5.0, 9.0, "RED"), ("c", 1, "r1", 5.0, None, "RED"), ("d", 1, "r1", 1.0, 2.0, "GREEN")],
        "job_id string, region_no long, region_id string, start_sec double, end_sec double, agreement_status string")
    windows = spark.createDataFrame([("b",)], "job_id string")
    assert {r.job_id: r.route for r in rescue.route(regions, windows).collect()} == {"a": "error", "b": "rescue", "c": "error", "d": "pass_through"}


def test_empty_cohort_is_reported(spark):
    df = spark.createDataFrame([outcome(data_classification="synthetic", evidence_eligible=False)]).withColumn("retention_review_due_on", F.col("retention_review_due_on").cast("date"))
    _, good = pilot.eligible_records(pilot.job_metrics(df), spark.createDataFrame([("j1", True)], "job_id string, ok boolean"))
    rows = pilot.cohort_summary(good, F.lit("2026-01-02").cast("date"), rollup=True).collect()
    assert len(rows) == 1 and rows[0]["eligible_jobs"] == 0 and rows[0]["participants"] == 0
    assert rows[0]["completion_rate_percent"] is None and rows[0]["total_corrections"] == 0 and rows[0]["retention_reviews_overdue"] == 0


def test_only_the_folder_itself_is_inside(spark, tmp_path):
    for place in ("in/a.json", f"other{tmp_path}/in/b.json", "in2/c.json"):
        path = tmp_path / place.lstrip("/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"job_id": "j", "text": place, "segments": []}))
    paths = [str(p) for p in tmp_path.rglob("*.json")]
    good, bad = readers.chunk_transcripts(spark, paths, f"file://{tmp_path}/in/")
    assert [r.text for r in good.collect()] == ["in/a.json"] and bad.count() == 2


def test_late_ledger_events_are_kept(spark, tmp_path):
    schema = "event_id string, job_id string, seq long, recorded_at timestamp, v int"
    src, ckpt = (str(tmp_path / n) for n in ("in", "ckpt"))
    for rows in ([("e1", "j", 1, "2026-03-01", 1)], [("e2", "k", 1, "2020-01-01", 5), ("e1", "j", 1, "2026-03-01", 1)]):
        spark.createDataFrame(rows, "event_id string, job_id string, seq long, t string, v int").select(
            "event_id", "job_id", "seq", F.col("t").cast("timestamp").alias("recorded_at"), "v").coalesce(1).write.mode("append").json(src)
        ledger.maintain_latest(ledger.ledger_stream(spark, src, ledger.StructType.fromDDL(schema)), ckpt).awaitTermination(120)
    assert {(r.job_id, r.v) for r in ledger.current(spark, ckpt).collect()} == {("j", 1), ("k", 5)}


def test_workers_find_the_package_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    code = f"""import sys
sys.path.insert(0, {repo!r})
from earwitness.session import build_session
spark = build_session("elsewhere", "local[1]", spark__ui__enabled="false")
from pyspark.sql import functions as F
from earwitness.functions.text import nfkc_casefold
def names(batches):
    import earwitness
    for b in batches:
        yield b.assign(id=len(earwitness.__name__))
print("FOUND", spark.range(1).mapInPandas(names, "id long").first()[0])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "FOUND 10" in done.stdout, done.stderr[-2000:]
