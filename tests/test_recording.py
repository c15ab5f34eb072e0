"""Quote identity, recording pilot events, publishing files and ledger upkeep, against plain definitions."""

import hashlib
import json
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from earwitness.functions.hashing import nested_json
from earwitness.operators import pilot, pricing, recording
from earwitness.params import PaymentRates, PriceBook
from earwitness.plans import pipelines
from earwitness.sinks import commits


# ---- canonical JSON and quote identity

def test_nested_json_equals_the_standard_writer(spark):
    rng = np.random.default_rng(0)
    signs = list("aZ9 \"\\/\b\f\n\r\t\x00\x1f\x7f é–𝄞漢")
    texts = ["".join(rng.choice(signs, k)) for k in rng.integers(0, 9, 60)] + [None, ""]
    rows = [((t, [(t, None if i % 3 else i)] * (i % 4) if i % 5 else None, {f"k{t}": bool(i % 2), "a": None}, i % 2 == 0),) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "r struct<zeta: string, list: array<struct<b: string, a: int>>, m: map<string,boolean>, B: boolean>")
    got = df.select("r", nested_json(F.col("r"), df.schema["r"].dataType).alias("wide"), nested_json(F.col("r"), df.schema["r"].dataType, True).alias("narrow")).collect()
    for r in got:
        value = r.r.asDict(recursive=True)
        for name, narrow in (("wide", False), ("narrow", True)):
            assert r[name] == json.dumps(value, ensure_ascii=narrow, sort_keys=True, separators=(",", ":"))
    with pytest.raises(TypeError):
        nested_json(F.lit(1.5), spark.range(1).select(F.lit(1.5).alias("x")).schema["x"].dataType)


def identity(book, plan_id, method, seconds, asked):
    """The quote's record as plain decimal arithmetic."""
    plan, pay = book.plans[plan_id], book.payments[method]
    review = plan.review_minutes_at_least is not None
    audio = None if review else math.ceil(Decimal(str(seconds)) / 60)
    rounded = math.ceil(Decimal(str(asked))) if review else None
    billed = max(rounded, plan.review_minutes_at_least) if review else None
    minutes = Decimal(billed if review else audio)
    hours, gst = minutes / 60, book.gst_rate if book.gst_registered else Decimal(0)
    provider = minutes * plan.usd_per_minute * book.usd_rate
    costs = {"provider_estimate_sgd": provider, "provider_contingency_sgd": provider * book.contingency, "infrastructure_storage_sgd": hours * plan.infrastructure_per_hour,
             "support_exception_reserve_sgd": plan.support, "product_operations_reserve_sgd": plan.operations, "reviewer_labor_sgd": hours * plan.labor_per_hour}
    asking, delivery = max(plan.minimum, hours * plan.list_per_hour), sum(costs.values())
    floor = (delivery + pay.fixed) / (1 - pay.variable * (1 + gst) - book.target_margin / (1 - book.income_tax))
    half = lambda x, places: x.quantize(Decimal(places), ROUND_HALF_UP)
    price = max(asking, floor).quantize(Decimal("0.01"), "ROUND_CEILING")
    while True:
        tax = half(price * gst, "0.01")
        fee = half((price + tax) * pay.variable + pay.fixed, "0.01")
        profit = price - delivery - fee
        kept = profit * (1 - book.income_tax) if profit >= 0 else profit
        if kept / price >= book.target_margin:
            break
        price += Decimal("0.01")
    cents, four = (lambda x: str(half(x, "0.01"))), (lambda x: str(half(x, "0.0001")))
    record = {
        "price_book_version": book.version, "plan_id": plan_id, "payment_method": method, "currency": book.currency, "billed_audio_minutes": audio,
        "requested_review_minutes": rounded, "billed_review_minutes": billed, "provider_routes": list(plan.routes), "list_price_pre_gst_sgd": cents(asking),
        "price_floor_pre_gst_sgd": cents(floor), "price_pre_gst_sgd": cents(price), "gst_amount_sgd": cents(tax), "customer_total_sgd": cents(price + tax),
        "costs": {k: cents(v) for k, v in costs.items()}, "delivery_cost_sgd": cents(delivery), "payment_fee_estimate_sgd": cents(fee),
        "pretax_operating_profit_sgd": cents(profit), "after_tax_operating_profit_sgd": cents(kept), "after_tax_margin": four(kept / price),
        "target_after_tax_margin": four(book.target_margin), "income_tax_rate_assumption": four(book.income_tax), "gst_registered": book.gst_registered,
        "gst_rate": four(gst), "usd_to_sgd_rate_assumption": four(book.usd_rate)}
    return hashlib.sha256(json.dumps(record, ensure_ascii=True, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("book", [PriceBook(), PriceBook(gst_registered=True, version="März", usd_rate=Decimal("1.37"))])
def test_quote_identity_covers_every_fact(spark, book):
    orders = [(f"q{n}{plan}{pay}", plan, pay, Decimal(n) + Decimal("0.5"), Decimal(n) / 7) for n in (1, 59, 3600, 10_000) for plan in book.plans for pay in book.payments]
    df = spark.createDataFrame(orders, "quote_id string, plan_id string, payment_method string, duration_seconds decimal(18,3), requested_review_minutes decimal(18,9)").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    quotes, refused = pricing.quote_orders(df, book)
    got = {r.quote_id: r.calculation_sha256 for r in quotes.collect()}
    assert refused.count() == 0 and got == {q: identity(book, plan, pay, seconds, asked) for q, plan, pay, seconds, asked in orders}


def test_price_book_faults_refuse_all_orders(spark):
    df = spark.createDataFrame([("q", "dialect_draft", "card", 60, 1)], "quote_id string, plan_id string, payment_method string, duration_seconds int, requested_review_minutes int").withColumn("created_at", F.current_timestamp())
    for book, fault in ((PriceBook(version=""), "version"), (PriceBook(target_margin=Decimal("0.81")), "no selling price"), (PriceBook(usd_rate=Decimal(0)), "usd_rate"),
                        (PriceBook(payments={"card": PaymentRates(Decimal("0.03"), Decimal("-1"))}), "card.fixed")):
        quotes, refused = pricing.quote_orders(df, book)
        assert quotes.count() == 0 and any(fault in e for e in refused.first().errors)


# ---- recording

EVENT = "job_id string, seq long, event_id string, previous_event_sha256 string, event struct<v: int, note: string>"


def sha(event_id, previous, event):
    record = {"event": {"note": event[1], "v": event[0]}, "event_id": event_id, "previous_event_sha256": previous}
    return hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def one_by_one(requests, heads):
    """Compare-and-set as a loop."""
    out, now, seen = {}, {j: (n, h) for j, (ok, n, h) in heads.items() if ok}, set()
    for job, seq, event_id, previous, event in sorted(requests, key=lambda r: r[:2]):
        if job in heads and not heads[job][0]:
            out[job, seq] = (None, recording.BROKEN)
        elif (job, event_id) in seen:
            out[job, seq] = (None, recording.TWICE)
        else:
            count, head = now.get(job, (0, None))
            if previous == head:
                now[job] = (count + 1, sha(event_id, previous, event))
                out[job, seq] = (count, None)
            else:
                out[job, seq] = (None, recording.STALE)
        seen.add((job, event_id))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_recording_equals_compare_and_set(spark, seed):
    rng = np.random.default_rng(seed)
    heads = {"a": (True, 3, "f" * 64), "b": (False, 2, None), "c": (True, 1, "e" * 64)}
    requests = []
    for job in "abcd":
        known = [heads.get(job, (True, 0, None))[2]]
        for i in range(40):
            event_id = f"e{i}" if rng.random() < 0.9 else f"e{max(0, i - 3)}"
            # Mostly the newest hash made so far, at times an old one, at times one that is made later.
            previous = known[-1] if rng.random() < 0.7 else known[int(rng.integers(0, len(known)))]
            event = (int(rng.integers(0, 5)), None if i % 3 else 'say "ü"')
            requests.append((job, i if rng.random() < 0.8 else i + 100, event_id, previous, event))
            known.append(sha(event_id, previous, event))
    requests = list({r[:2]: r for r in requests}.values())
    previous = None
    for i in range(70):
        requests.append(("long", i, f"e{i}", previous, (i, None)))
        previous = sha(f"e{i}", previous, (i, None))
    df = spark.createDataFrame(requests, EVENT)
    reports = spark.createDataFrame([(j, *h) for j, h in heads.items()], "job_id string, ok boolean, event_count long, latest_event_sha256 string")
    got = {(r.job_id, r.seq): (r.position, r.reason) for r in recording.record_events(df, reports).collect()}
    assert got == one_by_one(requests, heads) and got["long", 69] == (69, None)
    assert recording.record_events(df.limit(0), reports).count() == 0


def test_two_writers_leave_one_chain(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    ask = lambda job, who, seq, previous: spark.createDataFrame([(job, seq, f"{who}{seq}", previous, (seq, who))], EVENT)
    first = pipelines.record_pilot(spark, root, ask("j", "x", 1, None).unionByName(ask("k", "x", 1, None))).collect()
    head = {r.job_id: r.event_sha256 for r in first}
    assert [r.reason for r in first] == [None, None]

    # The second writer publishes between the first one's reading and publishing.
    publish, others = commits.publish, []

    def slower(*args, **kwargs):
        if not others:
            others.append(True)
            others.append(pipelines.record_pilot(spark, root, ask("j", "second", 3, head["j"])).first())
        return publish(*args, **kwargs)

    monkeypatch.setattr(commits, "publish", slower)
    mine = pipelines.record_pilot(spark, root, ask("j", "first", 2, head["j"]).unionByName(ask("k", "first", 2, head["k"]))).collect()
    assert others[1].reason is None and {r.job_id: r.reason for r in mine} == {"j": recording.STALE, "k": None}
    seen = commits.state(spark, root)
    events = spark.read.parquet(*seen.folders["events"])
    chains = {r.job_id: r for r in pipelines.ledger_chains(events).collect()}
    assert seen.version == 3 and all(c.ok and c.event_count == 2 for c in chains.values()) and chains["j"].latest_event_sha256 == others[1].event_sha256


# ---- publishing

def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "root")
    one = commits.publish(spark, root, commits.state(spark, root), {"t": commits.stage(spark.range(3), root, "t")})
    failing = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.stage(failing, root, "t")
    assert commits.state(spark, root) == one and one.read(spark, "t", spark.range(1).schema).count() == 3
    two = commits.publish(spark, root, one, {"t": commits.stage(spark.range(5), root, "t")}, replaced=("t",))
    with pytest.raises(commits.StaleVersion):
        commits.publish(spark, root, one, {"t": commits.stage(spark.range(9), root, "t")})
    assert commits.state(spark, root) == two and two.read(spark, "t", spark.range(1).schema).count() == 5
    assert commits.discard(spark, root, two) >= 3 and two.read(spark, "t", spark.range(1).schema).count() == 5
    assert commits.state(spark, root) == two


# ---- ledger lines and upkeep

def test_line_numbers_across_byte_ranges(spark, tmp_path):
    from earwitness.sources import readers

    rng = np.random.default_rng(5)
    bad = {}
    for name in "ab":
        lines = [["{}", '{"a": 1}', "", "  ", "[1]", "{", "x" * 200][k] for k in rng.integers(0, 7, 90)]
        (tmp_path / f"{name}.jsonl").write_bytes("".join(x + ("\r\n" if k % 7 == 0 else "\n") for k, x in enumerate(lines)).encode())
        bad |= {(name, k): x for k, x in enumerate(lines, 1) if x in ("[1]", "{", "x" * 200)}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for size in ("100", "777", before[keys[0]]):
            spark.conf.set(keys[0], size)
            spark.conf.set(keys[1], "0")
            got = readers.ledger_rejects(spark, f"{tmp_path}/*.jsonl").collect()
            assert {(r.file.split("/")[-1][0], r.line_no): r.line for r in got} == bad and len(got) == len(bad)
            numbers = readers.numbered_lines(spark, f"{tmp_path}/a.jsonl").agg(F.max("line_no"), F.count_distinct("line_no")).first()
            assert tuple(numbers) == (90, 90)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_upkeep_rewrites_what_changed_and_storage_stays(spark, tmp_path):
    from earwitness.streaming import ledger

    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    schema = ledger.StructType.fromDDL("job_id string, seq long, v string, more struct<x: int>")
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        ledger.maintain_latest(ledger.ledger_stream(spark, source, schema), kept).awaitTermination(120)

    deliver([(f"j{k}", 1, "first", (k,)) for k in range(3000)])
    sizes = []
    for n in range(2, 9):
        deliver([("j7", n, f"v{n}", None), ("j8", 0, "late", None), ("j7", n, f"v{n}", None)])
        sizes.append(sum(p.stat().st_size for p in (tmp_path / "kept" / "state").rglob("*.changelog") if p.name == f"{n}.changelog"))
    spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    now = {r.job_id: (r.seq, r.v) for r in ledger.current(spark, kept).collect()}
    assert len(now) == 3000 and now["j7"] == (8, "v8") and now["j8"] == (1, "first")
    first = sum(p.stat().st_size for p in (tmp_path / "kept" / "state").rglob("1.changelog"))
    assert max(sizes) < 5_000 and (not first or max(sizes) < first / 20)
    assert {r.job_id: r.v for r in ledger.current(spark, kept, 6).where("job_id = 'j7'").collect()} == {"j7": "v7"}


# ---- archive

def test_archive_to_the_end(spark, tmp_path, monkeypatch):
    from earwitness.operators.scan import slice_of
    from earwitness.sinks import documents

    root, bucket = str(tmp_path / "archive"), slice_of("seq", 10)
    monkeypatch.setattr(documents, "LINES_PER_PART", 2)
    monkeypatch.setattr(documents.document_parts, "__defaults__", (2,))
    meeting = "job_id string, meeting_id string, seq long, meeting_start string, meeting_datetime_source string, project string, content string, short_name string"
    window = "job_id string, ord long, window_id string, start_sec double, end_sec double, final_text string"
    label = "job_id string, window_id string, turn_no long, display_label string"

    def meetings(*rows):
        return spark.createDataFrame([(j, m, n, at, "user" if at else "unknown", "Proj", what, "short") for j, m, n, at, what in rows], meeting)

    windows = spark.createDataFrame([(j, k, f"w{k}", k * 24.0, k * 24.0 + 24, f"said <{k}> by {j}") for j in ("a", "b", "c") for k in range(3)] + [("open", 0, "w0", 0.0, 24.0, None)], window)
    labels = spark.createDataFrame([("a", "w1", 1, "Ann"), ("a", "w1", 2, " "), ("a", "w1", 3, "Bo"), ("a", "w1", 4, "Ann")], label)
    first = pipelines.archive_meetings(spark, root, meetings(("a", "m", 1, "2026-01-02T10:30", "x"), ("b", "n", 2, "2026-01-02T10:30", "x"), ("open", "o", 3, None, "y"), ("none", "p", 4, None, "z")), windows, labels, bucket)
    assert {r.job_id: r.errors for r in first["rejects"].collect()} == {"open": ["every window must be resolved"], "none": ["there are no windows"]}
    now = pipelines.archived(spark, root)
    files = now["files"].collect()
    assert {(r.meeting_id, r.revision) for r in files} == {("m", 1), ("n", 1)} and all(hashlib.sha256(r.body.encode()).hexdigest() == r.sha256 and len(r.body.encode()) == r.size_bytes for r in files)
    whole = lambda m, ext: "".join(r.body for r in sorted(files, key=lambda r: r.part) if (r.meeting_id, r.ext) == (m, ext))
    assert whole("m", "txt") == "\n\n".join(f"said <{k}> by a" for k in range(3)) + "\n"
    made = json.loads(whole("m", "json"))["segments"]
    assert [s["speaker"] for s in made] == [None, "Ann / Bo", None] and made[2]["text"] == "said <2> by a"
    assert whole("m", "srt").startswith("1\n00:00:00,000 --> 00:00:24,000\nsaid &lt;0&gt; by a\n\n2\n") and "Ann / Bo: said" in whole("m", "vtt")
    paths = {r.path for r in now["paths"].where("ext = 'txt'").collect()}
    assert len(paths) == 4 and any("x (2)/final/" in p and p.endswith("FINAL part00001.txt") for p in paths)

    second = pipelines.archive_meetings(spark, root, meetings(("c", "m", 5, "2026-01-02T10:30", "x")), windows, labels, bucket)
    assert second["rejects"].count() == 0
    renamed = pipelines.rename_meetings(spark, root, meetings((None, "m", 6, "2026-01-02T10:30", "new name"), (None, "who", 7, None, "x")).drop("job_id"), bucket)
    assert [r.errors for r in renamed["rejects"].collect()] == [["there is no such archive"]]
    later = pipelines.archived(spark, root)
    after = {(r.meeting_id, r.revision, r.ext, r.part): r for r in later["paths"].collect()}
    assert {k for k in after if k[0] == "m"} == {("m", v, r.ext, r.part) for v in (1, 2) for r in files if r.meeting_id == "m"}
    assert all(after[r.meeting_id, r.revision, r.ext, r.part].sha256 == r.sha256 for r in files)
    assert all("new name/final/" in r.path for k, r in after.items() if k[0] == "m") and {r.name for k, r in after.items() if k[:3] == ("m", 2, "txt")} == {n.replace(" FINAL", " rev02 FINAL") for n in (r.name for k, r in after.items() if k[:3] == ("m", 1, "txt"))}

    before = commits.state(spark, root)
    monkeypatch.setattr(pipelines.ar, "final_documents", lambda s: s.select("job_id", F.lit("txt").alias("ext"), F.lit(0).cast("long").alias("part"), F.raise_error(F.lit("lost")).cast("string").alias("body")))
    with pytest.raises(Exception, match="lost"):
        pipelines.archive_meetings(spark, root, meetings(("b", "m", 8, "2026-01-02T10:30", "x")), windows, labels, bucket)
    assert commits.state(spark, root) == before


# ---- media of any length

def test_streamed_media_equal_the_whole_files(spark, tmp_path, monkeypatch):
    import struct
    import wave

    from earwitness.operators import media
    from earwitness.sources import readers

    rng = np.random.default_rng(6)

    def write(name, samples, channels=1, width=2):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(16000)
            w.writeframes(samples)

    write("loud.wav", struct.pack("<4h", 32767, -32768, 100, 200))
    write("empty.wav", b"")
    write("eight.wav", b"\1\2\3", width=1)
    write("two words.wav", rng.integers(-32768, 32768, 6001 * 2).astype("<i2").tobytes(), channels=2)
    write("quiet.wav", rng.integers(-20, 21, 5000).astype("<i2").tobytes())
    (tmp_path / "cut.wav").write_bytes((tmp_path / "quiet.wav").read_bytes()[:777])
    (tmp_path / "not.wav").write_bytes(b"RIFX" + bytes(50))
    (tmp_path / "nothing.wav").write_bytes(b"")
    files = readers.binary_files(spark, str(tmp_path))
    want = {r.path: r for r in media.pcm_statistics(files).collect()}
    hashes = {r.path: (r.size_bytes, r.sha256) for r in media.file_identity(files).collect()}
    for size in (2, 1001, 1 << 20):
        got = {r.path: r for r in media.streamed_pcm_statistics(files, max(size, 500)).collect()}
        assert got == want
    assert {r.path: (r.size_bytes, r.sha256) for r in media.streamed_identity(files).collect()} == hashes
