import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from earwitness.functions import hashing, similarity as sim, text as tx


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_long_sequences_by_hash_equal_the_standard_library_matcher(monkeypatch):
    rng = random.Random(7)
    for few in (0, 40):
        monkeypatch.setattr(sim, "_FEW", few)
        for _ in range(300):
            a, b = ("".join(rng.choices("abé𝄞"[: rng.choice((2, 3, 4))], k=rng.randrange(0, 120))) for _ in range(2))
            assert sim.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            x, y = a.split("a"), b.split("a")
            assert sim.token_ratio(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    many = [str(k) for k in range(70_000)]
    assert sim.token_ratio(many, [*many[:60_000], "other", *many[60_001:]]) == 2 * 69_999 / 140_000


def test_matched_length_equals_the_standard_library_matcher():
    rng = random.Random(7)
    for trial in range(1500):
        alphabet = "ab" if trial % 3 else "abcdef "
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.4:
            cut = rng.randint(0, len(a))
            b = a[:cut] + b[:5] + a[cut + 2:]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else float(a == b)
        assert sim.ratio(a, b) == want, (a, b)


def test_token_ratio_equals_the_standard_library_matcher():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.choice(["x", "yy", "z", "w"]) for _ in range(rng.randint(1, 25))]
        b = [rng.choice(["x", "yy", "z", "q"]) for _ in range(rng.randint(1, 25))]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert sim.token_ratio(a, b) == want


def test_pair_scores_mixed_scripts(spark):
    df = spark.createDataFrame([("Kita makan 福建面 at 8pm!", "kita makan 福建面 at 8PM")], "l string, r string")
    row = df.select(sim.pair_scores(F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert list(row) == [1.0, 1.0, 1.0, 1.0]


def test_agreement_tokens(spark):
    s = "kita makan 福建面 at 8pm é́ _x"
    got = one(spark, tx.agreement_tokens(F.lit(s)))
    assert got == sim._forms(s)[1] == ["kita", "makan", "福", "建", "面", "at", "8pm", "é́", "x"]


def _edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), cur[-1] + 1, prev[j] + 1))
        prev = cur
    return prev[-1]


def test_error_rates_match_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "été", "团队", "Go", "go", "x"]
    rows = []
    for i in range(150):
        a = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        b = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        rows.append((i, "  ".join(a) + "\n", " ".join(b)))
    got = spark.createDataFrame(rows, "i int, r string, h string").select(
        "i", sim.word_error_rate(F.col("r"), F.col("h")).alias("w"),
        sim.character_error_rate(F.col("r"), F.col("h")).alias("c"),
    ).collect()
    for g in got:
        r, h = rows[g["i"]][1].lower().split(), rows[g["i"]][2].lower().split()
        want_w = (0.0 if not h else 1.0) if not r else _edit(r, h) / len(r)
        rc, hc = "".join(r), "".join(h)
        want_c = (0.0 if not hc else 1.0) if not rc else _edit(rc, hc) / len(rc)
        assert (g["w"], g["c"]) == (want_w, want_c)


def test_many_distinct_words_do_not_overflow_the_alphabet(spark):
    a = " ".join(f"w{i}" for i in range(2500))
    b = a.replace("w17 ", "").replace("w900", "zz")
    assert one(spark, sim.word_distance(F.col("a"), F.col("b")), a=a, b=b) == 2


def test_folding(spark):
    s = "Straße ﬁ Ⅳ ÀÉ"
    assert one(spark, tx.nfkc_casefold(F.col("s")), s=s) == unicodedata.normalize("NFKC", s).casefold()


def test_join_words(spark):
    assert one(spark, tx.join_words(F.array(*map(F.lit, ["hello", "world", "", ",", "福建", "面", "ok", "8"])))) == "hello world,福建面ok 8"


def test_time_and_names(spark):
    assert one(spark, tx.timecode(tx.to_ms(F.lit(360061.0005)), ",")) == "100:01:01,000"
    assert one(spark, tx.clock_label(F.lit(600.4))) == "00h10m00s"
    assert one(spark, tx.safe_component(F.lit(' a<b>:c  ."'))) == "a b c"
    assert one(spark, tx.safe_component(F.lit("con.txt"))) == "_con.txt"
    assert one(spark, tx.safe_component(F.lit("...  "), "Meeting")) == "Meeting"
    assert one(spark, tx.meeting_folder(F.lit("2026-09-11 08:05:00").cast("timestamp"), F.lit("Proj"), F.lit(None).cast("string"))) == "2609110805 11Sep2026 Proj Meeting"
    assert one(spark, tx.meeting_folder(F.lit(None).cast("timestamp"), F.lit("P/Q"), F.lit("x"))) == "UnknownDateTime UnknownDate P Q x"


def test_escape_span_redact(spark):
    assert one(spark, tx.html_escape(F.lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"
    assert one(spark, tx.html_escape(F.lit("<'\"&>"), quote=False)) == "&lt;'\"&amp;&gt;"
    s = "aé福z"
    assert one(spark, tx.utf8_span(F.lit(s), F.lit(1), F.lit(6))) == "é福"
    assert one(spark, tx.utf8_span(F.lit(s), F.lit(2), F.lit(6))) is None
    assert one(spark, tx.utf8_span(F.lit(s), F.lit(1), F.lit(60))) is None
    raw = '{"a":[{"file_url": "http://x/\\"q?s=1"}],"transcription_url":"u","other":"http://k"}'
    got = one(spark, tx.redact_urls(F.col("s")), s=raw)
    assert got == ('{"a":[{"file_url": "[REDACTED TEMPORARY SIGNED URL]"}],'
                   '"transcription_url":"[REDACTED TEMPORARY SIGNED URL]","other":"http://k"}')


@pytest.mark.parametrize("name,want", [("a.WAV", ".wav"), ("a", ".audio"), (".amr", ".audio"), ("x/y.m4a", ".m4a"), ("a.tar.gz", ".gz"), ("a.b_c", ".audio")])
def test_safe_suffix(spark, name, want):
    assert one(spark, tx.safe_suffix(F.lit(name))) == want


def test_script_conversion(spark):
    got = one(spark, tx.convert_script(F.lit("討論x"), {"討": "讨", "論": "论"}))
    assert got["text"] == "讨论x" and got["changed"]
    assert not one(spark, tx.convert_script(F.lit("討論x"), {"討": "讨"}, "preserve"))["changed"]


def test_foreign_hash(spark):
    import hashlib
    want = hashlib.sha256('{"a":null,"b":1.5}'.encode()).hexdigest()
    assert one(spark, hashing.foreign_event_sha256(F.col("s")), s='{"b": 1.5, "event_sha256": "q", "a": null}') == want
    assert one(spark, hashing.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'


def test_round_exact_is_pythons_round(spark):
    from earwitness.functions.numbers import round_exact

    rng = random.Random(5)
    xs = [2.675, 0.0000005, 0.0625, 1.0005, -2.5, 16.0246875, 1e17, 0.5, 1.5, 145.36125]
    xs += [rng.uniform(-1000, 1000) for _ in range(500)] + [rng.randint(0, 10**7) / 2000 for _ in range(500)]
    xs += [rng.randint(0, 10**6) / rng.randint(1, 999) for _ in range(1000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", *[round_exact(F.col("x"), n).alias(f"r{n}") for n in (0, 2, 3, 6)]).collect()
    for r in rows:
        for n in (0, 2, 3, 6):
            assert r[f"r{n}"] == round(r["x"], n), (r["x"], n)


def test_blocks_of_an_ordinary_transcript_are_found_from_a_list_of_runs(monkeypatch):
    rng = random.Random(20)
    said = [rng.choice(["thin", "of", "edwh", "to", "reading", "a"]) + rng.choice(["", "er", "tion", "ly"]) for _ in range(250)]
    a, b = " ".join(said), " ".join(w for w in said if len(w) > 2)
    want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    probes = []
    plain = sim._longest_common
    monkeypatch.setattr(sim, "_longest_common", lambda *args: probes.append(args) or plain(*args))
    assert sim.ratio(a, b) == want
    assert len(probes) < 20  # one by one there are more than a hundred
    same = "ab" * 2000  # too many runs to list: no more memory than before, and the same length
    assert sim.matched_length(same + "c", "c" + same) == len(same)


def test_forms_lengths_are_those_of_the_pair_scores(spark):
    from earwitness.operators import agreement

    rows = [("a", "Ünd, so?", "und so", "ab"), ("b", "x", None, None), ("c", "", "...", "!"), ("d", None, "abc", "ẞ")]
    df = spark.createDataFrame(rows, "id string, a string, b string, c string").select("id", F.map_from_arrays(
        F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(*[F.struct(F.col(p).isNull().alias("missing"), F.col(p).alias("text")) for p in "abc"])).alias("candidates"))
    lengths = F.transform(F.filter("pairwise", lambda p: ~p["missing"]), lambda p: p["length_ratio"])
    want = agreement.with_pairwise(df, "abc").select("id", F.array_min(lengths)).collect()
    got = agreement.with_length_ratio(df, "abc").select("id", "min_length_ratio").collect()
    assert {r[0]: r[1] for r in got} == {r[0]: r[1] for r in want}


def test_edit_distance_equals_the_table_and_needs_no_table(spark):
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(90))) for _ in "ab")
        assert sim.edit_distance(a, b) == table(a, b), (a, b)
        assert sim.edit_distance(a.split(), b.split()) == table(a.split(), b.split())
    # Six hundred million cells: minutes as a table.
    a = "".join(rng.choice("abcdefgh") for _ in range(24_000))
    assert sim.edit_distance(a, "x" + a[:9000] + "yz" + a[9001:]) == 3
    df = spark.createDataFrame([("A\u00a0 b", "a c d"), ("", ""), ("", "x"), (None, "x")], "r string, h string")
    got = df.select(sim.word_error_rate(F.col("r"), F.col("h")), sim.character_error_rate(F.col("r"), F.col("h")), sim.word_distance(F.col("r"), F.col("h"))).collect()
    assert [tuple(x) for x in got] == [(1.0, 1.0, 2), (0.0, 0.0, 0), (1.0, 1.0, 1), (None, None, None)]
