"""Toxicity, whitening and phrases against plain definitions."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from earwitness.llm import phrases, toxicity, whitening

SF = "/root/testdata/sf0.01"


# ---- phrases

def brute_phrases(rows, support, report=2000, longest=5):
    n, counts = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {g: a for g, a in counts.items() if a >= support}
    out = {}
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        if any(lg == lang and len(x) > len(w) and b >= a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (lg, x), b in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, l_, r_, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l_, r_) in enumerate(sorted(found)[:report], 1))


def some_texts(seed, rows=120):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "A", "c", "über", "x y", "d", "ÀB"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", ";\r", ":", "\x0b"]
    made = ["".join(w + m for w, m in zip(rng.choice(words, k, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]), rng.choice(marks, k), strict=True)) for k in rng.integers(0, 60, rows)]
    return [(t, (None, "en", "fr", "en")[i % 4]) for i, t in enumerate(made)]


@pytest.mark.parametrize("shards", [1, 4, 13])
def test_phrases_equal_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 700)
    rows = some_texts(shards) + [(None, "en"), ("", None), ("a a a a a a a a", "de"), ("b " * 4000, "fr")] + [("One two, one two three!", "es")] * 9
    docs = spark.createDataFrame([(k, t, g, "x") for k, (t, g) in enumerate(rows)], "key long, text string, lang string, n string").repartition(3)
    got = phrases.collocations(docs, phrases.PhraseParams(support=8, shards=shards))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 8)


def test_phrases_of_few_and_of_wide_scores(spark):
    docs = spark.createDataFrame(some_texts(3), "text string, lang string")
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert sorted(map(tuple, phrases.collocations(docs, phrases.PhraseParams(support=5, report=4)).collect())) == brute_phrases(some_texts(3), 5, 4)
    wide = spark.createDataFrame([("en", 3 * 10**9, 3 * 10**9, 2 * 10**9, 5 * 10**12)], "lang string, l long, r long, a long, n long")
    assert wide.select(phrases.score().alias("s")).head().s == 1000 * 2 * 10**9 * 5 * 10**12 // (9 * 10**18)


# ---- whitening

def brute_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    c = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, [int(d) for d in ((n * x - s) ** 2).sum(1)], c, e[::-1], v[:, ::-1]


def check_whitening(rows, vectors, ids, most=32):
    n, deviations, c, e, v = brute_whitening(vectors)
    rank = int((e > e[0] * 1e-10).sum())
    assert len(rows) == len(vectors) * min(rank, most)
    got = np.zeros((len(vectors), min(rank, most)))
    at = {i: k for k, i in enumerate(ids)}
    for r in rows:
        assert r.n == n and r.deviation == deviations[at[r.vec_id]] == r.deviation_exact and r.identity_error <= 1e-4
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-6
        got[at[r.vec_id], r.component - 1] = r.whitened
    want = (c @ v / np.sqrt(np.clip(e, 1e-300, None)))[:, : got.shape[1]]
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-6


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(0, 1, (300, 40)) * np.logspace(0, -1.2, 40) + rng.normal(0, 3, 40)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "n") for i, v in rows], "vec_id long, embedding array<float>, label int, n string").repartition(5)
    check_whitening(whitening.whitened(df, "vec_id").collect(), vectors, range(300))


def test_whitening_without_variance_in_some_directions(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 1, (50, 3)) @ rng.integers(-2, 3, (3, 6))
    wide = np.round(flat * 64) / 64  # whole steps keep the rank
    wide = np.concatenate([np.round(rng.normal(0, 3, (50, 2)) * 64) / 64, np.full((50, 2), 5.0)], 1)
    few = rng.normal(0, 1, (4, 9))
    for vectors in (wide, few):
        df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        check_whitening(whitening.whitened(df, "vec_id").collect(), vectors, range(len(vectors)))
    alike = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened(alike, "vec_id").collect() == [] and whitening.whitened(alike.limit(0), "vec_id").columns == whitening.whitened(df, "vec_id").columns


def test_deviations_are_exact_where_longs_are_too_short():
    rng = np.random.default_rng(4)
    for bound, n in ((100, 10**9), (2**40, 7)):
        x = rng.integers(-bound, bound, (20, 8))
        at = whitening.Centre(n, tuple(int(s) * 3 for s in x.sum(0)))
        assert at.deviations(x) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, at.sums, strict=True)) for row in x]
        assert np.allclose(at.centred(x), [[(n * int(c) - s) / n for c, s in zip(row, at.sums, strict=True)] for row in x], rtol=1e-15)


# ---- toxicity

SMALL = toxicity.ToxicityParams(window=6, stride=3, hidden=4, attention=3, word_size=3, char_size=3, char_rows=64)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.initial({"a": 1}, SMALL)
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.normal(0, 1, (30, 6))
    place, mask = rng.integers(0, 30, (6, 5)), np.arange(6)[:, None] < np.array([6, 1, 3, 6, 2])
    y = np.array([1, 0, 1, 0, 0.0])

    def loss(w):
        logit = toxicity.forward(w, toxicity._gates(w, x)[:, place], mask)
        return float(np.logaddexp(0, np.where(y == 1, -logit, logit)).sum())

    logit, traced = toxicity.forward(w, toxicity._gates(w, x)[:, place], mask, trace=True)
    grads, d_gates = toxicity.backward(w, mask, traced, toxicity._sigmoid(logit) - y)
    grads["bx"] = d_gates.sum((1, 2))
    grads["wx"] = np.stack([np.einsum("tbx,tbg->xg", x[place], d_gates[s]) for s in (0, 1)])
    for name in ("wo", "bo", "va", "wa", "ba", "wz", "wn", "wx", "bx"):
        for at in list(np.ndindex(w[name].shape))[:: max(1, w[name].size // 7)]:
            moved = []
            for step in (1e-4, -1e-4):
                other = {k: v.copy() for k, v in w.items()}
                other[name][at] += step
                moved.append(loss(other))
            assert abs((moved[0] - moved[1]) / 2e-4 - grads[name][at]) < 2e-3, (name, at)


def test_every_word_is_in_a_window_and_blocks_change_nothing(monkeypatch):
    p = SMALL
    for n in range(1, 40):
        begins = toxicity.spans(n, p)
        assert set(range(n)) <= {b + k for b in begins.tolist() for k in range(p.window)} and (len(begins) == 1 or begins[-1] < n)
    rng = np.random.default_rng(1)
    net = toxicity.initial({"a": 1}, p)
    for v in net.w.values():
        v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    texts = [None, "", " ", "a", "b " * 50, " ".join(f"w{k}" for k in range(333)), "A, a! é", "x" * 10_000]
    plain = [toxicity.Reader(net, p).texts([t])[1][0] for t in texts]
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 11)
    for a, b in zip(plain, toxicity.Reader(net, p).texts(texts)[1], strict=True):
        assert len(a) == len(b) and np.allclose(a, b, atol=1e-5)


def test_toxicity_learns_words_and_handles_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    made = []
    for k in range(240):
        text = rng.choice(words, int(rng.integers(3, 120))).tolist()
        if k % 4 == 0:
            for at in rng.integers(0, len(text), 3):
                text[at] = "vile" if k % 8 else f"dread{rng.choice(words)}"
        made.append((k, " ".join(text), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t, "o") for k, t, _ in made] + [(None, "vile vile", "o"), (7000, None, "o"), (7001, "", "o"), (7002, "w1 " * 30_000 + "vile vile vile", "o")], "doc_id long, text string, windows string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made] + [(None, 1), (7001, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, net, docs.columns).collect()}
    assert len(got) == 244 and sum((got[k]["__out"].score >= 0.5) == y for k, _, y in made) >= 230
    assert got[7002]["__out"].score > 0.5 and got[7002]["__out"].windows == 2500 and got[None]["__out"].score > 0.5
    assert got[7000]["__out"].score == got[7001]["__out"].score < 0.5 and got[7000]["__out"].windows == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs.limit(0), labels) is None
    assert [r["__out"].score for r in toxicity.scored(docs.limit(3), None, ["doc_id"]).collect()] == [0.0] * 3
    assert toxicity.scored(docs.limit(0), net, ["doc_id"]).count() == 0


def test_toxicity_of_held_out_documents(spark):
    from earwitness.llm import queries
    rows = queries.QUERIES["op11_recurrent_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    seen = rows.groupBy("toxic", "predicted").count().collect()
    by = {(r.toxic, r.predicted): r["count"] for r in seen}
    assert by[1, 1] >= 85 and by.get((0, 1), 0) <= 15
    assert rows.where(F.col("score").between(0, 1)).count() == rows.count()
