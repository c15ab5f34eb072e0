"""Jaccard join, cap filters and components against brute force."""

import itertools
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from earwitness.llm import caps, components, jaccard

DOCS = "doc_id long, text string, fp string, node string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return frozenset()
    n = min(words, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def smallest(ids, links):
    root = {i: i for i in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, copies=60):
    rng = random.Random(seed)
    texts = [None, "", " \t", "one", "One two", "one TWO", "a b c", "A b c", "a b c d"]
    for size in (9, 25, 60, 150, 151, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        texts += [" ".join(base)] * 3 + [edited(rng, base, k) for k in range(1, 6) for _ in range(3)]
    base = [f"x{k}" for k in range(148)]
    texts += [edited(rng, base, rng.randrange(9)) for _ in range(copies)]
    texts.append(" ".join(f"long{k % 9000}" for k in range(30_000)))
    rng.shuffle(texts)
    return [(k * 7 % len(texts) if len(texts) % 7 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 6)  # so that blocks and forests are used
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    docs = corpus(words)
    sets = {i: shingles(t, words) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = smallest(list(sets), links)
    df = spark.createDataFrame([(i, t, "f", "n", 1) for i, t in docs], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, "doc_id", words, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = jaccard.one_of_each(df, "doc_id", words, percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_rows_compared_grow_with_the_group(spark, monkeypatch):
    """Near copies, some of them too far from most; and texts that share no more than a passage."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    grouped = type(spark.range(1).groupBy("id"))
    apply, compared = grouped.applyInArrow, []
    monkeypatch.setattr(grouped, "applyInArrow", lambda self, *args: compared.append(self._df.count()) or apply(self, *args))

    def rows(texts):
        compared.clear()
        sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in jaccard.components(df, "doc_id", 5, 80).collect()}
        assert got == smallest(list(sets), links)
        return list(compared)

    rng = random.Random(8)
    base = [f"x{k}" for k in range(148)]
    apart = [" ".join(f"y{k}" if i in at else w for i, w in enumerate(base)) for k in range(5) for at in [rng.sample(range(5, 143, 7), 4)]]
    near = apart + [edited(rng, base, 1) for _ in range(235)]
    less, more = rows(near[:120]), rows(near)
    assert [0 < y <= 3 * x for x, y in zip(less, more, strict=True)] == [True, True], (less, more)
    assert rows([" ".join(base[:44] + [f"own{rng.randrange(10**9)}" for _ in range(104)]) for _ in range(100)]) == [0, 0]


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_meet_in_the_keys_needed(percent):
    """Whatever keys are in large buckets: two shared ones are not, or one of them is needed by both sets."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 90, 94, 140, 141, 150, 400, 1500]:
        for grow in (0, size * (100 - percent) // percent):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            if grow:
                b = np.unique(np.concatenate([a, rng.integers(0, 2**63, grow).astype(np.uint64)]))
            else:
                swaps = size * (100 - percent) // (100 + percent)
                b = np.unique(np.concatenate([a[swaps:], rng.integers(0, 2**63, swaps).astype(np.uint64)]))
            if np.array_equal(a, b):
                continue
            for share in (0.2, 0.7, 1):
                words = np.where(rng.random((1 << 14, 64)) < share, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)).sum(1, dtype=np.uint64)
                small, large = [], []
                for s in (a, b):
                    sketches = [{"band": k, "bits": jaccard.sketch(s, k, percent)} for k in jaccard.bands_of(len(s), percent) if jaccard.band_chunks(k, percent)[1]]
                    batch = pa.RecordBatch.from_pylist([{"node": 1, "n": len(s), "sketches": sketches}])
                    large += [k.column("key").to_numpy() for k in jaccard._chunk_rows([batch], percent, large=SimpleNamespace(value=words))]
                    small += [k.column("key").to_numpy() for k in jaccard._chunk_rows([batch], percent, without=SimpleNamespace(value=words))]
                assert len(np.intersect1d(*small)) >= 2 or len(np.intersect1d(*large)) >= 1


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "p q r s t u"), (9, "other words are in this text"), (None, "only null ids have this text"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.components(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (9, 9), (9, 9), (None, None), (None, None), (3, 3)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted([(4, "a b c d e f"), (9, "p q r s t u"), (9, "other words are in this text"), (None, "only null ids have this text"), (None, None), (3, None)], key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(docs).collect() == [] and jaccard.one_of_each(docs).collect() == []
    assert caps.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert components.roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for size in (12, 80, 700):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[3:], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        band = jaccard.bands_of(len(a), 80)[0]
        x, y = (np.frombuffer(jaccard.sketch(s, band, 80), np.uint32) for s in (a, b))
        assert np.bitwise_count((x ^ y) & jaccard.PARITY).sum() <= 6 and (x != y).sum() <= 6


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_two_keys(percent):
    """As far apart as a link allows, for sizes across bands."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 90, 150, 400, 1500]:
        for grow in (0, size * (100 - percent) // percent):  # other set larger, or as large with swaps
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            if grow:
                b = np.unique(np.concatenate([a, rng.integers(0, 2**63, grow).astype(np.uint64)]))
            else:
                swaps = int(size * (100 - percent) / (100 + percent))
                b = np.unique(np.concatenate([a[swaps:], rng.integers(0, 2**63, swaps).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert both * 100 >= percent * len(np.union1d(a, b))
            if both == len(a) == len(b):
                continue
            keys = []
            for s in (a, b):
                bands = [k for k in jaccard.bands_of(len(s), percent) if jaccard.band_chunks(k, percent)[1]]
                keys.append(np.concatenate([jaccard.chunk_keys(jaccard.sketch(s, k, percent), k, percent) for k in bands]))
            assert len(np.intersect1d(*keys)) >= 2


def test_roots_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3), (7, None)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    nodes = {x for a, b in edges if a is not None and b is not None for x in (a, b)}
    want = smallest(nodes, [(a, b) for a, b in edges if a is not None and b is not None])
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in itertools.combinations(sorted(nodes), 2))


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    ids = random.Random(6).sample(range(1000), 40)
    found = components.roots(spark.createDataFrame(list(itertools.pairwise(ids)), "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, found.first().root) for k in ids}
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 64


def brute_links(rows, cosine):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
            and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine]


def test_cap_filters_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = []
    for k in range(40):
        base = rng.normal(size=32)
        vectors += [(base + rng.normal(size=32) * s).tolist() for s in rng.uniform(0, 0.3, 6)] + [base.tolist()] * 2
    rows = [(k, v, int(k % 3)) for k, v in enumerate(vectors)]
    rows += [(len(rows) + k, v, lab) for k, (v, lab) in enumerate([
        (None, 1), ([], 1), ([0.0] * 32, 1), ([None] * 32, 1), ([float("nan")] * 32, 1), ([float("inf")] * 32, 1), (vectors[0], None), (vectors[0][:8], 0), (vectors[0][:8], 0), ([5.0], 0), ([2.0], 0), ([-2.0], 0)])]
    links = brute_links(rows, 0.98)
    want = smallest([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.linked(df, params=caps.CapParams(block=16)).collect()}
    assert len(links) > 100
    assert got == {i: (count[i], want[i], want[i] == i) for i in count}


def test_cap_filter_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in caps.linked(df).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True)], key=str)


def test_decoded_lists_all_directions_beyond_the_threshold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        left, right = rng.normal(size=16), rng.normal(size=16)
        sums = (left[:, None] + right[None, :]).ravel()
        assert caps.decoded(left, right, 2.0, 0).tolist() == np.flatnonzero(sums >= 2.0).tolist()
        best = caps.decoded(left, right, 99.0, 12)
        assert sorted(sums[best]) == sorted(np.sort(sums)[-12:])
