"""The pipeline's stages on a small table, and the SQL of this package's queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from earwitness.llm import decontaminate, jaccard, packing, quality, queries, secrets
from tests import oracle
from tests.llm.test_pairs import shingles, smallest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    ok, line = oracle.compare(spark, oracle.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, line


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == COLUMNS, name
        seen.append(docs.collect())
    first, good, single, clean, safe, packed = seen

    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r["__out"].score for r in quality.scored(spark.createDataFrame(first), model, ["doc_id"]).collect()}
    assert {r.doc_id for r in good} == {i for i, s in scores.items() if s >= quality.PARAMS.accept} and len(good) < len(first)

    sets = {r.doc_id: shingles(r.text, jaccard.WORDS) for r in good}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= jaccard.PERCENT * len(sets[a] | sets[b])]
    best = smallest(sorted(sets), links)
    assert sorted(r.doc_id for r in single) == sorted(i for i in sets if best[i] == i) and len(single) < len(good)

    search = decontaminate.WuManber([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    bad = set()
    for r in single:
        words = decontaminate.words_of(r.text.encode())
        hit = sum(b - a for a, b in search.hits(words)[0])
        if hit and 20 * hit >= len(words):
            bad.add(r.doc_id)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - bad

    before = {r.doc_id: r for r in clean}
    assert {r.doc_id for r in safe} == set(before)
    for r in safe:
        assert not secrets.base_spans(r.text)
        assert r.text == before[r.doc_id].text or (secrets.scan_text(before[r.doc_id].text)["base"] and r.n_chars == len(r.text))

    words = packing.WordTokens()
    ids = dict(zip([r.doc_id for r in safe], words.ids([r.text for r in safe]), strict=True))
    for i, raw in ids.items():
        assert sum(r.length for r in packed if r.doc_id == i) == len(raw) // 4 + 1
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 4096) + 1


def test_run_equals_the_stages_and_is_registered(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and set(rows.columns) >= {"doc_id", "sequence_id", "offset"}
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    assert [n for n in entry.queries() if n.startswith("op")] == [n for n in queries.QUERIES]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
