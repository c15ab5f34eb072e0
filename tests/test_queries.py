"""Registered queries against their SQL at the smallest scale; tests/oracle.py runs all of them."""

import os

import pytest

from earwitness import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "region_pairs_missing", "align_regions", "cer_characters", "speaker_turns", "speaker_overlap_join", "merged_duration", "review_summary",
    "full_transcript", "srt_cues", "corrections_applied", "cumulative_spend_stop", "cost_preflight", "price_quotes", "pilot_rollup", "chain_verify",
    "nearest_silence", "archive_folders", "object_retention", "job_inbox", "native_timing", "spend_summary", "spend_after_earlier_runs", "wer_words", "scorecards", "release_gate", "eval_report")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    ok, line = compare(spark, con, name, catalog.all_queries()[name], catalog.all_oracles().get(name), SF)
    assert ok, line


def test_every_sql_has_a_query_and_parses(con):
    queries, oracles = catalog.all_queries(), catalog.all_oracles()
    assert set(oracles) <= set(queries) and len(queries) >= 90
    for sql in oracles.values():
        con.execute("EXPLAIN " + sql)
