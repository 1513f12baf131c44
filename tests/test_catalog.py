"""Registered queries against their checks, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from compare import differences, oracle_connection

SF = "/root/testdata/sf0.001"
CHEAP = """d1_tokenize d4_sentences d5_identifiers d11_numbers a3_fetched_pages a4_live_chunks b5_text_blocks b11_context b15_quality c1_detect_changes
c4_activate c7_roll_back c8_reschedule c11_document_actions e2_access_lists e3_tier_masks e6_bm25_topk e7_dense_topk e8_exact_match f1_gate f3_plan f20_conflicts
f23_budget g1_chunk_signals g4_rephrases g6_recheck_verdict h3_rates h5_percentiles h6_repeat_failures h17_objectives i3_rescue_findings i10_diagnoses
i16_gate_verdict j2_judge j5_summary j9_canary_decision k2_daily_usage k5_chunk_helpfulness l3_traces l5_chat_turns l11_waterfall m4_sql_functions""".split()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_check(spark, con, name):
    assert name in entry.oracle_sql()
    assert differences(spark, con, name, SF) == []


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
