"""A cross-section of registered queries against their SQL check; oracle_check.py runs them all."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from runlumen.plans import book

SF = "/root/testdata/sf0.001"
NAMES = ["view_run_health", "view_node_health", "top_trend", "agg_status_counts", "pair_resolution",
         "sort_issues", "log_state", "mem_first_violation", "dq_collection_row", "snap_check",
         "fn_record_digest", "join_root_update", "pub_gate", "rec_claim", "rec_fold",
         "rec_replay_cap", "cat_grant_audit", "src_tree_digest", "st_dedup_late", "led_pre_register",
         "agg_generation_counts"]


def test_registry_is_complete():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert len([n for n in queries if n in book.QUERIES]) == len(book.QUERIES) == 157
    assert set(sqls) <= set(queries)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note, _, _ = compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "observed_job_run_id", "observed_at", "failed_node_results", "model_results"]
    assert df.count() > 0
