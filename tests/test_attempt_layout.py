"""Rows dealt by attempt once, and joins that sort no wide rows."""

import pytest
from pyspark.sql import functions as F

from runlumen.operators import pairs, publish
from runlumen.plans.book import Tables
from runlumen.schemas import REGISTRY_COLUMNS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture
def unconfigured(spark):
    """A session as Spark starts it, without broadcasts, as with large tables."""
    names = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.unset(names[0])
    for name in names[1:]:
        spark.conf.set(name, "-1")
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)), {
        "ignoreNullFields": "false"})).collect())


def test_nodes_are_shuffled_once_for_groups_and_joins_by_attempt(unconfigured, tables):
    nodes, registry = tables.nodes, tables.registry
    key = ["workspace_id", "dbt_task_run_id"]
    assert _plan(nodes.groupBy(*key).agg(F.min("unique_id"))).count("Exchange hashpartitioning") == 1
    joined = registry.select(*key, "normalized_digest").join(nodes, [*key, "normalized_digest"])
    assert _plan(joined).count("Exchange hashpartitioning") == 2


def test_digests_and_roots_sort_no_wide_rows(unconfigured, tables):
    digests = publish.record_digests(tables.registry_by_run, tables.invocations, tables.nodes)
    wide = [part for part in _plan(digests).splitlines() if "Sort [" in part and "archive_sha256" in part]
    assert not wide and _plan(digests).count("ShuffledHashJoin") == 2
    merged = _plan(publish.root_update(tables.root_target, tables.root_source))
    assert merged.count("ShuffledHashJoin") == 2 and "FullOuter" not in merged
    # neither meets the other after its own rows were shuffled by attempt
    assert "hashpartitioning(workspace_id" not in merged


def test_registry_by_run_has_the_rows_of_the_registry(tables):
    assert _rows(tables.registry_by_run) == _rows(tables.registry)


def test_root_update_as_a_full_join_says_it(spark):
    kinds = ("workspace_id long, dbt_task_run_id long, normalized_digest string, collector_state string, "
             "first_discovered_at string, capture_state string")
    target = spark.createDataFrame([
        (1, 1, None, "DISCOVERED", "t", "t"), (1, 2, None, "PUBLISHED", "t", "t"), (1, 3, "d", "COLLECTING", "t", "t"),
        (1, 4, None, None, "t", "t"), (1, 5, None, "DISCOVERED", None, "t"), (1, 6, None, "RETRYABLE", "t", "t"),
        (1, 6, None, "RETRYABLE", "u", "u"), (None, 7, None, "DISCOVERED", "t", "t")], kinds)
    source = spark.createDataFrame(
        [(1, i, "new", "COLLECTING", "s", "s") for i in (1, 2, 3, 4, 5, 6, 8, 8)]
        + [(None, 7, "new", "COLLECTING", "s", "s")], kinds)
    columns = [c for c in REGISTRY_COLUMNS if c in target.columns]
    t, s = (df.select(*(F.col(c).alias(p + c) for c in columns), F.lit(True).alias(p + "row"))
            for df, p in ((target, "t_"), (source, "s_")))
    on = (t.t_workspace_id == s.s_workspace_id) & (t.t_dbt_task_run_id == s.s_dbt_task_run_id)
    fill = F.expr("s_row IS NOT NULL AND (t_row IS NULL OR (t_normalized_digest IS NULL AND t_collector_state <> "
                  "'PUBLISHED'))")
    carried = F.expr("if(t_row IS NULL, s_first_discovered_at, t_first_discovered_at)")
    expected = t.join(s, on, "full").select(*(
        F.when(fill, carried if c == "first_discovered_at" else F.col("s_" + c)).otherwise(F.col("t_" + c)).alias(c)
        for c in columns))
    assert _rows(publish.root_update(target, source)) == _rows(expected)


def test_manifest_entries_come_from_one_pass(tables):
    plan = tables.inventory._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate [") == 1


def test_projection_joins_accepted_results_once(spark):
    keys = ["dbt_task_run_id"]
    verdicts = spark.createDataFrame([(1, "PAIR_VALID"), (2, "PAIR_INVALID")], "dbt_task_run_id long, pair_state string")
    meta = spark.createDataFrame([(1, "i1"), (2, "i2")], "dbt_task_run_id long, run_results_invocation string")
    results = spark.createDataFrame(
        [(1, "a", "success", 1.0, None), (1, "a", "error", 2.0, None), (1, None, "success", 1.0, None),
         (1, "b", "pass", 1.0, 0), (2, "a", "success", 1.0, None)],
        "dbt_task_run_id long, unique_id string, status string, execution_time double, failures long")
    entries = spark.createDataFrame(
        [(1, "nodes", "a", "a", "model")],
        "dbt_task_run_id long, collection string, map_key string, inner_id string, resource_type string")
    found = pairs.project(verdicts, meta, results, entries, keys)
    assert sorted((r["unique_id"], r["resource_type"], r["status"], r["invocation_id"]) for r in found.collect()) == [
        ("a", "model", "error", "i1"), ("a", "model", "success", "i1"), ("b", None, "pass", "i1")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
