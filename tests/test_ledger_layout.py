"""The stored ledger: bucketed by entity, the same rows as the steps joined one by one."""

import re

import pytest
from pyspark.sql import functions as F

from runlumen.operators import ledger as led
from runlumen.operators import ledger_append as app
from runlumen.plans import ledger_data
from runlumen.session import settings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customers(spark):
    """Thirty customers, three of whose keys occur twice with other facts, and one without a key."""
    some = spark.read.parquet(f"{SF}/customer.parquet").orderBy("c_custkey").limit(30)
    again = some.orderBy("c_custkey").limit(3).withColumn("c_mktsegment", F.lit("BUILDING"))
    unknown = some.limit(1).withColumn("c_custkey", F.lit(None).cast("bigint"))
    return some.unionByName(again).unionByName(unknown)


def _rows(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*led.COLUMNS))).collect())


def test_stored_ledger_has_the_rows_of_the_joined_steps(spark, customers, tmp_path):
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    stored = ledger_data.stored_ledger(spark, str(tmp_path))
    assert _rows(stored) == _rows(ledger_data._by_joins(customers))


def test_generations_and_chains_need_no_shuffle(spark, customers, tmp_path):
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    stored = ledger_data.stored_ledger(spark, str(tmp_path))
    for df in (stored.groupBy(*led.GENERATION).count(), led.validated(stored)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operation", [led.CANDIDATE, led.ACCEPT])
def test_wide_inputs_of_appends_stay_in_their_buckets(spark, customers, tmp_path, operation):
    """Without broadcasts, with more shuffle partitions than buckets: only narrow rows are exchanged."""
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    stored = ledger_data.stored_ledger(spark, str(tmp_path))
    inputs = stored.filter(F.col("operation") == operation).distinct()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}):
        checked = app.CHECKS[operation](app.with_times(inputs, stored), stored)
        plan = spark._jvm.PythonSQLUtils.explainString(checked._jdf.queryExecution(), "formatted")
        widths = [int(n) for n in re.findall(r"\) Exchange\nInput \[(\d+)\]", plan)]
        assert widths and max(widths) <= 4
        found = {r["event_id"]: r["eligible"] for r in checked.collect()}
    assert len(found) == inputs.select("event_id").distinct().count()


def test_an_acceptance_needs_a_single_copy_of_its_candidate(spark, customers, tmp_path):
    customers.filter("c_custkey is not null and c_nationkey <> 11 and c_acctbal >= 0").dropDuplicates(
        ["c_custkey"]).write.parquet(str(tmp_path / "customer.parquet"))
    stored = ledger_data.stored_ledger(spark, str(tmp_path))
    first = stored.filter((F.col("operation") == led.ACCEPT) & (F.col("generation") == 1) & (
        F.col("deployment_mode") == "SNAPSHOT"))
    one = first.orderBy("event_id").limit(1)
    before = stored.filter((F.col("generation") == 1) & F.col("operation").isin(led.REGISTER, led.CANDIDATE))
    # a copy of the candidate under another entity is a copy too
    copy = before.join(one.select(F.col("candidate_event_id").alias("event_id")), "event_id", "left_semi").withColumn(
        "installation_digest", F.lit("f" * 64)).select(*before.columns)

    def eligible(target):
        linked = app.with_times(one, target)
        return [r["eligible"] for r in app.accept_ok(linked, target).collect()]

    assert eligible(before) == [True]
    assert eligible(before.unionByName(copy)) == [False]


def test_event_readback_counts_values_and_repeats_no_row(spark):
    rows = [("a", "p", "s", "r"), ("a", "p", "s", "r"), ("a", "q", "s", None), ("b", None, None, None),
            (None, "p", "s", "r"), (None, "p", "t", "r")]
    shown = spark.createDataFrame(
        rows, "event_id string, payload_digest string, server_record_digest string, ledger_row_id string"
    ).withColumns({c: F.lit(None).cast(k) for c, k in (
        ("snapshot_id", "string"), ("statement_evaluated_at", "timestamp"), ("valid_until", "timestamp"))})
    found = led.event_readback(shown)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    counts = {r["event_id"]: (r["physical_row_count"], r["payload_digest"], r["distinct_payload_count"],
                              r["distinct_server_record_count"], r["distinct_ledger_row_count"])
              for r in found.collect()}
    assert counts == {"a": (3, "p", 2, 1, 1), "b": (1, None, 0, 0, 0), None: (2, "p", 1, 2, 1)}
