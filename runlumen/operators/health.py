"""Health views, trends and top-k reports over the registry and its child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.schemas import (
    ATTEMPT_KEY,
    COLLECTION_VIEW_COLUMNS,
    INVOCATION_COLUMNS,
    NATIVE_STATUSES,
    NODE_VIEW_COLUMNS,
    RUN_REPORT_COLUMNS,
)
from runlumen.session import require_limit

BIND = [*ATTEMPT_KEY, "normalized_digest"]
AXES = [
    "workspace_id",
    "observed_job_id",
    "observed_job_run_id",
    "dbt_task_run_id",
    "observed_task_key",
]


def published(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("collector_state") == "PUBLISHED")


def run_health(registry: DataFrame, invocations: DataFrame) -> DataFrame:
    """Published attempts with their invocation facts, bound by key and digest."""
    facts = invocations.select(*BIND, *INVOCATION_COLUMNS[3:-1])
    joined = published(registry).drop("raw_archive_locator", "collector_state").join(
        facts, BIND, "left"
    )
    own = [c for c in registry.columns if c not in ("raw_archive_locator", "collector_state")]
    return joined.select(*own, *INVOCATION_COLUMNS[3:-1])


def node_health(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node results of published attempts; a child with a foreign digest stays invisible."""
    root = published(registry).drop("invocation_id")
    return root.join(nodes, BIND).select(*NODE_VIEW_COLUMNS)


def collection_health(registry: DataFrame) -> DataFrame:
    """Collection state of every attempt, published or not."""
    return registry.select(*COLLECTION_VIEW_COLUMNS)


def since(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` before the explicit clock."""
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL '{days}' DAY"))


def recent(df: DataFrame, columns: list[str], order: list[Column], limit: int = 25) -> DataFrame:
    """Newest rows by an explicit total order; the plan is one TakeOrderedAndProject."""
    return df.select(*columns).orderBy(*order).limit(require_limit(limit))


def recent_runs(runs: DataFrame, limit: int = 25) -> DataFrame:
    return recent(
        runs, RUN_REPORT_COLUMNS,
        [F.desc("task_start_time"), F.desc("dbt_task_run_id")], limit,
    )


def recent_nodes(nodes: DataFrame, limit: int = 25) -> DataFrame:
    return recent(nodes, NODE_VIEW_COLUMNS, [F.desc("dbt_task_run_id"), F.asc("unique_id")], limit)


def recent_collection(collection: DataFrame, limit: int = 25) -> DataFrame:
    return recent(
        collection, COLLECTION_VIEW_COLUMNS,
        [F.desc_nulls_last("first_discovered_at"), F.desc("dbt_task_run_id")], limit,
    )


def newest_valid_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest accepted runs, at most 100 rows."""
    newest_first = [F.desc(c) for c in ("generated_at", "observed_job_run_id", "dbt_task_run_id")]
    return (
        runs.filter(F.col("pair_state") == "PAIR_VALID")
        .orderBy(*newest_first)
        .limit(require_limit(limit))
        .select(*AXES, F.col("generated_at").alias("observed_at"))
    )


def trend(runs: DataFrame, nodes: DataFrame, limit: int = 25) -> DataFrame:
    """Failed and model results of the newest accepted runs, oldest first.

    The limited side has at most 100 rows, so it is broadcast to the node scan: nodes of other runs
    leave before any shuffle and the counts are partial aggregates of at most 100 groups.
    """
    chosen = newest_valid_runs(runs, limit)
    failed = F.col("status").isin("error", "fail")
    counted = (
        nodes.join(F.broadcast(chosen.select(*AXES)), AXES)
        .groupBy(*AXES)
        .agg(
            F.count_if(failed).alias("failed_node_results"),
            F.count_if(F.col("resource_type") == "model").alias("model_results"),
        )
    )
    return (
        chosen.join(F.broadcast(counted), AXES, "left")
        .orderBy("observed_at", "observed_job_run_id", "dbt_task_run_id")
        .select(
            "observed_job_run_id",
            "observed_at",
            *(
                F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                for c in ("failed_node_results", "model_results")
            ),
        )
    )


def trend_from_tables(
    registry: DataFrame, invocations: DataFrame, nodes: DataFrame, limit: int = 25
) -> DataFrame:
    """``trend`` over the base tables: the chosen keys also thin out the registry and node scans."""
    runs = run_health(registry, invocations)
    keys = F.broadcast(newest_valid_runs(runs, limit).select(*ATTEMPT_KEY))
    seen = node_health(
        registry.join(keys, ATTEMPT_KEY, "left_semi"), nodes.join(keys, ATTEMPT_KEY, "left_semi")
    )
    return trend(runs, seen, limit)


def chart_summary(points: DataFrame) -> DataFrame:
    """Latest and largest value per metric, axis maximum (at least 1), run count and day range."""
    order = F.struct("observed_at", "observed_job_run_id")
    metrics = F.array(
        *(
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("failed_node_results", "model_results")
        )
    )
    return (
        points.select("observed_job_run_id", "observed_at", F.inline(metrics))
        .groupBy("metric")
        .agg(
            F.max_by("value", order).alias("latest"),
            F.max("value").alias("maximum"),
            F.greatest(F.max("value"), F.lit(1)).alias("axis_maximum"),
            F.count("*").alias("runs"),
            F.date_format(F.min("observed_at"), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max("observed_at"), "yyyy-MM-dd").alias("last_day"),
        )
    )


def node_summary(nodes: DataFrame) -> DataFrame:
    """Count and total seconds by resource type and status; seconds are summed as decimals."""
    seconds = F.sum(F.col("execution_time").cast("decimal(18,6)"))
    return nodes.groupBy("resource_type", "status").agg(
        F.count("*").alias("node_count"),
        F.round(seconds, 3).cast("double").alias("execution_seconds"),
    )


def status_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted status -> count map per attempt as compact JSON, and the number of results.

    One conditional count per known status keeps the aggregate fixed-width and partially combinable;
    a status outside the vocabulary only shows in ``result_count``.
    """
    counts = [F.count_if(F.col("status") == s).alias(f"n_{i}") for i, s in
              enumerate(NATIVE_STATUSES)]
    entries = F.array(
        *(
            F.struct(F.lit(s).alias("status"), F.col(f"n_{i}").alias("n"))
            for i, s in enumerate(NATIVE_STATUSES)
        )
    )
    present = F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0))
    return nodes.groupBy(*keys).agg(F.count("*").alias("result_count"), *counts).select(
        *keys, "result_count", F.to_json(present).alias("status_counts_json")
    )


def result_count_check(runs: DataFrame) -> DataFrame:
    """Counts recorded in the invocation against the count the registry expects."""
    counts = F.map_values(F.from_json("status_counts_json", "map<string,bigint>"))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return (
        runs.filter(F.col("pair_state") == "PAIR_VALID")
        .select(*ATTEMPT_KEY, "expected_node_count", "result_count", total.alias("status_total"))
        .withColumn(
            "matches",
            F.coalesce(
                (F.col("status_total") == F.col("result_count"))
                & (F.col("result_count") == F.col("expected_node_count")),
                F.lit(False),
            ),
        )
    )
