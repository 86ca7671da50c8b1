"""Registered queries: row contracts, column tests, snapshots and sample models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from runlumen.operators import health, quality, samples
from runlumen.plans.book import query
from runlumen.plans.health import NODE_VIEW, RUN_VIEW, TABLES, TREND, _nodes, _runs, _trend
from runlumen.schemas import (
    COLLECTION_VIEW_COLUMNS,
    NODE_VIEW_COLUMNS,
    RESULT_STATES,
    RUN_REPORT_COLUMNS,
)
from runlumen.sources.tables import seed_csv
from runlumen.session import scratch

_STATES = "'" + "', '".join(RESULT_STATES) + "'"
_LOGS = ("'UNAVAILABLE', 'NOT_INITIALIZED', 'TRUNCATED', 'MALFORMED', 'MISSING', 'UNKNOWN_VERSION', "
         "'ARTIFACT_INVOCATION_MISMATCH', 'VALID'")
_IDS = {
    "identifiers_positive": "NOT coalesce(least(workspace_id, dbt_task_run_id, observed_job_id, "
                            "observed_job_run_id) >= 1, FALSE)",
    "task_key_fixed": "observed_task_key IS DISTINCT FROM 'dbt_build'",
}
_FACTS = "(CASE WHEN {0} IS NULL THEN 0 ELSE 1 END)"
_PRESENT = " + ".join(_FACTS.format(x) for x in (
    "invocation_id", "generated_at", "elapsed_time", "dbt_version", "adapter_type", "result_count"))
RUN_CHECKS = {
    **_IDS,
    "repair_count_range": "repair_count IS NULL OR repair_count < 0",
    "execution_count_range": "execution_count IS NULL OR execution_count < 1",
    "attempt_number_range": "attempt_number IS NULL OR attempt_number < 0",
    "result_state_domain": f"lakeflow_result_state IS NULL OR lakeflow_result_state NOT IN ({_STATES})",
    "retrieval_state_domain": "retrieval_state IS NULL OR retrieval_state NOT IN ('RETRIEVED', 'UNAVAILABLE')",
    "capture_state_domain": "capture_state IS NULL OR capture_state NOT IN ('COMPLETE', 'PARTIAL', "
                            "'NOT_PRODUCED', 'ARCHIVE_UNAVAILABLE', 'INVALID_CAPTURE_CONTRACT')",
    "pair_state_domain": "pair_state NOT IN ('PAIR_VALID', 'PAIR_INVALID')",
    "issue_code_length": "length(issue_code) > 128",
    "log_state_domain": f"structured_log_state IS NULL OR structured_log_state NOT IN ({_LOGS})",
    "deps_log_state_domain": f"deps_structured_log_state NOT IN ({_LOGS})",
    "common_version_fixed": "structured_log_expected_dbt_common_version IS DISTINCT FROM '1.37.5'",
    "expected_count_range": "expected_node_count IS NULL OR expected_node_count < 0",
    "collected_at_present": "collected_at IS NULL",
    "elapsed_time_range": "elapsed_time < 0",
    "dbt_version_fixed": "dbt_version <> '1.11.12'",
    "adapter_type_fixed": "adapter_type <> 'databricks'",
    "result_count_range": "result_count < 0",
    "deps_log_presence": "dbt_include_deps IS DISTINCT FROM (deps_structured_log_state IS NOT NULL)",
    "valid_pair_is_complete": f"""pair_state = 'PAIR_VALID' AND (capture_state <> 'COMPLETE'
      OR issue_code IS NOT NULL OR {_PRESENT} < 6 OR result_count IS DISTINCT FROM expected_node_count
      OR expected_node_count < 1)""",
    "other_pair_has_issue_only": f"""pair_state IS DISTINCT FROM 'PAIR_VALID' AND (capture_state = 'COMPLETE'
      OR issue_code IS NULL OR {_PRESENT} > 0
      OR (pair_state = 'PAIR_INVALID' AND capture_state <> 'INVALID_CAPTURE_CONTRACT'))""",
}
NODE_CHECKS = {
    **_IDS,
    "capture_complete": "capture_state IS DISTINCT FROM 'COMPLETE'",
    "result_state_domain": f"lakeflow_result_state IS NULL OR lakeflow_result_state NOT IN ({_STATES})",
    "invocation_id_length": "invocation_id IS NULL OR length(invocation_id) > 128",
    "unique_id_length": "unique_id IS NULL OR length(unique_id) > 512",
    "resource_type_domain": """resource_type IS NULL OR resource_type NOT IN ('model', 'seed', 'snapshot',
      'test', 'unit_test', 'saved_query', 'exposure', 'function')""",
    "status_domain": """status IS NULL OR status NOT IN ('error', 'fail', 'no-op', 'partial success', 'pass',
      'skipped', 'success', 'warn')""",
    "status_legal_for_type": """CASE WHEN resource_type LIKE '%test'
      THEN status NOT IN ('error', 'fail', 'pass', 'skipped', 'warn')
      ELSE status NOT IN ('error', 'no-op', 'partial success', 'skipped', 'success') END""",
    "execution_time_range": "execution_time IS NULL OR execution_time < 0",
    "failures_range": "failures < 0",
}
_N = "collection_attempt_count"
COLLECTION_CHECKS = {
    **_IDS,
    "repair_count_range": "repair_count < 0",
    "execution_count_range": "execution_count < 1",
    "attempt_number_range": "attempt_number < 0",
    "result_state_domain": f"lakeflow_result_state NOT IN ({_STATES})",
    "collector_state_domain": """collector_state NOT IN ('DISCOVERED', 'COLLECTING', 'RETRYABLE',
      'TERMINAL_FAILURE', 'PUBLISHED')""",
    "issue_code_length": "length(collection_issue_code) > 96",
    "attempt_count_range": f"{_N} NOT BETWEEN 0 AND 3",
    "reconciliation_run_positive": "last_reconciliation_run_id < 1",
    "open_state_has_provenance": """collector_state <> 'PUBLISHED' AND (published_at IS NOT NULL
      OR first_discovered_at IS NULL OR last_reconciliation_run_id IS NULL)""",
    "published_shape": """collector_state = 'PUBLISHED' AND (published_at IS NULL
      OR collection_issue_code IS NOT NULL)""",
    "discovered_shape": f"""collector_state = 'DISCOVERED' AND ({_N} <> 0 OR last_attempted_at IS NOT NULL
      OR collection_issue_code IS NOT NULL)""",
    "collecting_shape": f"""collector_state = 'COLLECTING' AND ({_N} < 1 OR {_N} > 3
      OR last_attempted_at IS NULL OR collection_issue_code IS NOT NULL)""",
    "retryable_shape": f"""collector_state = 'RETRYABLE' AND ({_N} < 1 OR {_N} >= 3
      OR last_attempted_at IS NULL OR collection_issue_code IS NULL)""",
    "terminal_failure_shape": f"""collector_state = 'TERMINAL_FAILURE' AND ({_N} <> 3
      OR last_attempted_at IS NULL OR collection_issue_code IS NULL)""",
}


def _checks(relation, checks, keys):
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{rule}' AS rule FROM {relation} WHERE {cond}"
        for rule, cond in checks.items())


@query("dq_run_row", TABLES, f"WITH {RUN_VIEW} {_checks('run_view', RUN_CHECKS, 'dbt_task_run_id')}")
def _(t):
    return quality.violations(_runs(t), quality.run_rules(), ["dbt_task_run_id"])


@query("dq_node_row", TABLES,
       f"WITH {NODE_VIEW} {_checks('node_view', NODE_CHECKS, 'dbt_task_run_id, unique_id')}")
def _(t):
    return quality.violations(_nodes(t), quality.node_rules(), ["dbt_task_run_id", "unique_id"])


@query("dq_collection_row", ["registry"],
       _checks("registry", COLLECTION_CHECKS, "dbt_task_run_id"))
def _(t):
    return quality.violations(
        health.collection_health(t.registry), quality.collection_rules(), ["dbt_task_run_id"])


@query("dq_trend_row", TABLES, f"""WITH {RUN_VIEW}, {NODE_VIEW}, {TREND.format(n=100)}
SELECT CASE WHEN observed_job_run_id >= 1 AND observed_at IS NOT NULL AND failed_node_results >= 0
  AND model_results >= 0 THEN 'accepted' ELSE 'rejected' END AS verdict, count(*) AS points
FROM points GROUP BY 1""")
def _(t):
    broken = F.size(quality.code_array(quality.trend_rules())) > 0
    verdict = F.when(broken, "rejected").otherwise("accepted")
    return _trend(t, 100).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("points"))


@query("dq_shape", TABLES, f"""WITH {RUN_VIEW}, {NODE_VIEW}
SELECT 'run_health' AS contract, {len(RUN_REPORT_COLUMNS)} AS column_count, count(*) AS rows FROM run_view
UNION ALL SELECT 'node_health', {len(NODE_VIEW_COLUMNS)}, count(*) FROM node_view
UNION ALL SELECT 'collection_health', {len(COLLECTION_VIEW_COLUMNS)}, count(*) FROM registry""")
def _(t):
    contracts = {
        "run_health": (_runs(t).select(*RUN_REPORT_COLUMNS), RUN_REPORT_COLUMNS),
        "node_health": (_nodes(t), NODE_VIEW_COLUMNS),
        "collection_health": (health.collection_health(t.registry), COLLECTION_VIEW_COLUMNS),
    }
    parts = [
        quality.require_shape(df, columns).agg(
            F.lit(name).alias("contract"), F.lit(len(columns)).alias("column_count"),
            F.count("*").alias("rows"))
        for name, (df, columns) in contracts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- sample models and column tests ----------------------------------------------------------

@query("src_seed_csv", ["weather_text"], "SELECT * FROM weather_text")
def _(t):
    folder = scratch(t.spark, "seed")
    t.weather_text.write.option("header", True).csv(folder)
    return seed_csv(t.spark, folder, samples.SEED_SCHEMA)


@query("fn_typed_cast", ["weather_text"], """
SELECT city, CAST(observed_date AS DATE) AS observed_date, CAST(temperature_c AS DOUBLE) AS temperature_c,
  CAST(precipitation_mm AS DOUBLE) AS precipitation_mm, CAST(wind_speed_kph AS DOUBLE) AS wind_speed_kph
FROM weather_text""")
def _(t):
    typed = samples.staged(t.weather_text)
    return typed.select(*(
        F.col(n).cast("double").alias(n) if k.startswith("decimal") else F.col(n)
        for n, k in typed.dtypes))


_CENTS = "CAST(round(CAST({0} AS DECIMAL(9,2)) * 100) AS BIGINT)"


@query("agg_daily_weather", ["weather_text"], f"""
WITH c AS (SELECT CAST(observed_date AS DATE) AS observed_date, city,
    {_CENTS.format('temperature_c')} AS tc, {_CENTS.format('precipitation_mm')} AS pc,
    {_CENTS.format('wind_speed_kph')} AS wc FROM weather_text),
s AS (SELECT observed_date, count(DISTINCT city) AS city_count, CAST(sum(tc) AS BIGINT) AS t,
    count(*) AS n, CAST(sum(pc) AS BIGINT) AS p, max(wc) AS w FROM c GROUP BY 1)
-- half up at six digits, then half up at two, in whole numbers
SELECT observed_date, city_count,
  (((2 * t * 10000 + n) // (2 * n)) * 2 + 10000) // 20000 AS average_temperature_cents,
  p AS total_precipitation_cents, w AS maximum_wind_cents FROM s""")
def _(t):
    daily = samples.daily_summary(samples.staged(t.weather_text))
    return daily.select("observed_date", "city_count", *(
        (F.col(n) * 100).cast("bigint").alias(alias) for n, alias in (
            ("average_temperature_c", "average_temperature_cents"),
            ("total_precipitation_mm", "total_precipitation_cents"),
            ("maximum_wind_speed_kph", "maximum_wind_cents"))))


_LABEL = """CASE WHEN CAST(wind_speed_kph AS DOUBLE) >= 30 THEN 'high_wind'
  WHEN CAST(precipitation_mm AS DOUBLE) >= 7 THEN 'heavy_rain'
  WHEN CAST(temperature_c AS DOUBLE) >= 24 THEN 'warm' ELSE 'normal' END"""


@query("fn_case_label", ["weather_text"], f"""
SELECT city, CAST(observed_date AS DATE) AS observed_date, {_LABEL} AS weather_state FROM weather_text""")
def _(t):
    return samples.weather_state(samples.staged(t.weather_text))


@query("dq_not_null", ["registry"], """
SELECT 'not_null' AS test, c AS column_name, n AS failures FROM (
  SELECT 'pair_state' AS c, count(*) FILTER (pair_state IS NULL) AS n FROM registry
  UNION ALL SELECT 'normalized_digest', count(*) FILTER (normalized_digest IS NULL) FROM registry
  UNION ALL SELECT 'capture_state', count(*) FILTER (capture_state IS NULL) FROM registry) x""")
def _(t):
    parts = [quality.not_null(t.registry, c)
             for c in ("pair_state", "normalized_digest", "capture_state")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dq_unique", ["registry", "weather_text"], """
SELECT 'unique' AS test, 'observed_job_run_id' AS column_name, count(*) AS failures FROM (
  SELECT observed_job_run_id FROM registry GROUP BY 1 HAVING count(*) > 1) a
UNION ALL SELECT 'unique', 'dbt_task_run_id', count(*) FROM (
  SELECT dbt_task_run_id FROM registry GROUP BY 1 HAVING count(*) > 1) b
UNION ALL SELECT 'unique', 'observed_date', count(*) FROM (
  SELECT observed_date FROM weather_text GROUP BY 1 HAVING count(*) > 1) c""")
def _(t):
    return (
        quality.unique(t.registry, "observed_job_run_id")
        .unionByName(quality.unique(t.registry, "dbt_task_run_id"))
        .unionByName(quality.unique(t.weather_text, "observed_date"))
    )


@query("dq_accepted_values", ["weather_text"], f"""
SELECT 'accepted_values' AS test, 'weather_state' AS column_name, count(DISTINCT s) AS failures
FROM (SELECT {_LABEL} AS s FROM weather_text) x WHERE s NOT IN ('heavy_rain', 'warm', 'normal')""")
def _(t):
    labelled = samples.weather_state(samples.staged(t.weather_text))
    return quality.accepted_values(labelled, "weather_state", ["heavy_rain", "warm", "normal"])


_HISTORY = """history AS (
  SELECT p_partkey AS fixture_id, p_brand AS brand, p_size AS size, TIMESTAMP '2024-01-01' AS valid_from,
    CASE WHEN p_size = 9 THEN TIMESTAMP '2024-01-02' END AS valid_to FROM part WHERE p_size <> 3),
source AS (
  SELECT p_partkey AS fixture_id, CASE WHEN p_size = 5 THEN 'changed' WHEN p_size = 6 THEN NULL
    ELSE p_brand END AS brand, CASE WHEN p_size = 7 THEN 0 ELSE p_size END AS size
  FROM part WHERE p_size <> 4)"""


@query("snap_check", None, f"""WITH {_HISTORY},
changes AS (SELECT h.fixture_id FROM history h JOIN source s USING (fixture_id) WHERE h.valid_to IS NULL
  AND (h.brand IS DISTINCT FROM s.brand OR h.size IS DISTINCT FROM s.size))
SELECT fixture_id, brand, size, valid_from, CASE WHEN fixture_id IN (SELECT * FROM changes)
  THEN TIMESTAMP '2024-02-01' ELSE valid_to END AS valid_to FROM history
UNION ALL SELECT fixture_id, brand, size, TIMESTAMP '2024-02-01', NULL FROM source
WHERE fixture_id IN (SELECT * FROM changes)
  OR fixture_id NOT IN (SELECT fixture_id FROM history WHERE valid_to IS NULL)""")
def _(t):
    part = t.base("part")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    size = F.col("p_size")
    history = part.filter(size != 3).select(
        F.col("p_partkey").alias("fixture_id"), F.col("p_brand").alias("brand"),
        size.alias("size"), stamp("2024-01-01 00:00:00").alias("valid_from"),
        F.when(size == 9, stamp("2024-01-02 00:00:00")).alias("valid_to"))
    source = part.filter(size != 4).select(
        F.col("p_partkey").alias("fixture_id"),
        F.when(size == 5, "changed").when(size == 6, None).otherwise(F.col("p_brand"))
        .alias("brand"), F.when(size == 7, 0).otherwise(size).alias("size"))
    return quality.snapshot_check(
        history, source, "fixture_id", ["brand", "size"], stamp("2024-02-01 00:00:00"))


@query("fn_scalar_udf", ["nodes"], """
SELECT dbt_task_run_id, unique_id, failures * 2 AS doubled FROM nodes""")
def _(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fixture_double(value BIGINT) RETURNS BIGINT "
                "RETURN value * 2")
    return t.nodes.select("dbt_task_run_id", "unique_id",
                          F.expr("fixture_double(failures)").alias("doubled"))
