"""Registered queries: views, trends, aggregates, top-k and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.functions import labels
from runlumen.operators import health
from runlumen.plans.book import query
from runlumen.schemas import (
    COLLECTION_VIEW_COLUMNS,
    NODE_VIEW_COLUMNS,
    REGISTRY_COLUMNS,
    RESULT_STATES,
    RUN_REPORT_COLUMNS,
)

AS_OF = "2001-08-01 00:00:00"  # explicit clock of the seven-day reports

_RUN = [c for c in REGISTRY_COLUMNS if c not in ("raw_archive_locator", "collector_state")]
_FACTS = ["elapsed_time", "dbt_version", "adapter_type", "command", "result_count",
          "status_counts_json"]

RUN_VIEW = f"""run_view AS (
  SELECT {', '.join('r.' + c for c in _RUN)}, i.generated_at, {', '.join('i.' + c for c in _FACTS)}
  FROM (SELECT * FROM registry WHERE collector_state = 'PUBLISHED') r
  LEFT JOIN invocations i ON i.workspace_id = r.workspace_id
    AND i.dbt_task_run_id = r.dbt_task_run_id AND i.normalized_digest = r.normalized_digest)"""
NODE_VIEW = """node_view AS (
  SELECT r.workspace_id, r.dbt_task_run_id, r.observed_job_id, r.observed_job_run_id,
    r.observed_task_key, r.capture_state, r.lakeflow_result_state, n.invocation_id, n.unique_id,
    n.resource_type, n.status, n.execution_time, n.failures
  FROM registry r, nodes n WHERE r.workspace_id = n.workspace_id
    AND r.dbt_task_run_id = n.dbt_task_run_id AND r.normalized_digest = n.normalized_digest
    AND r.collector_state = 'PUBLISHED')"""
TREND = """points AS (
  SELECT c.observed_job_run_id, c.generated_at AS observed_at,
    CAST(count(CASE WHEN v.status = 'error' OR v.status = 'fail' THEN 1 END) AS BIGINT)
      AS failed_node_results,
    CAST(count(CASE WHEN v.resource_type = 'model' THEN 1 END) AS BIGINT) AS model_results
  FROM (SELECT * FROM run_view WHERE pair_state = 'PAIR_VALID'
        ORDER BY generated_at DESC, observed_job_run_id DESC, dbt_task_run_id DESC LIMIT {n}) c
  LEFT JOIN node_view v ON v.workspace_id = c.workspace_id
    AND v.observed_job_id = c.observed_job_id AND v.observed_job_run_id = c.observed_job_run_id
    AND v.dbt_task_run_id = c.dbt_task_run_id AND v.observed_task_key = c.observed_task_key
  GROUP BY c.workspace_id, c.dbt_task_run_id, c.observed_job_run_id, c.observed_job_id,
    c.observed_task_key, c.generated_at)"""
TABLES = ["registry", "invocations", "nodes"]


def _runs(t):
    return health.run_health(t.registry, t.invocations)


def _nodes(t):
    return health.node_health(t.registry, t.nodes)


def _trend(t, n):
    return health.trend_from_tables(t.registry, t.invocations, t.nodes, n)


@query("view_run_health", TABLES, f"WITH {RUN_VIEW} SELECT * FROM run_view")
def _(t):
    return _runs(t)


@query("view_node_health", TABLES, f"WITH {NODE_VIEW} SELECT * FROM node_view")
def _(t):
    return _nodes(t)


@query("view_collection_health", ["registry"],
       f"SELECT {', '.join(COLLECTION_VIEW_COLUMNS)} FROM registry")
def _(t):
    return health.collection_health(t.registry)


@query("sink_views", TABLES, f"""WITH {RUN_VIEW}, {NODE_VIEW}
SELECT 'run_health' AS view_name, count(*) AS row_count,
  count(DISTINCT dbt_task_run_id) AS attempt_count FROM run_view
UNION ALL SELECT 'node_health', count(*), count(DISTINCT dbt_task_run_id) FROM node_view
UNION ALL SELECT 'collection_health', count(*), count(DISTINCT dbt_task_run_id) FROM registry""")
def _(t):
    from runlumen.operators.catalog import publish_views

    publish_views(t.spark, t.registry, t.invocations, t.nodes)
    parts = [
        t.spark.table(v).agg(
            F.lit(v).alias("view_name"), F.count("*").alias("row_count"),
            F.count_distinct("dbt_task_run_id").alias("attempt_count"))
        for v in ("run_health", "node_health", "collection_health")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("join_trend", TABLES, f"WITH {RUN_VIEW}, {NODE_VIEW}, {TREND.format(n=25)} "
       "SELECT * FROM points")
def _(t):
    return _trend(t, 25)


@query("top_trend", TABLES, f"WITH {RUN_VIEW}, {NODE_VIEW}, {TREND.format(n=100)} "
       "SELECT * FROM points")
def _(t):
    return _trend(t, 100)


@query("agg_trend", TABLES, f"""WITH {NODE_VIEW}
SELECT workspace_id, dbt_task_run_id,
  CAST(sum(CASE WHEN status IN ('fail', 'error') THEN 1 ELSE 0 END) AS BIGINT) AS failed_node_results,
  CAST(sum(CASE resource_type WHEN 'model' THEN 1 ELSE 0 END) AS BIGINT) AS model_results
FROM node_view GROUP BY workspace_id, dbt_task_run_id""")
def _(t):
    return _nodes(t).groupBy("workspace_id", "dbt_task_run_id").agg(
        F.count_if(F.col("status").isin("error", "fail")).alias("failed_node_results"),
        F.count_if(F.col("resource_type") == "model").alias("model_results"),
    )


@query("agg_chart_summary", TABLES, f"""WITH {RUN_VIEW}, {NODE_VIEW}, {TREND.format(n=100)},
long AS (SELECT 'failed_node_results' AS metric, failed_node_results AS v, * FROM points
  UNION ALL SELECT 'model_results', model_results, * FROM points)
SELECT metric, (SELECT l.v FROM long l WHERE l.metric = long.metric
    ORDER BY observed_at DESC, observed_job_run_id DESC LIMIT 1) AS latest,
  max(v) AS maximum, CASE WHEN max(v) < 1 THEN 1 ELSE max(v) END AS axis_maximum,
  count(*) AS runs, strftime(min(observed_at), '%Y-%m-%d') AS first_day,
  strftime(max(observed_at), '%Y-%m-%d') AS last_day
FROM long GROUP BY metric""")
def _(t):
    return health.chart_summary(_trend(t, 100))


@query("agg_node_summary", TABLES, f"""WITH {NODE_VIEW}
SELECT v.resource_type, v.status, count(*) AS node_count,
  CAST(round(sum(CAST(v.execution_time AS DECIMAL(18,6))), 3) AS DOUBLE) AS execution_seconds
FROM node_view v GROUP BY ALL""")
def _(t):
    return health.node_summary(_nodes(t))


@query("agg_status_counts", ["nodes"], """
SELECT workspace_id, dbt_task_run_id, CAST(sum(n) AS BIGINT) AS result_count,
  '{' || string_agg('"' || status || '":' || CAST(n AS STRING), ',' ORDER BY status) || '}'
    AS status_counts_json
FROM (SELECT workspace_id, dbt_task_run_id, status, count(*) AS n FROM nodes GROUP BY 1, 2, 3) x
GROUP BY workspace_id, dbt_task_run_id""")
def _(t):
    return health.status_counts(t.nodes, ["workspace_id", "dbt_task_run_id"])


@query("agg_result_count", TABLES, f"""WITH {RUN_VIEW}, summed AS (
  SELECT dbt_task_run_id AS run, count(*) AS n FROM nodes GROUP BY 1)
SELECT workspace_id, dbt_task_run_id, expected_node_count, result_count,
  CASE WHEN result_count IS NOT NULL THEN CAST(coalesce(n, 0) AS BIGINT) END AS status_total,
  result_count IS NOT NULL AND result_count = expected_node_count
    AND result_count = coalesce(n, 0) AS matches
FROM run_view LEFT JOIN summed ON run = dbt_task_run_id WHERE pair_state = 'PAIR_VALID'""")
def _(t):
    return health.result_count_check(_runs(t))


def _top(name, sql, fn, needs=TABLES):
    query(name, needs, sql)(fn)


_top("top_recent_runs", f"""WITH {RUN_VIEW} SELECT {', '.join(RUN_REPORT_COLUMNS)} FROM run_view
ORDER BY task_start_time DESC, dbt_task_run_id DESC LIMIT 25""",
     lambda t: health.recent_runs(_runs(t)))
_top("top_recent_nodes", f"""WITH {NODE_VIEW} SELECT {', '.join(NODE_VIEW_COLUMNS)} FROM node_view
ORDER BY dbt_task_run_id DESC, unique_id LIMIT 25""",
     lambda t: health.recent_nodes(_nodes(t)))
_top("top_recent_collection", f"""SELECT {', '.join(COLLECTION_VIEW_COLUMNS)} FROM registry
ORDER BY first_discovered_at DESC NULLS LAST, dbt_task_run_id DESC LIMIT 25""",
     lambda t: health.recent_collection(health.collection_health(t.registry)), ["registry"])

_RUNS_7D = ["task_start_time", "lakeflow_result_state", "retrieval_state", "capture_state",
            "pair_state", "issue_code", "dbt_version", "command", "result_count",
            "status_counts_json"]
_COLLECTION_7D = ["task_start_time", "collector_state", "collection_issue_code",
                  "collection_attempt_count", "last_attempted_at", "published_at"]


def _clock():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _weekly(df, columns, limit):
    newest = [F.desc("task_start_time"), F.desc("dbt_task_run_id")]
    return df.orderBy(*newest).limit(limit).select(*columns)


_top("top_runs_7d", f"""WITH {RUN_VIEW} SELECT {', '.join(_RUNS_7D)} FROM run_view
WHERE task_start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
ORDER BY task_start_time DESC, dbt_task_run_id DESC LIMIT 100""",
     lambda t: _weekly(health.since(_runs(t), "task_start_time", _clock(), 7), _RUNS_7D, 100))
_top("top_collection_7d", f"""SELECT {', '.join(_COLLECTION_7D)} FROM registry
WHERE task_start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
ORDER BY task_start_time DESC, dbt_task_run_id DESC LIMIT 100""",
     lambda t: _weekly(health.since(t.registry, "task_start_time", _clock(), 7),
                       _COLLECTION_7D, 100), ["registry"])
_top("top_latest_run", f"""WITH {RUN_VIEW} SELECT {', '.join(_RUNS_7D)} FROM run_view
ORDER BY task_start_time DESC, dbt_task_run_id DESC LIMIT 1""",
     lambda t: _weekly(_runs(t), _RUNS_7D, 1))


@query("flt_recent_days", TABLES, f"""WITH {NODE_VIEW}
SELECT n.resource_type, n.status, count(*) AS node_count,
  CAST(round(sum(CAST(n.execution_time AS DECIMAL(18,6))), 3) AS DOUBLE) AS execution_seconds
FROM node_view n JOIN registry r ON r.workspace_id = n.workspace_id
  AND r.dbt_task_run_id = n.dbt_task_run_id
WHERE r.task_start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY ALL""")
def _(t):
    week = health.since(t.registry, "task_start_time", _clock(), 7)
    return health.node_summary(health.node_health(week, t.nodes))


@query("flt_published", ["registry"], """
SELECT capture_state, lakeflow_result_state, count(*) AS attempts, min(dbt_task_run_id) AS first_run,
  max(dbt_task_run_id) AS last_run FROM registry WHERE collector_state = 'PUBLISHED' GROUP BY 1, 2""")
def _(t):
    return health.published(t.registry).groupBy("capture_state", "lakeflow_result_state").agg(
        F.count("*").alias("attempts"),
        F.min("dbt_task_run_id").alias("first_run"), F.max("dbt_task_run_id").alias("last_run"))


@query("prj_star_except", ["registry"],
       "SELECT * EXCLUDE (raw_archive_locator, collector_state) FROM registry")
def _(t):
    return t.registry.drop("raw_archive_locator", "collector_state")


@query("src_typed_rows", ["registry"], f"SELECT {', '.join(REGISTRY_COLUMNS)} FROM registry")
def _(t):
    from runlumen.sources.tables import typed_rows

    return typed_rows(t.registry, "registry")


@query("src_key_read", ["result_rows"], """
SELECT dbt_task_run_id, unique_id, count(*) AS row_count,
  CASE WHEN count(*) > 1 THEN 'ATTEMPT_ROOT_DUPLICATE' END AS error_code
FROM result_rows GROUP BY dbt_task_run_id, unique_id""")
def _(t):
    from runlumen.sources.tables import key_cardinality

    return key_cardinality(t.result_rows, ["dbt_task_run_id", "unique_id"])


# ---- projections -----------------------------------------------------------------------------

@query("prj_allowlist", ["invocations", "nodes"], """
SELECT n.workspace_id, n.dbt_task_run_id, i.invocation_id, i.generated_at, i.elapsed_time,
  i.dbt_version, i.adapter_type, i.command, i.result_count, i.status_counts_json, n.unique_id,
  n.resource_type, n.status, n.execution_time, n.failures
FROM invocations i JOIN nodes n ON n.dbt_task_run_id = i.dbt_task_run_id""")
def _(t):
    from runlumen.operators.pairs import allowlist

    facts, nodes = allowlist(t.invocations, t.nodes)
    return facts.join(nodes, ["workspace_id", "dbt_task_run_id"])


_SIX = ["workspace_id", "observed_job_id", "observed_job_run_id", "dbt_task_run_id",
        "repair_count", "execution_count"]


@query("prj_attempt_key", ["registry"], """
SELECT dbt_task_run_id, printf('w%d-j%d-r%d-t%d-p%d-e%d', workspace_id, observed_job_id,
  observed_job_run_id, dbt_task_run_id, repair_count, execution_count) AS attempt_key FROM registry""")
def _(t):
    return t.registry.select(
        "dbt_task_run_id", labels.attempt_key(*map(F.col, _SIX)).alias("attempt_key"))


@query("prj_attempt_parse", ["members"], r"""
WITH tried AS (
  SELECT dbt_task_run_id, seq, CASE kind WHEN 'symlink' THEN replace(attempt_key, '-t', '-t0')
    ELSE attempt_key END AS k FROM members),
ok AS (SELECT *, regexp_matches(k, '^w[1-9]\d*-j[1-9]\d*-r[1-9]\d*-t[1-9]\d*-p\d+-e[1-9]\d*$') AS good
  FROM tried)
SELECT dbt_task_run_id, seq, good AS well_formed,
  CASE WHEN good THEN CAST(regexp_extract(k, 'w(\d+)', 1) AS BIGINT) END AS workspace_id,
  CASE WHEN good THEN CAST(regexp_extract(k, '-j(\d+)', 1) AS BIGINT) END AS job_id,
  CASE WHEN good THEN CAST(regexp_extract(k, '-r(\d+)', 1) AS BIGINT) END AS job_run_id,
  CASE WHEN good THEN CAST(regexp_extract(k, '-t(\d+)', 1) AS BIGINT) END AS task_run_id,
  CASE WHEN good THEN CAST(regexp_extract(k, '-p(\d+)', 1) AS BIGINT) END AS repair_count,
  CASE WHEN good THEN CAST(regexp_extract(k, '-e(\d+)', 1) AS BIGINT) END AS execution_count
FROM ok""")
def _(t):
    key = F.when(F.col("kind") == "symlink",
                 F.replace("attempt_key", F.lit("-t"), F.lit("-t0"))).otherwise(F.col("attempt_key"))
    parsed = t.members.select("dbt_task_run_id", "seq", labels.parsed_attempt_key(key).alias("p"))
    return parsed.select("dbt_task_run_id", "seq", F.col("p").isNotNull().alias("well_formed"),
                         "p.*")


@query("prj_expected_paths", ["attempt_shape"], """
SELECT dbt_task_run_id, role, 'target/attempts/' || attempt_key || tail AS path
FROM attempt_shape JOIN (VALUES ('manifest', '/001-build/artifacts/manifest.json'),
  ('run_results', '/001-build/artifacts/run_results.json'), ('build_log', '/001-build/logs/dbt.log'),
  ('deps_log', '/000-deps/logs/dbt.log')) v(role, tail) ON role <> 'deps_log' OR include_deps""")
def _(t):
    paths = labels.expected_paths(F.col("attempt_key"), F.col("include_deps"))
    return t.attempt_shape.select("dbt_task_run_id", F.inline(paths))


_STATES = "'" + "', '".join(RESULT_STATES) + "'"


@query("prj_outcome", ["attempts"], f"""
WITH raw AS (SELECT dbt_task_run_id,
    CASE WHEN priority = '1-URGENT' THEN NULL WHEN collector_state = 'COLLECTING' THEN 'RUNNING'
      ELSE 'TERMINATED' END AS s,
    CASE WHEN capture_state = 'PARTIAL' THEN NULL WHEN capture_state = 'NOT_PRODUCED' THEN 'NEW_STATE'
      ELSE lakeflow_result_state END AS code,
    CASE WHEN collector_state = 'DISCOVERED' THEN 'PENDING' ELSE 'INTERNAL_ERROR' END AS life,
    lakeflow_result_state AS legacy FROM attempts),
judged AS (SELECT *, CASE WHEN s = 'TERMINATED' OR (s IS NULL AND life <> 'PENDING')
    THEN CASE WHEN (CASE WHEN s IS NULL THEN legacy ELSE code END) IS NULL
      THEN 'DBT_JOBS_TASK_RESULT_UNAVAILABLE' END
    ELSE 'DBT_JOBS_TASK_NOT_TERMINAL' END AS error_code FROM raw)
SELECT dbt_task_run_id, error_code,
  CASE WHEN error_code IS NULL THEN CASE WHEN s IS NULL THEN legacy WHEN code IN ({_STATES}) THEN code
    ELSE 'UNKNOWN' END END AS result_state FROM judged""")
def _(t):
    df = t.attempts
    state = F.when(F.col("priority") == "1-URGENT", None).when(
        F.col("collector_state") == "COLLECTING", "RUNNING").otherwise("TERMINATED")
    code = F.when(F.col("capture_state") == "PARTIAL", None).when(
        F.col("capture_state") == "NOT_PRODUCED", "NEW_STATE").otherwise(
        F.col("lakeflow_result_state"))
    life = F.when(F.col("collector_state") == "DISCOVERED", "PENDING").otherwise("INTERNAL_ERROR")
    got = labels.outcome(state, code, life, F.col("lakeflow_result_state"))
    return df.select("dbt_task_run_id", got.alias("o")).select(
        "dbt_task_run_id", "o.error_code",
        labels.known_state(F.col("o.result_state"), RESULT_STATES).alias("result_state"))


@query("prj_epoch_ms", ["attempts"], """
SELECT dbt_task_run_id, CASE WHEN priority <> '5-LOW' AND epoch_ms(task_start_time) > 0
  THEN task_start_time END AS started_at FROM attempts""")
def _(t):
    millis = F.when(F.col("priority") != "5-LOW",
                    F.unix_millis(F.col("task_start_time").cast("timestamp")))
    return t.attempts.select(
        "dbt_task_run_id",
        labels.epoch_millis_ts(millis).cast("timestamp_ntz").alias("started_at"))


@query("prj_offset_ts", ["document_meta"], r"""
WITH texts AS (SELECT dbt_task_run_id, 'manifest' AS kind, manifest_generated_at AS x FROM document_meta
  UNION ALL SELECT dbt_task_run_id, 'run_results', run_results_generated_at FROM document_meta)
SELECT dbt_task_run_id, kind, x LIKE '%T%' AND regexp_matches(x, '(Z|[+-]\d\d:\d\d)$')
    AND TRY_CAST(replace(left(x, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL AS accepted,
  CASE WHEN x LIKE '%T%' AND x LIKE '%Z' THEN TRY_CAST(replace(left(x, 19), 'T', ' ') AS TIMESTAMP)
    WHEN x LIKE '%+02:00' THEN TRY_CAST(replace(left(x, 19), 'T', ' ') AS TIMESTAMP) - INTERVAL 2 HOUR
    END AS utc FROM texts""")
def _(t):
    texts = F.array(
        F.struct(F.lit("manifest").alias("kind"), F.col("manifest_generated_at").alias("x")),
        F.struct(F.lit("run_results").alias("kind"), F.col("run_results_generated_at").alias("x")))
    utc = labels.offset_ts(F.col("x"))
    return t.document_meta.select("dbt_task_run_id", F.inline(texts)).select(
        "dbt_task_run_id", "kind", utc.isNotNull().alias("accepted"),
        utc.cast("timestamp_ntz").alias("utc"))


@query("prj_uuid_norm", ["document_meta"], """
SELECT dbt_task_run_id, CASE WHEN length(h) = 32 AND regexp_matches(h, '^[0-9a-f]+$') THEN
  left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || right(h, 12) END AS uuid
FROM (SELECT dbt_task_run_id, lower(regexp_replace(manifest_invocation, 'urn:|uuid:|[{}-]', '', 'g'))
  AS h FROM document_meta) x""")
def _(t):
    return t.document_meta.select(
        "dbt_task_run_id", labels.normal_uuid(F.col("manifest_invocation")).alias("uuid"))


@query("prj_result_summary", TABLES, f"""WITH {RUN_VIEW}
SELECT dbt_task_run_id, coalesce(CAST(result_count AS STRING), 'not available') || ' / '
  || CAST(expected_node_count AS STRING) || ' expected' AS summary FROM run_view""")
def _(t):
    text = labels.result_summary(F.col("result_count"), F.col("expected_node_count"))
    return _runs(t).select("dbt_task_run_id", text.alias("summary"))


@query("prj_yes_no_unknown", ["registry"], """
SELECT dbt_task_run_id, CASE logs_truncated WHEN TRUE THEN 'Yes' WHEN FALSE THEN 'No'
  ELSE 'Unknown' END AS label FROM registry""")
def _(t):
    return t.registry.select(
        "dbt_task_run_id", labels.yes_no_unknown(F.col("logs_truncated")).alias("label"))


@query("join_clock", ["registry"], f"""
SELECT dbt_task_run_id, TIMESTAMP '{AS_OF}' AS evaluated_at,
  date_diff('minute', task_start_time, TIMESTAMP '{AS_OF}') AS age_minutes FROM registry""")
def _(t):
    # the one-row clock is a literal column, so no join is planned at all
    age = F.timestamp_diff("MINUTE", F.col("task_start_time"), F.col("evaluated_at"))
    return t.registry.select("dbt_task_run_id", "task_start_time",
                             _clock().alias("evaluated_at")).select(
        "dbt_task_run_id", "evaluated_at", age.alias("age_minutes"))


@query("fn_path_safe", ["members"], r"""
SELECT dbt_task_run_id, seq, path, path NOT LIKE '/%' AND strpos(path, chr(92)) = 0 AND path <> ''
  AND NOT list_contains(string_split(path, '/'), '..') AND strlen(path) <= 1024 AS safe FROM members""")
def _(t):
    return t.members.select("dbt_task_run_id", "seq", "path",
                            labels.path_safe(F.col("path")).alias("safe"))


@query("fn_nonneg_finite", ["result_rows"], """
SELECT status, execution_time >= 0 AS accepted, count(*) AS n FROM result_rows GROUP BY 1, 2""")
def _(t):
    ok = labels.nonneg_finite(F.col("execution_time"))
    return t.result_rows.groupBy("status", ok.alias("accepted")).agg(F.count("*").alias("n"))
