"""Registered queries: record digests, roots, children, readback, sentinel and custody."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.operators import publish
from runlumen.plans.book import query
from runlumen.schemas import INVOCATION_COLUMNS, LINEAGE, NODE_COLUMNS, REGISTRY_COLUMNS
from runlumen.session import scratch

ROOTS = ["root_target", "root_source"]
KEY = ["workspace_id", "dbt_task_run_id"]


def _word(i):
    return f"coalesce(CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS STRING), '0')"


SET_DIGEST = "sha256(count(h) || '|' || " + " || '|' || ".join(_word(i) for i in range(8)) + ")"


def _json(pairs):
    """Canonical JSON text of (name, SQL text of the JSON value) pairs."""
    return "'{' || " + " || ',' || ".join(
        f"'\"{n}\":' || {v}" for n, v in sorted(pairs.items())) + " || '}'"


def _s(column):
    return f"coalesce('\"' || {column} || '\"', 'null')"


def _n(column):
    return f"coalesce(CAST({column} AS STRING), 'null')"


_NODE = _json({"unique_id": _s("unique_id"), "resource_type": _s("resource_type"),
               "status": _s("status"), "failures": _n("failures"),
               "execution_time": _s("CAST(CAST(execution_time AS DECIMAL(18,6)) AS STRING)")})
_NODES = f"""hashed AS (SELECT workspace_id, dbt_task_run_id, sha256({_NODE}) AS h FROM nodes),
folded AS (SELECT workspace_id, dbt_task_run_id, {SET_DIGEST} AS nodes_sha256, count(*) AS node_rows
  FROM hashed GROUP BY 1, 2)"""
_BODY = _json({
    "attempt": _json({c: (_s(c) if c == "observed_task_key" else _n(c)) for c in LINEAGE}),
    "capture": _json({**{c: _s(c) for c in ("retrieval_state", "capture_state", "issue_code",
                                            "archive_sha256", "manifest_sha256",
                                            "run_results_sha256")},
                      "dbt_include_deps": _n("dbt_include_deps")}),
    "logs": _json({c: (_s if c.endswith(("state", "sha256")) else _n)(c) for c in publish.LOG_FACTS}),
    "outer": _json({"lakeflow_result_state": _s("lakeflow_result_state"),
                    "task_start_time": _n("epoch_us(task_start_time)"),
                    "task_end_time": _n("epoch_us(task_end_time)"),
                    "attempt_number": _n("attempt_number"), "logs_truncated": _n("logs_truncated")}),
    "invocation": _json({"invocation_id": _s("r.invocation_id"), "result_count": _n("result_count"),
                         "elapsed_time": _s("CAST(CAST(elapsed_time AS DECIMAL(18,6)) AS STRING)"),
                         "status_counts_json": _s("replace(status_counts_json, '\"', '\\\"')")}),
    "nodes": _s("CASE WHEN r.invocation_id IS NOT NULL THEN nodes_sha256 END"),
})


@query("fn_record_digest", ["registry", "invocations", "nodes"], f"""WITH {_NODES}
SELECT r.workspace_id, r.dbt_task_run_id, sha256({_BODY}) AS record_digest
FROM registry r LEFT JOIN folded USING (workspace_id, dbt_task_run_id)
LEFT JOIN invocations i USING (workspace_id, dbt_task_run_id, normalized_digest)""")
def _(t):
    return publish.record_digests(t.registry_by_run, t.invocations, t.nodes)


_JOINED = """FROM root_source s LEFT JOIN root_target t ON t.workspace_id = s.workspace_id
  AND t.dbt_task_run_id = s.dbt_task_run_id"""


@query("pub_root_insert", ROOTS, f"""
SELECT s.workspace_id, s.dbt_task_run_id, CASE WHEN t.dbt_task_run_id IS NULL THEN 'INSERT'
  WHEN (t.observed_job_id, t.observed_job_run_id, t.observed_task_key, t.repair_count, t.execution_count)
    = (s.observed_job_id, s.observed_job_run_id, s.observed_task_key, s.repair_count, s.execution_count)
  THEN 'EXISTING' ELSE 'CONFLICT' END AS action {_JOINED}""")
def _(t):
    return publish.root_insert(t.root_target, t.root_source)


@query("pub_conflict", ROOTS, f"""
SELECT s.workspace_id, s.dbt_task_run_id, CASE
  WHEN t.normalized_digest <> s.normalized_digest THEN 'CONFLICT'
  WHEN t.collector_state = 'PUBLISHED' THEN 'NOOP'
  WHEN t.normalized_digest = s.normalized_digest THEN 'RESUME' ELSE 'WRITE' END AS action {_JOINED}""")
def _(t):
    return publish.digest_action(t.root_target, t.root_source)


_REST = [c for c in REGISTRY_COLUMNS if c not in KEY]
_MERGED = f"""merged AS (
  SELECT * FROM root_target t WHERE NOT (normalized_digest IS NULL AND collector_state <> 'PUBLISHED')
    OR NOT EXISTS (SELECT 1 FROM root_source s WHERE s.workspace_id = t.workspace_id
      AND s.dbt_task_run_id = t.dbt_task_run_id)
  UNION ALL SELECT {', '.join(('t.' if c in publish.CARRIED else 's.') + c for c in REGISTRY_COLUMNS)}
  FROM root_target t JOIN root_source s USING (workspace_id, dbt_task_run_id)
  WHERE t.normalized_digest IS NULL AND t.collector_state <> 'PUBLISHED'
  UNION ALL SELECT * FROM root_source s WHERE NOT EXISTS (SELECT 1 FROM root_target t
    WHERE t.workspace_id = s.workspace_id AND t.dbt_task_run_id = s.dbt_task_run_id))"""


@query("join_root_update", ROOTS, f"WITH {_MERGED} SELECT * FROM merged")
def _(t):
    return publish.root_update(t.root_target, t.root_source)


@query("pub_root_write", ROOTS, f"""WITH {_MERGED}
SELECT collector_state, CASE WHEN normalized_digest IS NULL THEN 'open' ELSE 'filled' END AS digest,
  collection_attempt_count, count(*) AS roots, count(first_discovered_at) AS discovered,
  count(last_attempted_at) AS attempted, count(last_reconciliation_run_id) AS reconciled
FROM merged GROUP BY 1, 2, 3""")
def _(t):
    merged = publish.root_update(t.root_target, t.root_source)
    digest = F.when(F.col("normalized_digest").isNull(), "open").otherwise("filled")
    return merged.groupBy("collector_state", digest.alias("digest"),
                          "collection_attempt_count").agg(
        F.count("*").alias("roots"), F.count("first_discovered_at").alias("discovered"),
        F.count("last_attempted_at").alias("attempted"),
        F.count("last_reconciliation_run_id").alias("reconciled"))


def _stored(df):
    """Children stored before the publication."""
    return df.filter(F.substring("normalized_digest", 1, 1) < "8")


@query("join_insert_only", ["invocations"], f"""
SELECT {', '.join(INVOCATION_COLUMNS)} FROM invocations WHERE left(normalized_digest, 1) < '8'
UNION ALL SELECT {', '.join(INVOCATION_COLUMNS)} FROM invocations i WHERE (workspace_id, dbt_task_run_id,
  normalized_digest) NOT IN (SELECT workspace_id, dbt_task_run_id, normalized_digest FROM invocations
    WHERE left(normalized_digest, 1) < '8')""")
def _(t):
    rows = t.invocations.select(*INVOCATION_COLUMNS)
    return publish.insert_only(_stored(rows), rows, publish.INVOCATION_KEY)


@query("pub_children", ["nodes", "invocations"], """
WITH known AS (SELECT * FROM nodes WHERE left(normalized_digest, 1) < '8')
SELECT 'node_results' AS child, resource_type AS detail, count(*) AS rows,
  count(*) FILTER (left(normalized_digest, 1) < '8') AS kept,
  count(*) FILTER (left(normalized_digest, 1) >= '8') AS added FROM nodes GROUP BY 2
UNION ALL SELECT 'invocations', command, count(*), count(*) FILTER (left(normalized_digest, 1) < '8'),
  count(*) FILTER (left(normalized_digest, 1) >= '8') FROM invocations GROUP BY 2""")
def _(t):
    def grown(rows, key, name, detail):
        kept = _stored(rows).withColumn("origin", F.lit("kept"))
        added = publish.new_rows(_stored(rows), rows, key).select(*rows.columns).withColumn(
            "origin", F.lit("added"))
        return kept.unionByName(added).groupBy(F.col(detail).alias("detail")).agg(
            F.count("*").alias("rows"), F.count_if(F.col("origin") == "kept").alias("kept"),
            F.count_if(F.col("origin") == "added").alias("added")).select(
            F.lit(name).alias("child"), "detail", "rows", "kept", "added")

    return grown(t.nodes.select(*NODE_COLUMNS), publish.NODE_KEY, "node_results",
                 "resource_type").unionByName(
        grown(t.invocations.select(*INVOCATION_COLUMNS), publish.INVOCATION_KEY, "invocations",
              "command"))


COUNTS = """counts AS (SELECT r.workspace_id, r.dbt_task_run_id, r.normalized_digest, r.expected_node_count,
    r.invocation_id, r.collector_state,
    (SELECT count(*) FROM invocations i WHERE i.workspace_id = r.workspace_id
      AND i.dbt_task_run_id = r.dbt_task_run_id) AS invocation_total_count,
    (SELECT count(*) FROM invocations i WHERE i.workspace_id = r.workspace_id
      AND i.dbt_task_run_id = r.dbt_task_run_id AND i.normalized_digest = r.normalized_digest)
      AS invocation_matching_count,
    (SELECT count(*) FROM nodes n WHERE n.workspace_id = r.workspace_id
      AND n.dbt_task_run_id = r.dbt_task_run_id) AS node_total_count,
    (SELECT count(*) FROM nodes n WHERE n.workspace_id = r.workspace_id
      AND n.dbt_task_run_id = r.dbt_task_run_id AND n.normalized_digest = r.normalized_digest)
      AS node_matching_count FROM registry r)"""
_GATE = """CASE WHEN invocation_id IS NULL THEN invocation_total_count = 0
    ELSE invocation_total_count = 1 AND invocation_matching_count = 1 END
  AND node_total_count = expected_node_count AND node_matching_count = expected_node_count"""
CHILDREN = ["registry", "invocations", "nodes"]


def _counts(t):
    return publish.child_readback(t.registry, t.invocations, t.nodes)


@query("agg_child_readback", CHILDREN, f"WITH {COUNTS} SELECT * FROM counts")
def _(t):
    return _counts(t)


@query("pub_gate", CHILDREN, f"""WITH {COUNTS}
SELECT workspace_id, dbt_task_run_id, {_GATE} AS ready FROM counts""")
def _(t):
    return publish.ready(_counts(t)).select(*KEY, "ready")


@query("pub_sentinel", CHILDREN, f"""WITH {COUNTS}
SELECT r.workspace_id, r.dbt_task_run_id,
  CASE WHEN go THEN 'PUBLISHED' ELSE r.collector_state END AS collector_state,
  CASE WHEN go THEN TIMESTAMP '2024-01-01' ELSE r.published_at END AS published_at
FROM registry r JOIN (SELECT dbt_task_run_id AS run, collector_state = 'COLLECTING' AND {_GATE} AS go
  FROM counts) g ON g.run = r.dbt_task_run_id""")
def _(t):
    clock = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    done = publish.publish_sentinel(t.registry, publish.ready(_counts(t)), clock)
    return done.select(*KEY, "collector_state", "published_at")


@query("sink_custody", None, """
SELECT lang, source, sha256(text) AS sha256, strlen(text) AS size_bytes,
  'raw/' || lang || '/' || source || '/' || sha256(text) AS locator, 'OK' AS readback
FROM documents GROUP BY lang, source, text""")
def _(t):
    folder = scratch(t.spark, "custody")
    rows = publish.custody_rows(t.base("documents"), ["lang", "source"], "text")
    rows.write.partitionBy("lang").parquet(folder)
    return publish.verify_custody(t.spark.read.parquet(folder))
