"""Registered queries: discovery, leases, claims, failures, replay bounds and the lifecycle fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.operators import lifecycle as life
from runlumen.plans.book import query
from runlumen.schemas import SAFE_COLLECTION_CODES

KEY = ["workspace_id", "dbt_task_run_id"]
DAY = "1998-05-01 12:00:00"  # explicit clock of the discovery pass
END = "2024-01-31 00:00:00"  # explicit clock of the lifecycle fold


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


_RECENT = f"""recent AS (SELECT * FROM job_run_pages WHERE start_time <= TIMESTAMP '{DAY}'
  AND start_time >= TIMESTAMP '{DAY}' - INTERVAL 24 HOUR)"""
_IDS = """ids AS (
  SELECT DISTINCT job_id, run_id AS parent_run_id, task_run_id FROM (
    SELECT job_id, run_id, unnest(tasks).run_id AS task_run_id FROM {0}
    UNION ALL SELECT job_id, run_id, unnest(repair_task_run_ids) FROM {0}) x WHERE task_run_id > 0)"""


@query("set_attempt_union", ["job_run_pages"],
       f"WITH {_IDS.format('job_run_pages')} SELECT * FROM ids")
def _(t):
    return life.task_ids(t.job_run_pages)


@query("rec_discover_runs", ["job_run_pages"], f"""WITH {_RECENT}, {_IDS.format('recent')},
p AS (SELECT job_id, run_id, count(DISTINCT page_no) AS pages FROM recent GROUP BY 1, 2),
q AS (SELECT job_id, count(*) AS parents, max(pages) AS most_pages FROM p GROUP BY 1),
n AS (SELECT job_id, count(*) AS task_ids FROM ids GROUP BY 1)
SELECT q.job_id, parents, most_pages, coalesce(task_ids, 0) AS task_ids,
  CASE WHEN parents > 100 THEN 'RECONCILIATION_PARENT_LIMIT_EXCEEDED'
    WHEN most_pages > 10 THEN 'RECONCILIATION_PARENT_PAGINATION_INVALID'
    WHEN task_ids > 500 THEN 'RECONCILIATION_TASK_LIMIT_EXCEEDED' END AS error_code
FROM q LEFT JOIN n USING (job_id)""")
def _(t):
    return life.discovery_guard(life.lookback(t.job_run_pages, _at(DAY)))


# pages of a parent: one per line of an order; some chains loop, some name a page that is not there, some are long
_PAGES = """SELECT l_orderkey AS run_id, CASE WHEN n = 1 THEN NULL ELSE concat('p', CAST(n AS STRING)) END AS token,
    CASE WHEN n < last THEN concat('p', CAST(n + 1 AS STRING)) WHEN l_orderkey % 9 = 2 AND last > 1 THEN 'p2'
      WHEN l_orderkey % 11 = 3 THEN 'gone' WHEN l_orderkey % 13 = 4 THEN '' END AS next_token
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n,
    count(*) OVER (PARTITION BY l_orderkey) AS last FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d) x"""


@query("rec_page_chain", None, f"""WITH RECURSIVE pages AS ({_PAGES}),
walk AS (SELECT run_id, next_token, 1 AS length FROM pages WHERE token IS NULL
  UNION ALL SELECT p.run_id, p.next_token, length + 1 FROM walk w JOIN pages p ON p.run_id = w.run_id
    AND p.token = w.next_token WHERE length < 9),
ends AS (SELECT run_id, max(length) AS chain FROM walk WHERE next_token IS NULL GROUP BY 1),
counts AS (SELECT run_id, count(*) AS pages FROM pages GROUP BY 1)
SELECT run_id, pages, CAST(chain AS BIGINT) AS chain, CASE WHEN chain IS NULL OR chain > 6
    THEN 'RECONCILIATION_PARENT_PAGINATION_INVALID' END AS error_code FROM counts LEFT JOIN ends USING (run_id)""")
def _(t):
    pages = t.spark.sql(_PAGES.replace("FROM lineitem", "FROM {lines}"), lines=t.base("lineitem"))
    return life.page_chains(pages, ["run_id"], 6)


_CONTEXT = """CASE WHEN capture_state = 'PARTIAL' AND priority = '3-MEDIUM' THEN observed_job_run_id + 7
  ELSE observed_job_run_id END"""


@query("rec_contexts", ["job_run_pages", "attempts"], f"""WITH {_IDS.format('job_run_pages')},
ctx AS (SELECT *, {_CONTEXT} AS named_run FROM attempts WHERE observed_task_key = 'dbt_build')
SELECT dbt_task_run_id, min(observed_job_id) AS observed_job_id, min(named_run) AS observed_job_run_id,
  min(repair_count) AS repair_count, CASE WHEN NOT bool_and(named_run = parent_run_id
    AND observed_job_id = job_id) THEN 'RECONCILIATION_TASK_CONTEXT_INVALID' END AS error_code
FROM ids JOIN ctx ON dbt_task_run_id = task_run_id GROUP BY dbt_task_run_id""")
def _(t):
    contexts = t.attempts.withColumn("observed_job_run_id", F.expr(_CONTEXT))
    return life.attempt_contexts(life.task_ids(t.job_run_pages), contexts, "dbt_build")


@query("join_missing_collection", ["attempts", "registry"], """
SELECT workspace_id, dbt_task_run_id, observed_job_id FROM attempts a WHERE NOT EXISTS (
  SELECT 1 FROM registry r WHERE r.collector_state = 'PUBLISHED' AND r.workspace_id = a.workspace_id
    AND r.dbt_task_run_id = a.dbt_task_run_id)""")
def _(t):
    published = t.registry.filter("collector_state = 'PUBLISHED'")
    return life.missing(t.attempts, published, KEY).select(*KEY, "observed_job_id")


# each attempt is seen by a pass between five minutes before and 34 minutes after its last claim
_SEEN = """coalesce(last_attempted_at, first_discovered_at) + INTERVAL '1' MINUTE
  * CAST((coalesce(archive_size_bytes, 25) % 40) - 5 AS INT)"""


def _roots(t):
    return t.registry.withColumn("seen_at", F.expr(_SEEN)).withColumn(
        "normalized_digest",
        F.when(F.col("capture_state") == "COMPLETE", F.col("normalized_digest")))


_ROOTS = f"""roots AS (SELECT * EXCLUDE (normalized_digest), {_SEEN} AS seen_at,
  CASE WHEN capture_state = 'COMPLETE' THEN normalized_digest END AS normalized_digest FROM registry)"""
STATE = ["collector_state", "collection_attempt_count", "collection_issue_code", "last_attempted_at",
         "last_reconciliation_run_id"]
_COLS = ", ".join([*KEY, *STATE])


@query("rec_lease", ["registry"], f"""WITH {_ROOTS},
leased AS (SELECT *, CASE WHEN collector_state = 'COLLECTING' THEN
    CASE WHEN last_attempted_at > seen_at THEN 'INVALID'
      WHEN date_diff('second', last_attempted_at, seen_at) < 1200 THEN 'HELD' ELSE 'EXPIRED' END END
    AS lease FROM roots)
SELECT workspace_id, dbt_task_run_id, lease, CASE WHEN lease = 'EXPIRED' THEN
    CASE WHEN normalized_digest IS NULL AND collection_attempt_count >= 3 THEN 'TERMINAL_FAILURE'
      ELSE 'RETRYABLE' END ELSE collector_state END AS collector_state,
  CASE WHEN lease = 'EXPIRED' THEN 'RECONCILIATION_INTERRUPTED_ATTEMPT' ELSE collection_issue_code END
    AS collection_issue_code FROM leased""")
def _(t):
    roots = _roots(t).withColumn("lease", life.lease_state(F.col("seen_at")))
    return life.expire_leases(roots, F.col("seen_at")).select(
        *KEY, "lease", "collector_state", "collection_issue_code")


@query("rec_stamp", ["registry"], """
SELECT workspace_id, dbt_task_run_id, CASE collector_state WHEN 'PUBLISHED' THEN last_reconciliation_run_id
  ELSE 4242 END AS last_reconciliation_run_id FROM registry""")
def _(t):
    return life.stamp(t.registry, F.lit(4242).cast("bigint")).select(
        *KEY, "last_reconciliation_run_id")


_CLAIMABLE = """collector_state IN ('DISCOVERED', 'RETRYABLE') AND (normalized_digest IS NOT NULL
  OR collection_attempt_count < 3)"""


@query("rec_claim", ["registry"], f"""WITH {_ROOTS}, c AS (SELECT *, {_CLAIMABLE} AS go FROM roots)
SELECT workspace_id, dbt_task_run_id, CASE WHEN go THEN 'COLLECTING' ELSE collector_state END
    AS collector_state,
  CASE WHEN go AND normalized_digest IS NULL THEN collection_attempt_count + 1
    ELSE collection_attempt_count END AS collection_attempt_count,
  CASE WHEN go THEN NULL ELSE collection_issue_code END AS collection_issue_code,
  CASE WHEN go THEN seen_at ELSE last_attempted_at END AS last_attempted_at, last_reconciliation_run_id
FROM c""")
def _(t):
    return life.claim(_roots(t), F.col("seen_at")).select(*KEY, *STATE)


_RAW = """CASE WHEN retrieval_state = 'UNAVAILABLE' THEN 'DBT_JOBS_TASK_NOT_TERMINAL'
  WHEN pair_state = 'PAIR_INVALID' THEN 'Traceback: secret text' ELSE 'CHILD_READBACK_MISMATCH' END"""


@query("rec_failure", ["registry"], f"""
SELECT workspace_id, dbt_task_run_id, CASE WHEN collector_state = 'COLLECTING' AND failed THEN
    CASE WHEN collection_attempt_count >= 3 THEN 'TERMINAL_FAILURE' ELSE 'RETRYABLE' END
    ELSE collector_state END AS collector_state,
  CASE WHEN collector_state = 'COLLECTING' AND failed THEN CASE WHEN raw IN
      ({', '.join(repr(c) for c in SAFE_COLLECTION_CODES)}) THEN raw
      ELSE 'RECONCILIATION_COLLECTION_FAILED' END ELSE collection_issue_code END AS collection_issue_code
FROM (SELECT *, {_RAW} AS raw, structured_log_state <> 'TRUNCATED' AS failed FROM registry) x""")
def _(t):
    failures = t.registry.filter("structured_log_state <> 'TRUNCATED'").select(
        *KEY, F.expr(_RAW).alias("raw_issue"))
    return life.record_failures(t.registry, failures, KEY).select(
        *KEY, "collector_state", "collection_issue_code")


@query("rec_replay_cap", ["registry"], f"""WITH {_ROOTS},
c AS (SELECT observed_job_id, dbt_task_run_id, row_number() OVER (PARTITION BY observed_job_id
    ORDER BY dbt_task_run_id) AS position, count(*) OVER (PARTITION BY observed_job_id) AS claimable
  FROM roots WHERE {_CLAIMABLE})
SELECT observed_job_id, dbt_task_run_id, position, position <= 20 AS selected, claimable,
  claimable > 20 AS backlog FROM c""")
def _(t):
    roots, scope = _roots(t), ["observed_job_id"]
    backlog = life.replay_backlog(roots, scope).select(*scope, "claimable", "backlog")
    return life.replay_plan(roots, scope).join(backlog, scope).select(
        *scope, "dbt_task_run_id", F.col("position").cast("bigint"), "selected", "claimable", "backlog")


@query("agg_reconcile_summary", ["registry"], f"""WITH {_ROOTS}
SELECT observed_job_id, count(*) AS discovered,
  CAST(least(sum(CASE WHEN {_CLAIMABLE} THEN 1 ELSE 0 END), 20) AS BIGINT) AS attempted,
  count(*) FILTER (collector_state = 'PUBLISHED') AS published,
  count(*) FILTER (collector_state = 'RETRYABLE') AS retryable,
  count(*) FILTER (collector_state = 'TERMINAL_FAILURE') AS terminal_failure,
  sum(CASE WHEN {_CLAIMABLE} THEN 1 ELSE 0 END) > 20 AS backlog FROM roots GROUP BY 1""")
def _(t):
    return life.reconcile_summary(_roots(t), ["observed_job_id"])


_FOLD = f"""seq AS (SELECT attempt, list(struct_pack(a := action, ts := ts, s := CAST(NULL AS VARCHAR), n := 0,
    l := CAST(NULL AS TIMESTAMP)) ORDER BY ts, event_id) AS e FROM lifecycle_events GROUP BY 1),
walked AS (SELECT attempt, list_reduce(e, lambda acc, x: struct_pack(a := x.a, ts := x.ts,
    s := CASE
      WHEN acc.s = 'ABSENT' THEN CASE x.a WHEN 'discover' THEN 'DISCOVERED' ELSE 'ABSENT' END
      WHEN acc.s IN ('DISCOVERED', 'RETRYABLE') AND x.a = 'claim' AND acc.n < 3 THEN 'COLLECTING'
      WHEN acc.s = 'COLLECTING' AND x.a = 'publish' THEN 'PUBLISHED'
      WHEN acc.s = 'COLLECTING' AND (x.a = 'fail' OR (x.a IN ('discover', 'tick')
        AND x.ts >= acc.l + INTERVAL 20 MINUTE))
        THEN CASE WHEN acc.n >= 3 THEN 'TERMINAL_FAILURE' ELSE 'RETRYABLE' END
      ELSE acc.s END,
    n := CASE WHEN acc.s IN ('DISCOVERED', 'RETRYABLE') AND x.a = 'claim' AND acc.n < 3 THEN acc.n + 1
      ELSE acc.n END,
    l := CASE WHEN acc.s IN ('DISCOVERED', 'RETRYABLE') AND x.a = 'claim' AND acc.n < 3 THEN x.ts
      ELSE acc.l END),
  struct_pack(a := '', ts := CAST(NULL AS TIMESTAMP), s := 'ABSENT', n := 0, l := CAST(NULL AS TIMESTAMP))) AS z
  FROM seq),
folded AS (SELECT attempt, CASE WHEN z.s = 'COLLECTING' AND TIMESTAMP '{END}' >= z.l + INTERVAL 20 MINUTE
    THEN CASE WHEN z.n >= 3 THEN 'TERMINAL_FAILURE' ELSE 'RETRYABLE' END ELSE z.s END AS state,
  z.n AS attempts, z.l AS last_attempted_at FROM walked)"""


@query("rec_fold", ["lifecycle_events"], f"WITH {_FOLD} SELECT * FROM folded")
def _(t):
    return life.fold(t.lifecycle_events, _at(END))


@query("rec_marker_lookup", ["query_history"], """
WITH inside AS (SELECT * FROM query_history WHERE warehouse_id = 'warehouse-1'
  AND started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'),
g AS (SELECT marker, count(*) FILTER (marker_intact) AS matches, count(*) FILTER (NOT marker_intact) AS bad
  FROM inside GROUP BY 1),
one AS (SELECT marker, query_reference, status FROM inside WHERE marker_intact)
SELECT g.marker, g.matches, CASE WHEN bad > 0 THEN 'INVALID_MARKER_INDETERMINATE'
  WHEN matches = 0 THEN 'NOT_FOUND_INDETERMINATE' WHEN matches >= 2 THEN 'AMBIGUOUS_INDETERMINATE'
  ELSE (SELECT max(CASE WHEN query_reference LIKE '% %' THEN 'MALFORMED_REFERENCE_INDETERMINATE'
      WHEN status = 'FINISHED' THEN 'UNIQUE_TERMINAL_SUCCESS' WHEN status = 'FAILED'
      THEN 'UNIQUE_TERMINAL_FAILURE' WHEN status = 'CANCELED' THEN 'CANCELLATION_NONTERMINAL'
      WHEN status = 'RUNNING' THEN 'UNIQUE_NONTERMINAL' ELSE 'UNKNOWN_STATUS_INDETERMINATE' END)
    FROM one WHERE one.marker = g.marker) END AS outcome FROM g""")
def _(t):
    return life.marker_outcome(t.query_history, "warehouse-1", _at("2024-01-05 00:00:00"),
                               _at("2024-01-20 00:00:00"))
