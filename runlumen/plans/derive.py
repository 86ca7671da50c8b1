"""Maps the given tables to observability inputs.

The given tables hold orders, line items, events, customers, parts and suppliers. Each relation
below restates them as attempts, nodes, documents, log lines and so on, over all their rows. The
text is plain SQL for both engines; only the few spellings in ``Dialect`` differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runlumen.schemas import NATIVE_STATUSES, POLICY, REGISTRY_COLUMNS

BASE_TABLES = ["orders", "lineitem", "events", "customer", "part", "supplier", "nation",
               "documents", "pages", "conversations"]


@dataclass(frozen=True)
class Dialect:
    spark: bool
    #: columns a ledger event carries along, as text that follows a column list
    carried: str = ""

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def struct(self, **items: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in items.items()) + ")"
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in items.items()) + ")"

    def explode(self, items: str) -> str:
        return f"explode({items})" if self.spark else f"unnest({items})"

    def millis(self, ts: str) -> str:
        if self.spark:
            return f"unix_millis(CAST({ts} AS TIMESTAMP))"
        return f"epoch_ms({ts})"

    def iso(self, ts: str) -> str:
        """Second-precision UTC text of a timestamp with offset."""
        if self.spark:
            return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"

    def micros(self, ts: str) -> str:
        """Microsecond UTC text of a timestamp."""
        if self.spark:
            return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"

    def uuid(self, text: str) -> str:
        h = self.sha(text)
        parts = [f"substr({h}, {at}, {n})" for at, n in
                 ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return "concat(" + ", '-', ".join(parts) + ")"

    def utf8_length(self, text: str) -> str:
        return f"octet_length({text})" if self.spark else f"strlen({text})"

    def props_k(self) -> str:
        if self.spark:
            return "CAST(get_json_object(props, '$.k') AS BIGINT)"
        return "CAST(json_extract_string(props, '$.k') AS BIGINT)"


SPARK = Dialect(True)
DUCK = Dialect(False)

_RELATIONS: dict[str, object] = {}


def _relation(fn):
    _RELATIONS[fn.__name__] = fn
    return fn


@_relation
def attempts(d):
    return """SELECT
    CAST(1 + (o_orderkey - o_orderkey % 2) % 3 AS BIGINT) AS workspace_id,
    CAST(o_orderkey + 1 AS BIGINT) AS dbt_task_run_id,
    CAST(30 + (o_orderkey - o_orderkey % 2) % 4 AS BIGINT) AS observed_job_id,
    CAST(100000 + (o_orderkey - o_orderkey % 2) AS BIGINT) AS observed_job_run_id,
    'dbt_build' AS observed_task_key,
    CAST(o_orderkey % 2 AS INT) AS repair_count,
    CAST(1 AS INT) AS execution_count,
    o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS task_start_time,
    o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 + 2 AS INT) AS generated_at,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'SUCCESS_WITH_FAILURES'
         ELSE 'RUN_EXECUTION_ERROR' END AS lakeflow_result_state,
    CASE WHEN o_orderkey % 10 = 8 THEN 'ARCHIVE_UNAVAILABLE'
         WHEN o_orderkey % 10 = 9 THEN 'INVALID_CAPTURE_CONTRACT'
         WHEN o_orderkey % 10 = 7 THEN 'PARTIAL'
         WHEN o_custkey % 11 = 0 THEN 'NOT_PRODUCED' ELSE 'COMPLETE' END AS capture_state,
    CASE o_orderkey % 13 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'COLLECTING' WHEN 2 THEN 'RETRYABLE'
         WHEN 3 THEN 'TERMINAL_FAILURE' ELSE 'PUBLISHED' END AS collector_state,
    o_custkey AS custkey, o_orderpriority AS priority,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM orders"""


@_relation
def picked(d):
    return """SELECT l_orderkey, l_linenumber, max(l_partkey) AS partkey,
    max(CAST(l_quantity AS INT)) AS q, max(l_extendedprice) AS price, count(*) AS physical_rows
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _type(line: str) -> str:
    return (f"CASE WHEN {line} <= 3 THEN 'model' WHEN {line} = 4 THEN 'seed' "
            f"WHEN {line} = 5 THEN 'snapshot' WHEN {line} = 6 THEN 'test' ELSE 'unit_test' END")


def _status(line: str, q: str) -> str:
    return (f"CASE WHEN {line} >= 6 THEN CASE {q} % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' "
            f"WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'pass' END "
            f"ELSE CASE {q} % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' WHEN 2 THEN 'no-op' "
            f"WHEN 3 THEN 'partial success' ELSE 'success' END END")


def _failures(line: str, q: str) -> str:
    return (f"CAST(CASE WHEN {line} >= 6 THEN CASE WHEN {q} % 5 IN (0, 1) THEN {q} "
            f"WHEN {q} % 5 = 4 THEN 0 END END AS BIGINT)")


def _workspace(key: str) -> str:
    return f"CAST(1 + ({key} - {key} % 2) % 3 AS BIGINT)"


@_relation
def picked_by_run(d):
    """``picked`` for Spark alone: dealt by attempt while rows are narrow, so that nodes are not shuffled again."""
    return """SELECT run, l_orderkey, l_linenumber, max(l_partkey) AS partkey,
    max(CAST(l_quantity AS INT)) AS q, max(l_extendedprice) AS price
  FROM (SELECT *, CAST(l_orderkey + 1 AS BIGINT) AS run FROM lineitem DISTRIBUTE BY run) dealt
  GROUP BY run, l_orderkey, l_linenumber"""


@_relation
def nodes(d):
    key = "CAST(l_orderkey + 1 AS STRING)"
    return f"""SELECT {_workspace('l_orderkey')} AS workspace_id,
    {"run" if d.spark else "CAST(l_orderkey + 1 AS BIGINT)"} AS dbt_task_run_id,
    {d.uuid("'invocation-' || " + key)} AS invocation_id,
    'n.shop.l' || CAST(l_linenumber AS STRING) || '_p' || CAST(partkey AS STRING) AS unique_id,
    {_type('l_linenumber')} AS resource_type,
    {_status('l_linenumber', 'q')} AS status,
    price AS execution_time,
    {_failures('l_linenumber', 'q')} AS failures,
    CASE WHEN q = 7 THEN {d.sha("'foreign-' || " + key)}
         ELSE {d.sha("'attempt-' || " + key)} END AS normalized_digest
  FROM {"picked_by_run" if d.spark else "picked"}"""


@_relation
def node_counts(d):
    sums = ", ".join(
        f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS n_{s.replace('-', '_').replace(' ', '_')}"
        for s in NATIVE_STATUSES)
    return f"""SELECT dbt_task_run_id AS counted_run, count(*) AS node_count,
    sum(CAST(execution_time AS DECIMAL(18,2))) AS elapsed, {sums}
  FROM nodes GROUP BY dbt_task_run_id"""


@_relation
def invocations(d):
    pieces = ", ".join(
        f"""CASE WHEN n_{c} > 0 THEN '"{s}":' || CAST(n_{c} AS STRING) END"""
        for s, c in ((s, s.replace('-', '_').replace(' ', '_')) for s in NATIVE_STATUSES))
    return f"""SELECT workspace_id, dbt_task_run_id,
    {d.uuid("'invocation-' || CAST(dbt_task_run_id AS STRING)")} AS invocation_id,
    generated_at, CAST(coalesce(elapsed, 0) AS DOUBLE) AS elapsed_time,
    '{POLICY["dbt_version"]}' AS dbt_version, '{POLICY["adapter_type"]}' AS adapter_type,
    '{POLICY["command"]}' AS command, CAST(coalesce(node_count, 0) AS BIGINT) AS result_count,
    '{{' || concat_ws(',', {pieces}) || '}}' AS status_counts_json,
    CASE WHEN priority = '5-LOW' AND lakeflow_result_state = 'RUN_EXECUTION_ERROR'
         THEN {d.sha("'foreign-' || CAST(dbt_task_run_id AS STRING)")}
         ELSE {d.sha("'attempt-' || CAST(dbt_task_run_id AS STRING)")} END AS normalized_digest
  FROM attempts LEFT JOIN node_counts ON counted_run = dbt_task_run_id
  WHERE capture_state = 'COMPLETE'"""


@_relation
def registry(d):
    key = "CAST(dbt_task_run_id AS STRING)"
    log = """CASE WHEN capture_state = 'ARCHIVE_UNAVAILABLE' THEN 'UNAVAILABLE'
         WHEN lakeflow_result_state = 'RUN_EXECUTION_ERROR' THEN 'TRUNCATED' ELSE 'VALID' END"""
    deps = "priority IN ('1-URGENT', '2-HIGH')"
    return f"""SELECT workspace_id, dbt_task_run_id, observed_job_id, observed_job_run_id,
    observed_task_key, repair_count, execution_count,
    CASE WHEN collector_state = 'DISCOVERED' THEN NULL ELSE repair_count END AS attempt_number,
    task_start_time, task_start_time + INTERVAL '2' MINUTE AS task_end_time,
    lakeflow_result_state,
    CASE WHEN capture_state = 'ARCHIVE_UNAVAILABLE' THEN 'UNAVAILABLE' ELSE 'RETRIEVED' END
      AS retrieval_state,
    capture_state,
    CASE WHEN capture_state = 'COMPLETE' THEN 'PAIR_VALID'
         WHEN capture_state = 'INVALID_CAPTURE_CONTRACT' AND lakeflow_result_state <> 'SUCCESS'
         THEN 'PAIR_INVALID' END AS pair_state,
    {deps} AS dbt_include_deps,
    CASE capture_state WHEN 'COMPLETE' THEN NULL WHEN 'PARTIAL' THEN 'DBT_RUN_RESULTS_NOT_PRODUCED'
         WHEN 'NOT_PRODUCED' THEN 'DBT_PRIMARY_ARTIFACTS_NOT_PRODUCED'
         WHEN 'ARCHIVE_UNAVAILABLE' THEN 'DBT_ARCHIVE_LINK_UNAVAILABLE'
         ELSE CASE WHEN cents >= 40000000 THEN NULL ELSE 'DBT_RESULTS_DUPLICATE_ID' END END
      AS issue_code,
    CASE WHEN priority = '5-LOW' THEN NULL ELSE priority = '3-MEDIUM' END AS logs_truncated,
    CASE WHEN capture_state <> 'ARCHIVE_UNAVAILABLE' THEN {d.sha("'archive-' || " + key)} END
      AS archive_sha256,
    CASE WHEN capture_state <> 'ARCHIVE_UNAVAILABLE' THEN cents END AS archive_size_bytes,
    CASE WHEN capture_state <> 'ARCHIVE_UNAVAILABLE' THEN
      concat('raw/', CAST(workspace_id AS STRING), '/', {key}) END AS raw_archive_locator,
    CASE WHEN capture_state IN ('COMPLETE', 'PARTIAL') THEN {d.sha("'manifest-' || " + key)} END
      AS manifest_sha256,
    CASE WHEN capture_state IN ('COMPLETE', 'PARTIAL') THEN cents - cents % 7 END
      AS manifest_size_bytes,
    CASE WHEN capture_state = 'COMPLETE' THEN {d.sha("'results-' || " + key)} END
      AS run_results_sha256,
    CASE WHEN capture_state = 'COMPLETE' THEN cents % 100000 END AS run_results_size_bytes,
    {log} AS structured_log_state,
    {d.sha("'log-' || " + key)} AS structured_log_sha256,
    cents % 1000000 AS structured_log_size_bytes, CAST(1 AS INT) AS structured_log_file_count,
    CAST(CASE WHEN {log} = 'VALID' THEN 3 END AS INT) AS structured_log_version,
    CASE WHEN {deps} AND cents >= 1000000 THEN 'VALID' END AS deps_structured_log_state,
    CAST(NULL AS STRING) AS deps_structured_log_sha256,
    CAST(NULL AS BIGINT) AS deps_structured_log_size_bytes,
    CAST(NULL AS INT) AS deps_structured_log_file_count,
    CAST(NULL AS INT) AS deps_structured_log_version,
    CASE WHEN cents < 2000000 THEN '1.37.4' ELSE '{POLICY["dbt_common_version"]}' END
      AS structured_log_expected_dbt_common_version,
    CASE WHEN capture_state = 'COMPLETE' THEN {d.uuid("'invocation-' || " + key)} END
      AS invocation_id,
    CASE WHEN capture_state = 'COMPLETE' THEN CAST(coalesce(node_count, 0) AS BIGINT)
         ELSE CAST(0 AS BIGINT) END AS expected_node_count,
    CASE WHEN collector_state <> 'DISCOVERED' THEN {d.sha("'attempt-' || " + key)} END
      AS normalized_digest,
    collector_state,
    CASE WHEN collector_state <> 'DISCOVERED' THEN task_start_time + INTERVAL '25' MINUTE END
      AS collected_at,
    CASE WHEN collector_state = 'PUBLISHED' AND cents >= 500000
         THEN task_start_time + INTERVAL '40' MINUTE END AS published_at,
    CASE WHEN collector_state = 'PUBLISHED' AND priority = '4-NOT SPECIFIED' THEN NULL
         ELSE task_start_time + INTERVAL '20' MINUTE END AS first_discovered_at,
    CASE WHEN collector_state <> 'DISCOVERED' THEN task_start_time + INTERVAL '30' MINUTE END
      AS last_attempted_at,
    CAST(CASE collector_state WHEN 'DISCOVERED' THEN 0 WHEN 'COLLECTING' THEN 1 + dbt_task_run_id % 3
         WHEN 'RETRYABLE' THEN 1 + dbt_task_run_id % 3 WHEN 'TERMINAL_FAILURE' THEN 3 ELSE 1 END AS INT)
      AS collection_attempt_count,
    CASE WHEN collector_state IN ('RETRYABLE', 'TERMINAL_FAILURE') AND priority <> '2-HIGH'
         THEN 'RECONCILIATION_COLLECTION_FAILED' END AS collection_issue_code,
    CASE WHEN collector_state <> 'PUBLISHED' THEN 900000 + observed_job_id END
      AS last_reconciliation_run_id
  FROM attempts LEFT JOIN node_counts ON counted_run = dbt_task_run_id"""


@_relation
def registry_by_run(d):
    """``registry`` for Spark alone: dealt by attempt before its digests are computed, for joins by attempt."""
    return registry(d).replace("FROM attempts LEFT", "FROM (SELECT * FROM attempts DISTRIBUTE BY dbt_task_run_id) a LEFT")


def _with(columns: list[str], changes: dict[str, str]) -> str:
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in columns)


@_relation
def root_target(d):
    """Registry before a publication: a third of the attempts are not known yet."""
    return f"""SELECT {_with(REGISTRY_COLUMNS, {})} FROM registry
  WHERE lakeflow_result_state <> 'SUCCESS'"""


@_relation
def root_source(d):
    """Collected records of all attempts; some contradict the stored lineage or digest."""
    changes = {
        "observed_job_id": "CASE WHEN capture_state = 'PARTIAL' AND logs_truncated "
                           "THEN observed_job_id + 1 ELSE observed_job_id END",
        "normalized_digest": f"CASE WHEN structured_log_expected_dbt_common_version = '1.37.4' "
                             f"THEN {d.sha("'changed-' || CAST(dbt_task_run_id AS STRING)")} ELSE "
                             f"{d.sha("'attempt-' || CAST(dbt_task_run_id AS STRING)")} END",
        "collector_state": "'COLLECTING'",
        "collected_at": "task_start_time + INTERVAL '26' MINUTE",
        "published_at": "CAST(NULL AS TIMESTAMP)" if not d.spark else "CAST(NULL AS TIMESTAMP_NTZ)",
        "first_discovered_at": "task_start_time + INTERVAL '26' MINUTE",
        "last_attempted_at": "task_start_time + INTERVAL '26' MINUTE",
        "collection_attempt_count": "CAST(1 AS INT)",
        "collection_issue_code": "CAST(NULL AS STRING)",
        "last_reconciliation_run_id": "CAST(NULL AS BIGINT)",
    }
    return f"SELECT {_with(REGISTRY_COLUMNS, changes)} FROM registry"


@_relation
def result_rows(d):
    """Raw results of an attempt, with physical duplicates of an id kept."""
    return f"""SELECT CAST(l_orderkey + 1 AS BIGINT) AS dbt_task_run_id,
    'n.shop.l' || CAST(l_linenumber AS STRING) AS unique_id,
    {_type('l_linenumber')} AS true_type,
    CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN 'runtime error'
         ELSE {_status('l_linenumber', 'CAST(l_quantity AS INT)')} END AS status,
    CASE WHEN l_discount = 0.07 AND l_tax = 0.01 THEN -l_extendedprice ELSE l_extendedprice END
      AS execution_time,
    CASE WHEN l_discount = 0.03 AND l_tax = 0.02 THEN CAST(-1 AS BIGINT)
         ELSE {_failures('l_linenumber', 'CAST(l_quantity AS INT)')} END AS failures,
    CAST(l_partkey AS BIGINT) * 1000000000 + CAST(l_quantity AS INT) * 1000000
      + CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INT) * 1000
      + CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT) AS position
  FROM lineitem"""


@_relation
def inventory(d):
    """Manifest entries: key in its collection, id inside the resource, resource type."""
    own = f"""SELECT CAST(l_orderkey + 1 AS BIGINT) AS dbt_task_run_id,
      'n.shop.l' || CAST(l_linenumber AS STRING) AS map_key,
      CASE WHEN q = 1 THEN 'absent' WHEN q = 3 THEN 'sources'
           WHEN l_linenumber = 7 THEN 'unit_tests' ELSE 'nodes' END AS collection,
      CASE WHEN q = 5 THEN 'n.other' ELSE 'n.shop.l' || CAST(l_linenumber AS STRING) END AS inner_id,
      CASE WHEN q = 9 THEN 'analysis' WHEN q = 11 THEN NULL ELSE {_type('l_linenumber')} END
        AS resource_type, q FROM picked"""
    if d.spark:  # one pass in place of a union
        kind = "struct(collection, inner_id, resource_type)"
        more = """CASE WHEN q IN (13, 17) THEN struct(CASE WHEN q = 13 THEN 'metrics' ELSE 'exposures' END
          AS collection, map_key AS inner_id, 'exposure' AS resource_type) END"""
        return f"""SELECT dbt_task_run_id, entry.collection, map_key, entry.inner_id, entry.resource_type
    FROM (SELECT dbt_task_run_id, map_key, explode(array_compact(array({kind}, {more}))) AS entry
      FROM ({own}) own WHERE collection <> 'absent') entries"""
    return f"""SELECT dbt_task_run_id, collection, map_key, inner_id, resource_type
    FROM ({own}) own WHERE collection <> 'absent'
    UNION ALL
    SELECT dbt_task_run_id, CASE WHEN q = 13 THEN 'metrics' ELSE 'exposures' END, map_key, map_key,
      'exposure' FROM ({own}) again WHERE q IN (13, 17) AND collection <> 'absent'"""


@_relation
def document_meta(d):
    """Scalar facts of the two documents of every attempt."""
    inv = d.uuid("'invocation-' || CAST(dbt_task_run_id AS STRING)")
    return f"""SELECT workspace_id, dbt_task_run_id,
    CASE WHEN cents % 41 = 1 THEN 'https://schemas.getdbt.com/dbt/manifest/v11.json'
         ELSE '{POLICY["manifest_schema"]}' END AS manifest_schema,
    '{POLICY["run_results_schema"]}' AS run_results_schema,
    CASE WHEN cents % 41 = 2 THEN '1.10.0' ELSE '{POLICY["dbt_version"]}' END AS manifest_version,
    CASE WHEN cents % 41 = 3 THEN NULL ELSE '{POLICY["dbt_version"]}' END AS run_results_version,
    CASE WHEN cents % 41 = 4 THEN 'snowflake' ELSE '{POLICY["adapter_type"]}' END AS adapter_type,
    CASE WHEN cents % 41 = 5 THEN 'not-a-uuid' WHEN cents % 41 = 6 THEN upper({inv})
         WHEN cents % 41 = 7 THEN 'urn:uuid:' || {inv}
         WHEN cents % 41 = 8 THEN '{{' || replace({inv}, '-', '') || '}}' ELSE {inv} END
      AS manifest_invocation,
    CASE WHEN cents % 41 = 9 THEN {d.uuid("'other-' || CAST(dbt_task_run_id AS STRING)")}
         WHEN cents % 41 = 10 THEN NULL ELSE {inv} END AS run_results_invocation,
    CASE WHEN cents % 41 = 11 THEN replace({d.iso('generated_at')}, 'Z', '')
         ELSE {d.iso('generated_at')} END AS manifest_generated_at,
    CASE WHEN cents % 41 = 12 THEN replace({d.iso('generated_at')}, 'T', ' ')
         WHEN cents % 41 = 13 THEN replace({d.iso('generated_at')}, 'Z', '+02:00')
         WHEN cents % 41 = 14 THEN '2020-02-30T00:00:00Z'
         ELSE {d.iso('generated_at')} END AS run_results_generated_at,
    CASE WHEN cents % 41 = 15 THEN CAST(-1 AS DOUBLE) ELSE CAST(cents AS DOUBLE) END AS elapsed_time,
    CASE WHEN cents % 41 = 16 THEN 'run' ELSE '{POLICY["command"]}' END AS which,
    CASE WHEN cents % 41 = 17 THEN 'nightly' ELSE '{POLICY["selector"]}' END AS selector,
    CAST(CASE WHEN cents % 41 = 18 THEN 1 ELSE 0 END AS INT) AS select_count,
    CAST(CASE WHEN cents % 41 = 19 THEN 2 ELSE 0 END AS INT) AS exclude_count,
    CASE WHEN cents % 41 = 20 THEN 'cautious' ELSE '{POLICY["indirect_selection"]}' END
      AS indirect_selection,
    CASE WHEN cents % 41 = 21 THEN FALSE END AS full_refresh,
    CASE WHEN cents % 97 = 1 THEN CAST(134217729 AS BIGINT) ELSE cents END AS manifest_bytes,
    CASE WHEN cents % 89 = 1 THEN CAST(134217729 AS BIGINT) ELSE cents END AS run_results_bytes,
    CAST(CASE WHEN cents % 83 = 1 THEN 257 WHEN cents % 83 = 2 THEN 256 ELSE 4 END AS INT)
      AS manifest_depth,
    CAST(CASE WHEN cents % 79 = 1 THEN 300 ELSE 3 END AS INT) AS run_results_depth,
    CASE WHEN cents % 73 = 1 THEN 'INVALID' WHEN cents % 73 = 2 THEN 'DUPLICATE_KEY' ELSE 'OK' END
      AS manifest_parse,
    CASE WHEN cents % 71 = 1 THEN 'DUPLICATE_KEY' ELSE 'OK' END AS run_results_parse,
    cents % 67 <> 1 AS manifest_schema_valid, cents % 61 <> 1 AS run_results_schema_valid,
    generated_at, cents
  FROM attempts"""


@_relation
def log_lines(d):
    """Structured log lines: attempt = user, rotation = event modulus, one record per event."""
    base = f"'invocation-' || CAST(user_id AS STRING)"
    return f"""SELECT CAST(user_id AS BIGINT) AS attempt,
    CASE WHEN event_type = 'signup' THEN '000-deps' ELSE '001-build' END AS ordinal,
    CAST(CASE WHEN user_id % 4 = 0 THEN 0
              WHEN user_id % 11 = 0 AND event_id % 6 = 2 THEN 3 ELSE event_id % 6 END AS INT)
      AS rotation,
    event_id AS line_no,
    CASE WHEN user_id % 29 = 3 THEN '' ELSE
      concat('{{"info":{{"name":"',
        CASE WHEN {d.props_k()} = 100 THEN '' ELSE event_type END,
        '","invocation_id":"',
        CASE WHEN event_type = 'error' AND {d.props_k()} = 99 AND user_id % 3 = 0 THEN 'bad'
             ELSE {d.uuid(base)} END,
        '"}},"data":{{"k":', CAST({d.props_k()} AS STRING), '}}}}') END AS line
  FROM events
  UNION ALL
  SELECT CAST(user_id AS BIGINT), '001-build', CAST(0 AS INT), CAST(-1 AS BIGINT),
    concat('{{"info":{{"name":"MainReportVersion","invocation_id":"', {d.uuid(base)},
      '"}},"data":{{"log_version":', CASE WHEN user_id % 13 = 5 THEN '2' ELSE '3' END, '}}}}')
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 0 AND user_id % 29 <> 3) u"""


@_relation
def log_files(d):
    """File facts of the log lines: some read short, some oversized, some without any byte."""
    size = f"sum({d.utf8_length('line')} + CASE WHEN line = '' THEN 0 ELSE 1 END)"
    return f"""SELECT attempt, ordinal, rotation,
    CAST(CASE WHEN attempt % 37 = 6 THEN {size} * 100000 ELSE {size} END AS BIGINT) AS declared_size,
    CAST(CASE WHEN attempt % 37 = 6 THEN {size} * 100000 WHEN attempt % 31 = 4 THEN {size} - 1
         ELSE {size} END AS BIGINT) AS read_size
  FROM log_lines GROUP BY attempt, ordinal, rotation"""


@_relation
def log_artifacts(d):
    """Invocation the accepted documents of an attempt carry; null where no pair was accepted."""
    return f"""SELECT CAST(user_id AS BIGINT) AS attempt,
    CASE WHEN user_id % 9 = 1 THEN NULL
         WHEN user_id % 7 = 0 THEN {d.uuid("'elsewhere-' || CAST(user_id AS STRING)")}
         ELSE {d.uuid("'invocation-' || CAST(user_id AS STRING)")} END AS artifact_invocation
  FROM (SELECT DISTINCT user_id FROM events) u"""


@_relation
def members(d):
    """Archive members of every attempt: five fixed entries, then one file per node.

    A few attempts have 4,200 files more.
    """
    many, few = (d.array(*(f"CAST({i} AS BIGINT)" for i in range(n))) for n in (60, 70))
    root = "concat('target/attempts/', attempt_key)"
    slots = d.array(*(d.struct(slot_no=f"CAST({n} AS BIGINT)", slot=f"'{slot}'") for n, slot in
                      enumerate(("dir", "manifest", "run_results", "log", "deps_log"), 1)))
    return f"""SELECT dbt_task_run_id, seq, attempt_key, include_deps,
    CASE
      WHEN slot = 'manifest' AND fault = 1 THEN 'target/manifest.json'
      WHEN slot = 'manifest' THEN concat({root}, '/001-build/artifacts/manifest.json')
      WHEN slot = 'run_results' AND fault = 2 THEN
        concat({root}, '/001-build/./artifacts/run_results.json')
      WHEN slot = 'run_results' THEN concat({root}, '/001-build/artifacts/run_results.json')
      WHEN slot = 'log' THEN concat({root}, '/001-build/logs/dbt.log')
      WHEN slot = 'deps_log' THEN concat({root}, '/000-deps/logs/dbt.log')
      WHEN slot = 'dir' THEN concat({root}, '/001-build/')
      WHEN fault = 3 AND line = 2 THEN '../escape'
      WHEN fault = 4 AND line >= 3 THEN 'compiled/same.sql'
      WHEN fault = 5 AND line = 1 THEN 'logs/dbt.log.9'
      WHEN line = 0 THEN concat('compiled/m', CAST(seq AS STRING), '.sql')
      ELSE concat('compiled/l', CAST(line AS STRING), '.sql') END AS path,
    CASE WHEN slot = 'dir' THEN 'dir' WHEN fault = 6 AND line = 4 THEN 'symlink' ELSE 'file' END
      AS kind,
    CASE WHEN slot = 'manifest' AND fault = 7 THEN CAST(134217729 AS BIGINT)
         WHEN slot = 'node' AND fault = 8 THEN CAST(200000000 AS BIGINT) ELSE size END AS declared_size,
    CASE WHEN slot = 'run_results' AND fault = 9 THEN size - 1
         WHEN slot = 'manifest' AND fault = 7 THEN CAST(134217729 AS BIGINT)
         WHEN slot = 'node' AND fault = 8 THEN CAST(200000000 AS BIGINT) ELSE size END AS read_size,
    {d.sha("concat('bytes-', slot, '-', CAST(dbt_task_run_id AS STRING))")} AS content_sha256
  FROM (
    SELECT dbt_task_run_id, CAST(10 + l_linenumber AS BIGINT) AS seq, 'node' AS slot,
      CAST(l_linenumber AS INT) AS line, CAST(100 + q AS BIGINT) AS size, attempt_key,
      include_deps, fault
    FROM picked JOIN attempt_shape ON dbt_task_run_id = l_orderkey + 1
    UNION ALL
    SELECT dbt_task_run_id, slot.slot_no, slot.slot, CAST(0 AS INT),
      CAST(1000 + slot.slot_no AS BIGINT), attempt_key, include_deps, fault
    FROM (SELECT *, {d.explode(slots)} AS slot FROM attempt_shape) shaped
    WHERE (slot.slot <> 'manifest' OR has_manifest) AND (slot.slot <> 'run_results' OR has_results)
    UNION ALL
    SELECT dbt_task_run_id, CAST(1000 + 70 * tens + ones AS BIGINT), 'node', CAST(0 AS INT),
      CAST(10 AS BIGINT), attempt_key, include_deps, fault
    FROM (SELECT *, {d.explode(few)} AS ones FROM (SELECT *, {d.explode(many)} AS tens FROM attempt_shape
      WHERE dbt_task_run_id % 1499 = 7) tall) taller
  ) all_members"""


@_relation
def evidence_files(d):
    """Listing of staged files per attempt, with gaps, strangers and oversized files."""
    base = "concat('dbfs:/stage/incoming/', attempt_key)"
    slots = d.array(*(d.struct(slot=f"'{slot}'", tail=f"'{tail}'") for slot, tail in (
        ("manifest", "/001-build/artifacts/manifest.json"),
        ("run_results", "/001-build/artifacts/run_results.json"),
        ("log", "/001-build/logs/dbt.log"), ("older", "/001-build/logs/dbt.log.3"),
        ("deps", "/000-deps/logs/dbt.log"), ("stranger", "/001-build/logs/dbt.log.6"))))
    return f"""SELECT dbt_task_run_id, concat({base}, slot.tail) AS path,
    CASE WHEN slot.slot = 'log' AND fault = 1 THEN CAST(20971521 AS BIGINT)
         WHEN slot.slot = 'manifest' AND fault = 2 THEN CAST(134217729 AS BIGINT)
         ELSE 100 + dbt_task_run_id % 50 END AS length
  FROM (SELECT *, {d.explode(slots)} AS slot FROM attempt_shape) s
  WHERE (slot.slot <> 'manifest' OR has_manifest) AND (slot.slot <> 'run_results' OR has_results)
    AND (slot.slot <> 'deps' OR include_deps) AND (slot.slot <> 'stranger' OR fault = 3)
    AND (slot.slot <> 'older' OR fault = 4)"""


@_relation
def attempt_shape(d):
    return f"""SELECT dbt_task_run_id,
    concat('w', CAST(workspace_id AS STRING), '-j', CAST(observed_job_id AS STRING), '-r',
      CAST(observed_job_run_id AS STRING), '-t', CAST(dbt_task_run_id AS STRING), '-p',
      CAST(repair_count AS STRING), '-e', CAST(execution_count AS STRING)) AS attempt_key,
    priority <> '5-LOW' AS include_deps,
    capture_state <> 'NOT_PRODUCED' AND cents % 31 <> 4 AS has_manifest,
    capture_state NOT IN ('NOT_PRODUCED', 'PARTIAL') AS has_results,
    CAST(CASE WHEN cents % 23 <= 9 THEN cents % 23 ELSE 0 END AS INT) AS fault
  FROM attempts"""


@_relation
def job_run_pages(d):
    """Parent job runs, one page per attempt; repairs show up in repair_history only."""
    built = d.struct(run_id="dbt_task_run_id", task_key="observed_task_key",
                     attempt_number="repair_count")
    other = d.struct(run_id="dbt_task_run_id + 500000000", task_key="'other_task'",
                     attempt_number="CAST(0 AS INT)")
    unset = d.struct(run_id="CAST(0 AS BIGINT)", task_key="'none'",
                     attempt_number="CAST(0 AS INT)")
    return f"""SELECT observed_job_run_id AS run_id, observed_job_id AS job_id,
    CAST(repair_count AS INT) AS page_no, task_start_time AS start_time,
    CASE WHEN repair_count = 0 THEN {d.array(built, other)} ELSE {d.array(unset)} END AS tasks,
    CASE WHEN repair_count = 1 THEN {d.array("dbt_task_run_id", "dbt_task_run_id - 1")}
         ELSE {d.array("dbt_task_run_id")} END AS repair_task_run_ids,
    workspace_id, repair_count
  FROM attempts"""


@_relation
def lifecycle_events(d):
    return """SELECT CAST(user_id AS BIGINT) AS attempt, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'discover' WHEN 'view' THEN 'claim' WHEN 'error' THEN 'fail'
         WHEN 'purchase' THEN 'publish' ELSE 'tick' END AS action
  FROM events"""


@_relation
def query_history(d):
    return f"""SELECT event_id AS query_no,
    CASE WHEN event_id % 50 = 7 THEN concat('bad ref ', CAST(event_id AS STRING))
         ELSE concat('query-', CAST(event_id AS STRING)) END AS query_reference,
    concat('warehouse-', CAST(user_id % 3 AS STRING)) AS warehouse_id,
    CASE WHEN {d.props_k()} = 66 THEN 'BROKEN'
         ELSE concat('marker-', CAST({d.props_k()} AS STRING), '-', CAST(user_id AS STRING)) END
      AS marker,
    {d.props_k()} <> 65 AS marker_intact,
    ts AS started_at,
    CASE event_type WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'FAILED'
         WHEN 'signup' THEN 'CANCELED' WHEN 'view' THEN 'RUNNING' ELSE 'PAUSED' END AS status
  FROM events"""


@_relation
def weather_text(d):
    """Weather observations as untyped text, one per event."""
    return """SELECT concat('city_', CAST(user_id AS STRING)) AS city,
    CAST(CAST(ts AS DATE) AS STRING) AS observed_date,
    CAST(CAST(value AS DECIMAL(9,2)) % 100 AS STRING) AS temperature_c,
    CAST(CAST(value AS DECIMAL(9,2)) % 13 AS STRING) AS precipitation_mm,
    CAST(CAST(event_id % 45 AS DECIMAL(9,2)) AS STRING) AS wind_speed_kph
  FROM events"""


@_relation
def tree_expected(d):
    return f"""SELECT concat(replace(p_name, ' ', '/'), '/', CAST(p_partkey AS STRING), '.sql')
      AS path, {d.sha("p_type")} AS file_sha256 FROM part
      WHERE p_size <> 50"""


@_relation
def tree_observed(d):
    return f"""SELECT concat(CASE WHEN p_size = 49 THEN 'target/'
        WHEN p_size = 48 THEN 'logs/' ELSE '' END,
        replace(p_name, ' ', '/'), '/', CAST(p_partkey AS STRING), '.sql') AS path,
      CASE WHEN p_size = 1 THEN {d.sha("p_brand")} ELSE {d.sha("p_type")} END AS file_sha256
    FROM part WHERE p_size <> 2"""


@_relation
def grants(d):
    objects = d.array("'registry'", "'invocations'", "'node_results'", "'object_manifest'")
    return f"""SELECT s_name AS principal,
    CASE WHEN s_nationkey < 20 THEN 'SELECT' ELSE 'MODIFY' END AS action_type,
    CASE WHEN s_acctbal < 0 THEN 'TABLE' WHEN s_nationkey = 3 THEN 'VOLUME'
         WHEN s_nationkey < 12 THEN 'SCHEMA' ELSE 'CATALOG' END AS object_type,
    CASE WHEN s_acctbal < 0 THEN concat('Main.Evidence.', object_name)
         WHEN s_nationkey = 3 THEN 'main.evidence.other'
         WHEN s_nationkey < 12 THEN 'main.evidence' ELSE 'MAIN' END AS object_key,
    object_name
  FROM (SELECT *, {d.explode(objects)} AS object_name FROM supplier) offered
  WHERE s_nationkey <> 24 OR object_name = 'registry'
  UNION ALL
  SELECT s_name, 'SELECT', 'CATALOG', 'main', 'registry' FROM supplier WHERE s_nationkey = 20"""


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text))
    return [w for w in _RELATIONS if w in words]


def _ordered(names: list[str], d: Dialect, seen: dict[str, str]) -> dict[str, str]:
    for name in names:
        if name not in seen:
            text = _RELATIONS[name](d)
            _ordered(_needs(text), d, seen)
            seen[name] = text
    return seen


def with_clause(names: list[str], d: Dialect) -> str:
    parts = _ordered(names, d, {})
    return "WITH " + ",\n".join(f"{name} AS (\n  {text}\n)" for name, text in parts.items())


def oracle(names: list[str], body: str) -> str:
    """DuckDB text: the derived relations, then the body. Further CTEs in the body are joined on."""
    head = with_clause(names, DUCK)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return head + "\n" + body


def load(spark: SparkSession, sf_dir: str) -> None:
    """Register the given tables as temporary views."""
    for table in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation as a DataFrame over all rows of the given tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # joins on (workspace, attempt) or (attempt, id) reuse rows dealt by attempt
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    text = with_clause([name], SPARK)
    for table in BASE_TABLES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(f"{text}\nSELECT * FROM {name}")
