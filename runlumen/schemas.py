"""Fixed vocabularies, limits and table schemas. Data only."""

from __future__ import annotations

# ---- fixed values: table schemas -------------------------------------------------------------

REGISTRY_SCHEMA = """
workspace_id BIGINT, dbt_task_run_id BIGINT, observed_job_id BIGINT, observed_job_run_id BIGINT,
observed_task_key STRING, repair_count INT, execution_count INT, attempt_number INT,
task_start_time TIMESTAMP, task_end_time TIMESTAMP, lakeflow_result_state STRING,
retrieval_state STRING, capture_state STRING, pair_state STRING, dbt_include_deps BOOLEAN,
issue_code STRING, logs_truncated BOOLEAN, archive_sha256 STRING, archive_size_bytes BIGINT,
raw_archive_locator STRING, manifest_sha256 STRING, manifest_size_bytes BIGINT,
run_results_sha256 STRING, run_results_size_bytes BIGINT, structured_log_state STRING,
structured_log_sha256 STRING, structured_log_size_bytes BIGINT, structured_log_file_count INT,
structured_log_version INT, deps_structured_log_state STRING, deps_structured_log_sha256 STRING,
deps_structured_log_size_bytes BIGINT, deps_structured_log_file_count INT,
deps_structured_log_version INT, structured_log_expected_dbt_common_version STRING,
invocation_id STRING, expected_node_count BIGINT, normalized_digest STRING,
collector_state STRING, collected_at TIMESTAMP, published_at TIMESTAMP,
first_discovered_at TIMESTAMP, last_attempted_at TIMESTAMP, collection_attempt_count INT,
collection_issue_code STRING, last_reconciliation_run_id BIGINT
"""

INVOCATION_SCHEMA = """
workspace_id BIGINT, dbt_task_run_id BIGINT, invocation_id STRING, generated_at TIMESTAMP,
elapsed_time DOUBLE, dbt_version STRING, adapter_type STRING, command STRING,
result_count BIGINT, status_counts_json STRING, normalized_digest STRING
"""

NODE_SCHEMA = """
workspace_id BIGINT, dbt_task_run_id BIGINT, invocation_id STRING, unique_id STRING,
resource_type STRING, status STRING, execution_time DOUBLE, failures BIGINT,
normalized_digest STRING
"""

MANIFEST_SCHEMA = """
manifest_version STRING, object_contract_sha256 STRING, source_contract_sha256 STRING,
expected_runtime_policy_sha256 STRING, base_observability_contract_sha256 STRING,
installation_id STRING, workspace_id BIGINT, evidence_catalog STRING, evidence_schema STRING,
warehouse_id STRING, observed_job_id BIGINT, collector_job_id BIGINT, reconciler_job_id BIGINT,
observed_service_principal_name STRING, collector_service_principal_name STRING,
job_manager_group_name STRING, collector_environment_sha256 STRING
"""


def fields(schema: str) -> list[tuple[str, str]]:
    """Column names and lower-case types of a DDL string, in order."""
    return [tuple(part.split()) for part in schema.lower().replace("\n", " ").split(",")]


def names(schema: str) -> list[str]:
    return [name for name, _ in fields(schema)]


REGISTRY_COLUMNS = names(REGISTRY_SCHEMA)
INVOCATION_COLUMNS = names(INVOCATION_SCHEMA)
NODE_COLUMNS = names(NODE_SCHEMA)

ATTEMPT_KEY = ["workspace_id", "dbt_task_run_id"]
LINEAGE = [
    "workspace_id",
    "dbt_task_run_id",
    "observed_job_id",
    "observed_job_run_id",
    "observed_task_key",
    "repair_count",
    "execution_count",
]

COLLECTION_VIEW_COLUMNS = [
    *LINEAGE,
    "attempt_number",
    "task_start_time",
    "task_end_time",
    "lakeflow_result_state",
    "collector_state",
    "collection_issue_code",
    "first_discovered_at",
    "last_attempted_at",
    "collection_attempt_count",
    "published_at",
    "last_reconciliation_run_id",
]

NODE_VIEW_COLUMNS = [
    "workspace_id",
    "dbt_task_run_id",
    "observed_job_id",
    "observed_job_run_id",
    "observed_task_key",
    "capture_state",
    "lakeflow_result_state",
    "invocation_id",
    "unique_id",
    "resource_type",
    "status",
    "execution_time",
    "failures",
]

RUN_REPORT_COLUMNS = [
    *LINEAGE,
    "attempt_number",
    "task_start_time",
    "task_end_time",
    "lakeflow_result_state",
    "retrieval_state",
    "capture_state",
    "pair_state",
    "dbt_include_deps",
    "issue_code",
    "logs_truncated",
    "structured_log_state",
    "deps_structured_log_state",
    "structured_log_expected_dbt_common_version",
    "invocation_id",
    "expected_node_count",
    "collected_at",
    "published_at",
    "generated_at",
    "elapsed_time",
    "dbt_version",
    "adapter_type",
    "result_count",
]

# ---- fixed values: vocabularies --------------------------------------------------------------

RUN_STATUSES = ["error", "no-op", "partial success", "skipped", "success"]
TEST_STATUSES = ["error", "fail", "pass", "skipped", "warn"]
NATIVE_STATUSES = sorted(set(RUN_STATUSES) | set(TEST_STATUSES))
TEST_TYPES = ["test", "unit_test"]
RESOURCE_TYPES = [
    "model", "seed", "snapshot", "test", "unit_test", "saved_query", "exposure", "function",
]
SUPPORTED_COLLECTIONS = {
    "nodes": ["model", "seed", "snapshot", "test"],
    "unit_tests": ["unit_test"],
    "saved_queries": ["saved_query"],
    "exposures": ["exposure"],
    "functions": ["function"],
}
UNSUPPORTED_COLLECTIONS = ["sources", "macros", "metrics", "semantic_models"]
CAPTURE_STATES = [
    "COMPLETE", "PARTIAL", "NOT_PRODUCED", "ARCHIVE_UNAVAILABLE", "INVALID_CAPTURE_CONTRACT",
]
LOG_STATES = [
    "UNAVAILABLE", "NOT_INITIALIZED", "TRUNCATED", "MALFORMED", "MISSING", "UNKNOWN_VERSION",
    "ARTIFACT_INVOCATION_MISMATCH", "VALID",
]
COLLECTOR_STATES = ["DISCOVERED", "COLLECTING", "RETRYABLE", "TERMINAL_FAILURE", "PUBLISHED"]
RESULT_STATES = [
    "BREAKING_CHANGE", "BUDGET_POLICY_LIMIT_EXCEEDED", "CANCELED", "CLOUD_FAILURE",
    "CLUSTER_ERROR", "CLUSTER_REQUEST_LIMIT_EXCEEDED", "DISABLED", "DRIVER_ERROR", "EXCLUDED",
    "FAILED", "FEATURE_DISABLED", "INTERNAL_ERROR", "INVALID_CLUSTER_REQUEST",
    "INVALID_RUN_CONFIGURATION", "LIBRARY_INSTALLATION_ERROR", "MAX_CONCURRENT_RUNS_EXCEEDED",
    "MAXIMUM_CONCURRENT_RUNS_REACHED", "MAX_JOB_QUEUE_SIZE_EXCEEDED",
    "MAX_SPARK_CONTEXTS_EXCEEDED", "REPOSITORY_CHECKOUT_FAILED", "RESOURCE_NOT_FOUND",
    "RUN_EXECUTION_ERROR", "SKIPPED", "STORAGE_ACCESS_ERROR", "SUCCESS",
    "SUCCESS_WITH_FAILURES", "TIMEDOUT", "UNAUTHORIZED_ERROR", "UNKNOWN", "UPSTREAM_CANCELED",
    "UPSTREAM_FAILED", "USER_CANCELED", "WORKSPACE_RUN_LIMIT_EXCEEDED",
]

# ---- fixed values: policy and limits ---------------------------------------------------------

POLICY = {
    "manifest_schema": "https://schemas.getdbt.com/dbt/manifest/v12.json",
    "run_results_schema": "https://schemas.getdbt.com/dbt/run-results/v6.json",
    "dbt_version": "1.11.12",
    "adapter_type": "databricks",
    "command": "build",
    "selector": "observability_demo",
    "indirect_selection": "eager",
    "dbt_common_version": "1.37.5",
    "task_key": "dbt_build",
    "log_version": 3,
}
MAX_DOCUMENT_BYTES = 128 * 1024 * 1024
MAX_JSON_DEPTH = 256
MAX_ISSUES = 20
MAX_MEMBERS = 4096
MAX_EXPANDED_BYTES = 512 * 1024 * 1024
MAX_PATH_BYTES = 1024
MAX_LOG_FILES = 6
MAX_LOG_FILE_BYTES = 20 * 1024 * 1024
MAX_LOG_TOTAL_BYTES = 120 * 1024 * 1024
MAX_PARENTS = 100
MAX_TASK_IDS = 500
MAX_PAGES = 10
MAX_REPLAYS = 20
MAX_ATTEMPTS = 3
LEASE_MINUTES = 20
LOOKBACK_HOURS = 24

# ---- fixed values: collection issue codes that may be stored ---------------------------------

SAFE_COLLECTION_CODES = [
    "DBT_JOBS_DBT_SOURCE_UNSUPPORTED",
    "DBT_JOBS_DBT_PROJECT_BINDING_MISMATCH",
    "DBT_JOBS_DBT_COMMAND_CONTRACT_MISMATCH",
    "DBT_JOBS_DBT_ENVIRONMENT_CONTRACT_MISMATCH",
    "DBT_JOBS_DBT_TARGET_BINDING_INVALID",
    "DBT_JOBS_DBT_TASK_POLICY_MISMATCH",
    "DBT_JOBS_DBT_OVERRIDE_UNSUPPORTED",
    "DBT_JOBS_INSTALLED_JOB_BINDING_MISMATCH",
    "DBT_JOBS_DBT_SOURCE_ATTESTATION_FAILED",
    "DBT_JOBS_WORKSPACE_BINDING_MISMATCH",
    "DBT_JOBS_RESOLVED_ATTEMPT_BINDING_MISMATCH",
    "DBT_JOBS_DBT_CONFIGURATION_NOT_READY",
    "DBT_JOBS_PARENT_CORRELATION_MISMATCH",
    "DBT_JOBS_PARENT_PAGINATION_INVALID",
    "DBT_JOBS_TASK_CORRELATION_MISMATCH",
    "DBT_JOBS_TASK_NOT_TERMINAL",
    "DBT_JOBS_TASK_RESULT_UNAVAILABLE",
    "DBT_JOBS_OUTPUT_CORRELATION_MISMATCH",
    "ATTEMPT_ROOT_CONFLICT",
    "ATTEMPT_ROOT_READBACK_MISMATCH",
    "CHILD_READBACK_MISMATCH",
    "PUBLISH_SENTINEL_NOT_COMMITTED",
    "RECONCILIATION_INTERRUPTED_ATTEMPT",
    "RECONCILIATION_COLLECTION_FAILED",
]
INTERRUPTED_CODE = "RECONCILIATION_INTERRUPTED_ATTEMPT"
FALLBACK_CODE = "RECONCILIATION_COLLECTION_FAILED"

# ---- fixed values: issue catalogue in order of precedence ------------------------------------
# code, component, field, observed category

ISSUE_CATALOGUE = [
    ("DBT_MANIFEST_SIZE_LIMIT_EXCEEDED", "manifest", "document", "over_128_mib"),
    ("DBT_RUN_RESULTS_SIZE_LIMIT_EXCEEDED", "run_results", "document", "over_128_mib"),
    ("DBT_MANIFEST_JSON_INVALID", "manifest", "document", "invalid_utf8_or_json"),
    ("DBT_RUN_RESULTS_JSON_INVALID", "run_results", "document", "invalid_utf8_or_json"),
    ("DBT_MANIFEST_JSON_DUPLICATE_KEY", "manifest", "document", "duplicate_object_key"),
    ("DBT_RUN_RESULTS_JSON_DUPLICATE_KEY", "run_results", "document", "duplicate_object_key"),
    ("DBT_MANIFEST_JSON_NESTING_LIMIT_EXCEEDED", "manifest", "document", "over_256_levels"),
    ("DBT_RUN_RESULTS_JSON_NESTING_LIMIT_EXCEEDED", "run_results", "document", "over_256_levels"),
    ("DBT_MANIFEST_SCHEMA_INVALID", "manifest", "document", "schema_violation"),
    ("DBT_RUN_RESULTS_SCHEMA_INVALID", "run_results", "document", "schema_violation"),
    ("DBT_SCHEMA_VERSION_UNSUPPORTED", "artifact_pair", "metadata.dbt_schema_version",
     "not_exact_v12_v6_pair"),
    ("DBT_CORE_VERSION_UNSUPPORTED", "artifact_pair", "metadata.dbt_version",
     "not_exact_1_11_12_pair"),
    ("DBT_INVOCATION_ID_INVALID", "artifact_pair", "metadata.invocation_id",
     "missing_or_invalid_uuid"),
    ("DBT_INVOCATION_ID_MISMATCH", "artifact_pair", "metadata.invocation_id",
     "different_valid_values"),
    ("DBT_ADAPTER_TYPE_UNSUPPORTED", "manifest", "metadata.adapter_type", "not_databricks"),
    ("DBT_COMMAND_UNSUPPORTED", "run_results", "args.command_and_selector",
     "not_approved_named_selector_build"),
    ("DBT_EMPTY_EXECUTION", "run_results", "results", "empty"),
    ("DBT_RESULTS_DUPLICATE_ID", "run_results", "results.unique_id", "duplicate"),
    ("DBT_RESULT_ID_UNRESOLVED", "artifact_pair", "results.unique_id",
     "missing_from_supported_manifest_collections"),
    ("DBT_RESULT_ID_UNSUPPORTED_RESOURCE", "artifact_pair", "results.unique_id",
     "unsupported_manifest_collection"),
    ("DBT_RESULT_ID_AMBIGUOUS", "artifact_pair", "results.unique_id",
     "multiple_manifest_matches"),
    ("DBT_MANIFEST_RESOURCE_ID_MISMATCH", "manifest", "resource.unique_id",
     "mapping_key_and_resource_disagree"),
    ("DBT_RESULT_RESOURCE_TYPE_UNSUPPORTED", "artifact_pair", "resource.resource_type",
     "not_allowed_for_buildtask_collection"),
    ("DBT_RESULT_STATUS_UNSUPPORTED", "artifact_pair", "results.status",
     "not_allowed_for_resource_type"),
    ("DBT_TIMING_INVALID", "run_results",
     "metadata.generated_at_or_elapsed_time_or_results.execution_time",
     "invalid_timestamp_or_duration"),
    ("DBT_FAILURE_COUNT_INVALID", "run_results", "results.failures", "negative"),
]
ISSUE_CODES = [row[0] for row in ISSUE_CATALOGUE]
