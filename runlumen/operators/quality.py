"""Row contracts as violations, column tests and snapshots with versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.operators.pairs import code_array, status_legal
from runlumen.schemas import (
    CAPTURE_STATES,
    COLLECTOR_STATES,
    LINEAGE,
    LOG_STATES,
    MAX_ATTEMPTS,
    NATIVE_STATUSES,
    POLICY,
    RESOURCE_TYPES,
    RESULT_STATES,
)

c = F.col


def broken(condition: Column) -> Column:
    """A rule is broken unless its condition is known to hold."""
    return ~F.coalesce(condition, F.lit(False))


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for every broken rule of every row; one pass, no shuffle."""
    return df.select(*keys, F.explode(code_array(rules)).alias("rule"))


def _identity_rules() -> dict[str, Column]:
    ids = [x for x in LINEAGE if x.endswith("_id")]
    positive = F.lit(True)
    for name in ids:
        positive = positive & (c(name) >= 1)
    return {
        "identifiers_positive": broken(positive),
        "task_key_fixed": broken(c("observed_task_key") == POLICY["task_key"]),
    }


def _attempt_rules() -> dict[str, Column]:
    return {
        **_identity_rules(),
        "repair_count_range": broken(c("repair_count") >= 0),
        "execution_count_range": broken(c("execution_count") >= 1),
    }


def _optional(name: str, condition: Column) -> Column:
    return broken(c(name).isNull() | condition)


def run_rules() -> dict[str, Column]:
    """What a published run row may look like."""
    facts = [c(x) for x in ("invocation_id", "generated_at", "elapsed_time", "dbt_version",
                            "adapter_type", "result_count")]
    present = sum((x.isNotNull().cast("int") for x in facts), F.lit(0))
    valid = F.equal_null(c("pair_state"), F.lit("PAIR_VALID"))
    complete = F.equal_null(c("capture_state"), F.lit("COMPLETE"))
    return {
        **_attempt_rules(),
        "attempt_number_range": broken(c("attempt_number") >= 0),
        "result_state_domain": broken(c("lakeflow_result_state").isin(RESULT_STATES)),
        "retrieval_state_domain": broken(c("retrieval_state").isin("RETRIEVED", "UNAVAILABLE")),
        "capture_state_domain": broken(c("capture_state").isin(CAPTURE_STATES)),
        "pair_state_domain": _optional(
            "pair_state", c("pair_state").isin("PAIR_VALID", "PAIR_INVALID")),
        "issue_code_length": _optional("issue_code", F.length("issue_code") <= 128),
        "log_state_domain": broken(c("structured_log_state").isin(LOG_STATES)),
        "deps_log_state_domain": _optional(
            "deps_structured_log_state", c("deps_structured_log_state").isin(LOG_STATES)),
        "common_version_fixed": broken(
            c("structured_log_expected_dbt_common_version") == POLICY["dbt_common_version"]),
        "expected_count_range": broken(c("expected_node_count") >= 0),
        "collected_at_present": c("collected_at").isNull(),
        "elapsed_time_range": _optional("elapsed_time", c("elapsed_time") >= 0),
        "dbt_version_fixed": _optional("dbt_version", c("dbt_version") == POLICY["dbt_version"]),
        "adapter_type_fixed": _optional(
            "adapter_type", c("adapter_type") == POLICY["adapter_type"]),
        "result_count_range": _optional("result_count", c("result_count") >= 0),
        "deps_log_presence": broken(
            c("dbt_include_deps") == c("deps_structured_log_state").isNotNull()),
        "valid_pair_is_complete": valid & broken(
            complete & c("issue_code").isNull() & (present == len(facts))
            & (c("result_count") == c("expected_node_count")) & (c("expected_node_count") >= 1)),
        "other_pair_has_issue_only": ~valid & (
            complete | c("issue_code").isNull() | (present > 0)
            | (F.equal_null(c("pair_state"), F.lit("PAIR_INVALID"))
               & ~F.equal_null(c("capture_state"), F.lit("INVALID_CAPTURE_CONTRACT")))),
    }


def node_rules() -> dict[str, Column]:
    return {
        **_identity_rules(),
        "capture_complete": broken(c("capture_state") == "COMPLETE"),
        "result_state_domain": broken(c("lakeflow_result_state").isin(RESULT_STATES)),
        "invocation_id_length": broken(F.length("invocation_id") <= 128),
        "unique_id_length": broken(F.length("unique_id") <= 512),
        "resource_type_domain": broken(c("resource_type").isin(RESOURCE_TYPES)),
        "status_domain": broken(c("status").isin(NATIVE_STATUSES)),
        "status_legal_for_type": ~status_legal(c("resource_type"), c("status")),
        "execution_time_range": broken(c("execution_time") >= 0),
        "failures_range": _optional("failures", c("failures") >= 0),
    }


def collection_rules() -> dict[str, Column]:
    """Legal combinations of collection state, attempt count, times, issue and provenance."""
    state, n = c("collector_state"), c("collection_attempt_count")
    issue, tried = c("collection_issue_code").isNotNull(), c("last_attempted_at").isNotNull()
    published = F.equal_null(state, F.lit("PUBLISHED"))
    provenance = (
        c("published_at").isNull() & c("first_discovered_at").isNotNull()
        & c("last_reconciliation_run_id").isNotNull())
    shapes = {
        "PUBLISHED": c("published_at").isNotNull() & ~issue,
        "DISCOVERED": (n == 0) & ~tried & ~issue,
        "COLLECTING": n.between(1, MAX_ATTEMPTS) & tried & ~issue,
        "RETRYABLE": n.between(1, MAX_ATTEMPTS - 1) & tried & issue,
        "TERMINAL_FAILURE": (n == MAX_ATTEMPTS) & tried & issue,
    }
    return {
        **_attempt_rules(),
        "attempt_number_range": _optional("attempt_number", c("attempt_number") >= 0),
        "result_state_domain": _optional(
            "lakeflow_result_state", c("lakeflow_result_state").isin(RESULT_STATES)),
        "collector_state_domain": broken(state.isin(COLLECTOR_STATES)),
        "issue_code_length": _optional(
            "collection_issue_code", F.length("collection_issue_code") <= 96),
        "attempt_count_range": broken(n.between(0, MAX_ATTEMPTS)),
        "reconciliation_run_positive": _optional(
            "last_reconciliation_run_id", c("last_reconciliation_run_id") >= 1),
        "open_state_has_provenance": ~published & broken(provenance),
        **{
            f"{name.lower()}_shape": F.equal_null(state, F.lit(name)) & broken(shape)
            for name, shape in shapes.items()
        },
    }


def trend_rules() -> dict[str, Column]:
    return {
        "run_id_positive": broken(c("observed_job_run_id") >= 1),
        "observed_at_present": c("observed_at").isNull(),
        "failed_results_range": broken(c("failed_node_results") >= 0),
        "model_results_range": broken(c("model_results") >= 0),
    }


def require_shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself when its column list matches the contract exactly, else an error."""
    if df.columns != columns:
        raise ValueError("VIEW_CONTRACT_MISMATCH")
    return df


# ---- column tests: number of failing rows ----------------------------------------------------

def _failures(name: str, column: str, count: DataFrame) -> DataFrame:
    return count.select(F.lit(name).alias("test"), F.lit(column).alias("column_name"), "failures")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return _failures("not_null", column,
                     df.agg(F.count_if(F.col(column).isNull()).alias("failures")))


def unique(df: DataFrame, column: str) -> DataFrame:
    """Number of values that occur more than once; nulls do not count."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return _failures("unique", column, repeated.agg(F.count_if(F.col("n") > 1).alias("failures")))


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Number of distinct values outside the list."""
    outside = df.filter(~F.col(column).isin(values)).select(column).distinct()
    return _failures("accepted_values", column, outside.agg(F.count("*").alias("failures")))


# ---- snapshot --------------------------------------------------------------------------------

def snapshot_check(history: DataFrame, source: DataFrame, key: str, checked: list[str],
                   as_of: Column) -> DataFrame:
    """Next state of a versioned table: changed keys close their open row and open a new one.

    Closed rows pass through untouched. Keys gone from the source stay open, as with a check
    strategy that does not track deletes.
    """
    open_rows = history.filter(F.col("valid_to").isNull())
    closed = history.filter(F.col("valid_to").isNotNull())
    new = source.select(F.col(key), *(F.col(x).alias(f"new_{x}") for x in checked),
                        F.lit(True).alias("in_source"))
    joined = open_rows.withColumn("is_open", F.lit(True)).join(new, key, "full")
    same = F.lit(True)
    for name in checked:
        same = same & F.equal_null(F.col(name), F.col(f"new_{name}"))
    changed = F.coalesce(F.col("is_open") & F.col("in_source") & ~same, F.lit(False))
    old = F.struct(*(F.col(x) for x in checked), "valid_from",
                   F.when(changed, as_of).alias("valid_to"))
    fresh = F.struct(*(F.col(f"new_{x}").alias(x) for x in checked), as_of.alias("valid_from"),
                     F.lit(None).cast(dict(history.dtypes)["valid_to"]).alias("valid_to"))
    versions = (
        F.when(changed, F.array(old, fresh))
        .when(F.col("is_open").isNull(), F.array(fresh))
        .otherwise(F.array(old))
    )
    return joined.select(key, F.inline(versions)).unionByName(closed.select(
        key, *checked, "valid_from", "valid_to"))
