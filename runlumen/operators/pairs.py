"""Validation of document pairs (manifest and run results), set-based over all attempts.

Inputs are rows: one row of scalar facts per attempt, one row per result and one per manifest
entry. Every rule yields (attempt, code) rows; the verdict is their aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.functions.labels import nonneg_finite, normal_uuid, offset_ts
from runlumen.schemas import (
    ISSUE_CATALOGUE,
    ISSUE_CODES,
    MAX_DOCUMENT_BYTES,
    MAX_JSON_DEPTH,
    NODE_COLUMNS,
    POLICY,
    RUN_STATUSES,
    SUPPORTED_COLLECTIONS,
    TEST_STATUSES,
    TEST_TYPES,
    UNSUPPORTED_COLLECTIONS,
)

KEY = "dbt_task_run_id"
INVOCATION_FACTS = ["invocation_id", "generated_at", "elapsed_time", "dbt_version", "adapter_type",
                    "command", "result_count", "status_counts_json"]
NODE_FACTS = ["unique_id", "resource_type", "status", "execution_time", "failures"]


def issue_catalogue(spark: SparkSession) -> DataFrame:
    """The closed issue catalogue (26 rows), ranked by precedence."""
    rows = [(rank, *row) for rank, row in enumerate(ISSUE_CATALOGUE)]
    return spark.createDataFrame(
        rows, "rank INT, code STRING, component STRING, field STRING, observed_category STRING")


def rank_of(code: Column) -> Column:
    """Precedence of a code as an expression; the catalogue is closed, so no join is needed."""
    return F.array_position(F.array(*map(F.lit, ISSUE_CODES)), code).cast("int") - 1


def allowlist(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the eight invocation and five node fields leave the documents."""
    key = ["workspace_id", KEY]
    return facts.select(*key, *INVOCATION_FACTS), nodes.select(*key, *NODE_FACTS)


# ---- document rules: one boolean per code, stage by stage ------------------------------------

def size_codes() -> dict[str, Column]:
    return {
        "DBT_MANIFEST_SIZE_LIMIT_EXCEEDED": F.col("manifest_bytes") > MAX_DOCUMENT_BYTES,
        "DBT_RUN_RESULTS_SIZE_LIMIT_EXCEEDED": F.col("run_results_bytes") > MAX_DOCUMENT_BYTES,
    }


def depth_codes() -> dict[str, Column]:
    return {
        "DBT_MANIFEST_JSON_NESTING_LIMIT_EXCEEDED": F.col("manifest_depth") > MAX_JSON_DEPTH,
        "DBT_RUN_RESULTS_JSON_NESTING_LIMIT_EXCEEDED": F.col("run_results_depth") > MAX_JSON_DEPTH,
    }


def parse_codes() -> dict[str, Column]:
    codes = {}
    for kind in ("manifest", "run_results"):
        for verdict in ("INVALID", "DUPLICATE_KEY"):
            code = f"DBT_{kind.upper()}_JSON_{verdict}"
            codes[code] = F.col(f"{kind}_parse") == verdict
    return codes


def schema_codes() -> dict[str, Column]:
    """Schema stage: the facts every later rule reads must be there with the right type."""
    return {
        "DBT_MANIFEST_SCHEMA_INVALID": ~F.col("manifest_schema_valid"),
        "DBT_RUN_RESULTS_SCHEMA_INVALID": ~F.col("run_results_schema_valid"),
    }


def version_codes() -> dict[str, Column]:
    def differs(column: str, policy: str) -> Column:
        return ~F.equal_null(F.col(column), F.lit(POLICY[policy]))

    return {
        "DBT_SCHEMA_VERSION_UNSUPPORTED": differs("manifest_schema", "manifest_schema")
        | differs("run_results_schema", "run_results_schema"),
        "DBT_CORE_VERSION_UNSUPPORTED": differs("manifest_version", "dbt_version")
        | differs("run_results_version", "dbt_version"),
        "DBT_ADAPTER_TYPE_UNSUPPORTED": differs("adapter_type", "adapter_type"),
    }


def invocation_codes() -> dict[str, Column]:
    manifest = normal_uuid(F.col("manifest_invocation"))
    results = normal_uuid(F.col("run_results_invocation"))
    return {
        "DBT_INVOCATION_ID_INVALID": manifest.isNull() | results.isNull(),
        "DBT_INVOCATION_ID_MISMATCH": F.coalesce(manifest != results, F.lit(False)),
    }


def command_codes(selector: Column | None = None) -> dict[str, Column]:
    expected = F.lit(POLICY["selector"]) if selector is None else selector
    approved = (
        F.equal_null(F.col("which"), F.lit(POLICY["command"]))
        & F.equal_null(F.col("selector"), expected)
        & F.equal_null(F.col("select_count"), F.lit(0))
        & F.equal_null(F.col("exclude_count"), F.lit(0))
        & F.equal_null(F.col("indirect_selection"), F.lit(POLICY["indirect_selection"]))
        & F.col("full_refresh").isNull()
    )
    return {"DBT_COMMAND_UNSUPPORTED": ~approved}


def document_timing_codes() -> dict[str, Column]:
    return {
        "DBT_TIMING_INVALID": offset_ts(F.col("manifest_generated_at")).isNull()
        | offset_ts(F.col("run_results_generated_at")).isNull()
        | ~nonneg_finite(F.col("elapsed_time"))
    }


def semantic_document_codes() -> dict[str, Column]:
    return {**version_codes(), **invocation_codes(), **command_codes(), **document_timing_codes()}


def code_array(codes: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in codes.items())))


def raise_codes(df: DataFrame, codes: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, code) rows of the conditions that hold; no shuffle."""
    return df.select(*keys, F.explode(code_array(codes)).alias("code"))


# ---- result rules ----------------------------------------------------------------------------

def duplicate_ids(results: DataFrame, keys: list[str]) -> DataFrame:
    """Result ids that occur more than once within one attempt."""
    return results.groupBy(*keys, "unique_id").agg(F.count("*").alias("copies")).filter(
        F.col("copies") > 1)


def resolve(results: DataFrame, inventory: DataFrame, keys: list[str],
            distinct_ids: bool = False) -> DataFrame:
    """Each distinct (attempt, result id) against the manifest entries of the same attempt.

    ``distinct_ids`` says that ``results`` are resolved as they are, row by row; their columns stay.

    The inventory is reduced to one row per (attempt, id) before the join, so neither side fans
    out and a hot attempt is spread by id.
    """
    collection = F.col("collection")
    supported = collection.isin(list(SUPPORTED_COLLECTIONS))
    allowed = F.lit(False)
    for name, types in SUPPORTED_COLLECTIONS.items():
        allowed = allowed | (
            (collection == name) & F.coalesce(F.col("resource_type").isin(types), F.lit(False)))
    consistent = F.equal_null(F.col("inner_id"), F.col("map_key"))
    entries = inventory.groupBy(*keys, F.col("map_key").alias("unique_id")).agg(
        F.count_if(supported).alias("supported_hits"),
        F.count_if(collection.isin(UNSUPPORTED_COLLECTIONS)).alias("unsupported_hits"),
        (F.count_if(supported & ~consistent) == 0).alias("id_consistent"),
        (F.count_if(supported & ~allowed) == 0).alias("type_allowed"),
        F.max(F.when(supported, F.col("resource_type"))).alias("resource_type"),
    )
    ids = results if distinct_ids else results.select(*keys, "unique_id").distinct()
    return ids.join(entries, [*keys, "unique_id"], "left").select(
        *ids.columns,
        F.coalesce("supported_hits", F.lit(0)).alias("supported_hits"),
        F.coalesce("unsupported_hits", F.lit(0)).alias("unsupported_hits"),
        F.coalesce("id_consistent", F.lit(True)).alias("id_consistent"),
        F.coalesce("type_allowed", F.lit(True)).alias("type_allowed"),
        "resource_type",
    )


def resolution_code() -> Column:
    """First matching code of a resolved id, or null."""
    hits, others = F.col("supported_hits"), F.col("unsupported_hits")
    return (
        F.when((hits > 1) | ((hits > 0) & (others > 0)), "DBT_RESULT_ID_AMBIGUOUS")
        .when((hits == 0) & (others > 0), "DBT_RESULT_ID_UNSUPPORTED_RESOURCE")
        .when(hits == 0, "DBT_RESULT_ID_UNRESOLVED")
        .when(~F.col("id_consistent"), "DBT_MANIFEST_RESOURCE_ID_MISMATCH")
        .when(~F.col("type_allowed") | F.col("resource_type").isNull(),
              "DBT_RESULT_RESOURCE_TYPE_UNSUPPORTED")
    )


def status_legal(resource_type: Column, status: Column) -> Column:
    legal = F.when(resource_type.isin(TEST_TYPES), status.isin(TEST_STATUSES)).otherwise(
        status.isin(RUN_STATUSES))
    return F.coalesce(legal, F.lit(False))


def last_statuses(results: DataFrame, keys: list[str]) -> DataFrame:
    """Status that counts for an id: the last of its repeats in document order."""
    return results.groupBy(*keys, "unique_id").agg(F.max_by("status", "position").alias("status"))


def result_value_codes() -> dict[str, Column]:
    return {
        "DBT_TIMING_INVALID": ~nonneg_finite(F.col("execution_time")),
        "DBT_FAILURE_COUNT_INVALID": F.coalesce(F.col("failures") < 0, F.lit(False)),
    }


# codes single results can raise; the first five exclude each other per id
RESULT_CODES = [
    "DBT_RESULT_ID_AMBIGUOUS", "DBT_RESULT_ID_UNSUPPORTED_RESOURCE", "DBT_RESULT_ID_UNRESOLVED",
    "DBT_MANIFEST_RESOURCE_ID_MISMATCH", "DBT_RESULT_RESOURCE_TYPE_UNSUPPORTED",
]


def result_codes(results: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Per attempt: the codes of every rule that reads single results, and the result count.

    One aggregate per (attempt, id), one join with the reduced inventory and one aggregate per
    attempt made of booleans: hot attempts are spread by id, then combined before the last shuffle.
    """
    per_id = results.groupBy(*keys, "unique_id").agg(
        F.count("*").alias("copies"),
        F.max_by("status", "position").alias("status"),
        *(F.bool_or(cond).alias(code) for code, cond in result_value_codes().items()),
    )
    facts = resolve(per_id, inventory, keys, distinct_ids=True).withColumn(
        "resolution", resolution_code())
    illegal = F.col("resolution").isNull() & ~status_legal(F.col("resource_type"), F.col("status"))
    raised = {
        "DBT_RESULTS_DUPLICATE_ID": F.col("copies") > 1,
        **{code: F.equal_null(F.col("resolution"), F.lit(code)) for code in RESULT_CODES},
        "DBT_RESULT_STATUS_UNSUPPORTED": illegal,
        **{code: F.col(code) for code in result_value_codes()},
    }
    flags = facts.groupBy(*keys).agg(
        F.sum("copies").alias("result_count"),
        *(F.bool_or(cond).alias("f_" + code) for code, cond in raised.items()))
    return flags.select(*keys, "result_count", code_array(
        {code: F.col("f_" + code) for code in raised}).alias("result_codes"))


# ---- verdict ---------------------------------------------------------------------------------

def first_stage_codes() -> Column:
    """Codes of the first gate that fires: size, depth, parse, schema; empty when all pass."""
    stages = [code_array(size_codes()), code_array(depth_codes()), code_array(parse_codes()),
              code_array(schema_codes())]
    picked = F.array().cast("array<string>")
    for stage in reversed(stages):
        picked = F.when(F.size(stage) > 0, stage).otherwise(picked)
    return picked


def sorted_issues(codes: Column) -> Column:
    """Unique codes by precedence."""
    ranked = F.transform(F.array_distinct(codes), lambda c: F.struct(
        rank_of(c).alias("rank"), c.alias("code")))
    return F.transform(F.array_sort(ranked), lambda s: s["code"])


def judge(meta: DataFrame, results: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict per attempt: state, ordered issue codes and the primary one.

    A gate that fires hides all later stages.
    """
    gated = meta.withColumn("gate_codes", first_stage_codes())
    joined = gated.join(result_codes(results, inventory, keys), keys, "left")
    empty = {"DBT_EMPTY_EXECUTION": F.coalesce("result_count", F.lit(0)) == 0}
    none = F.array().cast("array<string>")
    semantic = F.concat(
        code_array({**semantic_document_codes(), **empty}), F.coalesce("result_codes", none))
    codes = sorted_issues(
        F.when(F.size("gate_codes") > 0, F.col("gate_codes")).otherwise(semantic))
    return joined.select(*keys, codes.alias("issue_codes")).select(
        *keys,
        F.when(F.size("issue_codes") == 0, "PAIR_VALID").otherwise("PAIR_INVALID")
        .alias("pair_state"),
        "issue_codes",
        F.try_element_at("issue_codes", F.lit(1)).alias("primary_code"),
    )


def report(verdicts: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """JSON report per attempt: a summary for valid pairs, catalogue issues otherwise, never both."""
    entries = {
        code: F.struct(F.lit(code).alias("code"), F.lit(component).alias("component"),
                       F.lit(field).alias("field"), F.lit(category).alias("observed_category"))
        for code, component, field, category in ISSUE_CATALOGUE
    }
    catalogue = F.create_map(*(c for code, e in entries.items() for c in (F.lit(code), e)))
    issues = F.transform("issue_codes", lambda c: F.element_at(catalogue, c))
    valid = F.col("pair_state") == "PAIR_VALID"
    body = F.struct(
        F.when(~valid, issues).alias("issues"),
        F.col("pair_state").alias("state"),
        F.when(valid, F.struct(
            F.lit(POLICY["adapter_type"]).alias("adapter_type"),
            F.lit(POLICY["command"]).alias("command"),
            F.lit(POLICY["dbt_version"]).alias("dbt_version"),
            F.col("result_count"),
            F.col("status_counts_json").alias("status_counts"),
        )).alias("summary"),
    )
    return verdicts.join(counts, keys, "left").select(
        *keys, "pair_state", F.to_json(body).alias("report_json"))


def project(verdicts: DataFrame, meta: DataFrame, results: DataFrame, inventory: DataFrame,
            keys: list[str]) -> DataFrame:
    """Node rows of accepted pairs; the type comes from the manifest entry."""
    accepted = verdicts.filter(F.col("pair_state") == "PAIR_VALID").select(*keys)
    rows = results.join(accepted, keys, "left_semi")
    typed = resolve(rows.filter("unique_id IS NOT NULL"), inventory, keys, distinct_ids=True)
    facts = meta.select(*keys, F.col("run_results_invocation").alias("invocation_id"))
    return (
        typed.join(facts, keys)
        .select(*keys, *[c for c in NODE_COLUMNS[2:-1]])
    )
