"""Scalar expressions: keys, identifiers, timestamps, outcomes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlumen.schemas import MAX_PATH_BYTES

# fixed value: anchored attempt key
ATTEMPT_KEY_PATTERN = (
    "^w([1-9][0-9]*)-j([1-9][0-9]*)-r([1-9][0-9]*)-t([1-9][0-9]*)-p([0-9]+)-e([1-9][0-9]*)$"
)
KEY_AXES = ["workspace_id", "job_id", "job_run_id", "task_run_id", "repair_count",
            "execution_count"]


def attempt_key(*axes: Column) -> Column:
    return F.format_string("w%d-j%d-r%d-t%d-p%d-e%d", *axes)


def parsed_attempt_key(text: Column) -> Column:
    """Struct of the six axes, or null where the key is not well formed."""
    axes = [
        F.regexp_extract(text, ATTEMPT_KEY_PATTERN, i + 1).try_cast("bigint").alias(name)
        for i, name in enumerate(KEY_AXES)
    ]
    return F.when(text.rlike(ATTEMPT_KEY_PATTERN), F.struct(*axes))


def expected_paths(key: Column, include_deps: Column, root: str = "target/attempts/") -> Column:
    """Array of (role, path) an attempt may carry; the deps log only where deps are included."""
    base = F.concat(F.lit(root), key)
    paths = {
        "manifest": "/001-build/artifacts/manifest.json",
        "run_results": "/001-build/artifacts/run_results.json",
        "build_log": "/001-build/logs/dbt.log",
        "deps_log": "/000-deps/logs/dbt.log",
    }
    entries = [
        F.struct(F.lit(role).alias("role"), F.concat(base, F.lit(tail)).alias("path"))
        for role, tail in paths.items()
    ]
    return F.when(include_deps, F.array(*entries)).otherwise(F.array(*entries[:-1]))


def path_safe(path: Column) -> Column:
    """Relative, no backslash, no ``..`` part, at most 1024 UTF-8 bytes."""
    bounded = (F.octet_length(path) > 0) & (F.octet_length(path) <= MAX_PATH_BYTES)
    # "." and empty parts vanish in a normalized path; a path made of nothing else names no file
    climbs = F.contains(path, F.lit("..")) & path.rlike(r"(^|/)\.\.(/|$)")
    return bounded & ~F.contains(path, F.lit("\\")) & ~F.startswith(path, F.lit("/")) & ~climbs


def normal_path(path: Column) -> Column:
    """Collapse empty and ``.`` parts; the empty result is written as ``.``."""
    once = F.regexp_replace(path, r"(^|/)(\./|/)+", "$1")
    tail = F.regexp_replace(once, r"(^|/)\.?$", "")
    # one look tells whether either pattern finds anything
    return F.when(~path.rlike(r"(^|/)\.?(/|$)"), path).when(tail == "", F.lit(".")).otherwise(tail)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def epoch_millis_ts(millis: Column) -> Column:
    """UTC timestamp of positive epoch milliseconds, else null."""
    return F.when(millis > 0, F.timestamp_millis(millis))


# fixed value: calendar time with an explicit offset
OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


def offset_ts(text: Column) -> Column:
    """UTC timestamp of ISO text that names its offset, else null."""
    dotted = F.regexp_replace(text, ",", ".")
    full = F.regexp_replace(dotted, r"^(.{10}T\d{2}:\d{2})([Z+-])", "$1:00$2")
    return F.when(text.rlike(OFFSET_TIME), F.try_to_timestamp(full))


def normal_uuid(text: Column) -> Column:
    """Canonical lower-case hyphenated text; braces, URN prefix and missing hyphens are accepted."""
    bare = F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit("")))
    dashed = F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)


def outcome(
    status_state: Column, status_code: Column, legacy_life: Column, legacy_result: Column
) -> Column:
    """Struct (result_state, error_code); the current status shape wins over the legacy one."""
    legacy_done = F.coalesce(
        legacy_life.isin("TERMINATED", "SKIPPED", "INTERNAL_ERROR"), F.lit(False)
    )
    done = F.when(status_state.isNotNull(), status_state == "TERMINATED").otherwise(legacy_done)
    result = F.when(status_state.isNotNull(), status_code).otherwise(legacy_result)
    error = (
        F.when(~done, "DBT_JOBS_TASK_NOT_TERMINAL")
        .when(result.isNull(), "DBT_JOBS_TASK_RESULT_UNAVAILABLE")
    )
    return F.struct(
        F.when(error.isNull(), result).alias("result_state"), error.alias("error_code")
    )


def known_state(state: Column, vocabulary: list[str]) -> Column:
    return F.when(state.isNull() | state.isin(vocabulary), state).otherwise("UNKNOWN")


def result_summary(actual: Column, expected: Column) -> Column:
    shown = F.coalesce(actual.cast("string"), F.lit("not available"))
    return F.concat(shown, F.lit(" / "), expected.cast("string"), F.lit(" expected"))


def yes_no_unknown(flag: Column) -> Column:
    return F.when(flag.isNull(), "Unknown").when(flag, "Yes").otherwise("No")


def nonneg_finite(value: Column) -> Column:
    """True for a finite double that is not negative; null counts as false."""
    finite = ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))
    return F.coalesce(finite, F.lit(False))
