"""Evidence members and capture states.

A member row is (attempt, seq, path, kind, declared_size, read_size). Positions and running sizes of an
attempt are prefix sums in two levels, over blocks of ``seq`` and inside each block, so an attempt with
very many members is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlumen.functions.labels import basename, normal_path, normal_uuid, offset_ts, path_safe
from runlumen.operators.pairs import version_codes
from runlumen.schemas import (
    MAX_DOCUMENT_BYTES,
    MAX_EXPANDED_BYTES,
    MAX_JSON_DEPTH,
    MAX_LOG_FILES,
    MAX_MEMBERS,
    POLICY,
)
from runlumen.session import all_of

KEY = ["dbt_task_run_id"]
PRIMARIES = {"manifest.json": "MANIFEST", "run_results.json": "RUN_RESULTS"}


#: Members of an attempt numbered together.
BLOCK = 4096


def scanned(members: DataFrame, own: dict[str, Column] | None = None) -> DataFrame:
    """All members with normalized path, position in the attempt, running size and earlier copies.

    Members meet twice: by path, to find earlier copies, and by block. ``own`` names facts of the
    member's own row; then only those travel, and not the texts they are made of.
    """
    size = F.when(F.col("kind") == "file", F.col("declared_size")).otherwise(F.lit(0))
    rows = members.withColumns({"block": F.floor(F.col("seq") / BLOCK), "bytes": size})
    if "normal" not in rows.columns:
        rows = rows.withColumn("normal", normal_path(F.col("path")))
    sums = rows.groupBy(*KEY, "block").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    earlier = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *KEY, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("members_before"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("bytes_before"))
    if own is not None:
        rows = rows.select(*KEY, "seq", "normal", "block", "bytes", *(c.alias(n) for n, c in own.items()))
    so_far = Window.partitionBy(*KEY, "normal").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.filter(F.col("normal").isNotNull() & F.col("block").isNotNull()).withColumn(
        "repeated", F.col("seq") > F.min("seq").over(so_far))
    if own is not None:
        marked = marked.drop("normal")
    inside = Window.partitionBy(*KEY, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumns({
        "nth": F.count("*").over(inside), "sum_bytes": F.sum("bytes").over(inside)})
    return (
        counted.join(offsets, [*KEY, "block"])
        .withColumn("position", F.col("members_before") + F.col("nth"))
        .withColumn("expanded_bytes", F.col("bytes_before") + F.col("sum_bytes"))
    )


def log_path(normal: Column, key: Column, include_deps: Column, root: str) -> Column:
    """True where a normalized path is one of the governed log files of the attempt."""
    base = F.concat(F.lit(root), key)
    tail = F.substr(normal, F.length(base) + 1)
    governed = tail.rlike(rf"^/(000-deps|001-build)/logs/dbt\.log(\.[1-{MAX_LOG_FILES - 1}])?$")
    return F.startswith(normal, base) & governed & (
        include_deps | F.startswith(tail, F.lit("/001-build/")))


def with_roles(rows: DataFrame, root: str = "target/attempts/") -> DataFrame:
    """Members with their base name and whether they are a governed log file or a primary."""
    base = basename(F.col("normal"))
    # only such names can be one; unknown keys stay unknown
    asked = F.startswith(base, F.lit("dbt.log")) | F.col("attempt_key").isNull() | F.col("include_deps").isNull()
    governed = log_path(F.col("normal"), F.col("attempt_key"), F.col("include_deps"), root)
    named = rows.withColumns({"base": base, "is_log": F.when(asked, governed).otherwise(F.lit(False))})
    return named.withColumn(
        "is_primary", (F.col("kind") == "file") & F.col("base").isin(list(PRIMARIES)) & ~F.col("is_log"))


def member_codes(root: str = "target/attempts/") -> dict[str, Column]:
    """Ordered conditions per member over ``scanned`` rows with roles; the first that holds is its code."""
    normal, name, is_log = F.col("normal"), F.col("base"), F.col("is_log")
    is_dir, is_file = F.col("kind") == "dir", F.col("kind") == "file"
    primary = F.col("is_primary")
    expected = F.concat(F.lit(root), F.col("attempt_key"), F.lit("/001-build/artifacts/"), name)
    codes = {
        "DBT_ARCHIVE_MEMBER_LIMIT_EXCEEDED": F.col("position") > MAX_MEMBERS,
        "DBT_ARCHIVE_PATH_UNSAFE": ~path_safe(F.col("path")),
        "DBT_ARCHIVE_MEMBER_DUPLICATE": F.col("repeated"),
        "DBT_ARCHIVE_LOG_PATH_UNEXPECTED": F.startswith(name, F.lit("dbt.log")) & ~is_log,
        "DBT_ARCHIVE_MEMBER_TYPE_UNSAFE": (is_dir & is_log) | ~(is_dir | is_file)
        | (is_file & (F.col("declared_size") < 0)),
        "DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED": is_file
        & (F.col("expanded_bytes") > MAX_EXPANDED_BYTES),
        "DBT_ARCHIVE_PRIMARY_PATH_UNEXPECTED": primary
        & ((F.col("path") != normal) | (normal != expected)),
    }
    for file_name, label in PRIMARIES.items():
        codes[f"DBT_{label}_SIZE_LIMIT_EXCEEDED"] = (
            primary & (name == file_name) & (F.col("declared_size") > MAX_DOCUMENT_BYTES))
    codes["DBT_ARCHIVE_PRIMARY_TRUNCATED"] = primary & (
        F.col("read_size") != F.col("declared_size"))
    return codes


#: Rules that read more than the member's own row.
POSITIONAL = ("DBT_ARCHIVE_MEMBER_LIMIT_EXCEEDED", "DBT_ARCHIVE_MEMBER_DUPLICATE",
              "DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED")


def breaking(members: DataFrame, codes: list[str], root: str = "target/attempts/") -> DataFrame:
    """Members that break one of the rules; rules on the row itself are a filter of the scan."""
    rows = members.withColumn("normal", normal_path(F.col("path")))
    if set(codes) & set(POSITIONAL):
        rows = scanned(members)
    rules, hit = member_codes(root), F.lit(False)
    for code in codes:
        hit = hit | rules[code]
    return with_roles(rows, root).filter(hit)


def member_code(root: str = "target/attempts/") -> Column:
    """Code of the first rule a member breaks, or null."""
    return F.coalesce(*(F.when(cond, F.lit(code)) for code, cond in member_codes(root).items()))


def first_violation(members: DataFrame, root: str = "target/attempts/") -> DataFrame:
    """Per attempt the earliest violation in member order and the members up to it, or all of them.

    Rules on a member's own row are judged before members meet: by the number of the first one that
    is broken between two positional rules.
    """
    rules = member_codes(root)
    order = list(rules)
    own, groups, at = {"is_file": F.col("kind") == "file"}, [], []
    for code in [*order, None]:
        if code is not None and code not in POSITIONAL:
            at.append(code)
            continue
        if at:
            name = f"own_{len(groups)}"
            own[name] = F.coalesce(*(
                F.when(rules[c], F.lit(order.index(c)).cast("tinyint")) for c in at))
            groups.append(F.col(name))
            at = []
        if code is not None:
            groups.append(code)
    positional = {
        "DBT_ARCHIVE_MEMBER_LIMIT_EXCEEDED": F.col("position") > MAX_MEMBERS,
        "DBT_ARCHIVE_MEMBER_DUPLICATE": F.col("repeated"),
        "DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED":
            F.col("is_file") & (F.col("expanded_bytes") > MAX_EXPANDED_BYTES),
    }
    broken = F.coalesce(*(
        F.when(positional[g], F.lit(order.index(g)).cast("tinyint")) if isinstance(g, str) else g
        for g in groups))
    judged = with_roles(members.withColumn("normal", normal_path(F.col("path"))), root)
    coded = scanned(judged, own).withColumn("broken", broken)
    bad = F.when(F.col("broken").isNotNull(), F.col("position"))
    first = coded.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min(bad).alias("first_bad"), F.min_by("broken", bad).alias("broken"))
    names = F.array(*(F.lit(code) for code in order))
    return first.select(
        *KEY, F.get(names, F.col("broken").cast("int")).alias("issue_code"),
        F.coalesce("first_bad", "n").alias("member_count"))


def primary_facts(members: DataFrame, root: str = "target/attempts/") -> DataFrame:
    """Hash and size of both primaries per attempt, from the members at their exact paths."""
    at = F.concat(F.lit(root), F.col("attempt_key"), F.lit("/001-build/artifacts/"))
    aggregates = []
    for name, label in (("manifest.json", "manifest"), ("run_results.json", "run_results")):
        here = (F.col("path") == F.concat(at, F.lit(name))) & (F.col("kind") == "file")
        aggregates += [
            F.max(F.when(here, F.col("content_sha256"))).alias(f"{label}_sha256"),
            F.max(F.when(here, F.col("read_size"))).alias(f"{label}_size_bytes"),
        ]
    return members.groupBy(*KEY).agg(*aggregates)


def primary_presence(members: DataFrame, root: str = "target/attempts/") -> DataFrame:
    """Whether each primary of an attempt has a hash; ``primary_facts`` without the hashes."""
    at = F.concat(F.lit(root), F.col("attempt_key"), F.lit("/001-build/artifacts/"))
    return members.groupBy(*KEY).agg(*(
        F.bool_or((F.col("path") == F.concat(at, F.lit(name))) & (F.col("kind") == "file")
                  & F.col("content_sha256").isNotNull()).alias(f"has_{label}")
        for name, label in (("manifest.json", "manifest"), ("run_results.json", "results")))
    ).select(*KEY, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_manifest", "has_results")))


def manifest_standalone() -> Column:
    """A manifest without results is accepted when every rule about it alone holds."""
    versions = {
        "manifest_schema": POLICY["manifest_schema"],
        "manifest_version": POLICY["dbt_version"],
        "adapter_type": POLICY["adapter_type"],
    }
    return all_of([
        F.col("manifest_bytes") <= MAX_DOCUMENT_BYTES,
        F.col("manifest_depth") <= MAX_JSON_DEPTH,
        F.col("manifest_parse") == "OK",
        F.col("manifest_schema_valid"),
        normal_uuid(F.col("manifest_invocation")).isNotNull(),
        offset_ts(F.col("manifest_generated_at")).isNotNull(),
        *(F.equal_null(F.col(c), F.lit(v)) for c, v in versions.items()),
    ])


def capture_state(facts: DataFrame) -> DataFrame:
    """Capture state and issue per attempt.

    ``facts``: retrieved, issue_code (first member violation), has_manifest, has_results,
    standalone_valid, pair_state, primary_code.
    """
    manifest, results = F.col("has_manifest"), F.col("has_results")
    invalid = "INVALID_CAPTURE_CONTRACT"

    def verdict(state: str | Column, code: str | Column | None) -> Column:
        as_col = [x if isinstance(x, Column) else F.lit(x) for x in (state, code)]
        return F.struct(as_col[0].alias("capture_state"),
                        as_col[1].cast("string").alias("capture_issue"))

    chosen = (
        F.when(~F.col("retrieved"), verdict("ARCHIVE_UNAVAILABLE", "DBT_ARCHIVE_LINK_UNAVAILABLE"))
        .when(F.col("issue_code").isNotNull(), verdict(invalid, F.col("issue_code")))
        .when(~manifest & ~results, verdict("NOT_PRODUCED", "DBT_PRIMARY_ARTIFACTS_NOT_PRODUCED"))
        .when(~manifest, verdict(invalid, "DBT_RUN_RESULTS_WITHOUT_MANIFEST"))
        .when(~results & F.col("standalone_valid"),
              verdict("PARTIAL", "DBT_RUN_RESULTS_NOT_PRODUCED"))
        .when(~results, verdict(invalid, "DBT_MANIFEST_STANDALONE_INVALID"))
        .when(F.col("pair_state") == "PAIR_VALID", verdict("COMPLETE", None))
        .otherwise(verdict(invalid, F.coalesce("primary_code", F.lit("DBT_ARTIFACT_PAIR_INVALID"))))
    )
    return facts.select(*KEY, chosen.alias("v")).select(*KEY, "v.*")


__all__ = ["scanned", "member_codes", "member_code", "breaking", "first_violation", "primary_facts",
           "manifest_standalone", "capture_state", "version_codes"]
