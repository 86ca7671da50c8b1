"""Registered queries: members, capture states and structured logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.operators import evidence, logs, pairs
from runlumen.plans.book import query
from runlumen.plans.pairs import _STAGES, RESOLVED, STATUS

KEYS = ["dbt_task_run_id"]

# members as the scan sees them: normalized path, earlier copies and running size, from self-joins
SCAN = r"""shape AS (SELECT *, rtrim(replace(path, '/./', '/'), '/') AS norm,
    row_number() OVER (PARTITION BY dbt_task_run_id ORDER BY seq) AS position FROM members),
before AS (SELECT dbt_task_run_id, norm, min(seq) AS first_seq FROM shape GROUP BY 1, 2),
sized AS (SELECT dbt_task_run_id, seq, sum(CASE kind WHEN 'file' THEN declared_size ELSE 0 END)
    OVER (PARTITION BY dbt_task_run_id ORDER BY seq) AS running FROM shape),
scan AS (SELECT s.*, s.seq > first_seq AS repeated, running,
    regexp_extract(norm, '[^/]*$') AS base,
    regexp_matches(norm, '^target/attempts/' || attempt_key || '/' || CASE WHEN include_deps
      THEN '(000-deps|001-build)' ELSE '001-build' END || '/logs/dbt\.log(\.[1-5])?$') AS is_log
  FROM shape s JOIN before USING (dbt_task_run_id, norm) JOIN sized USING (dbt_task_run_id, seq)),
prim AS (SELECT *, kind = 'file' AND NOT is_log AND base IN ('manifest.json', 'run_results.json') AS is_primary,
    'target/attempts/' || attempt_key || '/001-build/artifacts/' || base AS wanted FROM scan)"""
RULES = {
    "DBT_ARCHIVE_MEMBER_LIMIT_EXCEEDED": "position > 4096",
    "DBT_ARCHIVE_PATH_UNSAFE": "path LIKE '../%'",
    "DBT_ARCHIVE_MEMBER_DUPLICATE": "repeated",
    "DBT_ARCHIVE_LOG_PATH_UNEXPECTED": "base LIKE 'dbt.log%' AND NOT is_log",
    "DBT_ARCHIVE_MEMBER_TYPE_UNSAFE": "kind NOT IN ('dir', 'file') OR (kind = 'dir' AND is_log)",
    "DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED": "kind = 'file' AND running > 536870912",
    "DBT_ARCHIVE_PRIMARY_PATH_UNEXPECTED": "is_primary AND (path <> norm OR path <> wanted)",
    "DBT_MANIFEST_SIZE_LIMIT_EXCEEDED":
        "is_primary AND base = 'manifest.json' AND declared_size > 134217728",
    "DBT_RUN_RESULTS_SIZE_LIMIT_EXCEEDED":
        "is_primary AND base = 'run_results.json' AND declared_size > 134217728",
    "DBT_ARCHIVE_PRIMARY_TRUNCATED": "is_primary AND read_size <> declared_size",
}
CODED = f"""{SCAN}, coded_members AS (SELECT *, CASE
  {' '.join(f"WHEN {cond} THEN '{code}'" for code, cond in RULES.items())} END AS member_code FROM prim),
firsts AS (SELECT dbt_task_run_id, arg_min(member_code, seq) FILTER (member_code IS NOT NULL)
    AS issue_code, coalesce(min(position) FILTER (member_code IS NOT NULL), count(*)) AS member_count
  FROM coded_members GROUP BY 1)"""


def _member_rule(name, codes):
    cond = " OR ".join(f"({RULES[c]})" for c in codes)
    sql = f"WITH {SCAN} SELECT dbt_task_run_id, seq, path FROM prim WHERE {cond}"

    def run(t):
        return evidence.breaking(t.members, codes).select("dbt_task_run_id", "seq", "path")

    query(name, ["members"], sql)(run)


_member_rule("mem_count_limit", ["DBT_ARCHIVE_MEMBER_LIMIT_EXCEEDED"])
_member_rule("mem_path_unsafe", ["DBT_ARCHIVE_PATH_UNSAFE"])
_member_rule("mem_duplicate", ["DBT_ARCHIVE_MEMBER_DUPLICATE"])
_member_rule("mem_log_unexpected", ["DBT_ARCHIVE_LOG_PATH_UNEXPECTED"])
_member_rule("mem_type_unsafe", ["DBT_ARCHIVE_MEMBER_TYPE_UNSAFE"])
_member_rule("mem_expanded_limit", ["DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED"])
_member_rule("mem_primary_path", ["DBT_ARCHIVE_PRIMARY_PATH_UNEXPECTED"])
_member_rule("mem_primary_size", ["DBT_MANIFEST_SIZE_LIMIT_EXCEEDED",
                                  "DBT_RUN_RESULTS_SIZE_LIMIT_EXCEEDED",
                                  "DBT_ARCHIVE_PRIMARY_TRUNCATED"])


@query("mem_first_violation", ["members"], f"WITH {CODED} SELECT * FROM firsts")
def _(t):
    return evidence.first_violation(t.members)


_HASHES = """hashes AS (SELECT dbt_task_run_id,
  max(content_sha256) FILTER (path LIKE '%/001-build/artifacts/manifest.json') AS manifest_sha256,
  max(read_size) FILTER (path LIKE '%/001-build/artifacts/manifest.json') AS manifest_size_bytes,
  max(content_sha256) FILTER (path LIKE '%/001-build/artifacts/run_results.json') AS run_results_sha256,
  max(read_size) FILTER (path LIKE '%/001-build/artifacts/run_results.json') AS run_results_size_bytes
FROM members GROUP BY 1)"""


@query("cap_hashes", ["members"], f"WITH {_HASHES} SELECT * FROM hashes")
def _(t):
    return evidence.primary_facts(t.members)


@query("cap_state", ["members", "attempts", "document_meta", "result_rows", "inventory"], f"""
WITH {RESOLVED}, {STATUS}, {_STAGES}, {CODED}, {_HASHES}
SELECT dbt_task_run_id, CASE
    WHEN capture_state = 'ARCHIVE_UNAVAILABLE' THEN capture_state
    WHEN issue_code IS NOT NULL THEN 'INVALID_CAPTURE_CONTRACT'
    WHEN manifest_sha256 IS NULL THEN CASE WHEN run_results_sha256 IS NULL THEN 'NOT_PRODUCED'
      ELSE 'INVALID_CAPTURE_CONTRACT' END
    WHEN run_results_sha256 IS NULL THEN CASE WHEN ok THEN 'PARTIAL' ELSE 'INVALID_CAPTURE_CONTRACT' END
    WHEN pair_state = 'PAIR_VALID' THEN 'COMPLETE' ELSE 'INVALID_CAPTURE_CONTRACT' END AS capture_state,
  CASE WHEN capture_state = 'ARCHIVE_UNAVAILABLE' THEN 'DBT_ARCHIVE_LINK_UNAVAILABLE'
    WHEN issue_code IS NOT NULL THEN issue_code
    WHEN manifest_sha256 IS NULL THEN CASE WHEN run_results_sha256 IS NULL
      THEN 'DBT_PRIMARY_ARTIFACTS_NOT_PRODUCED' ELSE 'DBT_RUN_RESULTS_WITHOUT_MANIFEST' END
    WHEN run_results_sha256 IS NULL THEN CASE WHEN ok THEN 'DBT_RUN_RESULTS_NOT_PRODUCED'
      ELSE 'DBT_MANIFEST_STANDALONE_INVALID' END ELSE primary_code END AS capture_issue
FROM attempts JOIN firsts USING (dbt_task_run_id) JOIN hashes USING (dbt_task_run_id)
JOIN verdicts USING (dbt_task_run_id)
JOIN (SELECT dbt_task_run_id, manifest_bytes <= 134217728 AND manifest_depth <= 256
    AND manifest_parse = 'OK' AND manifest_schema_valid AND manifest_schema LIKE '%/v12.json'
    AND manifest_version = '1.11.12' AND adapter_type = 'databricks'
    AND manifest_invocation <> 'not-a-uuid' AND manifest_generated_at LIKE '%Z' AS ok
  FROM document_meta) m USING (dbt_task_run_id)""")
def _(t):
    verdicts = pairs.judge(t.document_meta, t.result_rows, t.inventory, KEYS)
    standalone = t.document_meta.select(
        *KEYS, evidence.manifest_standalone().alias("standalone_valid"))
    hashes = evidence.primary_presence(t.members)
    facts = t.attempts.select(
        *KEYS, (F.col("capture_state") != "ARCHIVE_UNAVAILABLE").alias("retrieved"))
    for part in (evidence.first_violation(t.members), hashes, standalone, verdicts):
        facts = facts.join(part, KEYS)
    return evidence.capture_state(facts)


# ---- structured logs -------------------------------------------------------------------------

LINES = """parsed AS (SELECT attempt, ordinal, rotation, line <> '' AS filled,
    json_extract_string(CASE line WHEN '' THEN '{}' ELSE line END, '$.info.name') AS name,
    json_extract_string(CASE line WHEN '' THEN '{}' ELSE line END, '$.info.invocation_id') AS inv,
    CAST(json_extract_string(CASE line WHEN '' THEN '{}' ELSE line END, '$.data.log_version') AS BIGINT)
      AS version FROM log_lines),
lf AS (SELECT attempt, ordinal, count(*) FILTER (NOT filled OR name = '' OR length(inv) <> 36) AS bad,
    count(DISTINCT inv) FILTER (length(inv) = 36) AS invocations, min(inv) FILTER (length(inv) = 36) AS inv,
    count(*) FILTER (name = 'MainReportVersion') AS main_reports,
    max(version) FILTER (name = 'MainReportVersion') AS version
  FROM parsed GROUP BY 1, 2),
ff AS (SELECT attempt, ordinal, count(*) AS files, CAST(sum(declared_size) AS BIGINT) AS bytes,
    max(declared_size) AS largest, bool_and(read_size = declared_size) AS complete,
    max(rotation) AS top, count(DISTINCT rotation) AS distinct_rotations, min(rotation) AS low
  FROM log_files GROUP BY 1, 2)"""
LOGS = ["log_lines", "log_files", "log_artifacts"]


def _expected(t):
    """Both ordinals of every run; the deps log only where deps are included."""
    ordinals = F.when(F.col("include_deps"), F.array(F.lit("000-deps"), F.lit("001-build"))).otherwise(
        F.array(F.lit("001-build")))
    shape = t.attempt_shape.select(
        F.col("dbt_task_run_id").alias("attempt"), F.explode(ordinals).alias("ordinal"))
    gone = t.attempts.filter("capture_state = 'ARCHIVE_UNAVAILABLE'").select(
        F.col("dbt_task_run_id").alias("attempt"), F.lit(False).alias("kept"))
    return shape.join(gone, "attempt", "left").select(
        "attempt", "ordinal", F.coalesce("kept", F.lit(True)).alias("retrieved"))


_EXPECTED = """expected AS (SELECT s.dbt_task_run_id AS attempt, o.ordinal,
  a.capture_state <> 'ARCHIVE_UNAVAILABLE' AS retrieved
FROM attempt_shape s JOIN attempts a USING (dbt_task_run_id)
JOIN (VALUES ('000-deps'), ('001-build')) o(ordinal) ON o.ordinal = '001-build' OR s.include_deps)"""


@query("log_missing", ["attempts", "attempt_shape", "log_files"], f"""
WITH {_EXPECTED} SELECT attempt, ordinal, CASE WHEN retrieved THEN 'MISSING' ELSE 'UNAVAILABLE' END
  AS log_state FROM expected e WHERE NOT retrieved OR NOT EXISTS (SELECT 1 FROM log_files f
    WHERE f.attempt = e.attempt AND f.ordinal = e.ordinal)""")
def _(t):
    files = t.log_files.groupBy(*logs.KEYS).agg(F.count("*").alias("n"))
    joined = _expected(t).join(files, logs.KEYS, "left")
    return joined.filter(~F.col("retrieved") | F.col("n").isNull()).select(
        *logs.KEYS, F.when(F.col("retrieved"), "MISSING").otherwise("UNAVAILABLE")
        .alias("log_state"))


@query("log_limits", ["log_files"], """
SELECT * FROM (SELECT attempt, ordinal, count(*) AS file_count,
    CAST(sum(declared_size) AS BIGINT) AS size_bytes, max(declared_size) AS largest,
    bool_and(read_size = declared_size) AS complete FROM log_files GROUP BY 1, 2) f
WHERE file_count > 6 OR size_bytes > 125829120 OR largest > 20971520 OR NOT complete""")
def _(t):
    return logs.file_facts(t.log_files).filter(logs.over_limits()).select(
        *logs.KEYS, "file_count", "size_bytes", "largest", "complete")


@query("log_rotation_gap", ["log_files"], """
SELECT attempt, ordinal, list_sort(list(rotation)) <> range(0, max(rotation) + 1) AS has_gap
FROM log_files GROUP BY 1, 2""")
def _(t):
    return logs.file_facts(t.log_files).select(*logs.KEYS, logs.rotation_gap().alias("has_gap"))


@query("log_empty", ["log_files"], """
SELECT attempt, ordinal, count(*) AS file_count FROM log_files GROUP BY 1, 2
HAVING sum(declared_size) = 0""")
def _(t):
    return logs.file_facts(t.log_files).filter("size_bytes = 0").select(*logs.KEYS, "file_count")


@query("src_log_lines", None, r"""
SELECT doc_id, CAST(len(string_split(rtrim_one, chr(10))) AS BIGINT) AS line_count,
  list_contains(string_split(rtrim_one, chr(10)), '') AS malformed
FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END AS rtrim_one
  FROM documents WHERE text <> '') d""")
def _(t):
    exploded = logs.lines(t.base("documents"), ["doc_id"], "text")
    return logs.blank_line_files(exploded, ["doc_id"])


@query("log_reconstruct", None, """
SELECT conv_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes,
  CASE WHEN count(*) = count(DISTINCT turn)
    THEN sha256(string_agg(text, '' ORDER BY turn DESC)) END AS sha256
FROM conversations GROUP BY conv_id""")
def _(t):
    files = t.base("conversations").withColumnRenamed("turn", "rotation")
    return logs.reconstruct(files, ["conv_id"], "text")


@query("agg_log_invocations", ["log_lines", "log_files"], f"""WITH {LINES}
SELECT attempt, ordinal, invocations, main_reports, version AS log_version FROM lf""")
def _(t):
    return logs.parsed_lines(t.log_lines).groupBy(*logs.KEYS).agg(
        F.count_distinct("invocation").alias("invocations"),
        F.count_if("main_report").alias("main_reports"), F.max("version").alias("log_version"))


@query("log_malformed", ["log_lines", "log_files"], f"""WITH {LINES}
SELECT attempt, ordinal, bad > 0 OR invocations <> 1 OR main_reports > 1 AS malformed FROM lf""")
def _(t):
    return logs.line_facts(t.log_lines).select(*logs.KEYS, logs.malformed().alias("malformed"))


@query("log_main_report", ["log_lines", "log_files"], f"""WITH {LINES}
SELECT attempt, ordinal, CASE WHEN files = 6 AND top = 5 THEN 'TRUNCATED' ELSE 'MISSING' END AS log_state
FROM lf JOIN ff USING (attempt, ordinal) WHERE main_reports = 0""")
def _(t):
    joined = logs.line_facts(t.log_lines).join(logs.file_facts(t.log_files), logs.KEYS)
    return joined.filter("main_reports = 0").select(
        *logs.KEYS, F.when(logs.saturated(), "TRUNCATED").otherwise("MISSING").alias("log_state"))


@query("log_version", ["log_lines", "log_files"], f"""WITH {LINES}
SELECT attempt, ordinal, version AS log_version, version = 3 AS supported FROM lf WHERE main_reports = 1""")
def _(t):
    return logs.line_facts(t.log_lines).filter("main_reports = 1").select(
        *logs.KEYS, "log_version", (F.col("log_version") == 3).alias("supported"))


@query("join_log_to_artifact", LOGS, f"""WITH {LINES}
SELECT lf.attempt, lf.ordinal, CASE WHEN lf.ordinal = '001-build' AND a.artifact_invocation IS NOT NULL
  THEN lf.inv = a.artifact_invocation END AS same_invocation
FROM lf LEFT JOIN log_artifacts a ON a.attempt = lf.attempt""")
def _(t):
    bound = F.when(F.col("ordinal") == "001-build",
                   F.col("first_invocation") == F.col("artifact_invocation"))
    return logs.line_facts(t.log_lines).join(t.log_artifacts, "attempt", "left").select(
        *logs.KEYS, bound.alias("same_invocation"))


@query("log_state", [*LOGS, "attempts", "attempt_shape"], f"""WITH {LINES}, {_EXPECTED},
decided AS (SELECT e.attempt, e.ordinal, e.retrieved, files, bytes, version, CASE
  WHEN NOT e.retrieved THEN 'UNAVAILABLE' WHEN files IS NULL THEN 'MISSING'
  WHEN files > 6 OR bytes > 125829120 OR largest > 20971520 OR NOT complete THEN 'TRUNCATED'
  WHEN low > 0 OR top + 1 <> distinct_rotations THEN 'TRUNCATED'
  WHEN bytes = 0 THEN 'NOT_INITIALIZED'
  WHEN bad > 0 OR invocations <> 1 OR main_reports > 1 THEN 'MALFORMED'
  WHEN main_reports = 0 THEN CASE WHEN files = 6 AND top = 5 THEN 'TRUNCATED' ELSE 'MISSING' END
  WHEN version <> 3 THEN 'UNKNOWN_VERSION'
  WHEN e.ordinal = '001-build' AND inv <> artifact_invocation THEN 'ARTIFACT_INVOCATION_MISMATCH'
  ELSE 'VALID' END AS log_state
FROM expected e LEFT JOIN ff USING (attempt, ordinal) LEFT JOIN lf USING (attempt, ordinal)
LEFT JOIN log_artifacts USING (attempt))
SELECT attempt, ordinal, log_state, CASE WHEN retrieved THEN coalesce(files, 0) ELSE 0 END AS file_count,
  CASE WHEN retrieved THEN bytes END AS size_bytes,
  CASE WHEN log_state IN ('VALID', 'UNKNOWN_VERSION', 'ARTIFACT_INVOCATION_MISMATCH') THEN version END
    AS log_version FROM decided""")
def _(t):
    return logs.states(_expected(t), t.log_files, t.log_lines, t.log_artifacts)
