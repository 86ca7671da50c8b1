"""Registered queries: document pairs, issues and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.functions import documents as docs
from runlumen.functions.labels import normal_uuid
from runlumen.operators import health, pairs
from runlumen.plans.book import query
from runlumen.schemas import ISSUE_CODES, POLICY
from runlumen.sources import artifacts

KEYS = ["dbt_task_run_id"]
RUN = "'error', 'no-op', 'partial success', 'skipped', 'success'"
TEST = "'error', 'fail', 'pass', 'skipped', 'warn'"


def _document_rule(name, codes, parts):
    sql = "\nUNION ALL ".join(
        f"SELECT dbt_task_run_id, '{code}' AS code FROM document_meta WHERE {cond}"
        for code, cond in parts.items())
    query(name, ["document_meta"], sql)(
        lambda t: pairs.raise_codes(t.document_meta, codes(), KEYS))


SIZE = {"DBT_MANIFEST_SIZE_LIMIT_EXCEEDED": "manifest_bytes > 128 * 1024 * 1024",
        "DBT_RUN_RESULTS_SIZE_LIMIT_EXCEEDED": "run_results_bytes > 128 * 1024 * 1024"}
DEPTH = {"DBT_MANIFEST_JSON_NESTING_LIMIT_EXCEEDED": "manifest_depth > 256",
         "DBT_RUN_RESULTS_JSON_NESTING_LIMIT_EXCEEDED": "run_results_depth > 256"}
PARSE = {"DBT_MANIFEST_JSON_INVALID": "manifest_parse = 'INVALID'",
         "DBT_MANIFEST_JSON_DUPLICATE_KEY": "manifest_parse = 'DUPLICATE_KEY'",
         "DBT_RUN_RESULTS_JSON_DUPLICATE_KEY": "run_results_parse = 'DUPLICATE_KEY'"}
SCHEMA = {"DBT_MANIFEST_SCHEMA_INVALID": "NOT manifest_schema_valid",
          "DBT_RUN_RESULTS_SCHEMA_INVALID": "NOT run_results_schema_valid"}
VERSIONS = {
    "DBT_SCHEMA_VERSION_UNSUPPORTED":
        f"manifest_schema IS DISTINCT FROM '{POLICY['manifest_schema']}' "
        f"OR run_results_schema IS DISTINCT FROM '{POLICY['run_results_schema']}'",
    "DBT_CORE_VERSION_UNSUPPORTED":
        "manifest_version IS DISTINCT FROM '1.11.12' OR run_results_version IS DISTINCT FROM '1.11.12'",
    "DBT_ADAPTER_TYPE_UNSUPPORTED": "adapter_type IS DISTINCT FROM 'databricks'"}
_HEX = "lower(regexp_replace({c}, 'urn:|uuid:|[{{}}-]', '', 'g'))"
_M, _R = _HEX.format(c="manifest_invocation"), _HEX.format(c="run_results_invocation")
_BAD = "NOT coalesce(regexp_matches({h}, '^[0-9a-f]{{32}}$'), FALSE)"
_ANYBAD = f"({_BAD.format(h=_M)} OR {_BAD.format(h=_R)})"
INVOCATION = {"DBT_INVOCATION_ID_INVALID": _ANYBAD,
              "DBT_INVOCATION_ID_MISMATCH": f"NOT {_ANYBAD} AND {_M} <> {_R}"}
COMMAND = {"DBT_COMMAND_UNSUPPORTED": """NOT (which = 'build' AND selector = 'observability_demo'
  AND select_count = 0 AND exclude_count = 0 AND indirect_selection = 'eager')
  OR full_refresh IS NOT NULL"""}
_TS = """NOT ({c} LIKE '%T%' AND regexp_matches({c}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$')
  AND TRY_CAST(replace(left({c}, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL)"""
TIMING = {"DBT_TIMING_INVALID": f"{_TS.format(c='manifest_generated_at')} OR "
          f"{_TS.format(c='run_results_generated_at')} OR elapsed_time < 0"}


def document_codes(groups):
    """SQL of the codes of several rule groups over document_meta."""
    rules = {"VERSIONS": VERSIONS, "INVOCATION": INVOCATION, "COMMAND": COMMAND, "TIMING": TIMING}
    return "\nUNION ALL ".join(
        f"SELECT dbt_task_run_id, '{code}' AS code FROM document_meta WHERE {cond}"
        for name in groups for code, cond in rules[name].items())


_document_rule("pair_size_gate", pairs.size_codes, SIZE)
_document_rule("pair_depth_gate", pairs.depth_codes, DEPTH)
_document_rule("pair_parse_gate", pairs.parse_codes, PARSE)
_document_rule("pair_versions", pairs.version_codes, VERSIONS)
_document_rule("pair_invocation", pairs.invocation_codes, INVOCATION)
_document_rule("pair_command", pairs.command_codes, COMMAND)

RESOLVED = """ids AS (SELECT DISTINCT dbt_task_run_id, unique_id FROM result_rows),
hits AS (
  SELECT i.dbt_task_run_id, i.unique_id,
    count(*) FILTER (collection IN ('nodes', 'unit_tests', 'saved_queries', 'exposures', 'functions'))
      AS supported_hits,
    count(*) FILTER (collection IN ('sources', 'macros', 'metrics', 'semantic_models'))
      AS unsupported_hits,
    coalesce(bool_and(inner_id IS NOT DISTINCT FROM map_key) FILTER (collection NOT IN
      ('sources', 'macros', 'metrics', 'semantic_models')), TRUE) AS id_consistent,
    coalesce(bool_and(coalesce((collection = 'nodes' AND resource_type IN ('model', 'seed', 'snapshot', 'test'))
      OR (collection = 'unit_tests' AND resource_type = 'unit_test')
      OR (collection = 'exposures' AND resource_type = 'exposure'), FALSE))
      FILTER (collection NOT IN ('sources', 'macros', 'metrics', 'semantic_models')), TRUE)
      AS type_allowed,
    max(CASE WHEN collection NOT IN ('sources', 'macros', 'metrics', 'semantic_models')
      THEN resource_type END) AS resource_type
  FROM ids i LEFT JOIN inventory v ON v.dbt_task_run_id = i.dbt_task_run_id
    AND v.map_key = i.unique_id GROUP BY 1, 2),
coded AS (SELECT *, CASE
    WHEN supported_hits >= 2 OR supported_hits * unsupported_hits > 0 THEN 'DBT_RESULT_ID_AMBIGUOUS'
    WHEN supported_hits + unsupported_hits = 0 THEN 'DBT_RESULT_ID_UNRESOLVED'
    WHEN supported_hits = 0 THEN 'DBT_RESULT_ID_UNSUPPORTED_RESOURCE'
    WHEN NOT id_consistent THEN 'DBT_MANIFEST_RESOURCE_ID_MISMATCH'
    WHEN resource_type IS NULL OR NOT type_allowed THEN 'DBT_RESULT_RESOURCE_TYPE_UNSUPPORTED'
  END AS code FROM hits)"""
STATUS = f"""last_status AS (SELECT dbt_task_run_id, unique_id, arg_max(status, position) AS status
  FROM result_rows GROUP BY 1, 2),
illegal AS (SELECT c.dbt_task_run_id, c.unique_id, c.resource_type, s.status
  FROM coded c JOIN last_status s USING (dbt_task_run_id, unique_id) WHERE c.code IS NULL AND NOT
    CASE WHEN c.resource_type IN ('test', 'unit_test') THEN s.status IN ({TEST})
         ELSE s.status IN ({RUN}) END)"""
ROWS = ["result_rows", "inventory"]


@query("join_resource_resolve", ROWS, f"WITH {RESOLVED} SELECT * FROM hits")
def _(t):
    return pairs.resolve(t.result_rows, t.inventory, KEYS)


@query("pair_resolution", ROWS, f"""WITH {RESOLVED}
SELECT dbt_task_run_id, unique_id, code FROM coded WHERE code IS NOT NULL""")
def _(t):
    got = pairs.resolve(t.result_rows, t.inventory, KEYS)
    return got.select(*KEYS, "unique_id", pairs.resolution_code().alias("code")).filter(
        F.col("code").isNotNull())


@query("pair_status_vocab", ROWS, f"WITH {RESOLVED}, {STATUS} SELECT * FROM illegal")
def _(t):
    got = pairs.resolve(t.result_rows, t.inventory, KEYS).filter(pairs.resolution_code().isNull())
    last = pairs.last_statuses(t.result_rows, KEYS)
    legal = pairs.status_legal(F.col("resource_type"), F.col("status"))
    return got.join(last, [*KEYS, "unique_id"]).filter(~legal).select(
        *KEYS, "unique_id", "resource_type", "status")


@query("agg_duplicate_ids", ["result_rows"], """
SELECT dbt_task_run_id, unique_id, count(*) AS copies FROM result_rows GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return pairs.duplicate_ids(t.result_rows, KEYS)


@query("pair_duplicate_results", ["result_rows"], """
SELECT dbt_task_run_id, 'DBT_RESULTS_DUPLICATE_ID' AS code FROM result_rows GROUP BY dbt_task_run_id
HAVING count(*) > count(DISTINCT unique_id)""")
def _(t):
    return pairs.duplicate_ids(t.result_rows, KEYS).select(*KEYS).distinct().withColumn(
        "code", F.lit("DBT_RESULTS_DUPLICATE_ID"))


@query("pair_nonempty", ["attempts", "result_rows"], """
SELECT dbt_task_run_id, 'DBT_EMPTY_EXECUTION' AS code FROM attempts
WHERE dbt_task_run_id NOT IN (SELECT dbt_task_run_id FROM result_rows)""")
def _(t):
    return t.attempts.select(*KEYS).join(t.result_rows.select(*KEYS), KEYS, "left_anti").withColumn(
        "code", F.lit("DBT_EMPTY_EXECUTION"))


@query("pair_timing", ["document_meta", "result_rows"], f"""
SELECT dbt_task_run_id, 'document' AS scope, 'DBT_TIMING_INVALID' AS code FROM document_meta
WHERE {TIMING['DBT_TIMING_INVALID']}
UNION ALL SELECT DISTINCT dbt_task_run_id, 'result', 'DBT_TIMING_INVALID' FROM result_rows
WHERE execution_time < 0""")
def _(t):
    meta = pairs.raise_codes(t.document_meta, pairs.document_timing_codes(), KEYS)
    code = {"DBT_TIMING_INVALID": pairs.result_value_codes()["DBT_TIMING_INVALID"]}
    rows = pairs.raise_codes(t.result_rows, code, KEYS).distinct()
    return meta.withColumn("scope", F.lit("document")).unionByName(
        rows.withColumn("scope", F.lit("result")))


@query("pair_failures", ["result_rows"], """
SELECT dbt_task_run_id, 'DBT_FAILURE_COUNT_INVALID' AS code FROM result_rows WHERE failures < 0
GROUP BY dbt_task_run_id""")
def _(t):
    code = {"DBT_FAILURE_COUNT_INVALID": pairs.result_value_codes()["DBT_FAILURE_COUNT_INVALID"]}
    return pairs.raise_codes(t.result_rows, code, KEYS).distinct()


def _when(parts):
    return "\nUNION ALL ".join(
        f"SELECT dbt_task_run_id, '{code}' AS code FROM document_meta WHERE {cond}"
        for code, cond in parts.items())


_STAGES = f"""stage1 AS ({_when(SIZE)}), stage2 AS ({_when(DEPTH)}), stage3 AS ({_when(PARSE)}),
stage4 AS ({_when(SCHEMA)}),
stage5 AS ({_when({**VERSIONS, **INVOCATION, **COMMAND, **TIMING})}
  UNION ALL SELECT dbt_task_run_id, 'DBT_EMPTY_EXECUTION' FROM document_meta
    WHERE dbt_task_run_id NOT IN (SELECT dbt_task_run_id FROM result_rows)
  UNION ALL SELECT dbt_task_run_id, 'DBT_RESULTS_DUPLICATE_ID' FROM result_rows GROUP BY 1
    HAVING count(*) > count(DISTINCT unique_id)
  UNION ALL SELECT dbt_task_run_id, code FROM coded WHERE code IS NOT NULL
  UNION ALL SELECT dbt_task_run_id, 'DBT_RESULT_STATUS_UNSUPPORTED' FROM illegal
  UNION ALL SELECT dbt_task_run_id, 'DBT_TIMING_INVALID' FROM result_rows WHERE execution_time < 0
  UNION ALL SELECT dbt_task_run_id, 'DBT_FAILURE_COUNT_INVALID' FROM result_rows WHERE failures < 0),
staged AS (SELECT 1 AS stage, * FROM stage1 UNION ALL SELECT 2, * FROM stage2
  UNION ALL SELECT 3, * FROM stage3 UNION ALL SELECT 4, * FROM stage4 UNION ALL SELECT 5, * FROM stage5),
shown AS (SELECT DISTINCT s.dbt_task_run_id, code, list_position([{', '.join(repr(c) for c in ISSUE_CODES)}], code)
    - 1 AS rank
  FROM staged s JOIN (SELECT dbt_task_run_id, min(stage) AS stage FROM staged GROUP BY 1) f
    ON f.dbt_task_run_id = s.dbt_task_run_id AND f.stage = s.stage),
verdicts AS (SELECT m.dbt_task_run_id,
    CASE WHEN count(code) = 0 THEN 'PAIR_VALID' ELSE 'PAIR_INVALID' END AS pair_state,
    coalesce(list(code ORDER BY rank) FILTER (code IS NOT NULL), []) AS issue_codes,
    arg_min(code, rank) AS primary_code
  FROM document_meta m LEFT JOIN shown USING (dbt_task_run_id) GROUP BY 1)"""
ALL = ["document_meta", "result_rows", "inventory"]


def _judge(t):
    return pairs.judge(t.document_meta, t.result_rows, t.inventory, KEYS)


@query("sort_issues", ALL, f"WITH {RESOLVED}, {STATUS}, {_STAGES} SELECT * FROM verdicts")
def _(t):
    return _judge(t)


@query("pair_report", ALL, f"""WITH {RESOLVED}, {STATUS}, {_STAGES},
catalogue AS (SELECT unnest({[list(row) for row in pairs.ISSUE_CATALOGUE]!r}) AS c),
issues AS (SELECT dbt_task_run_id, string_agg('{{"code":"' || c[1] || '","component":"' || c[2]
    || '","field":"' || c[3] || '","observed_category":"' || c[4] || '"}}', ',' ORDER BY rank) AS text
  FROM shown JOIN catalogue ON c[1] = code GROUP BY 1),
per_status AS (SELECT dbt_task_run_id, status, count(*) AS n FROM result_rows GROUP BY 1, 2),
summed AS (SELECT dbt_task_run_id, CAST(sum(n) AS BIGINT) AS result_count,
    '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS status_counts
  FROM per_status GROUP BY 1)
SELECT v.dbt_task_run_id, pair_state,
  CASE pair_state WHEN 'PAIR_INVALID' THEN '{{"issues":[' || i.text || '],"state":"PAIR_INVALID"}}'
    ELSE '{{"state":"PAIR_VALID","summary":{{"adapter_type":"databricks","command":"build",'
      || '"dbt_version":"1.11.12","result_count":' || result_count || ',"status_counts":"'
      || replace(status_counts, '"', '\\"') || '"}}}}' END AS report_json
FROM verdicts v LEFT JOIN summed USING (dbt_task_run_id) LEFT JOIN issues i USING (dbt_task_run_id)""")
def _(t):
    counts = health.status_counts(t.result_rows, KEYS)
    return pairs.report(_judge(t), counts, KEYS)


@query("pair_project", ALL, f"""WITH {RESOLVED}, {STATUS}, {_STAGES}
SELECT r.dbt_task_run_id, m.run_results_invocation AS invocation_id, r.unique_id, h.resource_type,
  r.status, r.execution_time, r.failures
FROM verdicts v JOIN result_rows r USING (dbt_task_run_id) JOIN document_meta m USING (dbt_task_run_id)
JOIN hits h ON h.dbt_task_run_id = r.dbt_task_run_id AND h.unique_id = r.unique_id
WHERE v.pair_state = 'PAIR_VALID'""")
def _(t):
    return pairs.project(_judge(t), t.document_meta, t.result_rows, t.inventory, KEYS)


@query("join_pair_by_invocation", ["document_meta"], f"""
SELECT dbt_task_run_id, CASE WHEN {_ANYBAD} THEN NULL ELSE {_M} = {_R} END AS same_invocation
FROM document_meta""")
def _(t):
    manifest = t.document_meta.select(*KEYS, normal_uuid(F.col("manifest_invocation")).alias("m"))
    results = t.document_meta.select(*KEYS, normal_uuid(F.col("run_results_invocation")).alias("r"))
    return manifest.join(results, KEYS).select(
        *KEYS, (F.col("m") == F.col("r")).alias("same_invocation"))


# ---- documents as bytes ----------------------------------------------------------------------

def _raw(t, meta=None, carried=()):
    """Both documents of every attempt as bytes, from its scalar facts and one result.

    ``meta`` stands for ``t.document_meta`` with the columns ``carried`` beside.
    """
    def opt(col):
        return F.col(col)

    result = F.struct(
        F.lit("success").alias("status"), F.array(F.struct(F.lit("execute").alias("name")))
        .alias("timing"), F.lit("Thread-1").alias("thread_id"),
        F.when(F.col("cents") % 59 == 1, F.lit("slow")).otherwise("1.5").alias("execution_time"),
        F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        .alias("adapter_response"),
        F.lit("canary-message").alias("message"),
        F.when(F.col("cents") % 59 == 2, F.lit(-1)).alias("failures"),
        F.lit("model.shop.a").alias("unique_id"), F.lit(True).alias("compiled"),
        F.lit("select 'canary-sql'").alias("compiled_code"),
        F.lit("canary.relation").alias("relation_name"))
    zeros = F.array_repeat(F.lit("x"), F.col("select_count"))
    run = F.struct(
        F.struct(opt("run_results_schema").alias("dbt_schema_version"),
                 opt("run_results_version").alias("dbt_version"),
                 opt("run_results_generated_at").alias("generated_at"),
                 opt("run_results_invocation").alias("invocation_id")).alias("metadata"),
        F.array(result).alias("results"), F.col("elapsed_time"),
        F.struct("which", "selector", zeros.alias("select"),
                 F.array_repeat(F.lit("y"), F.col("exclude_count")).alias("exclude"),
                 "indirect_selection", "full_refresh").alias("args"))
    entry = F.create_map(F.lit("model.shop.a"), F.struct(
        F.lit("model.shop.a").alias("unique_id"), F.lit("model").alias("resource_type")))
    none = F.map_filter(entry, lambda k, v: F.lit(False))
    maps = [entry.alias("nodes")] + [none.alias(c) for c in artifacts.COLLECTIONS if c != "nodes"]
    man = F.struct(
        F.struct(opt("manifest_schema").alias("dbt_schema_version"),
                 opt("manifest_version").alias("dbt_version"), "adapter_type",
                 opt("manifest_invocation").alias("invocation_id"),
                 opt("manifest_generated_at").alias("generated_at")).alias("metadata"), *maps)
    keep = {"ignoreNullFields": "false"}
    text = F.regexp_replace(F.to_json(run, keep), '"execution_time":"1.5"', '"execution_time":1.5')
    text = F.regexp_replace(text, '"dbt_version":null,', "")
    text = F.when(F.col("cents") % 59 == 3, F.concat(text, F.lit(" trailing"))).when(
        F.col("cents") % 59 == 4, F.regexp_replace(text, r"^\{", '{"args":{},')).otherwise(text)
    return (t.document_meta if meta is None else meta).select(
        *KEYS, *carried, F.encode(F.to_json(man, keep), "UTF-8").alias("manifest"),
        F.encode(text, "UTF-8").alias("run_results"))


@query("src_artifact_json", ["document_meta"], """
SELECT dbt_task_run_id, manifest_schema, run_results_schema, manifest_version, run_results_version, adapter_type, manifest_invocation,
  run_results_invocation, manifest_generated_at, run_results_generated_at, elapsed_time,
  which, selector, select_count, exclude_count,
  indirect_selection, CASE WHEN full_refresh THEN 'true' WHEN NOT full_refresh THEN 'false' END
  AS full_refresh,
  CASE WHEN cents % 59 = 3 THEN 'INVALID' WHEN cents % 59 = 4 THEN 'DUPLICATE_KEY' ELSE 'OK' END
  AS run_results_parse, 'OK' AS manifest_parse FROM document_meta""")
def _(t):
    meta = artifacts.pair_meta(_raw(t), KEYS)
    return meta.drop("manifest_bytes", "manifest_depth", "run_results_bytes", "run_results_depth",
                     "manifest_schema_valid", "run_results_schema_valid")


@query("pair_schema_gate", ["document_meta"], """
SELECT dbt_task_run_id, TRUE AS manifest_schema_valid,
  cents % 59 NOT IN (1, 4) AS run_results_schema_valid FROM document_meta""")
def _(t):
    meta = artifacts.pair_meta(_raw(t), KEYS)
    return meta.select(*KEYS, "manifest_schema_valid", "run_results_schema_valid")


@query("fn_json_strict", ["query_history"], """
SELECT query_no, CASE status WHEN 'FINISHED' THEN 'OK' WHEN 'FAILED' THEN 'DUPLICATE_KEY'
  ELSE 'INVALID' END AS verdict FROM query_history""")
def _(t):
    body = F.concat(F.lit('{"marker":"'), F.col("marker"), F.lit('","nested":{"n":[1,2.5e3]}'))
    text = (
        F.when(F.col("status") == "FINISHED", F.concat(body, F.lit("}")))
        .when(F.col("status") == "FAILED", F.concat(body, F.lit(',"marker":1}')))
        .when(F.col("status") == "CANCELED", F.concat(body, F.lit("} tail")))
        .when(F.col("status") == "RUNNING", F.concat(body, F.lit(',"x":NaN}')))
        .otherwise(F.concat(F.lit("["), body, F.lit("}]")))
    )
    return t.query_history.select(
        "query_no", docs.strict_verdict(F.encode(text, "UTF-8")).alias("verdict"))


_BARE = r"""regexp_replace(regexp_replace(body, '(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)', '', 'g'), '[^\[\]{}]+', '', 'g')"""


@query("fn_json_depth", None, f"""
WITH texts AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages
  UNION ALL SELECT 'document', doc_id, text FROM documents
  UNION ALL SELECT 'event', event_id, '[' || props || ',{{"x":[' || props || ']}}]' FROM events),
steps AS (SELECT kind, id, string_split({_BARE}, '') AS s FROM texts)
SELECT kind, id, CAST(list_reduce(list_transform(s, lambda c: struct_pack(
    d := CASE WHEN c IN ('[', '{{') THEN 1 WHEN c IN (']', '}}') THEN -1 ELSE 0 END, m := 0)),
  lambda a, b: struct_pack(d := greatest(a.d + b.d, 0), m := greatest(a.m, a.d + b.d)),
  struct_pack(d := 0, m := 0)).m AS INT) AS depth FROM steps""")
def _(t):
    pages = t.base("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                   F.col("html").alias("body"))
    prose = t.base("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
                                       F.col("text").alias("body"))
    nested = F.concat(F.lit("["), "props", F.lit(',{"x":['), "props", F.lit("]}]"))
    events = t.base("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"),
                                     nested.alias("body"))
    texts = pages.unionByName(prose).unionByName(events)
    return texts.select("kind", "id", docs.json_depth(F.col("body")).alias("depth"))


@query("fn_sha256", None, """
SELECT 'document' AS kind, doc_id AS id, sha256(text) AS digest, strlen(text) AS bytes FROM documents
UNION ALL SELECT 'page', page_id, sha256(html), strlen(html) FROM pages""")
def _(t):
    def hashed(table, kind, key, text):
        return t.base(table).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"),
            docs.sha256(F.col(text)).alias("digest"),
            F.octet_length(text).cast("bigint").alias("bytes"))

    return hashed("documents", "document", "doc_id", "text").unionByName(
        hashed("pages", "page", "page_id", "html"))


@query("fn_canonical_json", ["registry"], """
SELECT dbt_task_run_id, '{"capture_state":"' || capture_state || '","issue_code":'
  || coalesce('"' || issue_code || '"', 'null') || ',"logs_truncated":'
  || coalesce(CAST(logs_truncated AS STRING), 'null') || ',"pair_state":'
  || coalesce('"' || pair_state || '"', 'null') || ',"run":{"job":' || observed_job_id || ',"repair":'
  || repair_count || '}}' AS canonical FROM registry""")
def _(t):
    run = F.struct(F.col("observed_job_id").alias("job"), F.col("repair_count").alias("repair"))
    fields = {"run": run, **{c: F.col(c) for c in ("pair_state", "capture_state", "issue_code",
                                                   "logs_truncated")}}
    return t.registry.select("dbt_task_run_id", docs.canonical_json(fields).alias("canonical"))


@query("cap_manifest_standalone", ["document_meta"], f"""
SELECT dbt_task_run_id, NOT (coalesce({SIZE['DBT_MANIFEST_SIZE_LIMIT_EXCEEDED']}, FALSE)
  OR manifest_depth > 256 OR manifest_parse <> 'OK' OR NOT manifest_schema_valid
  OR manifest_schema <> '{POLICY['manifest_schema']}' OR manifest_version <> '1.11.12'
  OR adapter_type <> 'databricks' OR {_TS.format(c='manifest_generated_at')}
  OR {_BAD.format(h=_M)}) AS standalone_valid FROM document_meta""")
def _(t):
    from runlumen.operators.evidence import manifest_standalone

    return t.document_meta.select(*KEYS, manifest_standalone().alias("standalone_valid"))
