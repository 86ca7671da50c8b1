"""Registered queries: tables, catalog contracts, grants, trees and staged files."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.operators import catalog
from runlumen.plans.book import query
from runlumen.plans.publication import SET_DIGEST
from runlumen.schemas import INVOCATION_COLUMNS, NODE_COLUMNS, REGISTRY_COLUMNS
from runlumen.session import scratch
from runlumen.sources import evidence
from runlumen.sources.tables import typed_rows


@query("src_evidence_files", ["evidence_files"], r"""
WITH c AS (SELECT *, regexp_extract(path, 'incoming/([^/]+)/', 1) AS attempt_key,
    regexp_extract(path, '[^/]+$') AS base FROM evidence_files),
g AS (SELECT attempt_key, count(*) FILTER (base = 'manifest.json') AS manifest_files,
    count(*) FILTER (base = 'run_results.json') AS run_results_files,
    count(*) FILTER (base LIKE 'dbt.log%' AND base <> 'dbt.log.6') AS log_files,
    CAST(sum(length) FILTER (base <> 'dbt.log.6') AS BIGINT) AS total_bytes,
    coalesce(bool_or(length > CASE WHEN base LIKE 'dbt.log%' THEN 20971520 ELSE 134217728 END)
      FILTER (base <> 'dbt.log.6'), FALSE) AS too_large FROM c GROUP BY 1)
SELECT *, CASE WHEN manifest_files = 0 THEN 'DBT_VOLUME_ARTIFACT_UNAVAILABLE'
  WHEN too_large THEN 'DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED'
  WHEN run_results_files = 0 THEN 'DBT_VOLUME_ARTIFACT_UNAVAILABLE' END AS error_code FROM g""")
def _(t):
    return evidence.attempt_evidence(evidence.classify(t.evidence_files))


_STAGED = """staged AS (SELECT c_custkey, slot,
    CAST(100 + c_custkey % 50 - CASE WHEN c_custkey % 13 = 5 AND slot = 'manifest' OR c_custkey % 17 = 3
      AND slot = 'log' THEN 1 ELSE 0 END AS BIGINT) AS read_size,
    CAST(CASE WHEN c_custkey % 19 = 4 AND slot = 'run_results' THEN 134217729 ELSE 100 + c_custkey % 50 END AS BIGINT)
      AS declared_size
  FROM customer CROSS JOIN (VALUES ('manifest'), ('run_results'), ('log')) s(slot)
  WHERE NOT (slot = 'manifest' AND c_custkey % 11 = 2) AND NOT (slot = 'run_results' AND c_custkey % 7 = 1)
    AND NOT (slot = 'log' AND c_custkey % 5 = 4))"""


@query("src_evidence_read", None, f"""WITH {_STAGED},
g AS (SELECT c_custkey, count(*) AS files, CAST(sum(read_size) AS BIGINT) AS read_bytes,
    coalesce(bool_or(slot = 'manifest'), FALSE) AS m, coalesce(bool_or(slot = 'run_results'), FALSE) AS r,
    coalesce(bool_or(slot = 'manifest' AND read_size <> declared_size), FALSE) AS m_bad,
    coalesce(bool_or(read_size <> declared_size), FALSE) AS bad FROM staged GROUP BY 1)
SELECT 'w1-j1-r1-t' || (c_custkey + 1) || '-p0-e1' AS attempt_key, files, read_bytes,
  CASE WHEN NOT m THEN 'DBT_VOLUME_ARTIFACT_UNAVAILABLE' WHEN m_bad THEN 'DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED'
    WHEN NOT r THEN 'DBT_VOLUME_ARTIFACT_UNAVAILABLE' WHEN bad THEN 'DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED' END
    AS error_code FROM g""")
def _(t):
    """Files of one attempt per customer, staged and read back; some are short, some declared too large."""
    key = F.col("c_custkey")
    tails = {"manifest": "001-build/artifacts/manifest.json", "run_results": "001-build/artifacts/run_results.json",
             "log": "001-build/logs/dbt.log"}
    gone = {"manifest": key % 11 == 2, "run_results": key % 7 == 1, "log": key % 5 == 4}
    short = ((F.col("slot") == "manifest") & (key % 13 == 5)) | ((F.col("slot") == "log") & (key % 17 == 3))
    huge = (F.col("slot") == "run_results") & (key % 19 == 4)
    size = (F.lit(100) + key % 50).cast("int")
    slots = F.array(*(F.when(~gone[s], F.struct(F.lit(s).alias("slot"), F.lit(p).alias("tail"))) for s, p in tails.items()))
    folder = f"{scratch(t.spark, 'stage')}"
    base = folder if "://" in folder or folder.startswith("file:") else f"file:{folder}"
    staged = t.base("customer").select("c_custkey", F.inline(F.array_compact(slots))).select(
        F.concat(F.lit("incoming/w1-j1-r1-t"), (key + 1).cast("string"), F.lit("-p0-e1/"), "tail").alias("path"),
        F.repeat(F.lit("x"), size - F.when(short, 1).otherwise(0)).cast("binary").alias("content"),
        F.when(huge, 134217729).otherwise(size).cast("bigint").alias("length"))
    evidence.write_files(staged, folder)
    listing = staged.select(F.concat(F.lit(f"{base}/"), "path").alias("path"), "length")
    files = evidence.classify(evidence.read_files(t.spark, folder))
    return evidence.retrieval(evidence.verified(files, listing), ["attempt_key"])


@query("src_tree_digest", None, f"""
SELECT source, {SET_DIGEST} AS tree_sha256, count(*) AS file_count FROM (
  SELECT source, sha256(lang || '/' || doc_id || '|' || sha256(text)) AS h FROM documents) x
GROUP BY source""")
def _(t):
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    files = t.base("documents").withColumn("path", path)
    return evidence.tree_digest(files, ["source"], "path", "text")


@query("cmp_tree_attest", ["tree_expected", "tree_observed"], """
WITH o AS (SELECT path, count(*) AS n, min(file_sha256) AS h FROM tree_observed
  WHERE NOT regexp_matches(path, '^(logs|target)(/|$)') GROUP BY 1)
SELECT coalesce(o.path, e.path) AS path, CASE WHEN e.path IS NULL THEN 'EXTRA' WHEN o.path IS NULL
  THEN 'MISSING' WHEN n > 1 THEN 'DUPLICATE' WHEN h <> e.file_sha256 THEN 'CHANGED' ELSE 'OK' END AS verdict
FROM o FULL JOIN tree_expected e ON e.path = o.path""")
def _(t):
    return catalog.tree_attest(t.tree_observed, t.tree_expected)


@query("set_equality", ["tree_expected", "tree_observed"], """
WITH o AS (SELECT DISTINCT path FROM tree_observed), e AS (SELECT DISTINCT path FROM tree_expected),
m AS (SELECT count(*) AS missing FROM (SELECT path FROM e EXCEPT SELECT path FROM o) x),
u AS (SELECT count(*) AS unexpected FROM (SELECT path FROM o EXCEPT SELECT path FROM e) x)
SELECT missing, unexpected, missing = 0 AND unexpected = 0 AS equal FROM m, u""")
def _(t):
    return catalog.set_equal(t.tree_observed.select("path"), t.tree_expected.select("path"))


@query("cat_grant_audit", ["grants"], """
SELECT object_name, principal, action_type, lower(object_type) AS type_key, lower(object_key) AS object_id,
  count(*) AS copies, CASE WHEN count(*) > 1 THEN 'DUPLICATE'
    WHEN lower(object_type) = 'table' AND lower(object_key) = 'main.evidence.' || object_name THEN 'DIRECT'
    WHEN lower(object_type) IN ('schema', 'database') AND lower(object_key) = 'main.evidence'
      OR lower(object_type) = 'catalog' AND lower(object_key) = 'main' THEN 'INHERITED'
    ELSE 'INVALID' END AS verdict
FROM grants GROUP BY object_name, principal, action_type, lower(object_type), lower(object_key)""")
def _(t):
    return catalog.grant_audit(t.grants, "main", "evidence")


@query("cat_inventory", None, """
WITH o AS (SELECT lower(s_name) AS name, 1 AS n FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT lower(s_name), 1 FROM supplier WHERE s_nationkey = 3),
e AS (SELECT lower(s_name) AS name FROM supplier WHERE s_nationkey <> 7)
SELECT coalesce(g.name, e.name) AS name, CASE WHEN e.name IS NULL THEN 'UNKNOWN' WHEN g.name IS NULL
  THEN 'MISSING' WHEN seen > 1 THEN 'DUPLICATE' ELSE 'OK' END AS verdict
FROM (SELECT name, count(*) AS seen FROM o GROUP BY 1) g FULL JOIN e ON e.name = g.name""")
def _(t):
    supplier = t.base("supplier")
    names = supplier.filter("s_acctbal >= 0").select(F.col("s_name").alias("name"))
    again = supplier.filter("s_nationkey = 3").select(F.upper("s_name").alias("name"))
    expected = supplier.filter("s_nationkey <> 7").select(F.col("s_name").alias("name"))
    return catalog.inventory_check(names.unionByName(again), expected)


def _columns(t):
    """Column listings as rows: twenty columns per relation, from the part table."""
    key = F.col("p_partkey")
    return t.base("part").select(
        F.concat(F.lit("rel_"), (key - key % 20).cast("string")).alias("relation"),
        (key % 20).cast("int").alias("ordinal"), F.col("p_name").alias("column_name"),
        F.col("p_type").alias("column_type"), "p_size")


_COLUMNS = """SELECT 'rel_' || (p_partkey - p_partkey % 20) AS relation, CAST(p_partkey % 20 AS INT) AS ordinal,
  p_name AS column_name, p_type AS column_type, p_size FROM part"""


@query("cat_schema_drift", None, f"""WITH c AS ({_COLUMNS}),
o AS (SELECT relation, ordinal, column_name, CASE WHEN p_size = 2 THEN 'BINARY' ELSE column_type END AS column_type
  FROM c WHERE p_size <> 1),
e AS (SELECT relation, ordinal, CASE WHEN p_size = 4 THEN 'renamed' ELSE column_name END AS column_name, column_type
  FROM c WHERE p_size <> 3)
SELECT * FROM (SELECT coalesce(o.relation, e.relation) AS relation, coalesce(o.ordinal, e.ordinal) AS ordinal,
  o.column_name AS observed_name, o.column_type AS observed_type, e.column_name AS expected_name,
  e.column_type AS expected_type, CASE WHEN e.relation IS NULL THEN 'EXTRA' WHEN o.relation IS NULL THEN 'MISSING'
    WHEN o.column_name <> e.column_name THEN 'NAME' WHEN o.column_type <> e.column_type THEN 'TYPE' END AS drift
FROM o FULL JOIN e ON o.relation = e.relation AND o.ordinal = e.ordinal) d WHERE drift IS NOT NULL""")
def _(t):
    size = F.col("p_size")
    observed = _columns(t).filter(size != 1).withColumn(
        "column_type", F.when(size == 2, "BINARY").otherwise(F.col("column_type")))
    expected = _columns(t).filter(size != 3).withColumn(
        "column_name", F.when(size == 4, "renamed").otherwise(F.col("column_name")))
    return catalog.schema_drift(observed, expected)


@query("cat_contract_digest", None, f"""
SELECT relation, sha256('[' || string_agg('["' || column_name || '","' || column_type || '"]', ','
    ORDER BY ordinal) || ']') AS contract_sha256, count(*) AS column_count FROM ({_COLUMNS}) c GROUP BY 1""")
def _(t):
    return catalog.contract_digest(_columns(t))


@query("sink_tables", ["registry", "invocations", "nodes"], f"""
SELECT 'registry' AS table_name, {len(REGISTRY_COLUMNS)} AS column_count, count(*) AS row_count,
  min(dbt_task_run_id) AS first_run, max(dbt_task_run_id) AS last_run FROM registry
UNION ALL SELECT 'invocations', {len(INVOCATION_COLUMNS)}, count(*), min(dbt_task_run_id),
  max(dbt_task_run_id) FROM invocations
UNION ALL SELECT 'node_results', {len(NODE_COLUMNS)}, count(*), min(dbt_task_run_id), max(dbt_task_run_id)
FROM nodes""")
def _(t):
    folder = scratch(t.spark, "sink")
    database = folder.rsplit("/", 1)[1].replace("-", "_")
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    catalog.create_tables(t.spark, database, "contract-v1")
    parts = []
    for name, rows in (("registry", t.registry), ("invocations", t.invocations),
                       ("node_results", t.nodes)):
        table = f"{database}.{name}"
        typed_rows(rows, name).write.mode("overwrite").insertInto(table)
        stored = t.spark.table(table)
        parts.append(stored.agg(
            F.lit(name).alias("table_name"), F.lit(len(stored.columns)).alias("column_count"),
            F.count("*").alias("row_count"), F.min("dbt_task_run_id").alias("first_run"),
            F.max("dbt_task_run_id").alias("last_run")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
