"""Tables, views and catalog checks: create once, then compare what is there with the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.operators import health
from runlumen.schemas import ATTEMPT_KEY, fields
from runlumen.sources.tables import SCHEMAS

TABLE_NAMES = ["registry", "invocations", "node_results", "object_manifest"]
VIEW_NAMES = ["run_health", "node_health", "collection_health"]


def publish_views(spark: SparkSession, registry: DataFrame, invocations: DataFrame,
                  nodes: DataFrame) -> None:
    """The three health views as session views."""
    health.run_health(registry, invocations).createOrReplaceTempView("run_health")
    health.node_health(registry, nodes).createOrReplaceTempView("node_health")
    health.collection_health(registry).createOrReplaceTempView("collection_health")


def create_tables(spark: SparkSession, database: str, contract: str, buckets: int = 8) -> None:
    """Create the four tables once; evidence is bucketed by attempt so that joins on it need no shuffle.

    All absent: create. All present: verify them against the contract. A part present, or a table that
    differs: an error that says what.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    present = [n for n in TABLE_NAMES if spark.catalog.tableExists(f"{database}.{n}")]
    if not present:
        for name in TABLE_NAMES:
            keyed = set(ATTEMPT_KEY) <= {c for c, _ in fields(SCHEMAS[name])}
            layout = f"CLUSTERED BY ({', '.join(ATTEMPT_KEY)}) INTO {buckets} BUCKETS" if keyed else ""
            spark.sql(
                f"CREATE TABLE {database}.{name} ({SCHEMAS[name]}) USING parquet {layout} "
                f"TBLPROPERTIES ('contract.digest'='{contract}', 'contract.role'='{name}')")
    elif len(present) < len(TABLE_NAMES):
        raise RuntimeError("PARTIAL_SCHEMA_STATE")
    found = drift(described(spark, database, TABLE_NAMES), table_contract(spark, contract)).collect()
    if found:
        told = ", ".join(sorted(f"{r['relation']}.{r['aspect']}:{r['drift']}" for r in found))
        raise RuntimeError(f"SCHEMA_STATE_DRIFT {told}")


#: Aspects of a relation as rows: its kind, provider, owner, view text, properties by key, columns by place.
ASPECTS = "relation STRING, aspect STRING, name STRING, value STRING"


def table_contract(spark: SparkSession, contract: str) -> DataFrame:
    """Aspect rows that the four tables must have."""
    rows = []
    for table in TABLE_NAMES:
        rows += [(table, "type", "", "MANAGED"), (table, "provider", "", "parquet"),
                 (table, "property", "contract.digest", contract), (table, "property", "contract.role", table)]
        rows += [(table, "column", f"{i:04d}", f"{name} {kind}") for i, (name, kind) in enumerate(fields(SCHEMAS[table]))]
    return spark.createDataFrame(rows, ASPECTS)


def described(spark: SparkSession, database: str, names: list[str]) -> DataFrame:
    """Aspect rows of relations as the catalog describes them; one description per named relation."""
    raw = [(n, spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{n} AS JSON").first()[0]) for n in names]
    found = spark.createDataFrame(raw, "relation STRING, raw STRING").withColumn("d", F.from_json("raw", (
        "type STRING, provider STRING, owner STRING, view_text STRING, table_properties MAP<STRING, STRING>, "
        "columns ARRAY<STRUCT<name: STRING, type: STRUCT<name: STRING>>>")))
    d = F.col("d")

    def rows(aspect: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(aspect).alias("aspect"), name.alias("name"), value.alias("value"))

    single = [rows(a, F.lit(""), d[a]) for a in ("type", "provider", "owner")]
    single.append(rows("view_text", F.lit(""), folded_sql(d["view_text"])))
    properties = F.transform(F.map_entries(F.coalesce(d["table_properties"], F.create_map().cast("map<string,string>"))),
                             lambda e: rows("property", e["key"], e["value"]))
    columns = F.transform(d["columns"], lambda c, i: rows(
        "column", F.lpad(i.cast("string"), 4, "0"), F.lower(F.concat(
            c["name"], F.lit(" "), F.regexp_replace(c["type"]["name"], "_ltz$", "")))))
    every = F.concat(F.array(*single), properties, columns)
    return found.select("relation", F.inline(every)).filter("value is not null")


def drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Aspects that differ: MISSING, EXTRA (of properties and columns) or CHANGED; empty if all agree.

    Owners and whatever else the contract does not name for a relation are not compared.
    """
    key = ["relation", "aspect", "name"]
    bound = expected.select("relation", "aspect").distinct()
    seen = observed.join(bound, ["relation", "aspect"], "left_semi")
    o, e = seen.withColumnRenamed("value", "observed"), expected.withColumnRenamed("value", "expected")
    told = (F.when(F.col("observed").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA")
            .when(F.col("observed") != F.col("expected"), "CHANGED"))
    return o.join(e, key, "full").withColumn("drift", told).filter(F.col("drift").isNotNull())


def set_digest_of(aspects: DataFrame) -> DataFrame:
    """One digest over all relations, their kinds, columns, properties and view texts, in a fixed order.

    The rows of a contract are few: a bounded number of relations with a bounded number of aspects.
    """
    one = F.struct("aspect", "name", "value")
    per_relation = aspects.groupBy("relation").agg(F.array_sort(F.collect_list(one)).alias("aspects"))
    whole = F.array_sort(F.collect_list(F.struct("relation", "aspects")))
    return per_relation.agg(F.sha2(F.to_json(whole), 256).alias("contract_sha256"), F.count("*").alias("relations"))


def inventory_check(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed and expected names, compared without case: OK, UNKNOWN, DUPLICATE or MISSING."""
    seen = observed.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("seen"))
    want = expected.select(F.lower("name").alias("name")).distinct().withColumn(
        "wanted", F.lit(True))
    verdict = (
        F.when(F.col("wanted").isNull(), "UNKNOWN")
        .when(F.col("seen").isNull(), "MISSING")
        .when(F.col("seen") > 1, "DUPLICATE")
        .otherwise("OK")
    )
    return seen.join(want, "name", "full").select("name", verdict.alias("verdict"))


def set_equal(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: sizes of both differences and whether the two sets are equal."""
    left = observed.distinct().withColumn("o", F.lit(1))
    right = expected.distinct().withColumn("e", F.lit(1))
    joined = left.join(right, observed.columns, "full")
    missing, extra = F.count_if(F.col("o").isNull()), F.count_if(F.col("e").isNull())
    return joined.agg(missing.alias("missing"), extra.alias("unexpected")).withColumn(
        "equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def schema_drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Ordered comparison of two column listings; empty when the schemas agree."""
    key = ["relation", "ordinal"]
    o = observed.select(*key, F.col("column_name").alias("observed_name"),
                        F.col("column_type").alias("observed_type"))
    e = expected.select(*key, F.col("column_name").alias("expected_name"),
                        F.col("column_type").alias("expected_type"))
    drift = (
        F.when(F.col("expected_name").isNull(), "EXTRA")
        .when(F.col("observed_name").isNull(), "MISSING")
        .when(F.col("observed_name") != F.col("expected_name"), "NAME")
        .when(F.col("observed_type") != F.col("expected_type"), "TYPE")
    )
    return o.join(e, key, "full").withColumn("drift", drift).filter(F.col("drift").isNotNull())


def folded_sql(text: Column) -> Column:
    """Statement text with lower case and single spaces outside quoted literals."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s*;$", "")
    # pieces alternate between outside and inside of single quotes
    pieces = F.split(bare, "'")
    folded = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 0, F.lower(F.regexp_replace(p, r"\s+", " "))).otherwise(p),
    )
    return F.array_join(folded, "'")


def contract_digest(columns: DataFrame) -> DataFrame:
    """SHA-256 over the canonical text of an ordered column listing, one row per relation.

    A relation has a fixed, small number of columns, so the ordered list of one is bounded.
    """
    entry = F.struct("ordinal", "column_name", "column_type")
    ordered = F.array_sort(F.collect_list(entry))
    body = F.transform(ordered, lambda c: F.array(c["column_name"], c["column_type"]))
    return columns.groupBy("relation").agg(
        F.sha2(F.to_json(body), 256).alias("contract_sha256"),
        F.count("*").alias("column_count"))


def grant_audit(grants: DataFrame, catalog: str, schema: str) -> DataFrame:
    """Each grant row as DIRECT, INHERITED, DUPLICATE or INVALID; only INHERITED is accepted."""
    key = ["object_name", "principal", "action_type", "type_key", "object_id"]
    rows = grants.select(
        "object_name", "principal", "action_type",
        F.lower("object_type").alias("type_key"), F.lower("object_key").alias("object_id"),
    )
    own = F.concat(F.lit(f"{catalog}.{schema}."), F.lower("object_name"))
    inherited = (
        (F.col("type_key").isin("schema", "database") & (F.col("object_id") == f"{catalog}.{schema}"))
        | ((F.col("type_key") == "catalog") & (F.col("object_id") == catalog))
    )
    verdict = (
        F.when(F.col("copies") > 1, "DUPLICATE")
        .when((F.col("type_key") == "table") & (F.col("object_id") == own), "DIRECT")
        .when(inherited, "INHERITED")
        .otherwise("INVALID")
    )
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("verdict", verdict)


def tree_attest(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two (path, file_sha256) sets; generated folders are left out of the observed one."""
    seen = observed.filter(~F.substring_index("path", "/", 1).isin("logs", "target"))
    seen = seen.groupBy("path").agg(
        F.count("*").alias("copies"), F.min("file_sha256").alias("observed_sha256"))
    want = expected.select("path", F.col("file_sha256").alias("expected_sha256"))
    verdict = (
        F.when(F.col("expected_sha256").isNull(), "EXTRA")
        .when(F.col("observed_sha256").isNull(), "MISSING")
        .when(F.col("copies") > 1, "DUPLICATE")
        .when(F.col("observed_sha256") != F.col("expected_sha256"), "CHANGED")
        .otherwise("OK")
    )
    return seen.join(want, "path", "full").select("path", verdict.alias("verdict"))
