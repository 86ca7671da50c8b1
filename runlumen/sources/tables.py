"""Table sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.schemas import INVOCATION_SCHEMA, MANIFEST_SCHEMA, NODE_SCHEMA, REGISTRY_SCHEMA, fields

SCHEMAS = {"registry": REGISTRY_SCHEMA, "invocations": INVOCATION_SCHEMA,
           "node_results": NODE_SCHEMA, "object_manifest": MANIFEST_SCHEMA}


def typed_rows(rows: DataFrame, table: str) -> DataFrame:
    """Bring rows to the fixed columns and types of a table; a missing column is an error.

    Timestamps without a zone keep their type so that wall-clock values never shift.
    """
    known = dict(rows.dtypes)
    columns = []
    for name, kind in fields(SCHEMAS[table]):
        keep = kind == "timestamp" and known[name] == "timestamp_ntz"
        columns.append(F.col(name) if keep else F.col(name).cast(kind).alias(name))
    return rows.select(*columns)


def create_rows(spark: SparkSession, rows: list, table: str) -> DataFrame:
    """Rows handed over by a caller, typed by the explicit schema and never inferred."""
    return spark.createDataFrame(rows, SCHEMAS[table])


def key_cardinality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key for all keys at once; more than one row is a duplicate root."""
    count = F.count("*")
    return df.groupBy(*keys).agg(count.alias("row_count")).withColumn(
        "error_code", F.when(F.col("row_count") > 1, "ATTEMPT_ROOT_DUPLICATE"))


def seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row and an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
