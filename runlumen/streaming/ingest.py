"""Streaming ingestion: from staged files to published rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.functions.documents import sha256
from runlumen.functions.labels import parsed_attempt_key
from runlumen.operators import health, pairs
from runlumen.operators.store import NAMED, Partitions, publish
from runlumen.schemas import INVOCATION_SCHEMA, NODE_SCHEMA, REGISTRY_SCHEMA, fields
from runlumen.session import passing, settings, stage
from runlumen.sources import artifacts, evidence

KEYS = ["attempt_key"]
#: Streams start without adaptive execution; what a batch runs needs it, to size shuffles by their rows.
BATCH_SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
Records = tuple[DataFrame, DataFrame, DataFrame]


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """All columns of a table schema, null where ``rows`` does not have them."""
    return rows.select(*(
        (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields(schema)))


def records(raw: DataFrame) -> Records:
    """Roots, invocations and nodes of attempts from both documents (attempt_key, manifest, run_results)."""
    meta = stage(artifacts.pair_meta(raw, KEYS), "document-facts")
    results = stage(artifacts.result_rows(raw, KEYS), "document-results")
    inventory = stage(artifacts.inventory_rows(raw, KEYS), "document-entries")
    verdicts = stage(pairs.judge(meta, results, inventory, KEYS), "verdicts")
    nodes = pairs.project(verdicts, meta, results, inventory, KEYS)
    counts = health.status_counts(results, KEYS)
    named = raw.select(*KEYS, parsed_attempt_key(F.col("attempt_key")).alias("k"),
                       sha256(F.col("manifest")).alias("manifest_sha256"),
                       sha256(F.col("run_results")).alias("run_results_sha256"))
    axes = {"workspace_id": "workspace_id", "job_id": "observed_job_id", "job_run_id": "observed_job_run_id",
            "task_run_id": "dbt_task_run_id", "repair_count": "repair_count", "execution_count": "execution_count"}
    named = named.filter("k is not null").select(
        *KEYS, *(F.col(f"k.{axis}").alias(name) for axis, name in axes.items()), "manifest_sha256", "run_results_sha256",
        sha256(F.concat_ws("|", "manifest_sha256", "run_results_sha256")).alias("normalized_digest"))
    valid = F.col("pair_state") == "PAIR_VALID"
    facts = named.join(verdicts, KEYS).join(meta, KEYS).join(counts, KEYS, "left")
    roots = facts.select(
        "*", F.lit("COMPLETE").alias("capture_state"), F.col("primary_code").alias("issue_code"),
        F.col("manifest_bytes").alias("manifest_size_bytes"), F.col("run_results_bytes").alias("run_results_size_bytes"),
        F.when(valid, F.col("run_results_invocation")).alias("invocation_id"),
        F.when(valid, F.col("result_count")).otherwise(F.lit(0)).alias("expected_node_count"),
        F.lit("COLLECTING").alias("collector_state"), F.lit(1).alias("collection_attempt_count"))
    invocations = facts.filter(valid).select(
        "*", F.col("run_results_invocation").alias("invocation_id"),
        F.col("run_results_generated_at").alias("generated_at"), F.col("run_results_version").alias("dbt_version"),
        F.col("which").alias("command"))
    bound = named.select(*KEYS, "workspace_id", "dbt_task_run_id", "normalized_digest")
    return (_shaped(roots, REGISTRY_SCHEMA), _shaped(invocations, INVOCATION_SCHEMA),
            _shaped(nodes.join(bound, KEYS), NODE_SCHEMA))


def documents(files: DataFrame, custody: str, number: int) -> DataFrame:
    """Attempts that this batch of files touches and that have both documents by now.

    Files go to the custody folder first, in partitions of the batch and of task run ids; documents of
    earlier batches come from there. Of files that arrive again the first one counts.
    """
    spark = files.sparkSession
    part = F.floor(parsed_attempt_key(F.col("attempt_key"))["task_run_id"] / (1 << 16))
    own = evidence.classify(files).filter(F.col("role") != "log").select(
        *KEYS, "role", "size_ok", F.when(F.col("size_ok"), F.col("content")).alias("content"), part.alias("part"))
    own.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{custody}/batch={number}")
    kinds = "attempt_key string, role string, size_ok boolean, content binary, batch long, part long"
    kept = spark.read.schema(kinds).option("basePath", custody).parquet(custody).filter(F.col("batch") <= number)
    new = kept.filter(F.col("batch") == number)
    parts = [r["part"] for r in new.select("part").distinct().limit(NAMED + 1).collect()]
    if len(parts) <= NAMED:
        kept = kept.filter(F.col("part").isin(parts))
    # documents are shuffled once, by attempt, and meet a hashed side
    touched = new.select(*KEYS).distinct().hint("shuffle_hash")
    own = {kind: F.col("role") == kind for kind in ("manifest", "run_results")}
    pair = kept.join(touched, KEYS, "left_semi").groupBy(*KEYS).agg(*(
        F.min_by(F.when(is_kind, F.struct("content")), F.when(is_kind, F.col("batch")))["content"].alias(kind)
        for kind, is_kind in own.items()))
    return pair.filter(F.col("manifest").isNotNull() & F.col("run_results").isNotNull())


def drain_evidence(stream: DataFrame, custody: str, registry: Partitions, invocations: Partitions,
                   nodes: Partitions, published_at: Column, checkpoint: str) -> None:
    """Publish everything available of a stream of files (``evidence.stream_files``), then stop.

    Publication is idempotent by (attempt, digest), so a batch that is replayed after a failure
    changes nothing the second time.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        with settings(batch.sparkSession, BATCH_SETTINGS), passing(batch.sparkSession, "batch"):
            raw = stage(documents(batch, custody, number), "documents")
            rows = [stage(r, "records") for r in records(raw)]
            publish(registry, invocations, nodes, *rows, published_at)

    with settings(stream.sparkSession, evidence.SCAN_SETTINGS):
        query = (
            stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
