"""Staged evidence files: scan, classify by path and check sizes before any byte is read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.functions.documents import set_digest, sha256
from runlumen.schemas import MAX_DOCUMENT_BYTES, MAX_LOG_FILE_BYTES
from runlumen.session import settings

# fixed value: layout below incoming/<attempt key>/
_KEY = r"w[1-9][0-9]*-j[1-9][0-9]*-r[1-9][0-9]*-t[1-9][0-9]*-p[0-9]+-e[1-9][0-9]*"
_FILE = (
    rf"/incoming/({_KEY})/(?:(001-build)/artifacts/(manifest|run_results)\.json"
    r"|(000-deps|001-build)/logs/dbt\.log(?:\.([1-5]))?)$"
)

#: Columns of Spark's binary file source; streams want them named.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

#: Documents are small, a few to a folder: a task opens some thousand files or lists many folders, not 32 and one.
SCAN_SETTINGS = {"spark.sql.files.openCostInBytes": "65536",
                 "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}


#: Names of documents and logs that lie alone, and of bundles of many; bytes of documents in a bundle.
ALONE, BUNDLE, BUNDLE_BYTES = "{*.json,dbt.log*}", ".arrows", 32 << 20


def write_files(files: DataFrame, root: str, bundled: bool = False) -> None:
    """Stage rows (path below ``root``, content) as files; tasks write where ``root`` points to.

    A file for each row, or ``bundled``: Arrow streams of many rows each. What lists files, as a stream's
    driver does, holds a few hundred bytes for each, so that millions of documents come in bundles.
    """
    label = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        made, written, gathered, size, bundles = set(), 0, [], 0, 0

        def flush() -> None:
            # a task that runs again writes the same names
            name = f"{base}/{label}-{TaskContext.get().partitionId():05}-{bundles:05}{BUNDLE}"
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with store.open_output_stream(name) as out, pa.ipc.new_stream(out, gathered[0].schema, options=options) as rows:
                for part in gathered:
                    rows.write_batch(part)

        if bundled:
            store.create_dir(base, recursive=True)
        for batch in batches:
            written += batch.num_rows
            if bundled:
                for part in pieces(batch.select(["path", "content"]), BUNDLE_BYTES):
                    gathered.append(part)
                    size += part["content"].nbytes
                    if size >= BUNDLE_BYTES:
                        flush()
                        gathered, size, bundles = [], 0, bundles + 1
                continue
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                whole = f"{base}/{path}"
                folder = whole.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(whole) as out:
                    out.write(content)
        if gathered:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    files.select("path", "content").mapInArrow(run, "written long").agg(F.sum("written")).collect()


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``most`` bytes of content, or one row."""
    start = size = 0
    for row, length in enumerate(pa.compute.binary_length(batch["content"]).fill_null(0).to_pylist()):
        if row > start and size + length > most:
            yield batch.slice(start, row - start)
            start = row
            size = 0
        size += length
    if batch.num_rows:
        yield batch.slice(start)


def unpack(bundles: DataFrame) -> DataFrame:
    """The documents of bundles (``binaryFile``) as if each lay alone where its bundle lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                folder = batch["path"][row].as_py().rsplit("/", 1)[0]
                for part in pa.ipc.open_stream(batch["content"][row].as_buffer()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.compute.binary_join_element_wise(folder, part["path"], "/"),
                         pa.repeat(batch["modificationTime"][row], part.num_rows),
                         pa.compute.binary_length(part["content"]).cast(pa.int64()), part["content"]],
                        ["path", "modificationTime", "length", "content"])

    return bundles.select("path", "modificationTime", "length", "content").mapInArrow(run, FILE_SCHEMA)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder as (path, modificationTime, length, content)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )


def stream_files(spark: SparkSession, root: str, bytes_per_batch: int = 1 << 28) -> DataFrame:
    """The same files, alone or in bundles, as a stream of new arrivals.

    A batch is bounded by the bytes it holds: documents are small, and a bound on their number would
    make batches, each of which rewrites the registry's partitions it touches, in proportion to the files.
    """
    def named(names: str) -> DataFrame:
        return (
            spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
            .option("pathGlobFilter", names).option("maxBytesPerTrigger", bytes_per_batch).load(root)
        )

    with settings(spark, SCAN_SETTINGS):
        return named(ALONE).unionByName(unpack(named(f"*{BUNDLE}")))


def classify(files: DataFrame) -> DataFrame:
    """Attempt key, ordinal, role and rotation of each governed file; others are left out.

    Only ``path`` and ``length`` are read here, so a scan keeps ``content`` out of this step.
    """
    part = {name: F.regexp_extract("path", _FILE, i) for i, name in enumerate(
        ("attempt_key", "build", "primary", "log_ordinal", "suffix"), 1)}
    primary = part["primary"] != ""
    limit = F.when(primary, MAX_DOCUMENT_BYTES).otherwise(MAX_LOG_FILE_BYTES)
    return files.filter(F.col("path").rlike(_FILE)).select(
        *files.columns,
        part["attempt_key"].alias("attempt_key"),
        F.when(primary, part["build"]).otherwise(part["log_ordinal"]).alias("ordinal"),
        F.when(primary, part["primary"]).otherwise("log").alias("role"),
        F.when(primary, F.lit(None)).otherwise(
            F.coalesce(part["suffix"].try_cast("int"), F.lit(0))).alias("rotation"),
        (F.col("length") <= limit).alias("size_ok"),
    )


def verified(classified: DataFrame, listing: DataFrame) -> DataFrame:
    """Files with the size their listing declared: ``read_ok`` where as many bytes were read.

    ``listing`` has path and length, and limits hold for what it declares. A file that no listing
    names has no declared size and is not ok.
    """
    declared = listing.select("path", F.col("length").alias("declared_size"))
    limit = F.when(F.col("role") == "log", MAX_LOG_FILE_BYTES).otherwise(MAX_DOCUMENT_BYTES)
    joined = classified.drop("length", "size_ok").withColumn(
        "read_size", F.octet_length("content").cast("bigint")).join(declared, "path", "left")
    return joined.withColumns({
        "read_ok": F.coalesce(F.col("read_size") == F.col("declared_size"), F.lit(False)),
        "size_ok": F.coalesce(F.greatest("declared_size", "read_size") <= limit, F.lit(False))})


def retrieval(verified_files: DataFrame, keys: list[str]) -> DataFrame:
    """Per attempt the first error of its read files, null where all of them can be used."""
    def some(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    role, there, bad = F.col("role"), F.col("read_size").isNotNull(), ~F.col("read_ok") | ~F.col("size_ok")
    primary = [(some((role == r) & there), some((role == r) & there & bad)) for r in ("manifest", "run_results")]
    facts = verified_files.groupBy(*keys).agg(
        F.count_if(there).alias("files"), F.sum("read_size").alias("read_bytes"), some(bad & there).alias("bad"),
        *(column.alias(f"{name}_{i}") for i, both in enumerate(primary) for name, column in zip(("has", "bad"), both)))
    error = (
        F.when(~F.col("has_0"), "DBT_VOLUME_ARTIFACT_UNAVAILABLE")
        .when(F.col("bad_0"), "DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED")
        .when(~F.col("has_1"), "DBT_VOLUME_ARTIFACT_UNAVAILABLE")
        .when(F.col("bad"), "DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED"))
    return facts.select(*keys, "files", "read_bytes", error.alias("error_code"))


def attempt_evidence(classified: DataFrame) -> DataFrame:
    """Per attempt: presence of both primaries, log files, bytes and the first retrieval error."""
    role = F.col("role")
    error = (
        F.when(F.col("manifest_files") == 0, "DBT_VOLUME_ARTIFACT_UNAVAILABLE")
        .when(F.col("too_large"), "DBT_VOLUME_ARTIFACT_SIZE_LIMIT_EXCEEDED")
        .when(F.col("run_results_files") == 0, "DBT_VOLUME_ARTIFACT_UNAVAILABLE")
    )
    return classified.groupBy("attempt_key").agg(
        F.count_if(role == "manifest").alias("manifest_files"),
        F.count_if(role == "run_results").alias("run_results_files"),
        F.count_if(role == "log").alias("log_files"),
        F.sum("length").alias("total_bytes"),
        F.bool_or(~F.col("size_ok")).alias("too_large"),
    ).withColumn("error_code", error)


def documents_by_attempt(classified: DataFrame) -> DataFrame:
    """Both documents of each attempt side by side; at most one file exists per exact path.

    A document over the size limit has no content here and a flag; its attempt stays.
    """
    columns = []
    for kind in ("manifest", "run_results"):
        own = F.col("role") == kind
        columns += [F.max(F.when(own & F.col("size_ok"), F.col("content"))).alias(kind),
                    F.coalesce(F.bool_or(own & ~F.col("size_ok")), F.lit(False)).alias(f"{kind}_too_large")]
    return classified.filter(F.col("role") != "log").groupBy("attempt_key").agg(*columns)


def tree_digest(files: DataFrame, tree: list[str], path: str, content: str) -> DataFrame:
    """Digest per tree over (path, file digest) of all its files, combined before the shuffle."""
    member = sha256(F.concat_ws("|", F.col(path), sha256(F.col(content))))
    return files.select(*tree, member.alias("h")).groupBy(*tree).agg(
        set_digest(F.col("h")).alias("tree_sha256"), F.count("*").alias("file_count"))
