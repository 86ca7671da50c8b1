"""Structured log states per (attempt, ordinal), from file facts and exploded lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from runlumen.functions.documents import json_depth
from runlumen.functions.labels import normal_uuid
from runlumen.schemas import (
    MAX_JSON_DEPTH,
    MAX_LOG_FILE_BYTES,
    MAX_LOG_FILES,
    MAX_LOG_TOTAL_BYTES,
    POLICY,
)

KEYS = ["attempt", "ordinal"]
MAIN_REPORT = "MainReportVersion"
#: Bytes of a log file that travel in one row; a batch of rows stays below 200 MB.
CHUNK = 1 << 14


def lines(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines of whole files: split on newline, one trailing newline allowed, no lines if empty."""
    body = F.regexp_replace(F.col(text), r"\n\z", "")
    pieces = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(
        F.split(body, "\n"))
    return files.select(*keys, F.posexplode(pieces).alias("line_no", "line"))


def blank_line_files(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """Line count per file and whether any of its lines is blank, which makes it malformed."""
    return exploded.groupBy(*keys).agg(
        F.count("*").alias("line_count"), F.bool_or(F.col("line") == "").alias("malformed"))


def file_facts(files: DataFrame) -> DataFrame:
    """File count, sizes and the set of rotations as a bit mask per (attempt, ordinal)."""
    rotation = F.col("rotation")
    known = rotation.between(0, MAX_LOG_FILES - 1)
    bit = F.expr(f"CASE WHEN rotation BETWEEN 0 AND {MAX_LOG_FILES - 1} "
                 "THEN shiftleft(1, rotation) ELSE 0 END")
    return files.groupBy(*KEYS).agg(
        F.count("*").alias("file_count"),
        F.sum("declared_size").alias("size_bytes"),
        F.max("declared_size").alias("largest"),
        F.bool_and(F.equal_null("read_size", "declared_size")).alias("complete"),
        F.bit_or(bit).alias("rotations"),
        F.bool_or(~known).alias("foreign_rotation"),
    )


def over_limits() -> Column:
    return (
        (F.col("file_count") > MAX_LOG_FILES)
        | (F.col("size_bytes") > MAX_LOG_TOTAL_BYTES)
        | (F.col("largest") > MAX_LOG_FILE_BYTES)
        | ~F.col("complete")
    )


def rotation_gap() -> Column:
    """Rotations must be exactly 0..max: a mask of trailing ones."""
    mask = F.col("rotations")
    return F.col("foreign_rotation") | (mask == 0) | (mask.bitwiseAND(mask + 1) != 0)


def saturated() -> Column:
    return (F.col("file_count") == MAX_LOG_FILES) & (
        F.col("rotations") == 2**MAX_LOG_FILES - 1)


def strict_objects(exploded: DataFrame) -> DataFrame:
    """Adds ``event``: the variant of a line that is exactly one JSON value, else null.

    The parser ignores text after a value. Inside ``[..]`` only ``]`` or ``,`` may follow the value,
    inside ``{..}`` only ``}`` or ``,``; a comma adds an element. Both wraps together are exact.
    Each wrap is parsed once, as a column of its own.
    """
    wrapped = exploded.withColumns({
        "in_list": F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))),
        "in_map": F.try_parse_json(F.concat(F.lit('{"a":'), "line", F.lit(',"z":0}'))),
    })
    one = F.size(F.try_variant_get("in_list", "$", "array<variant>")) == 1
    two = F.size(F.try_variant_get("in_map", "$", "map<string,variant>")) == 2
    closed = F.equal_null(F.try_variant_get("in_map", "$.z", "int"), F.lit(0))
    return wrapped.withColumn("event", F.when(
        one & two & closed, F.try_variant_get("in_map", "$.a", "variant")))


def parsed_lines(exploded: DataFrame) -> DataFrame:
    """Name, normalized invocation, main-report version and a malformed flag per line."""
    event = F.col("event")

    def kind(path: str) -> Column:
        return F.regexp_extract(
            F.schema_of_variant(F.try_variant_get(event, path, "variant")), "^[A-Z]+", 0)

    name = F.when(kind("$.info.name") == "STRING", F.try_variant_get(event, "$.info.name", "string"))
    invocation = F.when(kind("$.info.invocation_id") == "STRING", normal_uuid(
        F.try_variant_get(event, "$.info.invocation_id", "string")))
    version = F.when(kind("$.data.log_version") == "BIGINT",
                     F.try_variant_get(event, "$.data.log_version", "bigint"))
    main = F.coalesce(F.col("name") == MAIN_REPORT, F.lit(False))
    shaped = (
        F.coalesce(kind("$.info") == "OBJECT", F.lit(False))
        & F.coalesce(kind("$.data") == "OBJECT", F.lit(False))
    )
    deep = json_depth(F.col("line")) > MAX_JSON_DEPTH
    read = strict_objects(exploded).select(
        *exploded.columns, shaped.alias("shaped"), deep.alias("deep"), name.alias("name"),
        invocation.alias("invocation"), version.alias("version"))
    bad = (
        ~F.col("shaped") | F.col("deep") | F.col("name").isNull() | (F.col("name") == "")
        | F.col("invocation").isNull() | (main & F.col("version").isNull())
    )
    return read.select(
        *exploded.columns, "name", "invocation", main.alias("main_report"),
        F.when(main, F.col("version")).alias("version"), bad.alias("malformed"))


def line_facts(exploded: DataFrame) -> DataFrame:
    """Fixed-width aggregates per (attempt, ordinal); one invocation means smallest = largest."""
    return parsed_lines(exploded).groupBy(*KEYS).agg(
        F.bool_or("malformed").alias("bad_line"),
        F.min("invocation").alias("first_invocation"),
        F.max("invocation").alias("last_invocation"),
        F.count_if("main_report").alias("main_reports"),
        F.max("version").alias("log_version"),
    )


def malformed() -> Column:
    one = F.equal_null("first_invocation", "last_invocation") & F.col("first_invocation").isNotNull()
    return F.coalesce(F.col("bad_line") | ~one | (F.col("main_reports") > 1), F.lit(True))


def states(expected: DataFrame, files: DataFrame, exploded: DataFrame,
           artifacts: DataFrame) -> DataFrame:
    """State of every expected (attempt, ordinal); the first rule that holds decides.

    ``expected`` has attempt, ordinal and retrieved. Only the build log is bound to the documents.
    """
    joined = (
        expected.join(file_facts(files), KEYS, "left")
        .join(line_facts(exploded), KEYS, "left")
        .join(artifacts, "attempt", "left")
    )
    other = (F.col("ordinal") == "001-build") & (
        F.col("first_invocation") != normal_uuid(F.col("artifact_invocation")))
    has_files = F.coalesce(F.col("file_count"), F.lit(0)) > 0
    report_missing = F.when(saturated(), "TRUNCATED").otherwise("MISSING")
    state = (
        F.when(~F.col("retrieved"), "UNAVAILABLE")
        .when(~has_files, "MISSING")
        .when(over_limits() | rotation_gap(), "TRUNCATED")
        .when(F.col("size_bytes") == 0, "NOT_INITIALIZED")
        .when(malformed(), "MALFORMED")
        .when(F.col("main_reports") == 0, report_missing)
        .when(F.col("log_version") != POLICY["log_version"], "UNKNOWN_VERSION")
        .when(F.coalesce(other, F.lit(False)), "ARTIFACT_INVOCATION_MISMATCH")
        .otherwise("VALID")
    )
    parsed = F.col("log_state").isin("UNKNOWN_VERSION", "ARTIFACT_INVOCATION_MISMATCH", "VALID")
    read = F.col("retrieved") & has_files
    return joined.withColumn("log_state", state).select(
        *KEYS, "log_state",
        F.when(read, F.col("file_count")).otherwise(F.lit(0)).alias("file_count"),
        F.when(read, F.col("size_bytes")).alias("size_bytes"),
        F.when(parsed, F.col("log_version")).alias("log_version"),
    )


def reconstruct(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Bytes of the rotations joined oldest first, hashed; null if a rotation is there twice.

    Files are cut into chunks, which are sorted by (log, age, place) inside partitions of logs and fed
    to the digest one after the other: no task holds a log, however long it is, and what is sorted
    spills. A file without a rotation makes its log unusable, one without content counts as empty.
    """
    body = F.col(content).cast("binary")
    size = F.octet_length(content).cast("bigint")
    places = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.coalesce(size, F.lit(0)) - 1, F.lit(0)) / CHUNK))
    cut = files.select(*keys, "rotation", size.alias("size"), body.alias("body"), F.explode(places).alias("place"))
    chunks = cut.select(*keys, "rotation", "size", "place", F.substring(
        "body", (F.col("place") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("chunk"))
    kinds = dict(files.select(*keys).dtypes)
    named = [f"k{i}" for i in range(len(keys))]
    sorted_chunks = chunks.toDF(*named, "rotation", "size", "place", "chunk").repartition(
        *named).sortWithinPartitions(*named, F.desc("rotation"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: list[tuple] = []
        log, digest = None, None

        def close() -> None:
            if log is not None:
                key, count, total, usable, _ = log
                logs.append((*key, count, total, digest.hexdigest() if usable else None))

        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*named, "rotation", "size", "place", "chunk")]
            for *key, rotation, length, place, chunk in zip(*columns):
                if log is None or log[0] != key:
                    close()
                    log, digest = [key, 0, None, True, None], hashlib.sha256()
                if place == 0:
                    log[1] += 1
                    log[2] = log[2] if length is None else (log[2] or 0) + length
                log[3] = log[3] and rotation is not None and (rotation, place) != log[4]
                log[4] = (rotation, place)
                digest.update(chunk or b"")
            if logs:
                yield _rows(logs, schema)
                logs = []
        close()
        if logs:
            yield _rows(logs, schema)

    schema = to_arrow_schema(StructType.fromDDL(", ".join(
        [*(f"{n} {kinds[k]}" for n, k in zip(named, keys)), "file_count long, size_bytes long, sha256 string"])))
    return sorted_chunks.mapInArrow(run, from_arrow_schema(schema)).toDF(
        *keys, "file_count", "size_bytes", "sha256")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
