"""Ingestion of documents takes all attempts, however many there are."""

import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlumen.operators import store
from runlumen.plans import load_all
from runlumen.plans.book import Tables
from runlumen.plans.streams import staged_documents
from runlumen.session import passing, stage
from runlumen.sources import evidence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    load_all()
    return Tables(spark, SF)


def test_both_documents_of_every_attempt_are_staged(tables):
    counts = staged_documents(tables).groupBy("dbt_task_run_id").count().collect()
    assert {r["dbt_task_run_id"] for r in counts} == {r[0] for r in tables.attempts.select("dbt_task_run_id").collect()}
    assert {r["count"] for r in counts} == {2}


def test_documents_arrive_in_few_files(spark, tables, tmp_path):
    files = staged_documents(tables).cache()
    evidence.write_files(files, str(tmp_path), bundled=True)
    # the driver lists files, not documents
    assert len(list(tmp_path.rglob("*.arrows"))) <= files.rdd.getNumPartitions()
    key = "w1-j30-r100000-t{}-p0-e1/001-build/artifacts/manifest.json"
    alone = tmp_path / "incoming" / key.format(99999999)
    alone.parent.mkdir(parents=True)
    alone.write_bytes(b"{}")
    seen = []

    def keep(batch, number):
        seen.extend((r["path"].split("/incoming/")[1], bytes(r["content"]), r["length"])
                    for r in evidence.classify(batch).collect())

    stream = evidence.stream_files(spark, str(tmp_path))
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}-ck").trigger(
        availableNow=True).start().awaitTermination()
    given = [(r["path"].removeprefix("incoming/"), bytes(r["content"]), len(r["content"])) for r in files.collect()]
    assert sorted(seen) == sorted([*given, (key.format(99999999), b"{}", 2)])


def test_a_bundle_is_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(list("abcd")), pa.array([b"x" * 60, b"x" * 50, b"x" * 40, b"x" * 200])], ["path", "content"])
    assert [p["path"].to_pylist() for p in evidence.pieces(batch, 100)] == [["a"], ["b", "c"], ["d"]]


def test_a_partition_gets_one_file_and_staged_rows_go(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("dbt_task_run_id"), F.lit("x").alias("text"))
    folder = store.Partitions(spark, f"{tmp_path}/t", rows.schema, 1000).create()
    folder.overwrite(rows.repartition(8))
    assert folder.read().count() == 4000 and len(list(tmp_path.glob("t/part=*/*.parquet"))) == 4
    with passing(spark, "gone"):
        inside = stage(rows, "rows")
        where = inside.inputFiles()[0].removeprefix("file://")
        assert "/gone-" in where and pathlib.Path(where).exists()
    assert not pathlib.Path(where).exists()
