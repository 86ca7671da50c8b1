"""Streams give the same rows however the feed is cut into batches; digests and decoding."""

import pathlib

import pytest
from pyspark.sql import functions as F

from runlumen.operators import lifecycle, publish
from runlumen.plans import load_all
from runlumen.plans.book import Tables
from runlumen.plans.streams import dedup_stream, feed, ingest_files, lifecycle_stream, staged_documents
from runlumen.sources import artifacts, evidence
from runlumen.streaming import dedup, ingest
from runlumen.streaming.lifecycle import UPDATES, drain_lifecycle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    load_all()
    return Tables(spark, SF)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_no_first_arrival_is_lost_and_no_repeat_stays(spark, tables, parts):
    events = tables.base("events")
    found, runs, both = dedup_stream(spark, events, parts)
    assert rows(found) == rows(events.select("event_id", "ts", "user_id", "event_type"))
    late = both.filter("late").count()
    assert 0 < late < 0.05 * events.count()
    # a repeat past midnight is dropped though its day is another one
    given = feed(events.select("event_id", "ts", "user_id", "event_type"))
    assert given.filter("to_date(sent) > to_date(ts)").count() > 0
    # after each run the state holds about two days of arrivals, however many days the feed has had
    days = events.select(F.to_date("ts")).distinct().count()
    assert days > 10 and len(runs) == parts
    assert all(r.state_rows[-1] < 3 * events.count() / days for r in runs)


def test_arrivals_out_of_order_are_an_error(spark, tmp_path):
    columns = "event_id long, sent timestamp, arrived timestamp"
    first = spark.createDataFrame([(1, None, None)], columns).select(
        "event_id", F.lit("2024-01-09 00:00:00").cast("timestamp").alias("sent"),
        F.lit("2024-01-09 00:00:00").cast("timestamp").alias("arrived"))
    for number, back in enumerate((0, 5)):
        moved = first.select(F.lit(number).cast("long").alias("event_id"), *(
            (F.col(c) - F.expr(f"INTERVAL {back} DAYS")).alias(c) for c in ("sent", "arrived")))
        moved.write.mode("append").parquet(f"{tmp_path}/in")
        stream = dedup.event_stream(spark, f"{tmp_path}/in", first.schema)
        places = (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        if number:
            with pytest.raises(ValueError, match="out of order"):
                dedup.drain_first(stream, ["event_id"], "sent", "arrived", *places)
        else:
            dedup.drain_first(stream, ["event_id"], "sent", "arrived", *places)


@pytest.mark.parametrize("parts", [1, 5])
def test_lifecycle_does_not_depend_on_batches(spark, tables, parts):
    events = tables.lifecycle_events
    clock = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    expected = rows(lifecycle.fold(events, clock).select("attempt", "state", "attempts", "last_attempted_at"))
    found, changes = lifecycle_stream(spark, events, parts)
    assert rows(found) == expected
    assert changes.agg(F.sum("late")).first()[0] == 0


def test_lease_ends_without_a_later_event(spark, tmp_path):
    """Events of other attempts move the clock; the claim of attempt 1 is shown as failed in time."""
    parts = [
        [(1, 1, "00:00", "discover"), (1, 2, "00:01", "claim"), (2, 3, "00:02", "discover")],
        [(2, 4, "00:25", "claim")], [(2, 5, "00:30", "tick")],
        # a collector that goes on after its lease still publishes; an event behind the clock is late
        [(1, 6, "00:40", "publish"), (2, 7, "00:03", "fail"), (2, 8, "00:41", "publish")],
        [(3, 9, "02:00", "discover")],
    ]
    shown = []
    schema = "attempt long, event_id long, at string, action string"
    for part in parts:
        df = spark.createDataFrame(part, schema).select("attempt", "event_id", F.concat(
            F.lit("2024-01-01 "), "at", F.lit(":00")).cast("timestamp").alias("ts"), "action").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = dedup.event_stream(spark, f"{tmp_path}/in", df.schema)
        drain_lifecycle(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "1 minute")
        changes = spark.read.schema(UPDATES).parquet(f"{tmp_path}/out")
        newest = changes.groupBy("attempt").agg(F.max_by("state", "step").alias("state")).collect()
        shown.append({r["attempt"]: r["state"] for r in newest})
    assert shown[0] == {"1": "COLLECTING", "2": "DISCOVERED"}
    assert shown[1]["1"] == "RETRYABLE" and shown[1]["2"] == "COLLECTING"
    assert shown[3]["1"] == "PUBLISHED" and shown[3]["2"] == "PUBLISHED"
    assert changes.agg(F.sum("late")).first()[0] == 1


def test_files_are_ingested_once_and_where_they_belong(spark, tables):
    files = staged_documents(tables)
    registry, invocations, nodes, base = ingest_files(spark, files, 2, 1000)
    attempts = files.select("dbt_task_run_id").distinct().count()
    found = registry.read()
    assert found.count() == attempts and found.filter("collector_state <> 'PUBLISHED'").count() == 0
    assert found.filter("pair_state = 'PAIR_VALID'").count() == invocations.read().count() == nodes.read().count() > 0

    def listing():
        return {p: p.stat().st_mtime_ns for p in pathlib.Path(base).rglob("part=*/*.parquet") if "custody" not in str(p)}

    # the same documents again, as other files: nothing changes, and no stored file is touched but the registry's
    before, rows_before = listing(), rows(found)
    evidence.write_files(files.withColumn("path", F.concat(F.lit("again/"), "path")), f"{base}/stage")
    clock = F.lit("2025-01-01 00:00:00").cast("timestamp")
    ingest.drain_evidence(evidence.stream_files(spark, f"{base}/stage"), f"{base}/custody", registry, invocations,
                          nodes, clock, f"{base}/checkpoint")
    assert rows(registry.read()) == rows_before
    children = {p: t for p, t in before.items() if "/registry/" not in str(p)}
    assert children == {p: t for p, t in listing().items() if "/registry/" not in str(p)}


def test_each_bound_fact_changes_the_digest(tables):
    key = ["workspace_id", "dbt_task_run_id", "normalized_digest"]
    # a record whose own digest has a published invocation
    one = tables.registry.join(tables.invocations.select(*key), key, "left_semi").limit(1).cache()
    facts = tables.invocations.join(one.select(*key), key, "left_semi").cache()
    nodes = tables.nodes.join(one.select(*key[:2]), key[:2], "left_semi").cache()

    def digest(record, invocation):
        return publish.record_digests(record, invocation, nodes).first()["record_digest"]

    kinds = dict(one.dtypes) | dict(facts.dtypes)
    other = {"string": F.lit("other"), "boolean": F.lit(True)}
    seen = {digest(one, facts)}
    changed = [*publish.LOG_FACTS, "task_start_time", "task_end_time", *publish.INVOCATION_FACTS]
    for column in changed:
        value = F.lit("2001-01-01").cast(kinds[column]) if "time" in kinds[column] else other.get(
            kinds[column], F.lit(987654)).cast(kinds[column])
        if column in publish.INVOCATION_FACTS:
            seen.add(digest(one, facts.withColumn(column, value)))
        else:
            seen.add(digest(one.withColumn(column, value), facts))
    assert len(seen) == len(changed) + 1


def test_bytes_that_are_not_utf8_are_a_verdict(spark):
    raw = spark.createDataFrame(
        [(1, bytearray(b"\xff\xfe"), bytearray(b"{}")), (2, bytearray(b"{}"), bytearray(b'{"a":NaN}'))],
        "dbt_task_run_id long, manifest binary, run_results binary")
    found = {r["dbt_task_run_id"]: r for r in artifacts.pair_meta(raw, ["dbt_task_run_id"]).collect()}
    assert found[1]["manifest_parse"] != "OK" and not found[1]["manifest_schema_valid"]
    assert found[2]["run_results_parse"] != "OK"
    assert artifacts.result_rows(raw, ["dbt_task_run_id"]).count() == 0
    assert artifacts.inventory_rows(raw, ["dbt_task_run_id"]).count() == 0


def test_batches_of_documents_are_bounded_by_bytes_and_adaptive(spark, tmp_path, monkeypatch):
    key = "w1-j30-r100000-t{}-p0-e1"
    for i in range(1, 1102):
        folder = tmp_path / "stage/incoming" / key.format(i) / "001-build/artifacts"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_bytes(b"{}")
    seen, tasks = [], []

    def documents(files, custody, number):
        seen.append(files.count())
        tasks.append(files.rdd.getNumPartitions())
        assert files.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
        return ingest_documents(files, custody, number).limit(0)

    ingest_documents = ingest.documents
    monkeypatch.setattr(ingest, "documents", documents)
    monkeypatch.setattr(ingest, "publish", lambda *rows: None)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    stream = evidence.stream_files(spark, str(tmp_path / "stage"))
    ingest.drain_evidence(stream, str(tmp_path / "custody"), None, None, None, F.lit(None), str(tmp_path / "ck"))
    assert seen == [1101] and tasks[0] < 1101 / 32
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
