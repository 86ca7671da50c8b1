"""Operators on fixtures: trend axes, lifecycle fold, publication, documents end to end, plans."""

import hashlib
import json
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlumen.functions.documents import json_depth
from runlumen.operators import evidence as members_evidence
from runlumen.operators import catalog, health, lifecycle, logs, pairs, publish, store
from runlumen.plans.book import Tables
from runlumen.schemas import POLICY, REGISTRY_COLUMNS
from runlumen.sources import artifacts, evidence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_trend_joins_on_all_axes(spark):
    day = datetime(2026, 7, 1)
    runs = spark.createDataFrame(
        [(1, 10, 100, 1000, "dbt_build", day, "PAIR_VALID"),
         (1, 10, 200, 2000, "dbt_build", day + timedelta(1), "PAIR_VALID"),
         (1, 10, 200, 2001, "dbt_build", day + timedelta(2), "PAIR_VALID"),
         (1, 10, 300, 3000, "dbt_build", day + timedelta(3), "PAIR_VALID"),
         (1, 10, 400, 4000, "dbt_build", day + timedelta(4), "PAIR_INVALID")],
        "workspace_id LONG, observed_job_id LONG, observed_job_run_id LONG, dbt_task_run_id LONG, "
        "observed_task_key STRING, generated_at TIMESTAMP, pair_state STRING")
    key = (1, 10, 200, 2000, "dbt_build")
    rows = [(*key, "model", "error"), (*key, "model", "success"), (*key, "test", "fail"),
            (*key, "test", "warn"), (*key, "seed", "error")]
    for i in range(5):
        other = list(key)
        other[i] = "other" if i == 4 else other[i] + 7
        rows.append((*other, "model", "error"))
    nodes = spark.createDataFrame(
        rows, "workspace_id LONG, observed_job_id LONG, observed_job_run_id LONG, "
        "dbt_task_run_id LONG, observed_task_key STRING, resource_type STRING, status STRING")
    got = [(r.observed_job_run_id, r.failed_node_results, r.model_results)
           for r in health.trend(runs, nodes, 3).collect()]
    assert got == [(200, 3, 2), (200, 0, 0), (300, 0, 0)]
    with pytest.raises(ValueError):
        health.trend(runs, nodes, 101)


def walk(events, as_of):
    state, n, last = "ABSENT", 0, None
    lease = timedelta(minutes=20)
    for ts, _, action in sorted(events):
        ended = "TERMINAL_FAILURE" if n >= 3 else "RETRYABLE"
        if state == "ABSENT" and action == "discover":
            state = "DISCOVERED"
        elif state in ("DISCOVERED", "RETRYABLE") and action == "claim" and n < 3:
            state, n, last = "COLLECTING", n + 1, ts
        elif state == "COLLECTING" and action == "publish":
            state = "PUBLISHED"
        elif state == "COLLECTING" and (
                action == "fail" or action in ("discover", "tick") and ts >= last + lease):
            state = ended
    if state == "COLLECTING" and as_of >= last + lease:
        state = "TERMINAL_FAILURE" if n >= 3 else "RETRYABLE"
    return state, n, last


def test_fold_equals_a_sequential_walk(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    actions = ["discover", "claim", "fail", "publish", "tick", "claim", "tick"]
    by_attempt = {
        a: [(start + timedelta(minutes=rng.randrange(240)), i, rng.choice(actions))
            for i in range(rng.randrange(1, 60))]
        for a in range(60)
    }
    rows = [(a, i, ts, act) for a, evs in by_attempt.items() for ts, i, act in evs]
    df = spark.createDataFrame(
        rows, "attempt LONG, event_id INT, ts TIMESTAMP, action STRING").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    as_of = start + timedelta(minutes=250)
    folded = lifecycle.fold(df, F.lit(as_of).cast("timestamp_ntz")).collect()
    assert {r.attempt: (r.state, r.attempts, r.last_attempted_at) for r in folded} == {
        a: walk(evs, as_of) for a, evs in by_attempt.items()}


def test_publication_is_idempotent(spark, tables, tmp_path):
    roots = tables.root_source
    keys = ["dbt_task_run_id", "normalized_digest"]
    accepted = roots.filter("invocation_id IS NOT NULL").select(*keys)
    facts = tables.invocations.join(accepted, keys, "left_semi")
    nodes = tables.nodes.join(accepted, keys, "left_semi")
    tables_of = [store.Partitions(spark, f"{tmp_path}/{n}", rows.schema, 500).create()
                 for n, rows in (("registry", roots), ("facts", facts), ("nodes", nodes))]
    clock = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def run(source):
        store.publish(*tables_of, source, facts, nodes, clock)
        return [sorted(map(str, s.read().select(sorted(s.read().columns)).collect())) for s in tables_of]

    first = run(roots)
    assert first == run(roots)
    registry = tables_of[0]
    states = {r.collector_state: r.n for r in registry.read().groupBy("collector_state").agg(
        F.count("*").alias("n")).collect()}
    assert states["PUBLISHED"] > 0
    changed = roots.withColumn("normalized_digest", F.sha2("normalized_digest", 256))
    actions = publish.digest_action(registry.read(), changed)
    assert {r.action for r in actions.select("action").distinct().collect()} == {"CONFLICT"}
    assert first == run(changed)
    assert registry.create().read().columns == REGISTRY_COLUMNS and registry.read().count() == len(first[0])


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    schema = "dbt_task_run_id long, v string"
    rows = spark.createDataFrame([(i, "a") for i in range(100)], schema)
    table = store.Partitions(spark, f"{tmp_path}/t", rows.schema, 10).create()
    table.append_new(rows, ["dbt_task_run_id"])

    def files():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    table.append_new(rows, ["dbt_task_run_id"])
    assert files() == before and table.read().count() == 100
    change = spark.createDataFrame([(42, "b")], schema)
    assert table.near(change).count() == 10
    table.overwrite(table.near(change).filter("dbt_task_run_id <> 42").union(change))
    after = files()
    assert {p for p in before if p not in after} == {p for p in before if "part=4/" in p}
    assert table.read().count() == 100 and table.read().filter("v = 'b'").count() == 1
    named, store.NAMED = store.NAMED, 0
    assert table.near(change).count() == 10
    store.NAMED = named


def document_pair(**changes):
    inv = str(uuid.uuid4())
    meta = {"dbt_version": "1.11.12", "generated_at": "2026-07-01T00:00:00Z",
            "invocation_id": inv}
    manifest = {"metadata": {**meta, "dbt_schema_version": POLICY["manifest_schema"],
                             "adapter_type": "databricks"},
                **{c: {} for c in artifacts.COLLECTIONS}}
    manifest["nodes"] = {"model.a": {"unique_id": "model.a", "resource_type": "model",
                                     "raw_code": "canary-sql"}}
    result = {"status": "success", "timing": [], "thread_id": "T", "execution_time": 1.5,
              "adapter_response": {}, "message": "canary-message", "failures": None,
              "unique_id": "model.a", "compiled": True, "compiled_code": "canary-code",
              "relation_name": "canary.relation"}
    run = {"metadata": {**meta, "dbt_schema_version": POLICY["run_results_schema"],
                        "env": {"X": "canary-env"}},
           "results": [result], "elapsed_time": 2.0,
           "args": {"which": "build", "selector": POLICY["selector"], "select": [], "exclude": [],
                    "indirect_selection": "eager"}}
    run = json.loads(json.dumps(run))
    for path, value in changes.items():
        target, *rest = path.split("__")
        node = manifest if target == "manifest" else run
        for step in rest[:-1]:
            node = node[int(step) if step.isdigit() else step]
        if value is ...:
            del node[rest[-1]]
        else:
            node[rest[-1]] = value
    return json.dumps(manifest).encode(), json.dumps(run).encode()


CASES = {
    "valid": ({}, []),
    "failed_node": ({"run__results__0__status": "error"}, []),
    "mismatch": ({"run__metadata__invocation_id": str(uuid.uuid4())}, ["DBT_INVOCATION_ID_MISMATCH"]),
    "no_uuid": ({"run__metadata__invocation_id": "x"}, ["DBT_INVOCATION_ID_INVALID"]),
    "version": ({"manifest__metadata__dbt_version": "1.0.0"}, ["DBT_CORE_VERSION_UNSUPPORTED"]),
    "extra_field": ({"run__extra": 1}, ["DBT_RUN_RESULTS_SCHEMA_INVALID"]),
    "missing_field": ({"run__results__0__thread_id": ...}, ["DBT_RUN_RESULTS_SCHEMA_INVALID"]),
    "bad_type": ({"run__elapsed_time": "2"}, ["DBT_RUN_RESULTS_SCHEMA_INVALID"]),
    "manifest_shape": ({"manifest__nodes": []}, ["DBT_MANIFEST_SCHEMA_INVALID"]),
    "empty": ({"run__results": []}, ["DBT_EMPTY_EXECUTION"]),
    "unresolved": ({"run__results__0__unique_id": "model.b"}, ["DBT_RESULT_ID_UNRESOLVED"]),
    "ambiguous": ({"manifest__exposures": {"model.a": {"unique_id": "model.a", "resource_type":
                  "exposure"}}}, ["DBT_RESULT_ID_AMBIGUOUS"]),
    "unsupported": ({"manifest__nodes": {}, "manifest__sources": {"model.a": {}}},
                    ["DBT_RESULT_ID_UNSUPPORTED_RESOURCE"]),
    "status": ({"run__results__0__status": "fail"}, ["DBT_RESULT_STATUS_UNSUPPORTED"]),
    "negative": ({"run__results__0__failures": -1, "run__results__0__execution_time": -1},
                 ["DBT_TIMING_INVALID", "DBT_FAILURE_COUNT_INVALID"]),
    "refresh": ({"run__args__full_refresh": False}, ["DBT_COMMAND_UNSUPPORTED"]),
}


def test_documents_end_to_end(spark, tmp_path):
    keys = {}
    for i, (name, (changes, _)) in enumerate(CASES.items()):
        key = f"w1-j2-r3-t{i + 1}-p0-e1"
        keys[key] = name
        folder = tmp_path / "incoming" / key / "001-build" / "artifacts"
        folder.mkdir(parents=True)
        manifest, run = document_pair(**changes)
        (folder / "manifest.json").write_bytes(manifest)
        (folder / "run_results.json").write_bytes(run)
        (folder / "other.json").write_bytes(b"{}")
    raw = evidence.documents_by_attempt(
        evidence.classify(evidence.read_files(spark, str(tmp_path))))
    meta = artifacts.pair_meta(raw, ["attempt_key"])
    results = artifacts.result_rows(raw, ["attempt_key"])
    inventory = artifacts.inventory_rows(raw, ["attempt_key"])
    verdicts = pairs.judge(meta, results, inventory, ["attempt_key"])
    got = {keys[r.attempt_key]: list(r.issue_codes) for r in verdicts.collect()}
    assert got == {name: codes for name, (_, codes) in CASES.items()}
    shown = pairs.project(verdicts, meta, results, inventory, ["attempt_key"]).collect()
    assert len(shown) == 2
    assert "canary" not in str(shown)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(tables):
    trend = plan_of(health.trend_from_tables(tables.registry, tables.invocations, tables.nodes, 25))
    assert "TakeOrderedAndProject" in trend and "CartesianProduct" not in trend
    nodes = plan_of(health.node_health(tables.registry, tables.nodes))
    assert "CartesianProduct" not in nodes and "BroadcastNestedLoopJoin" not in nodes
    replay = plan_of(lifecycle.replay_plan(tables.registry, ["observed_job_id"]))
    assert "SinglePartition" not in replay and "replay_block" in replay
    scan = plan_of(tables.base("events").filter("event_type = 'error'").select(
        json_depth(F.col("props"))))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in scan
    assert "ReadSchema: struct<event_type:string,props:string>" in scan


def test_logs_are_hashed_in_order_and_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(logs, "CHUNK", 7)
    rows = [("a", 0, b"newest " * 9), ("a", 2, b"oldest" * 20), ("a", 1, b""), ("b", 0, b"x"), ("b", 0, b"x"),
            ("c", None, b"y"), ("d", 1, None), ("d", 0, b"z" * 14), (None, 0, b"w"), ("e", 0, None)]
    df = spark.createDataFrame(rows, "log string, rotation int, content binary").repartition(4)
    found = {r["log"]: tuple(r)[1:] for r in logs.reconstruct(df, ["log"], "content").collect()}

    def sha(body):
        return hashlib.sha256(body).hexdigest()

    assert found == {
        "a": (3, 183, sha(b"oldest" * 20 + b"newest " * 9)), "b": (2, 2, None), "c": (1, 1, None),
        "d": (2, 14, sha(b"z" * 14)), None: (1, 1, sha(b"w")), "e": (1, None, sha(b""))}


def test_rules_on_the_row_itself_do_not_shuffle(tables):
    for codes in (["DBT_ARCHIVE_PATH_UNSAFE"], ["DBT_ARCHIVE_LOG_PATH_UNEXPECTED"], ["DBT_ARCHIVE_MEMBER_TYPE_UNSAFE"]):
        members = tables.base("events").selectExpr(
            "event_id AS dbt_task_run_id", "event_id AS seq", "event_type AS path", "'file' AS kind",
            "0L AS declared_size", "0L AS read_size", "'k' AS attempt_key", "true AS include_deps")
        assert "Exchange" not in plan_of(members_evidence.breaking(members, codes))
    counts = plan_of(publish.child_readback(tables.registry, tables.invocations, tables.nodes))
    assert "CartesianProduct" not in counts


def test_first_violation_sends_no_member_twice_by_text(spark):
    """Members with repeats, odd paths and no sequence number; only paths meet by text, once."""
    rows = [("k", 1, "compiled/a.sql", 5), ("k", 2, "x/./y", 5), ("k", 3, "x//y", 5), ("k", 2, "z", 5),
            ("m", 1, "ok", 5), ("m", None, "../lost", 5), ("n", 1, "big", 600_000_000), ("n", 2, "../up", 1),
            ("o", 4097, "late", 1), ("o", 1, "late", 1), ("p", 1, "../up", 1)]
    members = spark.createDataFrame(
        rows, "attempt_key string, seq long, path string, declared_size long").selectExpr(
        "ascii(attempt_key) AS dbt_task_run_id", "seq", "path", "'file' AS kind", "declared_size",
        "declared_size AS read_size", "attempt_key", "true AS include_deps")
    found = members_evidence.first_violation(members)
    shuffles = [line for line in plan_of(found).splitlines() if "Exchange hashpartitioning" in line]
    assert sum("normal" in line for line in shuffles) == 1
    assert {chr(r[0]): (r[1], r[2]) for r in found.collect()} == {
        "k": ("DBT_ARCHIVE_MEMBER_DUPLICATE", 4), "m": (None, 1),
        "n": ("DBT_ARCHIVE_EXPANDED_SIZE_LIMIT_EXCEEDED", 1), "o": ("DBT_ARCHIVE_MEMBER_DUPLICATE", 2),
        "p": ("DBT_ARCHIVE_PATH_UNSAFE", 1)}


def test_tables_are_created_once_and_verified(spark):
    database = "contract_tables"
    catalog.create_tables(spark, database, "v1", 2)
    catalog.create_tables(spark, database, "v1", 2)
    before = catalog.set_digest_of(catalog.described(spark, database, catalog.TABLE_NAMES)).first()
    assert before["relations"] == 4
    with pytest.raises(RuntimeError, match="contract.digest|property:CHANGED"):
        catalog.create_tables(spark, database, "v2", 2)
    spark.sql(f"ALTER TABLE {database}.invocations SET TBLPROPERTIES ('other'='x')")
    spark.sql(f"ALTER TABLE {database}.node_results ADD COLUMNS (more STRING)")
    with pytest.raises(RuntimeError, match="invocations.property:EXTRA, node_results.column:EXTRA"):
        catalog.create_tables(spark, database, "v1", 2)
    after = catalog.set_digest_of(catalog.described(spark, database, catalog.TABLE_NAMES)).first()
    assert after["contract_sha256"] != before["contract_sha256"]
    spark.sql(f"DROP TABLE {database}.object_manifest")
    with pytest.raises(RuntimeError, match="PARTIAL_SCHEMA_STATE"):
        catalog.create_tables(spark, database, "v1", 2)


def test_drift_names_each_kind(spark):
    spark.sql("CREATE DATABASE described_views")
    spark.sql("CREATE TABLE described_views.t (a BIGINT, b STRING) USING parquet TBLPROPERTIES ('role'='x')")

    def view(text):
        spark.sql(f"CREATE OR REPLACE VIEW described_views.v AS {text}")
        return catalog.described(spark, "described_views", ["t", "v"])

    expected = spark.createDataFrame(
        view("SELECT a FROM described_views.t WHERE b = 'X  y'").collect(), catalog.ASPECTS)

    def kinds(observed):
        return {(r["relation"], r["aspect"], r["drift"]) for r in catalog.drift(observed, expected).collect()}

    digest = catalog.set_digest_of(expected).first()["contract_sha256"]
    same = view("select  a from described_views.t\nwhere b = 'X  y'")
    assert kinds(same) == set() and catalog.set_digest_of(same).first()["contract_sha256"] == digest
    other = view("SELECT a FROM described_views.t WHERE b = 'x  y'")
    assert kinds(other) == {("v", "view_text", "CHANGED")}
    assert catalog.set_digest_of(other).first()["contract_sha256"] != digest
    view("SELECT a FROM described_views.t WHERE b = 'X  y'")
    changes = {"property": F.col("name") == "role", "column": F.col("name") == "0001", "provider": F.lit(True)}
    for aspect, where in changes.items():
        hit = (F.col("relation") == "t") & (F.col("aspect") == aspect) & where
        assert kinds(expected.filter(~hit)) == {("t", aspect, "MISSING")}
        assert kinds(expected.withColumn("value", F.when(hit, "other").otherwise(F.col("value")))) == {
            ("t", aspect, "CHANGED")}


def test_page_chains(spark):
    parents = {
        "one": [(None, None)], "three": [(None, "a"), ("a", "b"), ("b", None)], "loop": [(None, "a"), ("a", "b"), ("b", "a")],
        "self": [(None, "a"), ("a", "a")], "twice": [(None, "a"), ("a", None), ("a", None)], "gone": [(None, "a")],
        "apart": [(None, None), ("x", "y"), ("y", "x")], "empty": [(None, "")], "headless": [("a", None)],
        "long": [(None, "1"), *((str(i), str(i + 1)) for i in range(1, 11)), ("11", None)],
        "ten": [(None, "1"), *((str(i), str(i + 1)) for i in range(1, 9)), ("9", None)],
    }
    rows = [(p, *page) for p, own in parents.items() for page in own]
    df = spark.createDataFrame(rows, "parent string, token string, next_token string")
    found = {r["parent"]: r["error_code"] is None for r in lifecycle.page_chains(df, ["parent"]).collect()}
    assert {p for p, fine in found.items() if fine} == {"one", "three", "ten"} and set(found) == set(parents)
