"""Expressions against plain Python on small hand-made inputs."""

import json
import uuid
from datetime import datetime
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlumen.functions import documents as docs
from runlumen.functions import labels
from runlumen.operators.catalog import folded_sql
from runlumen.operators.logs import parsed_lines


def column(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i INT, x {kind}")


def evaluate(spark, values, expr, kind="string"):
    got = column(spark, values, kind).select("i", expr.alias("y")).collect()
    return [r["y"] for r in sorted(got, key=lambda r: r["i"])]


PATHS = ["a", "a/b", "./a", "a//b", "a/./b/", "/a", "a/../b", "..", ".", "a\\b", "", "x" * 1025,
         "a/.", "..a/b", "a/b..", "é" * 600]


def safe(path):
    if not path or "\\" in path or len(path.encode()) > 1024:
        return False
    p = PurePosixPath(path)
    return not p.is_absolute() and ".." not in p.parts


def test_paths(spark):
    assert evaluate(spark, PATHS, labels.path_safe(F.col("x"))) == [safe(p) for p in PATHS]
    plain = [p for p in PATHS if p and not p.startswith("/")]
    assert evaluate(spark, plain, labels.normal_path(F.col("x"))) == [
        str(PurePosixPath(p)) for p in plain]


def test_uuid(spark):
    good = str(uuid.uuid4())
    texts = [good, good.upper(), "{" + good + "}", "urn:uuid:" + good, good.replace("-", ""),
             good[:-1], "", "zz" + good[2:], good + "0"]

    def expected(t):
        try:
            return str(uuid.UUID(t))
        except ValueError:
            return None

    assert evaluate(spark, texts, labels.normal_uuid(F.col("x"))) == list(map(expected, texts))


def test_offset_time(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00",
             "2024-01-01 00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01T00:00:00.123456Z", "T",
             "2024-01-01T00:00+00:00"]

    def accepted(t):
        try:
            return "T" in t and datetime.fromisoformat(t.replace("Z", "+00:00")).tzinfo is not None
        except ValueError:
            return False

    got = evaluate(spark, texts, labels.offset_ts(F.col("x")).isNotNull())
    assert got == list(map(accepted, texts))


def depth(text):
    level = deepest = 0
    inside = escaped = False
    for ch in text:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "[{":
            level += 1
            deepest = max(deepest, level)
        elif ch in "]}" and level:
            level -= 1
    return deepest


TEXTS = st.text(alphabet='[]{}"\\a ', max_size=40)


def test_json_depth(spark):
    fixed = ["", "[[]]", ']][', '"[["', '"\\"[', '["\\\\"]', "[" * 300, '{"a":[1,{"b":"}"}]}', '"\\']

    @settings(max_examples=5, deadline=None)
    @given(st.lists(TEXTS, min_size=20, max_size=60))
    def check(texts):
        texts = texts + fixed
        assert evaluate(spark, texts, docs.json_depth(F.col("x"))) == list(map(depth, texts))

    check()


def test_strict_verdict(spark):
    cases = {b'{"a":1}': "OK", b'{"a":1,"a":2}': "DUPLICATE_KEY", b'{"a":{"b":1,"b":1}}':
             "DUPLICATE_KEY", b'{"a":NaN}': "INVALID", b"[]": "INVALID", b"{} x": "INVALID",
             b"": "INVALID", b"\xff{}": "INVALID", b'{"a":Infinity}': "INVALID"}
    got = evaluate(spark, [bytearray(k) for k in cases],
                   docs.strict_verdict(F.col("x")), "binary")
    assert got == list(cases.values())


def test_log_lines(spark):
    inv = str(uuid.uuid4())
    event = {"info": {"name": "A", "invocation_id": inv}, "data": {}}
    good = json.dumps(event)
    lines = {
        good: False, good + " tail": True, good + "]": True, good + "} x": True, good + "," + good: True,
        good + ',"z":0}': True, "": True, "[" + good + "]": True, good[:-1]: True,
        '{"info":{"name":"A","name":"B","invocation_id":"' + inv + '"},"data":{}}': True,
        json.dumps({**event, "data": []}): True, json.dumps({"info": event["info"]}): True,
        json.dumps({"info": {"name": "", "invocation_id": inv}, "data": {}}): True,
        json.dumps({"info": {"name": "A", "invocation_id": "x"}, "data": {}}): True,
        json.dumps({"info": {"name": "MainReportVersion", "invocation_id": inv},
                    "data": {"log_version": 3}}): False,
        json.dumps({"info": {"name": "MainReportVersion", "invocation_id": inv},
                    "data": {"log_version": True}}): True,
        json.dumps({**event, "data": {"x": [[0]] * 400}}): False,
        json.dumps({**event, "data": {"x": json.loads("[" * 300 + "]" * 300)}}): True,
    }
    rows = [(i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "i INT, line STRING")
    got = {r["line"]: r["malformed"] for r in parsed_lines(df).select("line", "malformed").collect()}
    assert got == lines


def test_canonical_json(spark):
    df = spark.createDataFrame([("é", None)], "b STRING, a STRING")
    text = df.select(docs.canonical_json({"b": F.col("b"), "a": F.col("a")}).alias("t")).first().t
    assert text.lower() == json.dumps({"a": None, "b": "é"}, separators=(",", ":")).lower()


def test_set_digest_ignores_order_and_sees_copies(spark):
    def digest(values):
        df = spark.createDataFrame([(v,) for v in values], "v STRING")
        return df.agg(docs.set_digest(F.sha2("v", 256)).alias("d")).first().d

    assert digest(["a", "b", "c"]) == digest(["c", "a", "b"])
    assert len({digest(["a"]), digest(["a", "a"]), digest(["b"]), digest(["a", "b"])}) == 4


def test_folded_sql(spark):
    texts = ["SELECT  A\n FROM t WHERE x = 'Keep  CASE' ;", "select a from T where X = 'Keep  CASE'"]
    got = evaluate(spark, texts, folded_sql(F.col("x")))
    assert got[0].strip() == got[1] == "select a from t where x = 'Keep  CASE'"


def test_a_cluster_needs_a_shared_folder():
    from runlumen.session import checkpoint_dir, settings

    class Conf(dict):
        def unset(self, key):
            self.pop(key)

        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert checkpoint_dir(Session(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")) == "hdfs://x/y"
    for master in ("yarn", "k8s://h", "spark://h:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            checkpoint_dir(Session(spark_master=master))
    one = Session(spark_master="local[4]")
    assert checkpoint_dir(one) == checkpoint_dir(one)
    with settings(one, {"spark.master": "x", "new": "y"}):
        assert one.conf["spark.master"] == "x" and one.conf["new"] == "y"
    assert one.conf["spark.master"] == "local[4]" and "new" not in one.conf
