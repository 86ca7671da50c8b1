"""Registered text queries, their SQL checks, and the pipeline against plain code."""

import collections

import brute
import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from runlumen.llm import decontaminate, quality
from runlumen.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert "pipeline" not in entry.oracle_sql() and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, note, _, _ = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if int(n[2:].split("_")[0]) <= 10))
def test_every_document_is_there(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    ids = collections.Counter(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    if name != "op7_bm25_topk":
        assert collections.Counter(r["doc_id"] for r in rows) == ids
    else:
        assert {r["query_id"] for r in rows} <= {i for i in ids if i % 50 == 0}


def holds(text, item):
    """Whether some passage is within a tenth of the item's length in edits; one of its pieces is unchanged."""
    k = int(0.1 * len(item))
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) and decontaminate.best_distance(item, text) <= k


def test_pipeline_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"]: r for r in quality.score(docs, model).filter("quality_score >= 0.5").collect()}
    groups = brute.jaccard_components([(d, r["text"]) for d, r in good.items()], 5, 80)
    kept = [d for d, _, c in groups if d == c]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d in kept if not any(holds(decontaminate.normal(good[d]["text"]), t) for t in items)]
    rows = corpus_pipeline.run(spark, SF).collect()
    times = collections.Counter(r["doc_id"] for r in rows)
    assert set(times) <= set(clean) and max(times.values()) <= 3
    words = {d: len(brute.WORD.findall(good[d]["text"])) for d in clean}
    assert sum(n * words[d] for d, n in times.items()) >= sum(words.values())
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(rows[0].asDict())
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
