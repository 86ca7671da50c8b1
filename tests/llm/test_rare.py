"""The n-gram Jaccard join by rarest shared shingles against plain code."""

import random

import brute
import pytest
from conftest import prose

from runlumen.llm import rare

SCHEMA = "doc_id long, text string"
NAMES = ("doc_id", "n_shingles", "component_id")


def joined(df, *args, **kwargs):
    return sorted(tuple(r) for r in rare.join(df, *args, **kwargs).select(*NAMES).collect())


def common_lines(seed=3):
    """Near copies in small and large groups, and a line that nearly all documents hold."""
    rng = random.Random(seed)
    line = prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(5, 60), 4000) + " " + line) for i in range(90)]
    base = prose(rng, 80, 4000).split()
    for i in range(90, 170):  # more sets than make a shingle hot, each a little different
        words = list(base)
        words[rng.randrange(len(words))] = f"only{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, line) for i in range(170, 180)]
    rows += [(i + 200, rows[i][1].replace("w1 ", "w1 extra ", 1)) for i in range(0, 60, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent", [(5, 80), (2, 50)])
def test_equals_plain_code(corpus, corpus_rows, n, percent):
    assert joined(corpus, n, percent) == brute.jaccard_components([r[:2] for r in corpus_rows], n, percent)


def test_hot_shingles_and_small_tasks(spark, monkeypatch):
    rows = common_lines()
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute.jaccard_components(rows, 5, 80)
    assert len({c for _, _, c in expected}) < len(rows) - 60
    for parts, hot, gathered in ((1, 32, 3_000_000), (7, 4, 500), (2, 10 ** 9, 100)):
        monkeypatch.setattr(rare, "HOT", hot)
        monkeypatch.setattr(rare, "GATHERED", gathered)
        monkeypatch.setattr(rare, "CHUNK", 2000)
        assert joined(df.repartition(parts), 5, 80, block=1500) == expected


def test_texts_of_one_document_share_their_links(spark):
    rng = random.Random(8)
    w, v, lone = prose(rng, 60, 4000), prose(rng, 60, 4000), prose(rng, 60, 4000)
    rows = [(1, w), (2, v), (5, w + " x"), (5, v + " y"), (5, ""), (6, lone), (6, None), (9, lone), (7, " "), (7, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert joined(df) == brute.jaccard_components(rows, 5, 80)
    assert {r[2] for r in joined(df) if r[0] in (1, 2, 5)} == {1}


def test_odd_rows(odd, empty):
    result = [tuple(r) for r in rare.join(odd).select(*NAMES).collect()]
    known = sorted(r for r in result if r[0] is not None)
    assert [(d, c) for d, _, c in known] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4)]
    assert sorted((n > 0, c) for d, n, c in result if d is None) == [(False, None), (True, None)]
    assert rare.join(empty).count() == 0
