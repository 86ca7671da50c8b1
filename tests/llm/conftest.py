import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(0.01)), vocabulary)}" for _ in range(n))


def small_corpus(seed=5):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated lines."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60)
    for i in range(40):
        rows.append((i, prose(rng, rng.randint(1, 120))))
    for i in range(40, 50):
        base = rows[i - 40][1].split()
        base[len(base) // 2] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(i, rows[30][1]) for i in range(50, 60)]
    rows += [(i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(60, 68)]
    rows += [(68, None), (69, ""), (70, " \n\t "), (71, "one"), (72, "One"), (73, "a b c"), (74, "A b C")]
    rows += [(75, "spam " * 300), (76, "spam " * 200), (77, prose(rng, 20000)), (78, "x" * 30000)]
    rows += [(79, "éè 漢字 🙂 " * 12), (80, "line one\nline two\nline three\n" * 4)]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def corpus_rows():
    return small_corpus()


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Repeated rows and null ids."""
    text = "some text that is long enough to be compared with others " * 4
    return [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, "short"), (4, "short")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    names = ["size", "score", "items", "row", "keys", "doc", "kind", "n", "shard", "slot", "mix_size",
             "mix_key", "quality_score", "held_out", "position", "n_tokens", "component", "node", "query"]
    rows = [(i, t, "en", "s", 0, *range(len(names))) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
