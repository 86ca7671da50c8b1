"""Whitening against numpy's eigenvectors and exact numbers."""

import math

import numpy as np
import pytest

from runlumen.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
SAMPLE = "/root/testdata/sf0.001"


def plain(rows, k=4):
    """(vec_id -> list of rows) with numpy.linalg.eigh."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found = []
    for i, x in good:
        exact = sum((n * v - int(s)) ** 2 for v, s in zip(x, sums))
        w = (np.array(x) - sums / n) @ vectors / np.sqrt(values)
        found += [(i, c + 1, n, exact, w[c], values[c] / np.trace(centred.T @ centred / n)) for c in range(len(values))]
    return found


def same(rows, wanted):
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    wanted = sorted(wanted)
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in rows] == [w[:4] for w in wanted]
    for c in {w[1] for w in wanted}:
        got = np.array([r["whitened"] for r in rows if r["component"] == c])
        want = np.array([w[4] for w in wanted if w[1] == c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
    assert np.allclose([r["explained"] for r in rows], [w[5] for w in wanted], rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_registered_query(spark):
    from runlumen.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/embeddings.parquet").collect()]
    found = QUERIES["op13_whiten_embeddings"](spark, SAMPLE)
    assert dict(found.dtypes)["deviation"] == "bigint"
    same(found.collect(), plain(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=6)], 0) for i in range(80)]
    rows += [(100, None, 0), (101, [], 0), (102, [1.0] * 5 + [None], 0), (103, [math.nan] + [0.0] * 5, 0),
             (104, [math.inf] + [0.0] * 5, 0)]
    # copies after rounding count once in the fit list, each row is returned
    rows += [(200 + i, [-0.0, 0.001, 0.002, 0.0, 0.003, 0.0], None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(whitening.whiten(df).collect(), plain(rows))
    short = spark.createDataFrame(rows + [(300, [1.0, 2.0], 0)], SCHEMA)
    same(whitening.whiten(short).collect(), plain(rows))


def test_empty_single_and_low_rank(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert {r["component"] for r in rows} == {1} and abs(rows[0]["explained"] - 1) < 1e-12


def test_repeated_ids_and_clashing_columns(spark):
    names = ["x", "part", "i", "key", "component", "n", "whitened"]
    rows = [(i // 2 if i else None, [float(i % 3), float(i % 5), float(i)], 0, *range(len(names))) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} int" for c in names))
    assert whitening.whiten(df).count() == 36


def test_exact_beyond_a_long(spark):
    rows = [(1, [3e12, 0.0], 0), (2, [-3e12, 1.0], 0), (3, [3e38, 1.0], 0)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    xs = {i: [min(math.floor(256 * float(np.float32(c))), 2 ** 63 - 1) for c in v] for i, v, _ in rows}
    sums = [sum(x[d] for x in xs.values()) for d in range(2)]
    exact = {i: sum((3 * v - s) ** 2 for v, s in zip(x, sums)) for i, x in xs.items()}
    assert all(r["deviation"] is None or int(r["deviation"]) == exact[r["vec_id"]] for r in found)
    assert all((r["deviation"] is None) == (exact[r["vec_id"]] >= 10 ** 38) for r in found)


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_eigenvectors(d, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    spectrum = [np.abs(rng.normal(size=d)) + 0.1, np.full(d, 5.0), np.where(np.arange(d) < 3, 7.0, 1e-9),
                10.0 ** -np.arange(d).clip(0, 9)][kind]
    matrix = (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:len(values)], rtol=1e-7)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13 * d * np.abs(matrix).max()
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13 * d
