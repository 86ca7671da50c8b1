"""Quality classifier: supervised subword embeddings with a softmax output.

A document is the average of learned vectors of hashed features: its words, the character n-grams of
its text, and for words that repeat one of the words just before them, the distance back. A softmax
layer on the average gives the label. Training is stochastic gradient descent in numpy on a bounded
sample of labelled rows, in one task. As both layers are linear, a feature moves the difference of
the two logits by a fixed amount; the model shipped to the scoring tasks is one number per feature
bucket, a megabyte whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import fold_of, pieces
from runlumen.llm.vectors import mix64, prefix_hash, row_sums, span_hash, text_bytes, words

#: Feature buckets and the lengths of character n-grams in bytes.
BUCKETS, GRAMS, BACK = 1 << 18, (3, 4, 5), 3
#: Labelled rows and text bytes the classifier is fitted on at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 48 << 20
DIM, STEPS, BATCH_ROWS, RATE = 8, 700, 32, 0.05
CHUNK = 2 << 20


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature families of texts as (bucket per feature, offsets by row)."""
    data, offsets = text_bytes(column)
    sums = prefix_hash(data)
    mask = np.uint64(BUCKETS - 1)
    for n in GRAMS:
        starts = np.arange(max(0, len(data) - n + 1))
        found = span_hash(sums, starts, starts + n) + np.uint64(n)
        # an n-gram must end inside its row
        rows = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        keep = np.zeros(len(data) + 1, np.int32)
        np.add.at(keep, offsets[:-1], 1)
        np.add.at(keep, rows, -1)
        inside = np.cumsum(keep)[:len(starts)] > 0
        counts = np.concatenate([[0], np.cumsum(rows - offsets[:-1])])
        yield (found[inside] & mask).astype(np.int64), counts
    starts, ends, row = words(data, offsets)
    hashes = span_hash(sums, starts, ends)
    counts = np.searchsorted(row, np.arange(len(offsets)))
    yield (mix64(hashes) & mask).astype(np.int64), counts
    back = np.zeros(len(hashes), np.int64)
    for k in range(BACK, 0, -1):
        same = (hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k])
        back[k:][same] = k
    yield back, counts


def _counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares."""
    families = list(features(column))
    result = []
    for i in range(len(column)):
        found = np.concatenate([b[o[i]:o[i + 1]] for b, o in families])
        ids, n = np.unique(found, return_counts=True)
        result.append((ids, (n / max(1, len(found))).astype(np.float32)))
    return result


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Effect of each bucket on the difference of logits; the last entry is the bias.

    Minibatch gradient descent with per-weight step sizes on embeddings and output layer. The number
    of steps is fixed, so that small samples are gone through more often.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen_v, seen_o, seen_b = np.full((BUCKETS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    order = np.zeros(0, np.int64)
    for _ in range(STEPS if len(labels) else 0):
        if len(order) < BATCH_ROWS:
            order = np.concatenate([order, rng.permutation(len(labels))])
        rows, order = order[:BATCH_ROWS], order[BATCH_ROWS:]
        ids = np.concatenate([examples[r][0] for r in rows])
        share = np.concatenate([examples[r][1] for r in rows])[:, None]
        which = np.repeat(np.arange(len(rows)), [len(examples[r][0]) for r in rows])
        hidden = np.zeros((len(rows), DIM), np.float32)
        for d in range(DIM):
            hidden[:, d] = np.bincount(which, vectors[ids, d] * share[:, 0], len(rows))
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), labels[rows]] -= 1
        p /= len(rows)
        back, at = (p @ out.T).astype(np.float32), np.unique(ids, return_inverse=True)
        grad_out, grad_bias = hidden.T @ p, p.sum(0)
        grad = np.stack([np.bincount(at[1], back[which, d] * share[:, 0], len(at[0])) for d in range(DIM)], 1)
        seen_v[at[0]] += grad ** 2
        vectors[at[0]] -= RATE * grad / np.sqrt(seen_v[at[0]])
        seen_o += grad_out ** 2
        out -= (RATE * grad_out / np.sqrt(seen_o)).astype(np.float32)
        seen_b += grad_bias ** 2
        bias -= (RATE * grad_bias / np.sqrt(seen_b)).astype(np.float32)
    step = out[:, 1] - out[:, 0]
    return np.append(vectors @ step, bias[1] - bias[0]).astype(np.float32)


def scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text; an empty text gets that of the bias."""
    total, n = np.zeros(len(column)), np.zeros(len(column))
    for buckets, offsets in features(column):
        total += row_sums(model[buckets], offsets)
        n += np.diff(offsets)
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + float(model[-1]))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS,
          most_bytes: int = SAMPLE_BYTES, folds: int = 3, held_out: int = 1) -> np.ndarray:
    """Fit the model on at most ``rows`` labelled documents of the folds other than ``held_out``.

    The sample is the labelled ids with the smallest hash; its ids (at most ``rows``) are broadcast to
    the scan of ``docs``, and texts are taken in that order as far as they fit ``most_bytes``: a text that does
    not fit is passed over and the next ones are tried. It is an error if no labelled text fits. Rows without id,
    label or text teach nothing. An id labelled twice counts with its smallest label. Without any
    usable label every score is 0.5.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
                           & (fold_of(F.col("doc_id"), folds) != held_out))
    chosen = usable.groupBy(F.col("doc_id").alias("sample_id")).agg(F.min(label).cast("int").alias("sample_label"))
    chosen = chosen.withColumn("sample_order", F.xxhash64(F.lit(3), "sample_id")).orderBy(
        "sample_order", "sample_id").limit(rows)
    sample = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("sample_id")).filter(F.col("text").isNotNull())
    sample = sample.orderBy("sample_order", "sample_id", F.xxhash64("text")).limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, marks, left, offered = [], [], most_bytes, 0
        for batch in pieces(batches, "text", CHUNK):
            offered, fits = offered + batch.num_rows, []
            for size in pa.compute.binary_length(batch["text"]).to_pylist():
                fits.append(size <= left)
                left -= size if fits[-1] else 0
            taken = batch.filter(pa.array(fits))
            examples += _counts(taken["text"])
            marks += taken["sample_label"].to_pylist()
        if offered and not examples:
            raise ValueError(f"none of {offered} labelled texts fits {most_bytes} bytes")
        model = fit(examples, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()])], ["model"])

    fitted = sample.select("text", "sample_label").coalesce(1).mapInArrow(run, "model binary").collect()
    return np.frombuffer(fitted[0]["model"], np.float32) if fitted else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, out: str = "quality_score") -> DataFrame:
    """``docs`` (needs text) with the probability of label 1 of each whole text.

    Null and empty texts get the bias alone; a column named ``out`` is replaced; repeated rows get
    equal scores.
    """
    kept = docs.select(*[c for c in docs.columns if c != out])
    schema = kept.select("*", F.lit(0.0).alias(out)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            found = pa.array(scores(batch["text"], shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
