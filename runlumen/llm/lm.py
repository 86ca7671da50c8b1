"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

The probability of a token is that of its class given the words before it, times that of the token
within its class. The class factor is a softmax over hashed features: the previous word, the word
before it (skip), the n-gram of the classes of the three previous words, and a bias. Within a class the
only feature is the token itself, whose maximum-entropy fit is its smoothed frequency; these counts
come from all training documents. Classes follow from the last two bytes of a word, and the end of a
text is a class of its own.

Weights are trained in rounds: each task runs gradient steps over its training documents of the round
from the shared weights, and per feature the results are averaged by how often a task saw it. Token
counts are summed per task before they are shuffled. Counts of frequent tokens, a bounded table, are
broadcast; documents join the counts of all other tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import fold_of, partitions, pieces
from runlumen.llm.vectors import lower_ascii, mix64, prefix_hash, row_sums, span_hash, text_bytes, words
from runlumen.session import stage

#: Hash buckets of features, token classes (the end first), rounds over disjoint parts of the corpus.
BUCKETS, CLASSES, ROUNDS = 1 << 14, 32, 2
#: Tokens whose counts are broadcast at most (16 bytes each); distinct tokens a task sums at once.
FREQUENT, GATHERED = 1 << 19, 3_000_000
STEP, RATE = 2048, 0.2
CHUNK = 1 << 20
END = np.uint64(0)
_FEATURES = 4


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token keys, offsets by row): the words in lower case, then one end. A key's lowest bits are
    its class."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, row = words(data, offsets)
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    former = np.where(ends - starts > 1, data[ends - 2] if len(ends) else 0, 0).astype(np.uint64)
    kind = np.uint64(1) + mix64(last * np.uint64(256) + former) % np.uint64(CLASSES - 1)
    keys = (span_hash(prefix_hash(data), starts, ends) & ~np.uint64(CLASSES - 1)) | kind
    counts = np.bincount(row, minlength=len(column)) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    result = np.full(bounds[-1], END)
    result[np.arange(len(keys)) + row] = keys
    return result, bounds


def classes(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(CLASSES - 1)).astype(np.int64)


def features(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of each feature of each token, one column per feature family."""
    place = np.arange(len(keys)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = []
    for k in (1, 2, 3):
        moved = np.full(len(keys), np.uint64(1 << 40))  # the start of a text
        moved[k:] = keys[:-k]
        before.append(np.where(place >= k, moved, np.uint64(1 << 40) + np.uint64(k)))
    kinds = [np.where(place >= k + 1, b & np.uint64(CLASSES - 1), np.uint64(CLASSES)) for k, b in enumerate(before)]
    gram = (kinds[0] * np.uint64(64) + kinds[1]) * np.uint64(64) + kinds[2]
    hashed = [mix64(x + np.uint64(salt << 56)) for x, salt in ((before[0], 1), (before[1], 2), (gram, 3))]
    columns = [np.zeros(len(keys), np.int64)]
    columns += [(1 + h % np.uint64(BUCKETS - 1)).astype(np.int64) for h in hashed]
    return np.stack(columns)


def log_softmax(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of all classes, a row per token."""
    logits = weights[found[0]]
    for f in found[1:]:
        logits += weights[f]
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def descend(weights: np.ndarray, seen: np.ndarray, found: np.ndarray, target: np.ndarray) -> None:
    """One gradient step on a batch of tokens, in place; ``seen`` keeps the step sizes."""
    slope = np.exp(log_softmax(weights, found))
    slope[np.arange(len(target)), target] -= 1
    for f in found:
        order = np.argsort(f, kind="stable")
        ordered = f[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        ids = ordered[starts]
        grad = np.add.reduceat(slope[order], starts, axis=0)
        seen[ids] += np.square(grad).mean(1)
        weights[ids] -= (RATE / np.sqrt(seen[ids]))[:, None] * grad


def _texts(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    fold = fold_of(F.col("doc_id"), folds)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "held_out", fold == held_out)


def summed(source: DataFrame, extract: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    """(key, n): sums of the (keys uint64, numbers or None for ones) that ``extract`` yields from batches.

    Each task adds up its own keys first and packs those of a bucket into arrays.
    """
    spread = 4 * partitions(source.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in gathered]), return_inverse=True)
            n = np.bincount(at, np.concatenate([np.ones(len(k)) if v is None else v for k, v in gathered]))
            bucket = (mix64(keys) % np.uint64(spread)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, n = bucket[order], keys[order], n[order].astype(np.int64)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = pa.array(np.append(starts, len(keys)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))),
                 pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))], ["bucket", "keys", "n"])

        gathered, size = [], 0
        for keys, n in extract(batches):
            gathered.append((keys, n))
            size += len(keys)
            if size >= GATHERED:
                yield flush()
                gathered, size = [], 0
        if size:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys.append(np.array(batch["keys"].flatten(), np.int64))
            n.append(np.array(batch["n"].flatten(), np.int64))
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(n)).astype(np.int64)
        for start in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[start:start + 50_000]), pa.array(total[start:start + 50_000])], ["key", "n"])

    packed = source.mapInArrow(deal, "bucket int, keys array<long>, n array<int>")
    return packed.repartition(partitions(source.sparkSession), "bucket").mapInArrow(gather, "key long, n long")


def counts(texts: DataFrame) -> DataFrame:
    """(key, n): tokens of the training documents."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches, "text", CHUNK):
            yield tokens(batch["text"])[0], None

    return summed(texts.filter("not held_out").select("text"), extract)


def _round(texts: DataFrame, weights: np.ndarray, part: int, rounds: int) -> np.ndarray:
    """Weights after one round over a part of the training documents."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    slices = 64
    width = BUCKETS // slices

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.copy()
        seen = np.full(BUCKETS, 1.0, np.float32)
        used = np.zeros(BUCKETS)
        for batch in pieces(batches, "text", CHUNK):
            keys, offsets = tokens(batch["text"])
            found, target = features(keys, offsets), classes(keys)
            for start in range(0, len(keys), STEP):
                descend(own, seen, found[:, start:start + STEP], target[start:start + STEP])
            used += np.bincount(found.ravel(), minlength=BUCKETS)
        if used.any():
            moved = (own * used[:, None].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(slices, dtype=np.int32)),
                 pa.array([moved[s * width:(s + 1) * width].tobytes() for s in range(slices)]),
                 pa.array([used[s * width:(s + 1) * width].tobytes() for s in range(slices)])],
                ["slice", "moved", "used"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, moved, used in zip(*[batch[c].to_pylist() for c in ("slice", "moved", "used")], strict=True):
                moved, used = np.frombuffer(moved, np.float32), np.frombuffer(used, np.float64)
                if s in sums:
                    sums[s][0] += moved
                    sums[s][1] += used
                else:
                    sums[s] = [moved.astype(np.float64), used.copy()]
        for s, (moved, used) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([moved.tobytes()]),
                                              pa.array([used.tobytes()])], ["slice", "moved", "used"])

    mine = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == part
    sent = texts.filter("not held_out").filter(mine).select("text").mapInArrow(
        work, "slice int, moved binary, used binary")
    added = sent.repartition(min(slices, partitions(spark)), "slice").mapInArrow(
        add, "slice int, moved binary, used binary")
    result = weights.copy()
    for row in added.collect():  # the model itself: 64 rows whatever the corpus
        at = slice(row["slice"] * width, (row["slice"] + 1) * width)
        moved = np.frombuffer(row["moved"], np.float64).reshape(width, CLASSES)
        used = np.frombuffer(row["used"], np.float64)
        seen = used > 0
        result[at][seen] = (moved[seen] / used[seen, None]).astype(np.float32)
    shared.unpersist()
    return result


def train(texts: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the class factor; each training document is used in one round."""
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    for part in range(rounds):
        weights = _round(texts, weights, part, rounds)
    return weights


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent tokens, at most ``most``, sorted by key.

    The bound is on a count: it comes from a histogram with a fixed number of bins.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    total, least = 0, None
    for row in bins:
        total += row["words"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = table.filter(level >= least).toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order]


def score(docs: DataFrame, folds: int = 5, held_out: int = 1, frequent: int = FREQUENT,
          rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``docs`` needs doc_id and text. Learning uses the rows whose crc32(doc_id as text) mod ``folds`` is
    not ``held_out``. base_score is the log10 probability of the text under smoothed token frequencies,
    score that under the model. Null and empty texts hold the end alone; a null doc_id counts as the
    empty id; repeated rows are counted and scored each; without training rows every count is 0.
    """
    spark = docs.sparkSession
    texts = _texts(docs, folds, held_out)
    table = stage(counts(texts), "counts")
    kind = F.col("key").bitwiseAND(F.lit(CLASSES - 1)).alias("kind")
    n_kind, v_kind = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in table.groupBy(kind).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_kind[row["kind"]], v_kind[row["kind"]] = row["n"], row["v"]
    whole, distinct = int(n_kind.sum()), int(v_kind.sum())
    weights = train(texts, rounds)
    shared = spark.sparkContext.broadcast((weights, *_frequent(table, frequent)))
    within = np.log10(n_kind + 0.5 * (v_kind + 1))
    below = float(np.log10(whole + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, count = shared.value
        value = np.log10(count + 0.5)
        for batch in pieces(batches, "text", CHUNK):
            keys, offsets = tokens(batch["text"])
            found, target = features(keys, offsets), classes(keys)
            model = np.empty(len(keys))
            for start in range(0, len(keys), STEP):
                part = slice(start, start + STEP)
                logs = log_softmax(weights, found[:, part])
                model[part] = logs[np.arange(len(logs)), target[part]]
            model = model / np.log(10) - within[target]
            spot = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[spot] == keys if len(known) else np.zeros(len(keys), bool)
            own = np.where(hit, value[spot] if len(known) else 0.0, 0.0)
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))[~hit]
            rare = keys[~hit]
            order = np.lexsort((rare, row))
            row, rare = row[order], rare[order]
            starts = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (row[1:] != row[:-1]))
                                    ) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(rare)))
            ends = pa.array(np.searchsorted(row[starts], np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(np.diff(offsets), pa.int64()),
                 pa.array(row_sums(hit, offsets).astype(np.int64)), pa.array(row_sums(own, offsets)),
                 pa.array(row_sums(model, offsets)),
                 pa.ListArray.from_arrays(ends, pa.array(rare[starts].view(np.int64))),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "own", "model", "rare", "times"])

    kind_of = docs.schema["doc_id"].dataType.simpleString()
    partial = texts.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {kind_of}, held_out boolean, n_tokens long, n_known long, own double, model double, "
             "rare array<long>, times array<int>")
    rows = stage(partial.withColumn("row", F.monotonically_increasing_id()), "partial")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select(
        "row", F.col("t.rare").alias("key"), F.col("t.times").alias("times"))
    count = F.coalesce("n", F.lit(0))
    rest = pairs.join(table, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(count + 0.5)).alias("rest"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("met"))
    own = F.col("own") + F.coalesce("rest", F.lit(0.0))
    return rows.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(whole).cast("long").alias("train_tokens"),
        (own - F.lit(below) * F.col("n_tokens")).alias("base_score"), (own + F.col("model")).alias("score"))
