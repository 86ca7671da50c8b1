"""Meetings of hashed keys: which documents hold a key that some other document holds too.

A task first meets the keys of its own documents. Of each key only one entry per task, that of its
smallest document, goes on to the key's bucket, packed with others of the bucket into arrays, so a
key that a third of all documents hold costs one entry per task there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlumen.llm.common import partitions

#: Keys a task gathers before it deals them out.
GATHERED = 3_000_000
LINK, KEY, POSTED, HOT = 1, 2, 3, 4
#: What comes out: kind LINK: doc, x = smallest document met; kind KEY: doc, key x; kind HOT: key x, its
#: documents y, doc a number of the partition; other kinds as given.
SCHEMA = "kind int, doc long, x long, y long, z long"
_PACKED = "bucket int, kind int, docs array<long>, x array<long>, y array<long>, z array<long>"

Rows = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def groups(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) by key, then doc, with the start and size of each key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[fresh], docs[fresh]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    return keys, docs, starts, np.diff(np.append(starts, len(keys)))


def met(keys: np.ndarray, docs: np.ndarray, want: int) -> tuple[Rows, np.ndarray, np.ndarray, np.ndarray]:
    """Rows for keys of several documents; the keys, the smallest document and the documents of each."""
    keys, docs, starts, sizes = groups(keys, docs)
    several = np.repeat(sizes > 1, sizes)
    none = np.zeros(0, np.int64)
    if want == KEY:
        rows = (KEY, docs[several], keys[several].view(np.int64), none, none)
    else:
        pairs = np.stack([docs[several], np.repeat(docs[starts], sizes)[several]])
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        rows = (LINK, pairs[0], pairs[1], none, none)
    return rows, keys[starts], docs[starts], sizes


def _pack(buckets: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with its entries as arrays."""
    order = np.lexsort((columns[0], buckets))  # by document, which packs well
    buckets = buckets[order]
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.zeros(0, int)
    offsets = pa.array(np.append(starts, len(buckets)), pa.int32())
    empty = pa.array(np.zeros(len(starts) + 1, np.int32))
    lists = [pa.ListArray.from_arrays(offsets if len(c) else empty, pa.array(c[order] if len(c) else c, pa.int64()))
             for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts], pa.int32()), pa.array(np.full(len(starts), kind), pa.int32()), *lists],
        ["bucket", "kind", "docs", "x", "y", "z"])


def _flat(rows: Rows) -> pa.RecordBatch:
    """Entries as plain rows."""
    kind, docs, *rest = rows
    columns = [pa.array(c, pa.int64()) if len(c) else pa.nulls(len(docs), pa.int64()) for c in rest]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(docs), kind), pa.int32()), pa.array(docs, pa.int64()), *columns],
        ["kind", "doc", "x", "y", "z"])


def meetings(source: DataFrame, extract: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]],
             want: int, hot: int | None = None) -> DataFrame:
    """Meet the keys that ``extract`` yields from the batches of ``source``.

    ``extract`` yields (keys uint64, docs int64, other rows or None); other rows (kind, docs, x, y, z)
    come out unchanged. ``want``: LINK for (doc, smallest document of a key it holds), KEY for (doc,
    key). LINK rows may repeat across buckets; what they connect is connected through shared keys. With
    ``hot`` keys of so many documents come out once more as HOT; their documents are counted in each
    flush of a task and the counts added up.
    """
    spread = 4 * partitions(source.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            rows, keys, docs, sizes = met(np.concatenate(key_parts), np.concatenate(doc_parts), want)
            yield _pack(rows[1] % spread, rows[0], list(rows[1:]))
            none = np.zeros(0, np.int64)
            yield _pack((keys % np.uint64(spread)).astype(np.int64), POSTED,
                        [docs, keys.view(np.int64), none if hot is None else sizes, none])

        key_parts, doc_parts, gathered = [], [], 0
        for keys, docs, other in extract(batches):
            if other is not None and len(other[1]):
                yield _pack(other[1] // 64 % spread, other[0], list(other[1:]))
            key_parts.append(keys)
            doc_parts.append(docs)
            gathered += len(keys)
            if gathered >= GATHERED:
                yield from flush()
                key_parts, doc_parts, gathered = [], [], 0
        if gathered:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_parts, doc_parts, counts = [], [], []
        for batch in batches:
            posted = np.asarray(batch["kind"]) == POSTED
            own = batch.filter(pa.array(posted))
            key_parts.append(np.array(own["x"].flatten(), np.int64).view(np.uint64))
            doc_parts.append(np.array(own["docs"].flatten(), np.int64))
            counts.append(np.array(own["y"].flatten(), np.int64))
            for kind in np.unique(np.asarray(batch["kind"])[~posted]):
                part = batch.filter(pa.array(np.asarray(batch["kind"]) == kind))
                docs = part["docs"].flatten()
                full = [part[c].flatten() for c in ("x", "y", "z")]
                full = [c if len(c) == len(docs) else pa.nulls(len(docs), pa.int64()) for c in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), kind), pa.int32()), docs, *full],
                    ["kind", "doc", "x", "y", "z"])
        if key_parts:
            keys = np.concatenate(key_parts)
            if hot is not None and len(keys):
                order = np.argsort(keys)
                starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
                total = np.add.reduceat(np.concatenate(counts)[order], starts)
                often = total >= hot
                names = keys[order][starts][often].view(np.int64)
                yield _flat((HOT, names % spread, names, total[often], np.zeros(0, np.int64)))
            rows = met(keys, np.concatenate(doc_parts), want)[0]
            for start in range(0, len(rows[1]), 50_000):
                yield _flat((rows[0], *[c[start:start + 50_000] for c in rows[1:]]))

    packed = source.mapInArrow(deal, _PACKED)
    return packed.repartition(partitions(source.sparkSession), "bucket").mapInArrow(gather, SCHEMA)
