"""The n-gram Jaccard join for lower thresholds: sets meet in their rarest shared shingles.

At five words and 80 % the parts of ``jaccard.join`` hold few shingles each, and common phrases tie
most of a corpus into one group. Here all shingles are counted, in how many different sets they are.
A shingle of one set is in no intersection, so a set with m shared shingles that needs T of them posts
its m - T + 1 rarest: two sets that reach the threshold meet in the rarest shingle they share. What
hangs together that way is searched by T-occurrence (DivideSkip, as in ``jaccard``) on the shared
shingles and the whole sizes, so texts are read once and never shuffled.

A shingle in ``HOT`` or more sets that one task gathers is known as hot to that task: it sends a mark in
place of its sets. Hot shingles rank behind all others, by hash, so no task counts their sets. Equal
sets are one set from the first step on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import partitions, pieces
from runlumen.llm.components import components
from runlumen.llm.jaccard import BLOCK, CHUNK, _sizes, digests, overlap_links, shingles
from runlumen.llm.postings import _PACKED, LINK, _pack, groups, meetings
from runlumen.session import stage

#: Shingles a task gathers before it deals them out.
GATHERED = 1_500_000
#: Sets among those gathered from which a shingle of them is hot.
HOT = 32
#: Kinds of packed rows: a shingle's set, the mark of a hot shingle, a set's shared shingle, a set's size, a document.
POST, MARK, SHARED, SIZE, INFO = 1, 2, 3, 4, 5
_LAST = np.iinfo(np.int64).max
_NONE = np.zeros(0, np.int64)
_OUT = "kind int, doc long, set long, n long, posted array<long>, items array<long>"


def _deal(n: int, spread: int):
    """Packed rows of the texts of a task; shingles go by hash, all else by set or document."""
    def bucket(values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) % np.uint64(spread)).astype(np.int64)

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, sets, starts, sizes = groups(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        hot = np.repeat(sizes >= HOT, sizes)
        names = keys.view(np.int64)
        yield _pack(bucket(names[~hot]), POST, [sets[~hot], names[~hot], _NONE, _NONE])
        marked = names[starts][sizes >= HOT]
        yield _pack(bucket(marked), MARK, [marked, _NONE, _NONE, _NONE])
        yield _pack(bucket(sets[hot]), SHARED, [sets[hot], names[hot], np.full(hot.sum(), _LAST), _NONE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered, seen = [], 0, np.zeros(0, np.int64)
        for batch in pieces(batches, "text", CHUNK):
            docs = np.asarray(batch["doc_id"])
            values, offsets = shingles(batch["text"], n)
            d1, _ = digests(values, offsets)
            counts = np.diff(offsets)
            yield _pack(docs // 64 % spread, INFO, [docs, d1, counts, _NONE])
            # copies inside what is gathered are told apart once
            first = np.zeros(len(d1), bool)
            first[np.unique(d1, return_index=True)[1]] = True
            first &= (counts > 0) & ~np.isin(d1, seen)
            yield _pack(bucket(d1[first]), SIZE, [d1[first], counts[first], _NONE, _NONE])
            seen = np.append(seen, d1[first])
            parts.append((values[np.repeat(first, counts)], np.repeat(d1[first], counts[first])))
            gathered += len(parts[-1][0])
            if gathered >= GATHERED:
                yield from flush(parts)
                parts, gathered, seen = [], 0, np.zeros(0, np.int64)
        if gathered:
            yield from flush(parts)
    return run


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch[name].flatten(), np.int64)


def _of_kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return batch.filter(pa.array(np.asarray(batch["kind"]) == kind))


def _count(spread: int):
    """Shingles of several sets, each with the number of sets, dealt to the sets; the rest goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, marks = [np.zeros(0, np.uint64)], [_NONE], [_NONE]
        for batch in batches:
            for at, kind in enumerate(batch["kind"].to_pylist()):  # a packed row after the other, no copy of a batch
                row = batch.slice(at, 1)
                if kind == POST:
                    keys.append(_column(row, "x").view(np.uint64))
                    sets.append(_column(row, "docs"))
                elif kind == MARK:
                    marks.append(_column(row, "docs"))
            yield batch.filter(pa.array(np.asarray(batch["kind"]) > MARK))
        keys, sets = np.concatenate(keys), np.concatenate(sets)
        keys, sets, _, sizes = groups(keys, sets)
        known = np.repeat(sizes, sizes)
        known[np.isin(keys.view(np.int64), np.concatenate(marks))] = _LAST
        several = known > 1
        keys, sets, known = keys[several], sets[several], known[several]
        for at in range(0, len(keys), GATHERED):
            part = slice(at, at + GATHERED)
            yield _pack((sets[part].view(np.uint64) % np.uint64(spread)).astype(np.int64), SHARED,
                        [sets[part], keys[part].view(np.int64), known[part], _NONE])
    return run


def _collect(percent: int):
    """INFO rows, and a row per set that can have a partner: its shared shingles and those it posts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, sizes = [(_NONE, _NONE, _NONE)], [(_NONE, _NONE)]
        for batch in batches:
            part = _of_kind(batch, SHARED)
            shared.append(tuple(_column(part, c) for c in ("docs", "x", "y")))
            part = _of_kind(batch, SIZE)
            sizes.append(tuple(_column(part, c) for c in ("docs", "x")))
            part = _of_kind(batch, INFO)
            docs = part["docs"].flatten()
            none = pa.nulls(len(docs), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), INFO), pa.int32()), docs, part["x"].flatten(), part["y"].flatten(),
                 none, none], ["kind", "doc", "set", "n", "posted", "items"])
        sets, keys, known = (np.concatenate(c) for c in zip(*shared, strict=True))
        names, whole = (np.concatenate(c) for c in zip(*sizes, strict=True))
        names, first = np.unique(names, return_index=True)
        whole = whole[first]
        order = np.lexsort((keys, known, sets))
        sets, keys = sets[order], keys[order]
        fresh = np.ones(len(sets), bool)
        fresh[1:] = (sets[1:] != sets[:-1]) | (keys[1:] != keys[:-1])
        sets, keys = sets[fresh], keys[fresh]
        start, end = np.searchsorted(sets, names), np.searchsorted(sets, names, "right")
        spare = end - start - -(-percent * whole // 100) + 1
        for at in np.array_split(np.flatnonzero(spare > 0), max(1, len(names) // 1000)):
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), SIZE), pa.int32()), pa.nulls(len(at), pa.int64()),
                     pa.array(names[at]), pa.array(whole[at]),
                     pa.array([keys[a:a + p] for a, p in zip(start[at], spare[at], strict=True)], pa.list_(pa.int64())),
                     pa.array([keys[a:b] for a, b in zip(start[at], end[at], strict=True)], pa.list_(pa.int64()))],
                    ["kind", "doc", "set", "n", "posted", "items"])
    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        lengths = np.asarray(pa.compute.list_value_length(batch["posted"]))
        keys = np.array(batch["posted"].flatten(), np.int64)
        yield keys.view(np.uint64), np.repeat(np.asarray(batch["set"]), lengths), None


def _search(percent: int):
    """Links of the sets of each (grp, i, j) of a partition sorted by it."""
    def close(sets: dict) -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            names = np.array(list(sets), np.int64)
            items, sizes = zip(*sets.values(), strict=True)
            pairs = np.array(overlap_links(list(items), percent, np.array(sizes)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(names[pairs[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            keys = zip(*[batch[c].to_pylist() for c in ("grp", "i", "j")], strict=True)
            values = np.array(batch["items"].flatten(), np.int64)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch["items"])))
            rows = np.split(values, ends[:-1]) if len(ends) else []
            for key, name, size, items in zip(keys, batch["set"].to_pylist(), batch["n"].to_pylist(), rows, strict=True):
                if key != now:
                    yield from close(sets)
                    now, sets = key, {}
                sets[name] = (items.copy(), size)
        yield from close(sets)
    return run


def join(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``, as ``jaccard.join`` gives them.

    Two documents link when their sets of word n-grams have ``percent`` % of their union in common;
    component_id is the smallest doc_id reachable by links. Documents without words link with nothing.
    A null doc_id gives a null component; rows that share a doc_id are one document with several texts,
    each with its own n_shingles, and share their links. An empty table gives no rows. Shingles and
    sets are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    spread = 2 * partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = texts.filter(F.col("doc_id").isNotNull()).mapInArrow(_deal(n, spread), _PACKED)
    # a bucket is a partition of its own, so none holds several by chance
    bucket = F.col("bucket")
    counted = packed.repartitionById(spread, bucket).mapInArrow(_count(spread), _PACKED)
    rows = stage(counted.repartitionById(spread, bucket).mapInArrow(_collect(percent), _OUT), "sets")
    info = rows.filter(F.col("kind") == INFO).select("doc", "set", "n")
    sets = rows.filter(F.col("kind") == SIZE).select("set", "n", "posted", "items")
    met = meetings(sets.select("set", "posted"), _posted, LINK)
    grouped = components(met.select(F.col("doc").alias("a"), F.col("x").alias("b"))).select(
        F.col("node").alias("set"), F.col("component").alias("grp"))
    members = stage(sets.select("set", "n", "items").join(grouped, "set"), "members")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum(F.size("items")) / block).cast("int").alias("blocks"))
    members = members.join(blocks, "grp")
    # a group of more than a block is searched by pairs of blocks
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != own))
    dealt = members.withColumn("other", F.explode(others)).select(
        "grp", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "set", "n", "items")
    dealt = dealt.repartition(partitions(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = dealt.mapInArrow(_search(percent), "a long, b long")
    # the texts of one document hang together
    filled = info.filter("n > 0")
    held = filled.groupBy("doc").agg(F.min("set").alias("set"), F.max("set").alias("last"))
    several = held.filter("`set` < `last`").select("doc", F.col("set").alias("b"))
    bridges = filled.join(several, "doc").select(F.col("set").alias("a"), "b")
    linked = components(found.union(bridges)).select(F.col("node").alias("set"), "component")
    placed = held.select("doc", "set").join(linked, "set", "left").select(
        "doc", F.coalesce("component", "set").alias("place"))
    least = placed.groupBy("place").agg(F.min("doc").alias("component_id"))
    named = placed.join(least, "place").select("doc", "component_id")
    result = info.join(named, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"))
    nameless = texts.filter(F.col("doc_id").isNull()).mapInArrow(_sizes(n), "n_shingles long")
    return result.unionByName(nameless.select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))
