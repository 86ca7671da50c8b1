"""Exact join of documents whose sets of word n-grams are alike (Jaccard), by overlap search.

Two sets that reach the threshold differ in few elements. Dealt by hash into more parts than they may
differ in, they agree in at least one part; a hash per part brings such documents together, and what
hangs together that way is a group that loses no link. Inside a group, T-occurrence search finds the
sets that share enough elements with a set: the inverted lists of its elements are divided, the short
ones are merged, and what occurs often enough there is looked up in the long ones by binary search
(DivideSkip). Every link is checked on the whole sets.

Equal sets are one class with one representative. A group with more elements than a task should hold
is cut into blocks, and each pair of blocks is searched by itself. A search stops once what is left
lies in one component, so a group of near copies costs its members once, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import partitions, pieces
from runlumen.llm.components import components
from runlumen.llm.postings import LINK, meetings
from runlumen.llm.vectors import lower_ascii, mix64, prefix_hash, span_hash, text_bytes, words
from runlumen.session import stage

#: Rows that carry a document's set size and 128-bit digest of the set.
INFO = 4
#: Elements of the sets in a block of a large group (8 bytes each).
BLOCK = 2_000_000
CHUNK = 2 << 20
_GROWTH = 1.4
#: Part sizes told apart when small parts are left out.
_LARGE = 12


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of the distinct word n-grams of each text, sorted within a row.

    A-Z in lower case; a text with fewer than ``n`` words has its whole sequence as one; without
    words it has none.
    """
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, row = words(data, offsets)
    hashes = span_hash(prefix_hash(data), starts, ends)
    counts = np.bincount(row, minlength=len(column)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    spots = np.maximum(counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(column)), spots)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(spots) - spots, spots) + first[owner]
    padded = np.append(hashes, np.zeros(n, np.uint64))
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        inside = at + j < first[owner + 1]
        total = mix64(total + np.where(inside, padded[at + j], np.uint64(j + 1)))
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[fresh], owner[fresh]
    return total, np.searchsorted(owner, np.arange(len(column) + 1))


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, independent of order."""
    result = []
    for salt in (1, 2):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix64(values + np.uint64(salt * 0x5851F42D4C957F2D)), out=sums[1:])
        result.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return result[0], result[1]


def _classes(most: int) -> np.ndarray:
    """Upper sizes of the classes in which sets are compared."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * _GROWTH)))
    return np.array(bounds, np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of the parts of each set.

    A pair is compared in the class of its larger set, so a set takes part in its own class and in
    those of the larger sets it may be like. In a class of sets up to r elements, a pair differs in
    at most k = 2r(100-p)/(100+p) elements, and the sets are dealt into m > k parts, so at least m-k
    parts agree. Small parts say little, and each set leaves out its smallest: those below the largest
    size that at most m-k-1 of its parts are below. The largest part in which a pair agrees is never
    left out, as all m-k agreeing parts would be. Classes with k = 0 hold equal sets only.
    """
    sizes = np.diff(offsets)
    if not len(values):
        return
    bounds = _classes(int(sizes.max()) * 100 // percent + 1)
    lowest = np.searchsorted(bounds, sizes)
    highest = np.searchsorted(bounds, sizes * 100 // percent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(int((highest - lowest).max()) + 1):
        level = lowest + step
        differ = 2 * bounds[np.minimum(level, len(bounds) - 1)] * (100 - percent) // (100 + percent)
        active = (level <= highest) & (sizes > 0) & (differ > 0)
        spare = np.maximum(2, 3 * differ // 8)
        parts = np.where(active, differ + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        chosen = active[owner]
        x, o = values[chosen], owner[chosen]
        slot = base[o] + ((x >> np.uint64(9)) % parts[o].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, mix64(x))
        filled = np.bincount(slot, minlength=base[-1])
        row = np.repeat(np.arange(len(sizes)), parts)
        # parts below 1, 2, ... elements of each set
        below = np.bincount(row * _LARGE + np.minimum(filled, _LARGE - 1), minlength=len(sizes) * _LARGE)
        below = np.cumsum(below.reshape(-1, _LARGE), axis=1)[:, :-1]
        least = (below <= spare[:, None]).sum(1)
        place = np.arange(base[-1]) - base[row]
        keep = filled >= least[row]
        name = (level[row].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)
        yield mix64(sums + mix64(name))[keep], row[keep]


def overlap_links(sets: list[np.ndarray], percent: int, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of alike sets; T-occurrence search by DivideSkip.

    ``whole`` gives the sizes of the sets where ``sets`` leaves out elements that no other set has.

    Sets are searched one by one against all others, sets outside the largest component first, until
    all sets not yet searched lie in one component.
    """
    n = len(sets)
    given = np.array([len(s) for s in sets])
    sizes = given if whole is None else whole
    tokens, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), given)
    order = np.argsort(codes, kind="stable")
    lists, first = owner[order], np.searchsorted(codes[order], np.arange(len(tokens) + 1))
    own = np.split(codes, np.cumsum(given)[:-1])
    label, members = np.arange(n), {i: [i] for i in range(n)}
    waiting = dict.fromkeys(range(n))
    alive: dict[int, int] = dict.fromkeys(range(n), 1)  # sets of each component still to be searched
    found = []
    while len(alive) > 1:
        largest = max(alive, key=lambda c: len(members[c])) if len(found) else -1
        q = next((i for i in waiting if label[i] != largest), None)
        if q is None:
            break
        del waiting[q]
        for c in _occurrences(own[q], q, lists, first, sizes, percent):
            a, b = label[q], label[c]
            if a != b:
                found.append((q, int(c)))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                label[members[b]] = a
                members[a] += members.pop(b)
                alive[a] = alive.get(a, 0) + alive.pop(b, 0)
        c = label[q]
        alive[c] = alive.get(c, 0) - 1
        if alive[c] <= 0:
            del alive[c]
    return found


def _occurrences(query: np.ndarray, q: int, lists: np.ndarray, first: np.ndarray, sizes: np.ndarray,
                 percent: int) -> np.ndarray:
    """Other sets alike to a query set."""
    lengths = first[query + 1] - first[query]
    needed = -(-percent * int(sizes[q]) // 100)  # an alike set shares at least that many elements
    if len(query) < needed:
        return np.zeros(0, np.int64)
    longest = int(lengths.max())
    long = min(needed - 1, int(needed / (0.01 * np.log2(longest + 1) + 1)))
    by_length = query[np.argsort(lengths, kind="stable")]
    short, rest = by_length[:len(by_length) - long], by_length[len(by_length) - long:]
    runs = [lists[first[t]:first[t + 1]] for t in short]
    merged = np.sort(np.concatenate(runs), kind="stable")  # merges sorted runs
    starts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    count, at = np.diff(np.append(starts, len(merged))), merged[starts]
    near = (count >= needed - long) & (at != q) & (
        sizes[at] * 100 >= percent * sizes[q]) & (sizes[at] * percent <= 100 * sizes[q])
    at, count = at[near], count[near]
    for i, t in enumerate(rest):
        if not len(at):
            break
        run = lists[first[t]:first[t + 1]]
        spot = np.searchsorted(run, at)
        count = count + (run[np.minimum(spot, len(run) - 1)] == at)
        still = count + (len(rest) - 1 - i) >= needed
        at, count = at[still], count[still]
    return at[100 * count >= percent * (sizes[q] + sizes[at] - count)]


def _extract(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches, "text", CHUNK):
            docs = np.asarray(batch["doc_id"])
            values, offsets = shingles(batch["text"], n)
            d1, d2 = digests(values, offsets)
            info = (INFO, docs, np.diff(offsets), d1, d2)
            for keys, row in signatures(values, offsets, percent):
                yield keys, docs[row], info
                info = None
            if info is not None:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64), info
    return run


def _sets(n: int):
    """Shingle sets of representatives, checked against their digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            values, offsets = shingles(batch["text"], n)
            d1, d2 = digests(values, offsets)
            same = (np.asarray(batch["d1"]) == d1) & (np.asarray(batch["d2"]) == d2)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch[c] for c in ("grp", "doc", "blocks", "d1", "d2")] + [lists],
                                             ["grp", "doc", "blocks", "d1", "d2", "items"])
            yield out.filter(pa.array(same))
    return run


def _search(percent: int):
    """Search each (grp, i, j) of a partition sorted by it; a document may have several sets."""
    def close(docs: list, sets: list) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(docs, np.int64)
        pairs = np.array(overlap_links(sets, percent), np.int64).reshape(-1, 2)
        return ids[pairs[:, 0]], ids[pairs[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sets, seen = None, [], [], set()
        for batch in batches:
            keys = list(zip(*[batch[c].to_pylist() for c in ("grp", "i", "j")], strict=True))
            ids = batch["doc"].to_pylist()
            names = zip(ids, batch["d1"].to_pylist(), batch["d2"].to_pylist())
            values = np.array(batch["items"].flatten(), np.int64)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch["items"])))
            rows = np.split(values, ends[:-1]) if len(ends) else []
            for key, doc, name, items in zip(keys, ids, names, rows, strict=True):
                if key != now:
                    if len(docs) > 1:
                        a, b = close(docs, sets)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    now, docs, sets, seen = key, [], [], set()
                if name in seen:  # the same row once more
                    continue
                seen.add(name)
                docs.append(doc)
                sets.append(items.copy())
        if len(docs) > 1:
            a, b = close(docs, sets)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def join(docs: DataFrame, n: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (needs doc_id and text).

    Two documents link when their sets of word n-grams have ``percent`` % of their union in common;
    component_id is the smallest doc_id reachable by links. Documents without words link with nothing.
    A null doc_id gives a null component; rows that share a doc_id are one document with several texts,
    each with its own n_shingles, and share their links. Elements are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.filter(F.col("doc_id").isNotNull())
    met = stage(meetings(known, _extract(n, percent), LINK), "met")
    info = met.filter(F.col("kind") == INFO).select(
        "doc", F.col("x").alias("n"), F.col("y").alias("d1"), F.col("z").alias("d2"))
    links = met.filter(F.col("kind") == LINK).select(F.col("doc").alias("a"), F.col("x").alias("b"))
    grouped = components(links).select(F.col("node").alias("doc"), F.col("component").alias("grp"))
    # one representative for each set; equal sets are in one group
    filled = info.filter("n > 0")
    classes = stage(filled.groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep")), "classes")
    members = classes.select(F.col("rep").alias("doc"), "d1", "d2", "n").join(grouped, "doc")
    sizes = members.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    sizes = sizes.filter("sets > 1").select(
        "grp", F.ceil(F.col("elements") / block).cast("int").alias("blocks"))
    wanted = stage(members.join(sizes, "grp").select("doc", "grp", "d1", "d2", "blocks"), "members")
    # the same join at every size: the wanted documents are many on a large corpus
    sets = known.join(wanted.hint("merge"), F.col("doc_id") == F.col("doc")).select(
        "grp", "doc", "blocks", "text", "d1", "d2").mapInArrow(
        _sets(n), "grp long, doc long, blocks int, d1 long, d2 long, items array<long>")
    own = F.pmod(F.xxhash64("doc", "d1", "d2"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != own))
    dealt = sets.withColumn("other", F.explode(others)).select(
        "grp", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "doc", "d1",
        "d2", "items")
    dealt = dealt.repartition(partitions(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = dealt.mapInArrow(_search(percent), "a long, b long")
    copies = filled.join(classes, ["d1", "d2", "n"]).filter("doc <> rep").select(
        F.col("doc").alias("a"), F.col("rep").alias("b"))
    linked = components(found.union(copies))
    result = info.join(linked, info["doc"] == linked["node"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"))
    nameless = texts.filter(F.col("doc_id").isNull()).mapInArrow(_sizes(n), "n_shingles long")
    return result.unionByName(nameless.select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(shingles(batch["text"], n)[1]))], ["n_shingles"])
    return run
