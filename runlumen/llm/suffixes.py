"""Remove later copies of repeated byte strings, found with suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id.
Strings can meet only where their smallest k-mer hash is the same, so each document posts those
hashes, and those that another document posts too mark the stretches worth sorting. A stretch is the
run of windows that share a smallest hash, and all stretches with that hash go to one task. There the
windows are put in suffix order by prefix doubling, documents in order among equal prefixes. The
longest-previous-factor of a window reaches ``length`` if its previous smaller position in suffix
order, the nearest entry of a smaller document, has so long a prefix in common with it.

Equal stretches of several documents are collapsed before they travel and again where they meet: later
ones follow the fate of the first. They are told apart by a 64-bit hash, as are k-mers. Equal whole texts
are collapsed likewise: only the first is cut into stretches, and of later ones every byte is matched.

A k-mer whose stretches are all equal has no other windows to compare, so only k-mers with two or more
different stretches are sorted.

A k-mer that very many documents hold would bring all its stretches to one task. Its documents are
counted where k-mers meet. Windows of such hot k-mers do not travel as stretches but one by one, by a
64-bit hash of the whole window: a task settles its own and sends on only those of its smallest
document, and the smallest document of all is found where the window's hash is dealt to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import partitions, pieces
from runlumen.llm.postings import HOT, KEY, meetings
from runlumen.llm.vectors import mix64, prefix_hash, span_hash, text_bytes
from runlumen.session import stage

#: Bytes of a k-mer and of text in work at once.
KMER, CHUNK = 20, 2 << 20
#: Buckets of stretches for each partition, which bound what is sorted at once.
BUCKETS = 8
#: Documents from which on a k-mer is hot, hot k-mers that tasks are told of (8 MB; of more the most
#: frequent ones, and the others travel as stretches), and windows or spans that a task gathers.
OFTEN, TOLD, GATHERED = 20_000, 1_000_000, 1_000_000
#: Packed stretches: of each its document, the row, its place, its length; all their bytes
#: in one, compressed. Sizes below 0: spans that are covered already. Sizes 0: windows of hot k-mers, with
#: their hashes in place of the bytes.
_STRETCH = "bucket int, docs array<long>, rows array<long>, at array<int>, sizes array<int>, text binary"
_PACKED = "bucket int, docs array<long>, rows array<long>, starts array<int>, ends array<int>"
_COVER = "doc long, row long, starts array<int>, ends array<int>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 20 bytes at each place, from two words of eight bytes and one of four."""
    n = len(data) - KMER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    low, middle = (np.ndarray(n, "<u8", raw, at, (1,)) for at in (0, 8))
    total = low * _ODD[0]
    total ^= total >> np.uint64(29)
    total += middle
    total *= _ODD[1]
    total ^= total >> np.uint64(32)
    total += np.ndarray(n, "<u4", raw, 16, (1,))
    total *= _ODD[2]
    return mix64(total)


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """Smallest k-mer hash in the window of ``length`` bytes at each place."""
    wide = length - KMER + 1
    low = kmer_hashes(data)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    rest = wide - span
    return np.minimum(low[:-rest], low[rest:]) if rest and len(low) > rest else low[:0] if rest else low


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, row, first, last) of the runs of windows with one key, none across rows."""
    keys = window_keys(data, length)
    if not len(keys):
        none = np.zeros(0, np.int64)
        return keys, none, none, none
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    # a run ends with its row, and where windows no longer fit into it
    over = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    edges = np.concatenate([offsets[:-1], over])
    fresh[edges[edges < len(keys)]] = True
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(keys)) - 1
    row = np.searchsorted(offsets, first, "right") - 1
    fits = first + length <= offsets[row + 1]
    first, last, row = first[fits], last[fits], row[fits]
    return keys[first], row, first, last


def _extract(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches, "text", CHUNK):
            keys, row, _, _ = _runs(*text_bytes(batch["text"]), length)
            yield keys, np.asarray(batch["doc_id"])[row], None
    return run


def hot_keys(found: DataFrame, told: int = TOLD) -> np.ndarray:
    """Keys that ``meetings`` found hot, sorted; if more than ``told`` those of most documents.

    Only the way of the work depends on this, no result.
    """
    hot = found.filter(F.col("kind") == HOT)
    top = hot.orderBy(F.col("y").desc(), "x").limit(told).toArrow()["x"]
    return np.sort(top.to_numpy().view(np.uint64))


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint intervals that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > reach[:-1])
    last = np.append(first[1:], True)
    return starts[first], reach[last]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each span, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _merged(doc: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, row, start, end) of spans merged per (doc, row), in this order."""
    order = np.lexsort((row, doc))
    doc, row, starts, ends = doc[order], row[order], starts[order], ends[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) if len(doc) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    stride = int(ends.max()) + 2 if len(ends) else 1
    a, b = merge(starts + group * stride, ends + group * stride)
    base = a // stride
    return doc[new][base], row[new][base], a - base * stride, b - base * stride


def _pack_covers(spread: int, *found: np.ndarray) -> pa.RecordBatch:
    """Spans merged per (doc, row), one row for each bucket of documents."""
    doc, row, starts, ends = _merged(*found)
    bucket = (mix64(doc.view(np.uint64)) % np.uint64(spread)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    bounds = pa.array(np.append(cut, len(bucket)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(c[order], t)) for c, t in (
        (doc, pa.int64()), (row, pa.int64()), (starts, pa.int32()), (ends, pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int32()), *lists], ["bucket", "docs", "rows", "starts", "ends"])


def _unpack_covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (doc, row) with its spans; rows come by bucket, and one bucket is held at a time."""
    def close() -> Iterator[pa.RecordBatch]:
        doc, row, starts, ends = _merged(*(np.concatenate(c) for c in zip(*own, strict=True)))
        new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
        first = np.flatnonzero(new)
        for at in range(0, len(first), 5_000):
            heads = first[at:at + 5_000]
            end = first[at + 5_000] if at + 5_000 < len(first) else len(doc)
            bounds = pa.array(np.append(heads, end) - heads[0], pa.int32())
            part = slice(heads[0], end)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[heads]), pa.array(row[heads]),
                 pa.ListArray.from_arrays(bounds, pa.array(starts[part], pa.int32())),
                 pa.ListArray.from_arrays(bounds, pa.array(ends[part], pa.int32()))],
                ["doc", "row", "starts", "ends"])

    own, current = [], None
    for batch in batches:
        for i, bucket in enumerate(batch["bucket"].to_pylist()):
            if bucket != current:
                if own:
                    yield from close()
                own, current = [], bucket
            own.append([np.array(batch[c][i].values, np.int64) for c in ("docs", "rows", "starts", "ends")])
    if own:
        yield from close()


def _first_of(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (name, doc), start of each name, and for each entry in order the start of its name."""
    order = np.lexsort((docs, names))
    names = names[order]
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return order, starts, np.repeat(starts, np.diff(np.append(starts, len(names))))


def _packed(bucket: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, sizes: np.ndarray,
            body: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, of entries in order of buckets; ``body`` up to ``reach`` is that of each entry."""
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.append(cut, len(bucket))
    ends = np.append(0, reach)[bounds]
    body = body.tobytes()
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, t)) for c, t in (
        (doc, pa.int64()), (row, pa.int64()), (at, pa.int32()), (sizes, pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int32()), *lists,
         pa.array([pa.compress(body[x:y], "zstd", asbytes=True) for x, y in zip(ends, ends[1:], strict=False)],
                  pa.binary())],
        ["bucket", "docs", "rows", "at", "sizes", "text"])


def _covered(doc: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, spread: int) -> pa.RecordBatch:
    """Spans that are covered already, merged, by bucket."""
    doc, row, starts, ends = _merged(doc, row, starts, ends)
    bucket = doc % spread
    order = np.argsort(bucket, kind="stable")
    return _packed(bucket[order], doc[order], row[order], starts[order], (starts - ends)[order],
                   np.zeros(0, np.uint8), np.zeros(len(order), np.int64))


def _stretches(length: int, spread: int, hot: np.ndarray):
    """Stretches of marked windows and windows of hot keys, by bucket.

    What copies in a chunk cover, and hot windows of later documents of a task, come as covered spans.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            names, docs, rows, at = (np.concatenate(c) for c in zip(*gathered, strict=True))
            order, _, lead = _first_of(names, docs)
            names, docs, rows, at = names[order], docs[order], rows[order], at[order]
            later = docs > docs[lead]
            yield _covered(docs[later], rows[later], at[later], at[later] + length, spread)
            names, docs, rows, at = names[~later], docs[~later], rows[~later], at[~later]
            bucket = (names % np.uint64(spread)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield _packed(bucket[order], docs[order], rows[order], at[order], np.zeros(len(order), np.int64),
                          names[order].view(np.uint8), np.arange(8, 8 * len(order) + 1, 8))

        gathered, size = [], 0
        for batch in pieces(batches, "text", CHUNK):
            data, offsets = text_bytes(batch["text"])
            docs, rows = np.asarray(batch["doc_id"]), np.asarray(batch["row"])
            # a marked key is marked for every document
            marked = np.unique(np.array(batch["keys"].flatten(), np.int64).view(np.uint64))
            keys, row, first, last = _runs(data, offsets, length)
            if not len(marked) or not len(keys):
                continue
            hit = marked[np.minimum(np.searchsorted(marked, keys), len(marked) - 1)] == keys
            keys, row, first, last = keys[hit], row[hit], first[hit], last[hit]
            sums = prefix_hash(data)
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                counts = (last - first + 1)[often]
                at, of = _spread(first[often], counts), np.repeat(row[often], counts)
                gathered.append((span_hash(sums, at, at + length), docs[of], rows[of], at - offsets[of]))
                size += len(at)
                if size >= GATHERED:
                    yield from flush()
                    gathered, size = [], 0
                keys, row, first, last = keys[~often], row[~often], first[~often], last[~often]
            end, doc, place = last + length, docs[row], first - offsets[row]
            order, _, lead = _first_of(span_hash(sums, first, end), doc)
            copy = np.empty(len(order), bool)
            copy[order] = doc[order] > doc[order][lead]
            own = np.flatnonzero(~copy)
            bucket = (keys[own] % np.uint64(spread)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            sizes = (end - first)[own]
            yield _packed(bucket, doc[own], rows[row[own]], place[own], sizes, data[_spread(first[own], sizes)],
                          np.cumsum(sizes))
            if copy.any():
                yield _covered(doc[copy], rows[row[copy]], place[copy], (place + end - first)[copy], spread)
        if size:
            yield from flush()
    return run


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of values, as unsigned 64-bit numbers."""
    order = np.argsort(values)
    ordered = values[order]
    steps = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
    result = np.empty(len(values), np.uint64)
    result[order] = steps
    return result


def suffix_ranks(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Ranks in suffix order of the first ``length`` bytes at each place where they fit into their text.

    Texts of ``sizes`` bytes lie end to end in ``data``. Prefix doubling: ranks of 8 bytes give those of
    16, of 32 and so on, each computed only where so many bytes fit. Other places have no rank (0).
    """
    begin = np.cumsum(sizes) - sizes
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.zeros(len(data), np.uint64)
    span = min(8, length)
    for j in range(span):
        word = (word << np.uint64(8)) | padded[j:j + len(word)]
    at = _spread(begin, sizes - span + 1)
    rank = np.zeros(len(data), np.uint64)
    rank[at] = _ranks(word[at])
    while span < length:
        step = min(span, length - span)
        span += step
        at = _spread(begin, sizes - span + 1)
        longer = _ranks((rank[at] << np.uint64(32)) | rank[at + step])
        rank = np.zeros(len(data), np.uint64)
        rank[at] = longer
    return rank


def earlier(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts, laid end to end in ``data``, that also start in a text of a smaller document.

    Returns (text, place in it) of each such window, in order.
    """
    begin, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = _spread(begin, counts)
    rank, doc = suffix_ranks(data, sizes, length)[at], _ranks(docs)[owner]
    order = np.argsort(rank << np.uint64(32) | doc)
    rank, ordered = rank[order], doc[order]
    run = np.maximum.accumulate(np.where(np.append(True, rank[1:] != rank[:-1]), np.arange(len(rank)), 0))
    found = np.empty(len(rank), bool)
    found[order] = ordered > ordered[run]  # the previous smaller position shares the prefix
    return owner[found], (at - begin[owner])[found]


def _settle(length: int, spread: int):
    """Covered spans of the stretches of a task, by bucket of documents."""
    def close(docs: np.ndarray, rows: np.ndarray, at: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        begin = np.cumsum(sizes) - sizes
        names = span_hash(prefix_hash(data), begin, begin + sizes)
        order, starts, lead = _first_of(names, docs)
        docs, rows, at, sizes, begin = docs[order], rows[order], at[order], sizes[order], begin[order]
        later = docs > docs[lead]
        yield docs[later], rows[later], at[later], (at + sizes)[later]
        # windows of distinct stretches of keys that have several
        keys = window_keys(data, length)[begin[starts]]
        head = np.argsort(keys, kind="stable")
        same = keys[head][1:] == keys[head][:-1]
        head = starts[head[np.append(False, same) | np.append(same, False)]] if len(head) else starts
        if not len(head):
            return
        own, least = sizes[head], docs[head]
        text = data[_spread(begin[head], own)]
        who, place = earlier(text, own, least, length)
        new = np.append(True, (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)) if len(who) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(new)[1:], len(who)) - 1
        who, a, b = head[who[new]], place[new], place[last] + length if len(who) else place
        # each entry of the first document with that stretch
        size = np.diff(np.append(starts, len(docs)))
        size_of = np.zeros(len(docs), np.int64)
        size_of[starts] = size
        use = _spread(who, size_of[who])
        a, b = np.repeat(a, size_of[who]), np.repeat(b, size_of[who])
        same = ~later[use]
        use, a, b = use[same], a[same], b[same]
        yield docs[use], rows[use], at[use] + a, at[use] + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        gathered, own, single, current = 0, [], [], None

        def add(found: tuple) -> None:
            nonlocal gathered
            gathered += len(found[0])
            for column, values in zip(out, found, strict=True):
                column.append(values)

        def settle() -> None:
            if own:
                for found in close(*[np.concatenate(c) for c in zip(*own, strict=True)]):
                    add(found)
                own.clear()
            if single:
                names, docs, rows, at = (np.concatenate(c) for c in zip(*single, strict=True))
                order, _, lead = _first_of(names, docs)
                use = order[docs[order] > docs[order][lead]]
                add((docs[use], rows[use], at[use], at[use] + length))
                single.clear()

        for batch in batches:  # by bucket, so that one is held at a time
            for i, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != current:
                    settle()
                    current = bucket
                    if gathered >= GATHERED:
                        yield _pack_covers(spread, *[np.concatenate(c) for c in out])
                        out, gathered = [[], [], [], []], 0
                docs, rows, at, sizes = (
                    np.array(batch[c][i].values, np.int64) for c in ("docs", "rows", "at", "sizes"))
                if len(sizes) and sizes[0] < 0:
                    add((docs, rows, at, at - sizes))
                elif len(sizes) and sizes[0] == 0:
                    single.append([np.frombuffer(pa.decompress(
                        batch["text"][i].as_py(), 8 * len(docs), "zstd", asbytes=True), np.uint64), docs, rows, at])
                else:
                    data = np.frombuffer(pa.decompress(
                        batch["text"][i].as_py(), int(sizes.sum()), "zstd", asbytes=True), np.uint8)
                    own.append([docs, rows, at, sizes, data])
        settle()
        if gathered:
            yield _pack_covers(spread, *[np.concatenate(c) for c in out])
    return run


def _cut(length: int):
    """What is left of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            sizes, removed, spans, digest = [], [], [], []
            texts = batch["text"].fill_null("").cast(pa.binary()).to_pylist()
            rows, covers = batch["row"].to_pylist(), batch["covers"].to_pylist()
            for text, row, found, copy in zip(texts, rows, covers, batch["copy"].to_pylist(), strict=True):
                mine = [c for c in found or [] if c["row"] == row]
                if copy and len(text) >= length:
                    mine = [{"starts": [0], "ends": [len(text)]}]
                a, b = merge(np.array([x for c in mine for x in c["starts"]], np.int64),
                             np.array([x for c in mine for x in c["ends"]], np.int64))
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                sizes.append(len(text))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def deduplicate(docs: DataFrame, length: int = 50, hot: int = OFTEN, told: int = TOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a
    smaller doc_id, judged on the input; n_spans counts maximal removed runs. Null and empty texts have
    0 bytes; texts shorter than ``length`` stay whole. Rows of one doc_id, repeated ones too, are not
    earlier than each other; a row with a null doc_id is earlier than none, later than none, and stays
    whole. k-mers of ``hot`` documents or more are dealt out window by window, at most ``told`` of them.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.filter(F.col("doc_id").isNotNull())
    found = stage(meetings(known, _extract(length), KEY, hot).select("kind", "doc", "x", "y"), "meetings")
    often = hot_keys(found, told)
    marked = found.filter(F.col("kind") == KEY).groupBy("doc").agg(F.collect_list("x").alias("keys"))
    # ids of texts that a smaller id has too, with those texts' hashes
    text_hash = F.xxhash64("text")
    same = known.groupBy(text_hash.alias("row"), F.md5(F.col("text").cast("binary")).alias("sum"))
    several = same.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = known.select("doc_id", text_hash.alias("row"), F.md5(F.col("text").cast("binary")).alias("sum")).join(
        several.hint("merge"), ["row", "sum"]).filter("doc_id > first").groupBy(
        F.col("doc_id").alias("copy_of")).agg(F.collect_set("row").alias("copied"))
    dealt = known.repartition(n, "doc_id")
    row = text_hash.alias("row")
    copy = F.coalesce(F.array_contains("copied", text_hash), F.lit(False)).alias("copy")
    flagged = dealt.join(copies.hint("merge"), F.col("doc_id") == F.col("copy_of"), "left")
    stretches = flagged.filter(~copy).join(marked.hint("merge"), F.col("doc_id") == F.col("doc")).select(
        "doc_id", "text", row, "keys").mapInArrow(_stretches(length, BUCKETS * n, often), _STRETCH)
    settled = stretches.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _settle(length, 4 * n), _PACKED)
    covers = settled.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_unpack_covers, _COVER).groupBy(
        "doc").agg(F.collect_list(F.struct("row", "starts", "ends")).alias("covers"))
    joined = flagged.join(covers.hint("merge"), F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", "text", row, copy, "covers")
    none = F.lit(None).cast(covers.schema["covers"].dataType).alias("covers")
    nameless = texts.filter(F.col("doc_id").isNull()).select("doc_id", "text", row, F.lit(False).alias("copy"), none)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_cut(length), schema).union(nameless.mapInArrow(_cut(length), schema))
