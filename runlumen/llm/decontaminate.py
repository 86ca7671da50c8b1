"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may appear in a document with up to k = rate * m edits. Split into k + 1
pieces, at least one piece must appear unchanged. One automaton finds all pieces of all items in one
pass over a document; around each hit, Myers' bit-parallel algorithm finds the distance of ever larger
parts of the item, up to the whole of it, to the best-matching passage. A part of p pieces may have p - 1
edits: of a match split in two, one half always keeps within its own budget, so some hit leads to the
whole item, and a chance hit ends with a short part. Case and runs of white space do not count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlumen.llm.common import pieces, texts_of

#: Share of an item's characters that may differ, and the shortest item in which any may.
RATE, LEAST = 0.1, 20
#: Characters of items in one automaton (a megabyte broadcast); more items take more passes.
BLOCK_CHARS = 1 << 20
CHUNK = 4 << 20


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


@functools.lru_cache(1 << 16)
def _places(item: str) -> dict[str, int]:
    """Bit mask of the places of each character."""
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | (1 << i)
    return places


def best_distance(item: str, passage: str) -> int:
    """Smallest edit distance of ``item`` to any substring of ``passage`` (Myers, bit-parallel)."""
    m = len(item)
    places = _places(item)
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in passage:
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
    return best


def parts_around(piece: int, pieces_in_all: int) -> list[tuple[int, int]]:
    """Ranges of pieces around a piece, from the smallest part of two or more to all, halving down."""
    low, high, found = 0, pieces_in_all, []
    while high - low > 1:
        found.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    return found[::-1]


class Matcher:
    """All items of a block: an automaton of pieces and the distance check."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = LEAST) -> None:
        import ahocorasick

        self.items, self.cuts, self.least = items, [], least
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            n = int(rate * len(text)) + 1 if len(text) >= least else 1
            cuts = [i * len(text) // n for i in range(n + 1)]
            self.cuts.append(cuts)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                found.setdefault(text[a:b], []).append((number, i))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def _holds(self, number: int, piece: int, at: int, text: str) -> bool:
        """Whether the whole item matches around an exact hit of a piece at ``at``."""
        item, cuts = self.items[number][1], self.cuts[number]
        start = at - cuts[piece]
        if len(item) < self.least:  # too short to differ: whole words, as they are
            return not (text[at - 1:at].isalnum() and item[0].isalnum()) and not (
                text[at + len(item):at + len(item) + 1].isalnum() and item[-1].isalnum())
        for low, high in parts_around(piece, len(cuts) - 1):
            budget = high - low - 1
            passage = text[max(0, start + cuts[low] - budget):start + cuts[high] + budget]
            if best_distance(item[cuts[low]:cuts[high]], passage) > budget:
                return False
        return True

    def matches(self, text: str) -> list[int]:
        """Ids of items within their error budget, in order."""
        if not self.items:
            return []
        text = normal(text)
        hit: set[int] = set()
        for end, (size, uses) in self.automaton.iter(text):
            for number, piece in uses:
                if number not in hit and self._holds(number, piece, end + 1 - size, text):
                    hit.add(number)
        return sorted({self.items[n][0] for n in hit})


def blocks(items: DataFrame, most: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """Items (item_id, text) normalised and cut into blocks of about ``most`` characters.

    Their number follows from the total length, counted first; each block is fetched by itself. Items
    without id or without any word are left out.
    """
    usable = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most)
    result = []
    for i in range(n):
        part = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        clean = sorted({(r["item_id"], normal(r["text"])) for r in part})
        result.append([x for x in clean if x[1]])
    return result


def contaminating(docs: DataFrame, items: DataFrame, rate: float = RATE, out: str = "items",
                  least: int = LEAST, most: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (needs text) with the sorted ids of benchmark items that each whole text contains.

    A text contains an item if some passage is within ``rate`` of the item's length in edits, case and
    white space aside; an item of fewer than ``least`` characters must be there unchanged, between word
    bounds. Null and empty texts contain none; a column named ``out`` is replaced; repeated
    rows get equal lists. Documents stay in their partitions: nothing is shuffled.
    """
    kept = docs.select(*[c for c in docs.columns if c != out])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in blocks(items, most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(b.value, rate, least) for b in shared]
        for batch in pieces(batches, "text", CHUNK):
            found = [sorted({i for m in matchers for i in m.matches(t)}) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
