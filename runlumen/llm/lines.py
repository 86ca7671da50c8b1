"""Delete later repeats of runs of lines, found by winnowing.

Lines are hashed. A run counts from ``run`` lines on, or from ``words`` words on. Every window of so many
lines selects the place of its smallest hash as a fingerprint; neighbouring windows mostly select the
same place, and equal windows select the same line of theirs, so a repeated run shares a fingerprint for
sure. Places whose fingerprint occurs once end there. The others are extended both ways over the lines
around them, to the windows that selected them, and joined to the first place with the same lines.
Matched windows that overlap extend each other to the full length of a run, and the lines they cover are
deleted. The first copy, by document and place, stays.

Only DataFrame functions are used. A line that very many documents share gives one row for each place
and a minimum that is pre-aggregated, never pairs of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import n_words

#: Words from which on a run of fewer lines counts as well.
WORDS = 50


def line_list(text: Column) -> Column:
    """Lines of a text, cut at line feeds only."""
    return F.split(text, "\n", -1)


def _chosen(lines: Column) -> Column:
    """Place of the first smallest hash among ``lines``."""
    return F.array_position(lines, F.array_min(lines)).cast("int")


def _between(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _held(counts: Column, start: Column, size: int) -> Column:
    return F.aggregate(F.slice(counts, start, size), F.lit(0).cast("long"), lambda n, x: n + x)


def fingerprints(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc, row, place, mark, begin, around, held) of every place that a window of ``run`` lines selects.

    With ``words`` also of those that windows of fewer lines select which hold so many words together.
    ``around`` are the hashes of the lines, from ``begin`` on, that a window with this place can reach, and
    ``held`` their words.
    """
    hashes = F.transform(line_list(F.col("text")), lambda x: F.xxhash64(x))
    held = F.transform(line_list(F.col("text")), n_words) if words is not None else F.lit(None).cast("array<long>")
    listed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), hashes.alias("hashes"),
                         held.alias("held"))

    def selected(size: int) -> Column:
        starts = _between(F.lit(1), F.size("hashes") - (size - 1))
        if size < run:
            starts = F.filter(starts, lambda i: _held(F.col("held"), i, size) >= words)
        return F.transform(starts, lambda i: i + _chosen(F.slice("hashes", i, size)) - 1)

    sizes = range(1 if words is not None else run, run + 1)
    places = listed.select("*", F.explode(F.array_distinct(F.concat(*map(selected, sizes)))).alias("place"))
    begin = F.greatest(F.lit(1), F.col("place") - (run - 1))
    reach = F.col("place") + run - begin
    return places.select("doc", "row", "place", F.element_at("hashes", F.col("place")).alias("mark"),
                         begin.alias("begin"), F.slice("hashes", begin, reach).alias("around"),
                         F.slice("held", begin, reach).alias("held"))


def extend(found: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc, row, place, size, lines) of the windows that selected the places of ``found``.

    A window selects one place, so it comes out once at most.
    """
    at = F.col("place") - F.col("begin") + 1

    def cut(size: int) -> Column:
        starts = _between(F.greatest(F.lit(1), at - (size - 1)), F.least(at, F.size("around") - (size - 1)))
        starts = F.filter(starts, lambda i: i + _chosen(F.slice("around", i, size)) - 1 == at)
        if size < run:
            starts = F.filter(starts, lambda i: _held(F.col("held"), i, size) >= words)
        return F.transform(starts, lambda i: F.struct(
            (F.col("begin") + i - 1).alias("place"), F.lit(size).alias("size"),
            F.slice("around", i, size).alias("lines")))

    sizes = range(1 if words is not None else run, run + 1)
    return found.select("doc", "row", F.explode(F.concat(*map(cut, sizes))).alias("w")).select(
        "doc", "row", "w.place", "w.size", "w.lines")


def deduplicate(docs: DataFrame, run: int = 2, words: int | None = WORDS) -> DataFrame:
    """``docs`` columns doc_id and text, with n_lines, n_removed and kept (the text left over).

    A line is deleted if a window of ``run`` lines around it has the same lines as a window at an
    earlier place: in a document with a smaller doc_id or further up in the same document. A window of
    fewer lines counts too if they hold ``words`` words or more together, so a long line is compared on its
    own and a document of one long line as a whole; None leaves that out. Rows of one
    doc_id count in the order of a hash of their text; repeated rows are one place. Null texts have no
    lines and stay null; an empty text is one empty line. Rows with a null doc_id are neither compared
    nor changed.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = fingerprints(texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), run, words)
    at = F.struct("doc", "row", "place")
    repeated = found.select("mark", "doc", "row", "place").groupBy("mark").agg(
        F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("mark")
    marked = extend(found.join(repeated, "mark", "left_semi"), run, words)
    firsts = marked.groupBy("lines").agg(F.min(at).alias("first"))
    later = marked.join(firsts, "lines").filter(at > F.col("first")).select(
        "doc", "row", F.struct("place", "size").alias("span"))
    covered = later.groupBy("doc", "row").agg(F.collect_set("span").alias("spans")).select(
        "doc", "row", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(
            s["place"], s["place"] + s["size"] - 1)))).alias("gone"))
    joined = texts.join(covered, (F.col("doc_id") == F.col("doc")) & (F.xxhash64("text") == F.col("row")), "left")
    kept = F.filter(line_list(F.col("text")), lambda x, i: ~F.array_contains(F.col("gone"), i + 1))
    return joined.select(
        "doc_id", "text", F.coalesce(F.size(line_list(F.col("text"))), F.lit(0)).alias("lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    ).select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
             F.when(F.col("removed") < 0, 0).otherwise(F.col("removed")).cast("long").alias("n_removed"), "kept")
