"""Mix sources to target weights that may change over the training run.

A schedule gives each source a weight at knots of training time 0..1, linear in between. Its
integral is the share of the source; shares become word targets, no source being asked for more
than ``cap`` times its words. Documents of a source queue up in a fixed pseudo-random order, and the
words queued before a document are the demand at which it is due: inverting the integrated schedule
at that demand gives the training position, and documents are range-sorted by it.

Only DataFrame functions are used. Per source nothing is gathered: the queue is cut into ``blocks``
by the document's hash, sizes are summed per (source, block), offsets run over blocks, and rows are
numbered inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlumen.llm.common import n_words

#: Pieces of one source's queue. A block holds 1/4096 of a source; raise it with the rows a source has.
BLOCKS = 4096
_OWN = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_positions"]


def constant_schedule(weights: DataFrame) -> DataFrame:
    """(source, weight) as a schedule that does not change: knots at 0 and 1."""
    knot = lambda t: F.struct(F.lit(t).alias("t"), F.col("weight").cast("double").alias("w"))
    return weights.select("source", F.array(knot(0.0), knot(1.0)).alias("knots"))


def cyclic_weights(docs: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Sources in code-point order, null last, weighing ``cycle`` over and over."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return docs.select("source").distinct().select("source", weights[place].alias("weight"))


def _segments(knots: Column) -> Column:
    """Linear pieces of a schedule with the area before each."""
    parts = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        knots[i - 1]["t"].alias("t"), knots[i - 1]["w"].alias("w"),
        (knots[i]["t"] - knots[i - 1]["t"]).alias("dt"), (knots[i]["w"] - knots[i - 1]["w"]).alias("dw")))
    area = lambda s: (s["w"] + s["dw"] / 2) * s["dt"]
    return F.transform(parts, lambda s, i: F.struct(
        s["t"].alias("t"), s["w"].alias("w"), (s["dw"] / s["dt"]).alias("slope"), area(s).alias("area"),
        F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0.0), lambda a, p: a + area(p)).alias("before")))


def _time_of(segments: Column, area: Column) -> Column:
    """Training time by which a schedule's integral reaches ``area``."""
    due = F.element_at(F.filter(segments, lambda s: (s["before"] <= area) & (s["area"] > 0)), -1)
    rest = F.least(area - due["before"], due["area"])
    root = F.sqrt(F.greatest(due["w"] * due["w"] + 2 * due["slope"] * rest, F.lit(0.0)))
    return due["t"] + F.when(rest > 0, 2 * rest / (due["w"] + root)).otherwise(0.0)


def targets(sizes: DataFrame, schedule: DataFrame, cap: float) -> DataFrame:
    """Word target of each source (source, source_size, segments, share, target).

    Sources share all words by the integral of their schedule; what a source would get beyond
    ``cap`` times its size is shared among the others by weight until none is above. One row per
    source: sources in order of the level at which they fill up, a running sum finds the level.
    A source without schedule, or with weight 0, gets nothing.
    """
    joined = sizes.join(schedule.withColumnRenamed("source", "mix_name"),
                        F.col("source").eqNullSafe(F.col("mix_name")), "left").drop("mix_name")
    segments = joined.withColumn("segments", _segments(F.col("knots")))
    share = F.coalesce(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["area"]), F.lit(0.0))
    limit = F.lit(float(cap)) * F.col("source_size")
    rows = segments.withColumn("share", share).withColumn("limit", limit).withColumn(
        "full_at", F.when(F.col("share") > 0, F.col("limit") / F.col("share")))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("full_at").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("share").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col("share") > 0, (F.sum("source_size").over(everything) - before) / left)
    rows = rows.withColumn("level", level)
    open_level = F.first(F.when(F.col("level") < F.col("full_at"), F.col("level")), ignorenulls=True)
    rows = rows.withColumn("level", open_level.over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("share") > 0, F.least("limit", F.coalesce(F.col("level") * F.col("share"), "limit")))
    return rows.select("source", "source_size", "segments", "share",
                       F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, schedule: DataFrame, cap: float = 3.0, blocks: int = BLOCKS,
        seed: int = 17, size: Column | None = None) -> DataFrame:
    """Documents with mix_size, mix_source_size, mix_target, mix_taken and mix_positions.

    ``docs`` needs doc_id, text (or ``size``) and source; its columns are kept, and columns of the
    five names are replaced. ``schedule``: (source, knots array<struct<t, w>>), knots in order, the
    first at 0 and the last at 1. mix_taken is the number of words the mix takes from the document,
    repeats counted: each full pass over the source takes all of it, the last pass is cut at the
    target, so the taken words of a source add up to its rounded target and no document gives more
    than ``cap`` times its size. mix_positions lists the training time of each pass.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own;
    repeated rows count each; reruns agree, since the order comes from a hash of doc_id and text and
    rows alike in both go by their other columns.
    """
    kept = [c for c in docs.columns if c not in _OWN]
    size = n_words(F.col("text")) if size is None else size
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text") if "text" in docs.columns else F.lit(0))
    content = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if c in kept and "map<" not in t])
    # a document's own columns travel as one, so none of them can meet a name used here
    rows = docs.select(F.struct(*kept).alias("own"), "source", size.alias("mix_size"), key.alias("mix_key"),
                       F.struct("doc_id", content).alias("mix_tie")).withColumn(
        "mix_block", F.pmod("mix_key", F.lit(blocks)))
    dealt = rows.repartition("source", "mix_block")
    sums = dealt.groupBy("source", "mix_block").agg(F.sum("mix_size").alias("words"))
    totals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedule, cap)
    earlier = Window.partitionBy("source").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("mix_name"), F.col("mix_block").alias("mix_at"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("mix_offset"))
    offsets = offsets.join(totals, F.col("mix_name").eqNullSafe(F.col("source")), "left").select(
        "mix_name", "mix_at", "mix_offset", F.col("source_size").alias("mix_source_size"),
        F.col("segments").alias("mix_segments"), F.col("share").alias("mix_share"),
        F.col("target").alias("mix_target"))
    in_block = Window.partitionBy("source", "mix_block").orderBy("mix_key", "mix_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    queued = dealt.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(in_block), F.lit(0)))
    placed = queued.join(offsets, F.col("source").eqNullSafe(F.col("mix_name"))
                         & (F.col("mix_block") == F.col("mix_at")))
    start = F.col("mix_offset") + F.col("mix_before")
    goal = F.round("mix_target").cast("long")
    passes = F.when(F.col("mix_source_size") > 0, F.floor(goal / F.col("mix_source_size"))).otherwise(0)
    part = F.least(F.col("mix_size"), F.greatest(
        F.lit(0), goal - passes * F.col("mix_source_size") - start))
    taken = (passes * F.col("mix_size") + part).cast("long")
    times = (passes + F.when(part > 0, 1).otherwise(0)).cast("int")
    due = lambda i: (start + i * F.col("mix_source_size")) / F.col("mix_target") * F.col("mix_share")
    positions = F.when((F.col("mix_size") > 0) & (times > 0), F.transform(
        F.sequence(F.lit(0), times - 1), lambda i: _time_of(F.col("mix_segments"), due(i))))
    return placed.select("own.*", "mix_size", "mix_source_size", "mix_target", taken.alias("mix_taken"),
                         positions.alias("mix_positions"))


def sort_by_position(mixed: DataFrame) -> DataFrame:
    """Range-sort by the first training position; documents that are not taken come last."""
    return mixed.withColumn("position", F.col("mix_positions")[0]).orderBy(
        F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame, out: str = "position") -> DataFrame:
    """One row per pass over a taken document, range-sorted by training position in the new column ``out``."""
    return mixed.withColumn(out, F.explode("mix_positions")).orderBy(out, "doc_id")


def ramps(weights: DataFrame) -> DataFrame:
    """(source, weight) as schedules that vary: half the weight at the start, one and a half at the end.

    Their integrals are the weights, so shares are those of ``constant_schedule`` but each source
    comes in more densely as training goes on, from a start where it is sparse.
    """
    knot = lambda t, f: F.struct(F.lit(t).alias("t"), (F.col("weight") * f).cast("double").alias("w"))
    return weights.select("source", F.array(knot(0.0, 0.5), knot(1.0, 1.5)).alias("knots"))
