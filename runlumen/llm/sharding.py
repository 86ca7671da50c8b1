"""Shard records by weighted rendezvous hashing of a stable key.

Each shard bids for each key: an exponential variate drawn from the hash of (key, shard), divided by
the shard's weight; the lowest bid wins. A shard's share follows its weight, and a further shard only
takes keys whose bids it undercuts, so that no key moves between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces into which a shard's slots are numbered; raise it with the rows a shard has.
BLOCKS = 1024
_OWN = ["law", "shard", "slot", "grown_shard"]


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """Bid of a shard for a key: 52 bits of the hash as a uniform number, then exponential."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 12)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 52))) / weight


def assign(docs: DataFrame, shards: int | list[float], key: str = "doc_id", grown_weight: float = 1.0,
           blocks: int = BLOCKS) -> DataFrame:
    """Rows with law, shard, slot and grown_shard; columns of these names are replaced.

    ``shards``: how many, or the weight of each (positive). slot numbers the rows of a shard from 0
    without gaps, in an order fixed by the key and, among rows of one key, by their content. It is
    numbered in ``blocks`` per shard, so no task holds a shard. grown_shard is the shard after one
    more of ``grown_weight`` is added.

    Rows of one key share a shard; null keys are one key; an empty table gives no rows.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) <= 0:
        raise ValueError("shard weights must be positive")
    kept = [c for c in docs.columns if c not in _OWN]
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    table = F.array(*[F.lit(w) for w in weights])
    bids = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda i: F.struct(
        bid(F.col("shard_key"), i, table[i]).alias("bid"), i.alias("shard")))
    # a row's own columns travel as one, so none of them can meet a name used here
    content = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if c in kept and "map<" not in t])
    rows = docs.select(F.struct(*kept).alias("own"), name.alias("shard_key"), content.alias("shard_row")).withColumn(
        "shard_won", F.array_min(bids))
    late = bid(F.col("shard_key"), F.lit(len(weights)), F.lit(float(grown_weight)))
    rows = rows.withColumns({
        "law": F.lit("key"), "shard": F.col("shard_won")["shard"],
        "grown_shard": F.when(late < F.col("shard_won")["bid"], len(weights)).otherwise(
            F.col("shard_won")["shard"]),
        "shard_order": F.xxhash64(F.lit("slot"), "shard_key"),
    }).withColumn("shard_block", F.pmod("shard_order", F.lit(blocks))).drop("shard_won")
    dealt = rows.repartition("shard", "shard_block")
    counts = dealt.groupBy("shard", "shard_block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("shard_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("shard_of"), F.col("shard_block").alias("shard_at"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_offset"))
    within = Window.partitionBy("shard", "shard_block").orderBy("shard_order", "shard_key", "shard_row")
    numbered = dealt.withColumn("shard_place", F.row_number().over(within) - 1)
    placed = numbered.join(offsets, (F.col("shard") == F.col("shard_of"))
                           & (F.col("shard_block") == F.col("shard_at")))
    slot = (F.col("shard_offset") + F.col("shard_place")).cast("long")
    return placed.select("own.*", "law", "shard", slot.alias("slot"), "grown_shard")
