"""Streaming de-duplication: state for a sliding day of arrivals, a side table for what comes later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.session import STREAM_SETTINGS, settings

#: Repeats within this time are dropped; evidence sent longer before its arrival is late.
HORIZON = "24 hours"


@dataclass(frozen=True)
class Drained:
    """Rows of the state store and rows its watermark refused, by batch."""

    state_rows: list[int]
    refused: int


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; times become the kind a watermark accepts."""
    stream = spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema
                               if f.dataType.typeName() == "timestamp_ntz"})


def is_late(sent: str, arrived: str):
    """Sent more than the horizon before it arrived, or without a time of its own."""
    return F.coalesce(F.col(arrived) - F.col(sent) > F.expr(f"INTERVAL {HORIZON}"), F.lit(True))


def _day(sent: str):
    return F.coalesce(F.to_date(sent), F.lit("1970-01-01").cast("date")).alias("day")


def drain_first(stream: DataFrame, keys: list[str], sent: str, arrived: str, out: str,
                checkpoint: str) -> Drained:
    """Append the first arrival of each key among rows that are not late.

    Spark keeps the keys of one horizon of arrivals, so the state is as large as a day of traffic. The
    watermark runs on arrival times, which the collector gives in order: no row is refused for the time
    it was sent at. If rows arrive out of order by more than the horizon all the same, an error says so.
    A batch that runs again replaces its own folder.
    """
    fresh = (stream.filter(~is_late(sent, arrived)).withWatermark(arrived, HORIZON)
             .dropDuplicatesWithinWatermark(keys))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("*", _day(sent)).write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")

    drained = _run(fresh, write, checkpoint)
    if drained.refused:
        raise ValueError(f"{drained.refused} rows arrived out of order by more than {HORIZON}")
    return drained


def drain_late(stream: DataFrame, keys: list[str], sent: str, arrived: str, accepted: str, out: str,
               checkpoint: str) -> Drained:
    """Append late rows that are no repeats, to a side table; run it after ``drain_first``.

    There are few of them, so each batch is compared with stored rows: of ``accepted`` and of the side
    table itself, in the days around its own rows only, and within the horizon.
    """
    late = stream.filter(is_late(sent, arrived))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("*", _day(sent)).dropDuplicates([*keys, "day"])
        near = own.select(*keys, F.col(sent).alias("own_sent"), F.explode(F.sequence(
            F.date_sub("day", 1), F.date_add("day", 1))).alias("day"))
        kinds = dict(batch.dtypes)
        columns = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{sent}` {kinds[sent]}", "batch long", "day date"])
        seen = spark.read.schema(columns).option("basePath", accepted).parquet(accepted).drop("batch")
        if number:
            side = spark.read.schema(columns).option("basePath", out).parquet(out)
            seen = seen.unionByName(side.filter(F.col("batch") < number).drop("batch"))
        apart = F.abs(F.unix_micros(F.col(sent)) - F.unix_micros(F.col("own_sent"))) if kinds[sent] == "timestamp" else F.lit(0)
        met = near.join(seen, [*keys, "day"]).filter(F.coalesce(apart <= 86_400_000_000, F.lit(True))).select(*keys)
        own.join(met.distinct(), keys, "left_anti").select(*batch.columns, "day").write.mode(
            "overwrite").partitionBy("day").parquet(f"{out}/batch={number}")

    return _run(late, write, checkpoint)


def _run(stream: DataFrame, write, checkpoint: str) -> Drained:
    """Everything available, then stop."""
    with settings(stream.sparkSession, STREAM_SETTINGS):
        query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return Drained([s["numRowsTotal"] for s in states], sum(s["numRowsDroppedByWatermark"] for s in states))
