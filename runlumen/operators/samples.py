"""Sample models over weather observations: typing, daily summary and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_SCHEMA = ("city STRING, observed_date STRING, temperature_c STRING, precipitation_mm STRING, "
               "wind_speed_kph STRING")
TYPES = {"city": "string", "observed_date": "date", "temperature_c": "decimal(5,2)",
         "precipitation_mm": "decimal(7,2)", "wind_speed_kph": "decimal(5,2)"}


def staged(text: DataFrame) -> DataFrame:
    """Typed observations."""
    return text.select(*(F.col(n).cast(t).alias(n) for n, t in TYPES.items() if n in text.columns))


def daily_summary(rows: DataFrame) -> DataFrame:
    aggregates = [
        F.count_distinct("city").alias("city_count"),
        F.round(F.avg("temperature_c"), 2).alias("average_temperature_c"),
        F.round(F.sum("precipitation_mm"), 2).alias("total_precipitation_mm"),
    ]
    if "wind_speed_kph" in rows.columns:
        aggregates.append(F.round(F.max("wind_speed_kph"), 2).alias("maximum_wind_speed_kph"))
    return rows.groupBy("observed_date").agg(*aggregates)


def weather_state(rows: DataFrame) -> DataFrame:
    """Ordered labels; the wind label only where wind was observed."""
    label = (
        F.when(F.col("precipitation_mm") >= 7, "heavy_rain")
        .when(F.col("temperature_c") >= 24, "warm")
        .otherwise("normal")
    )
    if "wind_speed_kph" in rows.columns:
        label = F.when(F.col("wind_speed_kph") >= 30, "high_wind").otherwise(label)
    return rows.select("city", "observed_date", label.alias("weather_state"))
