"""Streams of alerts and events: windowed counts, duplicates, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a zoned timestamp (session zone), which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(df: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) per window of fixed width; batch and stream alike."""
    x = _timed(df, ts).withWatermark(ts, late)
    return x.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding_counts(df: DataFrame, ts: str, key: str, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    x = _timed(df, ts).withWatermark(ts, late)
    return x.groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, finish, key, n) per run of events of a key with pauses below the gap."""
    x = _timed(df, ts).withWatermark(ts, late)
    return x.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), key, "n")


def first_arrivals(df: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key did not arrive before, within the watermark."""
    return _timed(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rate_in_window(df: DataFrame, ts: str, key: str, micros: int) -> DataFrame:
    """Each event with the number of events of its key in the window that ends with it (batch).

    Partitioned by key; of a key with many events, each event costs the frame
    moving on, not its size.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-micros + 1, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))
