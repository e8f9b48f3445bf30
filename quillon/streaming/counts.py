"""Streaming counts of intervals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_counts(reads: DataFrame, regions: DataFrame, width: int, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, name, n): streamed reads (ts, chrom, start, end) over static regions (chrom, start, end, name), by event
    time window. Reads expand into bins of `width` and meet the regions by an equi-join; late ones up to `late` count.
    """
    binned = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / width))))
    a = binned(reads.withWatermark("ts", late).select("ts", "chrom", "start", "end"))
    b = binned(regions.select("chrom", "start", "end", "name")).select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"), "name", F.col("bin").alias("b"))
    hit = (F.col("chrom") == F.col("c")) & (F.col("bin") == F.col("b")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("bin") == F.floor(F.greatest("start", "s") / width))
    return a.join(b, hit).groupBy(F.window("ts", window), "name").agg(F.count("*").alias("n"))


def event_totals(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) of streamed events (ts, event_type, value) by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
