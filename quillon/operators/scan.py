"""Ordered scans that do not put a whole table, or a whole chromosome, into one task.

A table is cut into ordered tiles; each tile is scanned by a window of its own, and what earlier tiles hand on
comes from a small table with one row a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

#: Rows of one tile of a global scan, about; and the most tiles, whose carry tables have a row each.
TILE_ROWS, TILES = 1 << 20, 4096


#: Rows of whole families of tests in one task, about.
FAMILY_ROWS = 1 << 18


def _tiled(df: DataFrame, by: str) -> DataFrame:
    """df with _tile: number of cut points at or under the value; cut points are approximate quantiles, as many as the rows call for."""
    tiles = min(TILES, max(8, df.count() // TILE_ROWS))
    cuts = df.approxQuantile(by, [i / tiles for i in range(1, tiles)], 0.3 / tiles)
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return df.withColumn("_tile", F.size(F.filter(bounds, lambda c: c <= F.col(by))))


def cumulative_count(values: DataFrame, by: str) -> DataFrame:
    """Distinct non-null values of column `by` with _upto: how many rows are at most as large; and _all: rows in all."""
    counts = settle(values.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n")))
    tiled = _tiled(counts, by)
    tile = tiled.groupBy("_tile").agg(F.sum("_n").alias("_s"))
    every = Window.orderBy("_tile")  # over at most TILES rows
    before = tile.select("_tile", (F.sum("_s").over(every) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    own = F.sum("_n").over(Window.partitionBy("_tile").orderBy(by))
    return tiled.join(F.broadcast(before), "_tile").select(by, (own + F.col("_before")).alias("_upto"), "_all")


def bh_fdr(df: DataFrame, p: str, out: str, within: list[str] | None = None) -> DataFrame:
    """df with Benjamini-Hochberg adjusted values of p; null p stays null and does not count.

    within: columns that separate families of tests, each adjusted on its own. Ties get the same value.
    """
    if within:
        df = settle(df)
        # families by their hash, about FAMILY_ROWS to a task however small they look when compressed
        df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // FAMILY_ROWS), *within)
        up = Window.partitionBy(*within).orderBy(p)
        family = Window.partitionBy(*within)
        down = Window.partitionBy(*within).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
        ok = df.withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(family).cast("double") / F.count(p).over(up)))
        return ok.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")
    df = settle(df)  # values are joined by equality below, so both sides must be one computation
    ranked = settle(cumulative_count(df.select(F.col(p).alias("_p")), "_p").withColumn("_raw", F.col("_p") * F.col("_all").cast("double") / F.col("_upto")))
    tiled = _tiled(ranked, "_p")
    later = tiled.groupBy("_tile").agg(F.min("_raw").alias("_m")).withColumn("_later", F.min("_m").over(Window.orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)))
    own = F.min("_raw").over(Window.partitionBy("_tile").orderBy(F.desc("_p")))
    adjusted = tiled.join(F.broadcast(later.select("_tile", "_later")), "_tile").select("_p", F.least(F.lit(1.0), own, "_later").alias(out))
    return df.join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")


def top_by(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order: each task keeps k, and they meet in one."""
    return df.orderBy(*order).limit(k)
