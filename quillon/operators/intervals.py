"""Interval algebra over (chrom, start, end), half-open.

Overlap joins expand both sides into bins of a fixed width and join on (chrom, bin), so the join key is finer
than a chromosome; a pair is kept only in the bin that holds the later of its two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_width(*sides: DataFrame) -> int:
    """Twice the larger of the sides' approximate median widths, at least 16."""
    medians = [df.select(F.percentile_approx(F.col("end") - F.col("start"), 0.5).alias("m")).first()["m"] or 1 for df in sides]
    return max(16, 2 * int(max(medians)))


def _binned(df: DataFrame, prefix: str, width: int, slack: int = 0) -> DataFrame:
    names = [F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns]
    low, high = F.floor((F.col("start") - slack) / F.lit(width)), F.floor((F.greatest(F.col("end") - 1, F.col("start")) + slack) / F.lit(width))
    return df.select(*names, F.col("chrom").alias(f"{prefix}key"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias(f"{prefix}bin"))


def overlap_pairs(left: DataFrame, right: DataFrame, width: int | None = None, slack: int = 0, condition: Column | None = None) -> DataFrame:
    """All pairs of overlapping intervals, columns prefixed l_ and r_; strand is not looked at.

    slack widens the left side on both ends. Touching intervals and empty ones do not overlap (an empty one
    overlaps what strictly contains it). Rows with a null bound or chromosome pair with nothing.
    """
    width = width or bin_width(left, right)
    a, b = _binned(left, "l_", width, slack), _binned(right, "r_", width)
    met = (F.col("l_key") == F.col("r_key")) & (F.col("l_bin") == F.col("r_bin"))
    low = F.col("l_start") - slack
    hit = (low < F.col("r_end")) & (F.col("r_start") < F.col("l_end") + slack)
    once = F.col("l_bin") == F.floor(F.greatest(low, F.col("r_start")) / F.lit(width))
    return a.join(b, met & hit & once if condition is None else met & hit & once & condition).drop("l_key", "r_key", "l_bin", "r_bin")


def overlap_count(catalog: DataFrame, query: DataFrame, name: str = "name", width: int | None = None) -> DataFrame:
    """(name, n): how many pairs each category of catalog has with query; categories without any are absent."""
    return overlap_pairs(catalog.select("chrom", "start", "end", name), query.select("chrom", "start", "end"), width).groupBy(F.col(f"l_{name}").alias(name)).agg(F.count("*").alias("n"))


def overlap_semi(catalog: DataFrame, query: DataFrame, width: int | None = None) -> DataFrame:
    """Rows of catalog that overlap some query, each once. catalog needs a unique column `name`."""
    hit = overlap_pairs(catalog.select("chrom", "start", "end", "name"), query.select("chrom", "start", "end"), width).select(F.col("l_name").alias("name")).distinct()
    return catalog.join(hit, "name", "left_semi")


def intersection(query: DataFrame, catalog: DataFrame, width: int | None = None) -> DataFrame:
    """(name, chrom, start, end): the part of each query that each overlapping catalog row covers."""
    pairs = overlap_pairs(query, catalog, width)
    return pairs.select(F.col("l_name").alias("name"), F.col("l_chrom").alias("chrom"), F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end"))


def tss(genes: DataFrame) -> DataFrame:
    """Transcription starts: start on +, end on any other strand, as one-base intervals."""
    at = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return genes.select("chrom", at.alias("start"), (at + 1).alias("end"), "gene")


def nearest(query: DataFrame, points: DataFrame, max_dist: float | None = None, width: int = 1024) -> DataFrame:
    """query with gene and distance of the nearest point (chrom, start, gene), unstranded.

    A point inside is at distance 0, one outside at the gap plus 1. "None" where the chromosome has no point or
    the distance is not under max_dist. Ties go to the smaller position, then the lesser gene.

    Points are few and sorted into bins; each query meets the one row of its start's bin, which also carries the
    last point before the bin and the first after it.
    """
    item = F.struct(F.col("start").alias("p"), F.col("gene").alias("g"))
    held = points.where("chrom is not null and start is not null").groupBy("chrom", F.floor(F.col("start") / width).alias("bin")).agg(F.sort_array(F.collect_set(item)).alias("own"))
    asked = query.select("chrom", F.floor(F.col("start") / width).alias("bin")).distinct()
    bins = held.join(asked, ["chrom", "bin"], "full")
    order = Window.partitionBy("chrom").orderBy("bin")  # one row for each bin, not each interval
    # of equal positions the lesser gene is the one before as well as the one after
    last_p = F.element_at("own", -1)["p"]
    tail = F.element_at(F.filter("own", lambda x: x["p"] == last_p), 1)
    bins = bins.withColumn("before", F.last(F.when(F.col("own").isNotNull(), tail), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    bins = bins.withColumn("after", F.first(F.when(F.col("own").isNotNull(), F.element_at("own", 1)), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    near = F.concat(F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array()), F.coalesce("own", F.array()), F.when(F.col("after").isNotNull(), F.array("after")).otherwise(F.array()))
    bins = bins.select("chrom", "bin", near.alias("_near"))
    distance = lambda p: F.when(p < F.col("start"), F.col("start") - p).when(p >= F.col("end"), p - F.col("end") + 1).otherwise(F.lit(0))
    best = F.array_min(F.transform("_near", lambda x: F.struct(distance(x["p"]).cast("long").alias("d"), x["p"].alias("p"), x["g"].alias("g"))))
    out = query.withColumn("bin", F.floor(F.col("start") / width)).join(bins, ["chrom", "bin"], "left").withColumn("_best", best)
    ok = F.col("_best").isNotNull() if max_dist is None else F.col("_best.d") < max_dist
    return out.select(*query.columns, F.when(ok, F.col("_best.g")).otherwise("None").alias("gene"), F.col("_best.d").alias("distance"))


def label_by_nearest(query: DataFrame, points: DataFrame, order: list[str], max_dist: float | None = 1_000_000, width: int = 1024) -> DataFrame:
    """query with label gene__k, k counting a gene's regions in the given order.

    Regions are counted within the first column of the order (the chromosome, say), and that count starts from the
    number of the gene's regions before it: regions near no gene, which all have one name, are many tasks' work.
    """
    named = nearest(query, points, max_dist, width)
    lead = order[0]
    part = named.groupBy("gene", lead).agg(F.count("*").alias("_n"))
    start = part.select(F.col("gene").alias("_g"), F.col(lead).alias("_l"), (F.sum("_n").over(Window.partitionBy("gene").orderBy(lead)) - F.col("_n")).alias("_start"))
    k = F.row_number().over(Window.partitionBy("gene", lead).orderBy(*order))
    counted = named.withColumn("_k", k).join(start, (F.col("gene") == F.col("_g")) & F.col(lead).eqNullSafe(F.col("_l")))
    return counted.withColumn("label", F.concat_ws("__", "gene", (F.col("_start") + F.col("_k")).cast("string"))).drop("_k", "_g", "_l", "_start")


def clusters(df: DataFrame, by: tuple[str, ...] = ("chrom",), tile: int = 4096) -> DataFrame:
    """df with head: the start of the first interval of the chain of intervals that overlap or touch.

    Chains are found tile by tile along a chromosome, so a long chromosome is scanned by many tasks.
    """
    keys = list(by)
    cut = df.withColumn("_tile", F.floor(F.col("start") / tile))
    per_tile = cut.groupBy(*keys, "_tile").agg(F.max("end").alias("_far"))
    upto = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.join(per_tile.select(*keys, "_tile", F.max("_far").over(upto).alias("_before")), [*keys, "_tile"])
    own = F.max("end").over(Window.partitionBy(*keys, "_tile").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("_reach", F.greatest("_before", own)).withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")))
    heads = cut.groupBy(*keys, "_tile").agg(F.max("_head").alias("_h")).select(*keys, "_tile", F.max("_h").over(upto).alias("_carried"))
    within = Window.partitionBy(*keys, "_tile").orderBy("start", "end")  # up to the last of equal intervals: they share a head
    return cut.join(heads, [*keys, "_tile"]).withColumn("head", F.coalesce(F.max("_head").over(within), "_carried")).select(*df.columns, "head")


def merge_overlapping(df: DataFrame, min_count: int = 2, by: tuple[str, ...] = ("chrom",), tile: int = 4096) -> DataFrame:
    """Chains of overlapping or touching intervals as one: (by..., start, end, n), those of at least min_count."""
    return clusters(df, by, tile).groupBy(*by, "head").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).where(F.col("n") >= min_count).drop("head")


def coverage(df: DataFrame, tile: int = 4096) -> DataFrame:
    """(chrom, start, end, depth): maximal stretches by how many intervals cover them, depth over 0.

    Depth runs along a chromosome tile by tile: a tile starts from the sum of all steps before it.
    """
    steps = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step"))))
    events = df.select("chrom", steps.alias("e")).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step")).where("step <> 0").withColumn("_tile", F.floor(F.col("pos") / tile))
    order = Window.partitionBy("chrom").orderBy("_tile")
    per_tile = events.groupBy("chrom", "_tile").agg(F.sum("step").alias("_s"), F.min("pos").alias("_p"))
    carry = per_tile.select("chrom", "_tile", (F.sum("_s").over(order) - F.col("_s")).alias("_before"), F.lead("_p").over(order).alias("_next"))
    within = Window.partitionBy("chrom", "_tile").orderBy("pos")
    placed = events.join(carry, ["chrom", "_tile"])
    return placed.select("chrom", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(within), "_next").alias("end"), (F.sum("step").over(within) + F.col("_before")).alias("depth")).where("depth > 0")
