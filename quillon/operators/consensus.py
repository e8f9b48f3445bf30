"""Consensus intervals from several peak sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import clusters, overlap_pairs


def normalise_peaks(peaks: DataFrame, infer_center: bool = False, force_unstranded: bool = False) -> DataFrame:
    """(chrom, start, end, strand, summit) of all peaks; a null strand is "."; strands may be + and -, or only "."."""
    out = peaks.select(F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(".").alias("strand") if force_unstranded else F.coalesce("strand", F.lit(".")).alias("strand"), F.floor((F.col("start") + F.col("end")) / 2).alias("summit") if infer_center else F.col("summit").cast("long").alias("summit"))
    found = sorted(r[0] for r in out.select("strand").distinct().limit(4).collect())
    if len(found) > 2 or len(found) == 2 and "." in found:
        raise ValueError(f"strands {found} do not go together")
    return out


def _minima(density: np.ndarray) -> np.ndarray:
    """First positions of runs that no neighbour is under."""
    left, right = np.concatenate([density[:1], density[:-1]]), np.concatenate([density[1:], density[-1:]])
    low = np.flatnonzero((density <= left) & (density <= right))
    return low[np.concatenate([[True], np.diff(low) > 1])] if len(low) else low


def separators(peaks: DataFrame, sigma: float, per_peak: float | None = None) -> DataFrame:
    """(strand, chrom, sep): least points of the smoothed density of summits.

    The kernel reaches int(8 sigma) / 2 to each side, so summits farther apart than that belong to islands that do
    not touch; an island's density is made apart from the others'. An island ends in a separator where its density falls to zero.
    per_peak: each summit has its own sigma, this share of its peak's width.
    """
    half = int(8 * sigma) // 2 + 1
    wide = F.lit(half) if per_peak is None else (4 * per_peak * (F.col("end") - F.col("start"))).cast("long") + 1
    width = (F.col("end") - F.col("start") if per_peak is not None else F.lit(0)).alias("width")
    reach = peaks.select("strand", "chrom", "summit", width, (F.col("summit") - wide).alias("start"), (F.col("summit") + wide).alias("end"))
    cut = clusters(reach, ("strand", "chrom"), 64 * half).withColumnRenamed("head", "island")
    counted = cut.groupBy("strand", "chrom", "island", "summit", "width").agg(F.count("*").alias("n"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["island", "summit", "width"])
        at, n, width = (pdf[c].to_numpy(np.int64) for c in ("summit", "n", "width"))
        s = np.full(len(at), float(sigma)) if per_peak is None else np.maximum(per_peak * width, 1.0)
        side = np.full(len(at), half - 1) if per_peak is None else (4 * s).astype(np.int64)
        kernels = {(sd, h): np.exp(-0.5 * (np.arange(-h, h + 1) / sd) ** 2) / (1.0 if per_peak is None else sd) for sd, h in set(zip(s.tolist(), side.tolist(), strict=True))}
        first = np.flatnonzero(np.concatenate([[True], np.diff(pdf["island"].to_numpy(np.int64)) != 0]))
        found = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            low, high = int((at[lo:hi] - side[lo:hi]).min()) - 1, int((at[lo:hi] + side[lo:hi]).max()) + 1
            density = np.zeros(high - low + 1)
            for p, w, sd, h in zip(at[lo:hi].tolist(), n[lo:hi].tolist(), s[lo:hi].tolist(), side[lo:hi].tolist(), strict=True):
                density[p - h - low : p + h + 1 - low] += w * kernels[sd, h]
            found.append(low + _minima(np.round(density, 10)))  # sums of equal terms are equal
        return pd.DataFrame({"strand": pdf["strand"].iloc[0], "chrom": pdf["chrom"].iloc[0], "sep": np.concatenate(found)})

    return counted.groupBy("strand", "chrom", F.floor(F.col("island") / (1024 * half)).alias("stretch")).applyInPandas(find, "strand string, chrom string, sep long")


def merge_peaks(peaks: DataFrame, sizes: DataFrame, sigma: float | None = None, min_overlap: int = 2, per_peak: bool = False) -> DataFrame:
    """(id, chrom, start, end, n_peaks, strand, centre, centre_end) from normalised peaks.

    Separators cut each strand of each chromosome into bins. A peak belongs to every bin that has over half of it or
    that it fills by over half. A bin with min_overlap peaks spans them within its bounds; spans under an eighth of
    the median width go. centre: mean summit inside the bin, else the middle. Chromosomes without a size are left out.
    """
    known = peaks.join(sizes.select("chrom", "size"), "chrom")
    width = known.select(F.expr("percentile(`end` - `start`, 0.5D)").alias("w")).first()["w"]
    if width is None:
        width = 0.0
    spread = float(sigma if sigma is not None else max(width / 4, 0.25))
    seps = separators(known, spread, 0.25 if per_peak else None).join(sizes.select("chrom", "size"), "chrom").where("sep > 0 and sep < size").select("strand", "chrom", "sep")
    ends = known.select("strand", "chrom", "size").distinct()
    cuts = seps.union(ends.select("strand", "chrom", F.lit(0).cast("long"))).union(ends.select("strand", "chrom", "size")).distinct()
    bins = cuts.withColumn("hi", F.lead("sep").over(Window.partitionBy("strand", "chrom").orderBy("sep"))).where("hi is not null").withColumnRenamed("sep", "lo")
    left = known.select("chrom", "start", "end", "strand", "summit")
    # peaks look for the bins that their ends and what is between them fall into; a bin may be long, a peak is not
    fine = max(16, int(2 * width) or 16)
    ask = left.withColumn("key", F.explode(F.sequence(F.floor(F.col("start") / fine), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / fine))))
    touched = ask.select("strand", "chrom", "key").distinct()
    starts = bins.withColumn("key", F.floor(F.col("lo") / fine))
    pos = touched.select("strand", "chrom", "key", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).unionByName(starts.select("strand", "chrom", "key", "lo", "hi"))
    order = Window.partitionBy("strand", "chrom").orderBy("key", F.col("lo").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = pos.withColumn("cur", F.last(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")), ignorenulls=True).over(order))
    per_key = carried.select("strand", "chrom", "key", F.explode(F.array_compact(F.array("cur"))).alias("b")).select("strand", "chrom", "key", "b.lo", "b.hi").distinct()
    hit = ask.join(per_key, ["strand", "chrom", "key"]).where((F.col("lo") < F.col("end")) & (F.col("start") < F.col("hi"))).where(F.floor(F.greatest("start", "lo") / fine) == F.col("key"))
    common = F.least("end", "hi") - F.greatest("start", "lo")
    member = hit.where((common / (F.col("hi") - F.col("lo")) > 0.5) | (common / (F.col("end") - F.col("start")) > 0.5))
    inside = (F.col("summit") > F.col("lo")) & (F.col("summit") < F.col("hi"))
    agg = member.groupBy("strand", "chrom", "lo", "hi").agg(F.count("*").alias("n_peaks"), F.min("start").alias("a"), F.max("end").alias("z"), F.avg(F.when(inside, F.col("summit"))).alias("c"))
    span = agg.where(F.col("n_peaks") >= min_overlap).withColumn("start", F.greatest("a", "lo")).withColumn("end", F.least("z", "hi")).where(F.col("end") - F.col("start") >= 0.125 * width)
    centre = F.coalesce(F.col("c"), (F.col("start") + F.col("end")) / 2).cast("long")
    # ids: runs of a chromosome and strand follow each other, so a count before each run makes them global
    out = span.select("chrom", "start", "end", "n_peaks", "strand", centre.alias("centre"), (centre + 1).alias("centre_end"))
    runs = out.groupBy("strand", "chrom").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("strand", "chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("strand", "chrom").orderBy("start", "end")) - 1
    return out.withColumn("_k", nth).join(F.broadcast(runs.select("strand", "chrom", "before")), ["strand", "chrom"]).select((F.col("before") + F.col("_k")).alias("id"), "chrom", "start", "end", "n_peaks", "strand", "centre", "centre_end")


def greedy_suppression(peaks: DataFrame, min_overlap: int = 2, tile: int = 4096) -> DataFrame:
    """(strand, chrom, start, end, summit, score, n): peaks by score, best first; each takes the peaks not taken yet
    whose summit lies strictly inside it, and stays if with itself there are min_overlap.

    Only peaks of one chain of overlapping intervals can take each other, so a task walks whole chains: those whose
    heads lie in one stretch of 16 tiles.
    """
    chains = clusters(peaks, ("strand", "chrom"), tile)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["summit", "start", "end", "score"], ascending=[True, True, True, False]).reset_index(drop=True)
        at, s, e = pdf["summit"].to_numpy(), pdf["start"].to_numpy(), pdf["end"].to_numpy()
        taken, n = np.zeros(len(pdf), bool), np.zeros(len(pdf), np.int64)
        for i in np.lexsort((np.arange(len(pdf)), -pdf["score"].to_numpy(float))):
            if taken[i]:
                continue
            lo, hi = np.searchsorted(at, s[i], "right"), np.searchsorted(at, e[i], "left")
            near = np.arange(lo, hi)
            near = near[~taken[near] & (near != i)]
            taken[near] = True
            taken[i] = True
            n[i] = len(near) + 1
        out = pdf[n >= min_overlap].assign(n=n[n >= min_overlap])
        return out[["strand", "chrom", "start", "end", "summit", "score", "n"]]

    return chains.select("strand", "chrom", "start", "end", "summit", F.col("score").cast("double").alias("score"), F.floor(F.col("head") / (16 * tile)).alias("stretch")).groupBy("strand", "chrom", "stretch").applyInPandas(walk, "strand string, chrom string, start long, end long, summit long, score double, n long")


def reads_per_region(reads: DataFrame, regions: DataFrame, file: str = "file", width: int | None = None) -> DataFrame:
    """(file, var_id, value): reads (file, chrom, start, end) over each region (chrom, start, end, var_id), zeros too."""
    hits = overlap_pairs(regions.select("chrom", "start", "end", "var_id"), reads.select("chrom", "start", "end", file), width).groupBy(F.col(f"r_{file}").alias(file), F.col("l_var_id").alias("var_id")).agg(F.count("*").alias("n"))
    grid = reads.select(file).distinct().join(regions.select("var_id"))  # files x regions is the matrix
    return grid.join(hits, [file, "var_id"], "left").select(file, "var_id", F.coalesce("n", F.lit(0)).cast("int").alias("value"))
