"""Normalisation of signal against a control input, from counts at random places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rescale_piecewise


def reference_lfc(random: DataFrame) -> DataFrame:
    """(obs_id, lfc, low): ln of signal over input in the background.

    random: (obs_id, var_id, value, input), dense, or with one of the places of an observation that are 0 in both for all
    of them. Places go by signal ascending, then by input descending; the
    background ends where the input's share leads the signal's by most (the first such place). Where either sum is
    10 or less there, low is true and the sums over all places count.
    """
    order = Window.partitionBy("obs_id").orderBy("value", F.desc("input"), "var_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("obs_id")
    run = random.select("obs_id", F.row_number().over(order).alias("k"), F.sum("value").over(upto).alias("c"), F.sum("input").over(upto).alias("i"), F.sum("value").over(every).alias("tc"), F.sum("input").over(every).alias("ti"))
    lead = (F.col("i") / F.col("ti") - F.col("c") / F.col("tc")).alias("lead")
    best = run.select("*", lead).groupBy("obs_id").agg(F.max_by(F.struct("c", "i", "tc", "ti"), F.struct(F.col("lead"), -F.col("k"))).alias("b"))
    low = (F.col("b.i") <= 10) | (F.col("b.c") <= 10)
    return best.select("obs_id", F.when(low, F.log(F.col("b.tc") / F.col("b.ti"))).otherwise(F.log(F.col("b.c") / F.col("b.i"))).alias("lfc"), low.alias("low"))


def strength(cells: DataFrame, lfc: DataFrame) -> DataFrame:
    """(obs_id, lfc, strength): input total over signal total times exp(lfc); 1 / strength is the share of background."""
    total = cells.groupBy("obs_id").agg((F.sum("input") / F.sum("value")).alias("ratio"))
    return total.join(lfc, "obs_id").select("obs_id", "lfc", (F.col("ratio") * F.exp("lfc")).alias("strength"))


def filled_input(cells: DataFrame) -> DataFrame:
    """cells (obs_id, var_id, value, input: dense) with nf: the input, small ones replaced by what its feature leads to expect."""
    factor = cells.groupBy("obs_id").agg(F.sum("input").cast("double").alias("s"))
    mean = factor.agg(F.avg("s").alias("m"), F.count("*").alias("n"))
    factor = factor.join(F.broadcast(mean)).select("obs_id", (F.col("s") / F.col("m")).alias("sf"), "n")
    with_sf = cells.join(factor, "obs_id")
    level = with_sf.groupBy("var_id").agg(F.avg(F.col("input") / F.col("sf")).alias("level"), F.sum("sf").alias("all_sf"))
    level = level.withColumn("nothing", F.col("level") * F.col("all_sf") < 1e-10)
    expected = F.when(F.col("nothing"), F.col("sf") / F.col("n")).otherwise(F.col("level") * F.col("sf"))
    return with_sf.join(level, "var_id").select("obs_id", "var_id", "value", "input", F.when(F.col("input") < 0.5, expected).otherwise(F.col("input").cast("double")).alias("nf"))


def rescale_center_scale(cells: DataFrame, random: DataFrame) -> DataFrame:
    """(obs_id, var_id, factor): inputs centred on the background and stretched by each observation's strength over the median."""
    power = strength(cells, reference_lfc(random))
    mid = power.agg(F.expr("percentile(strength, 0.5D)").alias("mid"))
    scaled = filled_input(cells).join(power.join(F.broadcast(mid)), "obs_id").withColumn("nf", F.col("nf") * F.exp("lfc"))
    fold = F.greatest(F.col("value").cast("double"), F.lit(0.1)) / F.col("nf")
    return scaled.select("obs_id", "var_id", (F.col("nf") * fold / rescale_piecewise(fold, F.col("strength") / F.col("mid"))).alias("factor"))


def rescale_quantile(cells: DataFrame, random: DataFrame) -> DataFrame:
    """(obs_id, var_id, factor): fold changes of every observation take the distribution of the mean observation.

    The mean observation has the mean of ln fold changes of equal rank; folds equal to 9 digits rank by feature.
    """
    lfc = reference_lfc(random)
    centred = filled_input(cells).join(lfc.select("obs_id", "lfc"), "obs_id").withColumn("nf", F.col("nf") * F.exp("lfc"))
    fold = centred.withColumn("fold", F.greatest(F.col("value").cast("double"), F.lit(0.1)) / F.col("nf"))
    ranked = fold.withColumn("k", F.row_number().over(Window.partitionBy("obs_id").orderBy(F.round("fold", 9), "var_id")))
    meta = ranked.groupBy("k").agg(F.exp(F.avg(F.log("fold"))).alias("target"))
    return ranked.join(meta, "k").select("obs_id", "var_id", (F.col("nf") * F.col("fold") / F.col("target")).alias("factor"))
