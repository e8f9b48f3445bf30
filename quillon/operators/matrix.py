"""Moments, size factors, filters and transforms of a long count table (zeros absent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trim_low_counts(counts: DataFrame, min_exp: int = 3, min_counts: int = 1) -> DataFrame:
    """(var_id, n): features with at least min_counts in at least min_exp observations."""
    if min_exp < 1 or min_counts < 1:
        raise ValueError("min_exp and min_counts start at 1")
    return counts.groupBy("var_id").agg(F.sum((F.col("value") >= min_counts).cast("int")).alias("n")).where(F.col("n") >= min_exp)


def qc_metrics(counts: DataFrame, flagged: F.Column) -> DataFrame:
    """(obs_id, total, n_detected, pct_flagged) of each observation; flagged tells features apart."""
    total = F.sum("value")
    return counts.groupBy("obs_id").agg(total.alias("total"), F.sum((F.col("value") > 0).cast("int")).alias("n_detected"), (100.0 * F.sum(F.when(flagged, F.col("value")).otherwise(0)) / total).alias("pct_flagged"))


def _scaled(raw: DataFrame) -> DataFrame:
    """(obs_id, raw, size_factor): raw over its mean; one row of means for all observations."""
    mean = raw.agg(F.avg("raw").alias("_mean"))
    return raw.join(F.broadcast(mean)).select("obs_id", "raw", (F.col("raw") / F.col("_mean")).alias("size_factor"))


def top_detected(counts: DataFrame, var: DataFrame, pct: float = 0.05) -> DataFrame:
    """(var_id): the most detected features: by observations over 0, then over 5, 10, 15 and 20, then by ord, all descending."""
    k = int(var.count() * pct + 1)
    levels = counts.groupBy("var_id").agg(*[F.sum((F.col("value") > i).cast("int")).alias(f"d{i}") for i in range(0, 25, 5)])
    ranked = var.select("var_id", "ord").join(levels, "var_id", "left").na.fill(0)
    return ranked.orderBy(*[F.desc(f"d{i}") for i in range(0, 25, 5)], F.desc("ord")).limit(k).select("var_id")


def size_factors(counts: DataFrame, obs: DataFrame, var: DataFrame, method: str = "top_fpkm") -> DataFrame:
    """(obs_id, raw, size_factor) by fpkm, top_fpkm, fpkm_uq, deseq or pooled; an observation whose deseq factor is 0 is an error."""
    cells = obs.select("obs_id")
    if method == "fpkm":
        sums = counts.groupBy("obs_id").agg(F.sum("value").cast("double").alias("raw"))
    elif method == "top_fpkm":
        sums = counts.join(top_detected(counts, var), "var_id", "left_semi").groupBy("obs_id").agg(F.sum("value").cast("double").alias("raw"))
    elif method == "fpkm_uq":
        return _scaled(upper_quartile(counts, obs, var.count()))
    elif method == "deseq":
        # a factor of 0, or none, is an error: every count over it would be infinite
        known = obs.select("obs_id").join(median_of_ratios(counts, obs), "obs_id", "left")
        bad = F.raise_error(F.concat(F.lit("no median of ratios over 0 for "), F.col("obs_id"))).cast("double")
        return _scaled(known.withColumn("raw", F.when(F.col("raw") > 0, F.col("raw")).otherwise(bad)))
    elif method == "pooled":
        from .pooling import pooled_factors

        return _scaled(pooled_factors(counts, obs, var))
    else:
        raise ValueError(f"unknown size factor method {method!r}")
    return _scaled(cells.join(sums, "obs_id", "left").select("obs_id", F.coalesce("raw", F.lit(0.0)).alias("raw")))


def upper_quartile(counts: DataFrame, obs: DataFrame, n_var: int, q: float = 0.75) -> DataFrame:
    """(obs_id, raw): the interpolated quantile over all features, absent ones 0.

    Zeros fill the lowest ranks, so the quantile is found from the ranks of the values that are there.
    """
    at = q * (n_var - 1)
    low = int(at)
    per = counts.where("value <> 0").groupBy("obs_id", "value").agg(F.count("*").alias("n"))
    held = per.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("v"), F.sum("n").alias("k"))
    # ranks of a value run to n_var - (how many are over it)
    start = F.struct(F.lit(n_var).cast("long").alias("room"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc, x):
        first = acc["room"] - x["n"]
        pick = lambda rank, old: F.when((F.lit(rank) >= first) & (F.lit(rank) < acc["room"]), x["value"].cast("double")).otherwise(old)
        return F.struct(first.alias("room"), pick(low, acc["a"]).alias("a"), pick(min(low + 1, n_var - 1), acc["b"]).alias("b"))

    got = held.withColumn("q", F.aggregate(F.reverse("v"), start, step))
    return obs.select("obs_id").join(got, "obs_id", "left").select("obs_id", F.coalesce(F.col("q.a") + (F.col("q.b") - F.col("q.a")) * F.lit(at - low), F.lit(0.0)).alias("raw"))


def median_of_ratios(counts: DataFrame, obs: DataFrame) -> DataFrame:
    """(obs_id, raw): the median over features of count over geometric mean; features with a zero anywhere are out."""
    n = obs.count()
    mean = counts.where("value > 0").groupBy("var_id").agg(F.count("*").alias("k"), F.exp(F.avg(F.log(F.col("value").cast("double")))).alias("gm")).where(F.col("k") == n)
    return counts.join(mean, "var_id").groupBy("obs_id").agg(F.expr("percentile(value / gm, 0.5D)").alias("raw"))


def feature_moments(counts: DataFrame, factors: DataFrame, n_obs: int) -> DataFrame:
    """(var_id, mean, variance): of value over size factor, population variance, zeros included."""
    y = counts.join(factors.select("obs_id", "size_factor"), "obs_id").withColumn("y", F.col("value") / F.col("size_factor"))
    k, zeros = F.count("y"), F.lit(n_obs) - F.count("y")
    mean = F.sum("y") / n_obs
    # the zeros join what is there by the rule for merging two groups' moments, which loses no digits
    variance = (F.var_pop("y") * k + F.avg("y") * F.avg("y") * k * zeros / n_obs) / n_obs
    return y.groupBy("var_id").agg(mean.alias("mean"), variance.alias("variance"))


def feature_moments_factors(dense: DataFrame, factors: DataFrame) -> DataFrame:
    """(var_id, mean, variance) of value over its cell's factor, factors scaled by their global mean."""
    scale = factors.agg(F.avg("factor").alias("scale"))
    y = dense.join(factors, ["obs_id", "var_id"]).join(F.broadcast(scale)).withColumn("y", F.col("value") / (F.col("factor") / F.col("scale")))
    return y.groupBy("var_id").agg(F.avg("y").alias("mean"), F.var_pop("y").alias("variance"))


def log_cpm(counts: DataFrame, per: float = 1e4) -> DataFrame:
    """(obs_id, var_id, value): ln(1 + x / (total / per)); zeros stay absent."""
    total = counts.groupBy("obs_id").agg(F.sum("value").alias("t"))
    return counts.join(total, "obs_id").select("obs_id", "var_id", F.log1p(F.col("value") / (F.col("t") / per)).alias("value"))


def standardise(table: DataFrame, n_obs: int) -> DataFrame:
    """(obs_id, var_id, value): z-scores by feature, population deviation, zeros included in the moments; for the rows there are."""
    k, zeros = F.count("value"), F.lit(n_obs) - F.count("value")
    moments = table.groupBy("var_id").agg((F.sum("value") / n_obs).alias("m"), F.sqrt((F.var_pop("value") * k + F.avg("value") * F.avg("value") * k * zeros / n_obs) / n_obs).alias("s"))
    return table.join(moments, "var_id").select("obs_id", "var_id", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("value"))


def sum_of_squares(residuals: DataFrame) -> DataFrame:
    """(var_id, ssr)."""
    return residuals.groupBy("var_id").agg(F.sum(F.col("value") * F.col("value")).alias("ssr"))


def median_absolute_deviation(table: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mad): median of |x - median| of each group."""
    mid = table.groupBy(by).agg(F.expr(f"percentile({value}, 0.5D)").alias("_m"))
    return table.join(mid, by).groupBy(by).agg(F.expr(f"percentile(abs({value} - _m), 0.5D)").alias("mad"))


def category_fraction(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """(category, var_id, fraction): mean squared distance from the feature's least value by category, as a share of all categories'."""
    low = dense.groupBy("var_id").agg(F.min("value").alias("low"))
    squared = dense.join(low, "var_id").join(labels, "obs_id").groupBy("category", "var_id").agg(F.avg(F.pow(F.col("value") - F.col("low"), F.lit(2.0))).alias("msr"))
    total = F.sum("msr").over(Window.partitionBy("var_id"))
    return squared.select("category", "var_id", F.when(total > 0, F.col("msr") / total).otherwise(0.0).alias("fraction"))


def raster(cells: DataFrame, rows: int, cols: int, most_rows: int, most_cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, value): a matrix (i, j, value) on a grid of at most most_rows x most_cols, each cell a weighted mean.

    by: columns of further axes, such as depth, each value of which has a grid of its own. A value goes to the cell under it and the next ones in both directions, with weight 1 - |dx dy|.
    """
    h, w = min(most_rows, rows), min(most_cols, cols)
    at = cells.withColumn("fx", F.lit(float(h)) * F.col("i") / rows).withColumn("fy", F.lit(float(w)) * F.col("j") / cols).withColumn("bx", F.floor("fx")).withColumn("by", F.floor("fy"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    to = at.withColumn("s", step).select((F.col("bx") + F.col("s.a")).alias("x"), (F.col("by") + F.col("s.b")).alias("y"), "fx", "fy", "value", *by).where((F.col("x") < h) & (F.col("y") < w))
    weight = 1.0 - F.abs(F.col("x") - F.col("fx")) * F.abs(F.col("y") - F.col("fy"))
    return to.groupBy(*by, "x", "y").agg((F.sum(F.col("value") * weight) / (1e-9 + F.sum(weight))).alias("value"))
