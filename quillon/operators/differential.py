"""Two-group differential testing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_isf, normal_sf, normal_sf_col, t_two_sided_col
from ..functions.scalar import log2_ratio
from .scan import bh_fdr


def two_groups(labels: DataFrame, reference: str, category: str = "label") -> DataFrame:
    """(obs_id, is_ref): exactly two labels, one of them the reference."""
    found = sorted(str(r[0]) for r in labels.where(F.col(category).isNotNull()).select(category).distinct().limit(3).collect())
    if len(found) != 2 or reference not in found:
        raise ValueError(f"two labels with {reference!r} are needed, there are {found}")
    return labels.where(F.col(category).isNotNull()).select("obs_id", (F.col(category).cast("string") == reference).alias("is_ref"))


def fold_changes(counts: DataFrame, factors: DataFrame, groups: DataFrame) -> DataFrame:
    """(var_id, lfc): log2 of the other group's mean over the reference's, of value over size factor, floored at 1/n."""
    sizes = groups.agg(F.sum(F.col("is_ref").cast("int")).alias("n_ref"), F.sum((~F.col("is_ref")).cast("int")).alias("n_alt"))
    y = counts.join(factors.select("obs_id", "size_factor"), "obs_id").join(groups, "obs_id").withColumn("y", F.col("value") / F.col("size_factor"))
    sums = y.groupBy("var_id").agg(F.sum(F.when(F.col("is_ref"), F.col("y")).otherwise(0.0)).alias("r"), F.sum(F.when(~F.col("is_ref"), F.col("y")).otherwise(0.0)).alias("a"))
    floor = 1.0 / (F.col("n_ref") + F.col("n_alt"))
    return sums.join(F.broadcast(sizes)).select("var_id", log2_ratio(F.col("a") / F.col("n_alt"), F.col("r") / F.col("n_ref"), floor).alias("lfc"))


def welch_stats(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(var_id, t, df) of Welch's test, other group against reference; values is dense."""
    g = values.join(groups, "obs_id")
    alt, ref = F.when(~F.col("is_ref"), F.col("value").cast("double")), F.when(F.col("is_ref"), F.col("value").cast("double"))
    m = g.groupBy("var_id").agg(F.avg(alt).alias("ma"), F.var_samp(alt).alias("va"), F.count(alt).alias("na"), F.avg(ref).alias("mr"), F.var_samp(ref).alias("vr"), F.count(ref).alias("nr"))
    a, r = F.col("va") / F.col("na"), F.col("vr") / F.col("nr")
    return m.where(a + r > 0).select("var_id", ((F.col("ma") - F.col("mr")) / F.sqrt(a + r)).alias("t"), ((a + r) * (a + r) / (a * a / (F.col("na") - 1) + r * r / (F.col("nr") - 1))).alias("df"))


def welch_test(values: DataFrame, counts: DataFrame, factors: DataFrame, groups: DataFrame) -> DataFrame:
    """(var_id, stat, lfc, pvalue, padj) by Welch's t on residuals; features without variance have p 1."""
    t = welch_stats(values, groups).withColumn("pvalue", t_two_sided_col(F.col("t"), F.col("df")))
    out = fold_changes(counts, factors, groups).join(t, "var_id", "left").select("var_id", F.coalesce("t", F.lit(0.0)).alias("stat"), "lfc", F.coalesce("pvalue", F.lit(1.0)).alias("pvalue"))
    return bh_fdr(out, "pvalue", "padj")


def mann_whitney_u(counts: DataFrame, groups: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(var_id, u, n_alt, n_ref, ties): U of the other group over value / size factor; absent cells are zeros.

    The zeros of a feature are one tied block at the bottom, so ranks come from the rows that are there.
    """
    y = counts.where("value > 0").join(groups, "obs_id")
    y = y.withColumn("y", F.col("value").cast("double")) if factors is None else y.join(factors.select("obs_id", "size_factor"), "obs_id").withColumn("y", F.col("value") / F.col("size_factor"))
    sizes = groups.agg(F.sum((~F.col("is_ref")).cast("long")).alias("n_alt"), F.sum(F.col("is_ref").cast("long")).alias("n_ref"))
    tied = y.groupBy("var_id", "y").agg(F.count("*").alias("n"), F.sum((~F.col("is_ref")).cast("long")).alias("n1"))
    order = Window.partitionBy("var_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("under", F.coalesce(F.sum("n").over(order), F.lit(0)))
    per = tied.groupBy("var_id").agg(F.sum("n").alias("k"), F.sum("n1").alias("k1"), F.sum(F.col("n1") * (F.col("under") + (F.col("n") + 1) / F.lit(2.0))).alias("r"), F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("t"))
    zeros, zeros1 = F.col("n_alt") + F.col("n_ref") - F.col("k"), F.col("n_alt") - F.col("k1")
    rank_sum = F.col("r") + F.col("k1") * zeros + zeros1 * (zeros + 1) / F.lit(2.0)
    u = rank_sum - F.col("n_alt") * (F.col("n_alt") + 1) / F.lit(2.0)
    return per.join(F.broadcast(sizes)).select("var_id", u.alias("u"), "n_alt", "n_ref", (F.col("t") + F.pow(zeros.cast("double"), 3.0) - zeros).alias("ties"))


def mann_whitney_test(counts: DataFrame, factors: DataFrame, groups: DataFrame) -> DataFrame:
    """(var_id, stat, lfc, pvalue, padj): two-sided, normal approximation with ties and continuity correction."""
    u = mann_whitney_u(counts, groups, factors)
    n = F.col("n_alt") + F.col("n_ref")
    mid = F.col("n_alt") * F.col("n_ref") / F.lit(2.0)
    sd = F.sqrt(F.col("n_alt") * F.col("n_ref") / F.lit(12.0) * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, F.signum(F.col("u") - mid) * F.greatest(F.abs(F.col("u") - mid) - 0.5, F.lit(0.0)) / sd).otherwise(0.0)
    tested = u.withColumn("stat", z).withColumn("pvalue", F.least(F.lit(1.0), 2 * normal_sf_col(F.abs(z))))
    out = fold_changes(counts, factors, groups).join(tested, "var_id").select("var_id", "stat", "lfc", "pvalue")
    return bh_fdr(out, "pvalue", "padj")


def nb_wald_test(dense: DataFrame, exposure: DataFrame, groups: DataFrame) -> DataFrame:
    """(var_id, stat, lfc, pvalue, padj): a negative binomial Wald test for each feature, without shrinkage.

    exposure: (obs_id, exposure) or (obs_id, var_id, exposure). Dispersion is each feature's own estimate.
    """
    from .enrich import nb_two_groups

    keys = [c for c in ("obs_id", "var_id") if c in exposure.columns]
    joined = dense.join(exposure, keys).join(groups, "obs_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        alt = ~pdf["is_ref"].to_numpy(bool)
        beta, p, _ = nb_two_groups(pdf["value"].to_numpy(float), pdf["exposure"].to_numpy(float), np.ones(len(pdf)), alt)
        if not np.isfinite(beta):
            return pd.DataFrame({"var_id": [pdf["var_id"].iloc[0]], "stat": [0.0], "lfc": [0.0], "pvalue": [1.0]})
        z = float(normal_isf(np.array([min(max(p, 1e-300), 1 - 1e-16)]))[0])
        return pd.DataFrame({"var_id": [pdf["var_id"].iloc[0]], "stat": [z], "lfc": [beta / np.log(2)], "pvalue": [min(1.0, 2 * float(normal_sf(np.array([abs(z)]))[0]))]})

    fits = joined.select("var_id", "value", "exposure", "is_ref").groupBy("var_id").applyInPandas(fit, "var_id string, stat double, lfc double, pvalue double")  # as many rows as observations
    return bh_fdr(fits, "pvalue", "padj")


def differential(method: str, n_obs: int, dense: DataFrame, counts: DataFrame, factors: DataFrame, groups: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """The test that method names; auto: Welch over 50 observations, else the negative binomial."""
    if method == "auto":
        method = "t-test" if n_obs > 50 else "deseq"
    if method == "t-test":
        return welch_test(residuals if residuals is not None else dense, counts, factors, groups)
    if method == "wilcoxon":
        return mann_whitney_test(counts, factors, groups)
    if method == "deseq":
        return nb_wald_test(dense, factors.select("obs_id", F.col("size_factor").alias("exposure")), groups)
    raise ValueError(f"unknown method {method!r}")


def rank_groups(result: DataFrame, group: str, reference: str) -> DataFrame:
    """(grp, rank, var_id, score, pvalue, padj, lfc): both directions of a test, strongest first, ties by var_id."""
    parts = []
    for name, sign in ((group, 1.0), (reference, -1.0)):
        signed = result.select(F.lit(name).alias("grp"), "var_id", (F.col("stat") * sign).alias("score"), "pvalue", "padj", (F.col("lfc") * sign).alias("lfc"))
        parts.append(signed.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "var_id"))))
    return parts[0].union(parts[1])
