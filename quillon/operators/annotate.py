"""Annotations of observations and features: designs, factors, filters, labels and neighbours in an order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CountMatrix


def design_matrix(obs: DataFrame, terms: list[str] | str = "intercept") -> DataFrame:
    """obs with design array<double>: 1, and for each named column its number, or 0 and 1 for every value but the least if it is text.

    Null entries are an error when the design is read, as a fit would have no use for the row.
    """
    parts: list[Column] = [F.lit(1.0)]
    for name in [] if terms == "intercept" else terms:
        if name not in obs.columns:
            raise KeyError(f"obs has no {name!r}")
        bad = F.raise_error(F.lit(f"{name} is null in a design"))
        if obs.schema[name].dataType.simpleString() == "string":
            levels = [r[0] for r in obs.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(257).collect()]
            if len(levels) > 256:
                raise ValueError(f"{name} has over 256 values")
            parts += [F.when(F.col(name).isNull(), bad.cast("double")).otherwise((F.col(name) == v).cast("double")) for v in levels[1:]]
        else:
            parts.append(F.when(F.col(name).isNull(), bad.cast("double")).otherwise(F.col(name).cast("double")))
    return obs.withColumn("design", F.array(*parts))


def set_size_factors(m: CountMatrix, factors: DataFrame) -> CountMatrix:
    """m with obs.size_factor from factors (obs_id, size_factor), scaled to a mean of 1; each observation needs one over 0."""
    mean = factors.join(m.obs.select("obs_id"), "obs_id", "left_semi").agg(F.avg("size_factor").alias("_mean"))
    bad = F.raise_error(F.concat(F.lit("no size factor over 0 for "), F.col("obs_id"))).cast("double")
    held = m.obs.drop("size_factor").join(factors.select("obs_id", "size_factor"), "obs_id", "left").join(F.broadcast(mean))
    return replace(m, obs=held.withColumn("size_factor", F.when(F.col("size_factor") > 0, F.col("size_factor") / F.col("_mean")).otherwise(bad)).drop("_mean"))


def set_normalisation_factors(m: CountMatrix, factors: DataFrame) -> CountMatrix:
    """m with the layer normalization_factors from factors (obs_id, var_id, factor): one over 0 for every cell."""
    cells = m.obs.select("obs_id").join(m.var.select("var_id"))  # every cell of the matrix is the result
    bad = F.raise_error(F.concat_ws(" ", F.lit("no factor over 0 for"), "obs_id", "var_id")).cast("double")
    held = cells.join(factors.select("obs_id", "var_id", "factor"), ["obs_id", "var_id"], "left")
    return replace(m, layers=m.layers | {"normalization_factors": held.withColumn("factor", F.when(F.col("factor") > 0, F.col("factor")).otherwise(bad))})


def keep_good(qc: DataFrame, min_total: float = 0, max_total: float | None = None, min_detected: int = 0, max_pct_flagged: float = 100.0) -> DataFrame:
    """Rows of qc_metrics() within the bounds, ends included."""
    ok = (F.col("total") >= min_total) & (F.col("n_detected") >= min_detected) & (F.col("pct_flagged") <= max_pct_flagged)
    return qc.where(ok if max_total is None else ok & (F.col("total") <= max_total))


def recode(df: DataFrame, column: str, names: dict, other: str | None = None) -> DataFrame:
    """df with column's values replaced by their names; values without one become `other`, or stay if that is None."""
    value = F.col(column).cast("string")
    known = F.create_map(*[F.lit(str(x)) for pair in names.items() for x in pair]) if names else None
    kept = value if other is None else F.when(value.isNotNull(), F.lit(other))
    return df.withColumn(column, kept if known is None else F.coalesce(F.try_element_at(known, value), kept))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n): how often each value occurs, null apart."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def neighbours(df: DataFrame, by: list[str], order: list[str], columns: list[str], sentinel: int = -1) -> DataFrame:
    """df with prev_ and next_ of each column: of the rows before and after in the order of its group, `sentinel` at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[f(c, 1, sentinel).over(w).alias(f"{p}_{c}") for c in columns for f, p in ((F.lag, "prev"), (F.lead, "next"))])


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct values of `on` that left has and right has not."""
    return left.select(*on).distinct().join(right.select(*on), on, "left_anti")
