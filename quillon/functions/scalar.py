"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale_piecewise(fold: Column, strength: Column) -> Column:
    """A fold change stretched around 1 by `strength`, symmetric for losses."""
    return F.when(fold > 1, strength * (fold - 1) + 1).otherwise(1 / (strength * (1 / fold - 1) + 1))


def log2_ratio(a: Column, b: Column, floor: Column) -> Column:
    """log2(a / b), both floored."""
    return F.log2(F.greatest(a, floor) / F.greatest(b, floor))


def cap_text(text: Column, most: int) -> Column:
    """Text cut to most-3 characters and "..." if it has `most` or more; null becomes "N/A"."""
    return F.when(text.isNull(), "N/A").when(F.length(text) >= most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def wrap_text(text: Column, width: int = 20, lines: int = 5) -> Column:
    """Capitalised text broken at spaces into at most `lines` lines of `width`, joined by <br>."""
    words = F.split(text, r"\s+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, w: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + 1 + F.length(w) <= width)
        joined = F.when(acc["now"] == "", w).otherwise(F.concat_ws(" ", acc["now"], w))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(fits, joined).otherwise(w).alias("now"))

    folded = F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    out = F.array_join(F.slice(folded, 1, lines), "<br>")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substring(out, 2, 1 << 20)))


def region_part(region: Column) -> Column:
    """chr:start-end as a struct (chrom, start, end)."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    return F.struct(F.regexp_extract(region, pattern, 1).alias("chrom"), F.regexp_extract(region, pattern, 2).try_cast("long").alias("start"), F.regexp_extract(region, pattern, 3).try_cast("long").alias("end"))


def gauss_kernel(distance: Column, sigma: float = 1.0) -> Column:
    """exp(-distance sigma)."""
    return F.exp(-distance * sigma)
