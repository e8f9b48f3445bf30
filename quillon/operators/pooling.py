"""Size factors by pooling observations and solving for each one's share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .matrix import top_detected

#: Windows of a ring that one task slides over.
STRETCH = 256


def pooled_factors(counts: DataFrame, obs: DataFrame, var: DataFrame, pools: tuple[int, ...] = (21, 41, 61, 81, 101)) -> DataFrame:
    """(obs_id, raw) from sums over pools of similar observations against the mean observation.

    On the most detected features; pools are windows on a ring of observations ordered by total; the linear system of
    pool factors is solved by least squares with the totals as a weak prior. A pool's factor is a median over features,
    which executors take stretch by stretch of the ring; each stretch also has the observations that its windows reach.
    The driver holds a few numbers for each observation.
    """
    spark = obs.sparkSession
    counts = settle(counts)
    small = settle(counts.join(top_detected(counts, var), "var_id", "left_semi").select("obs_id", "var_id", F.col("value").cast("double").alias("value")))
    sums = small.groupBy("obs_id").agg(F.sum("value").alias("total"))
    held = obs.select("obs_id", "ord").join(sums, "obs_id", "left").orderBy("ord").select("obs_id", F.coalesce("total", F.lit(0.0)).alias("total")).toPandas()  # a row for each observation
    total, n = np.maximum(held["total"].to_numpy(float), 1e-9), len(held)
    order = np.argsort(total, kind="stable")
    ring = np.concatenate([order[::2], order[1::2][::-1]])
    sizes = [p for p in pools if p <= n] or [n]
    place = np.empty(n, np.int64)
    place[ring] = np.arange(n)
    at = spark.createDataFrame(pa.table({"obs_id": pa.array(held["obs_id"], pa.string()), "place": pa.array(place), "total": pa.array(total)}), "obs_id string, place long, total double")
    unit = settle(small.join(F.broadcast(at), "obs_id").select("var_id", "place", (F.col("value") / F.col("total")).alias("u")))
    # features in any order: a pool's factor is a median over them
    mean = settle(unit.groupBy("var_id").agg((F.sum("u") / n).alias("mean")).where("mean > 0"))
    on = mean.count()
    rhs = np.tile(np.asarray(sizes, float)[:, None] * (not on), (1, n))  # a stretch without entries has medians of 0
    if on:
        reach, many = max(sizes) - 1, -(-n // STRETCH)
        # a place p is in the windows that start at p - reach to p, around the ring
        last = F.floor(F.col("place") / STRETCH)
        back = F.transform(F.sequence(F.lit(0), F.lit(-(-reach // STRETCH) + 1)), lambda i: F.pmod(last - i, F.lit(many)))
        near = F.array_distinct(back) if many > 1 else F.array(F.lit(0).cast("long"))
        ahead = F.pmod(F.col("place") - F.col("stretch") * STRETCH, F.lit(n))
        entries = unit.join(mean, "var_id").select("place", F.xxhash64("var_id").alias("v"), (F.col("u") / F.col("mean")).alias("x"), F.explode(near).alias("stretch")).withColumn("step", ahead).where(F.col("step") < STRETCH + reach)
        dealt = entries.repartition(min(4096, many), "stretch").sortWithinPartitions("stretch", "step")
        for b in dealt.select("stretch", "step", "v", "x").mapInArrow(_medians(n, on, sizes), "size int, start long, median double").toArrow().to_batches():
            rhs[b.column("size").to_numpy(), b.column("start").to_numpy()] = b.column("median").to_numpy()
    return spark.createDataFrame(pa.table({"obs_id": pa.array(held["obs_id"], pa.string()), "raw": pa.array(np.maximum(_solved(rhs, sizes, n)[place], 1e-9) * total)}), "obs_id string, raw double")


def _solved(rhs: np.ndarray, sizes: list[int], n: int, weak: float = 1e-3) -> np.ndarray:
    """Shares around the ring by least squares: sums over windows of each size from each place on, and weakly 1 each.

    Windows of one size are a circulant matrix, so the normal equations fall apart by frequency.
    """
    top, under = np.fft.rfft(np.full(n, weak * weak)), np.full(n // 2 + 1, weak * weak)
    for b, size in zip(rhs, sizes, strict=True):
        window = np.zeros(n)
        np.add.at(window, np.arange(size) % n, 1.0)
        c = np.conj(np.fft.rfft(window))  # a window looks ahead
        if size == n:
            c[1:] = 0
        top, under = top + np.conj(c) * np.fft.rfft(b), under + np.abs(c) ** 2
    return np.fft.irfft(top / under, n)


def _medians(n: int, on: int, sizes: list[int]):
    """A function over entries (stretch, step, v, x), sorted: (size, start, median over `on` features of each window's sum)."""

    def windows(stretch: int, step: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = stretch * STRETCH
        here = min(STRETCH, n - first)
        _, v = np.unique(v, return_inverse=True)
        width = int(v.max()) + 1
        cut = np.searchsorted(step, np.arange(STRETCH + max(sizes)))
        step_of = lambda j: (j % n) if n < STRETCH + max(sizes) else j  # noqa: E731  a small ring is gone around
        out = []
        for k, size in enumerate(sizes):
            total, count = np.zeros(width), np.zeros(width, np.int64)
            for s in range(here):
                if s % 64 == 0:  # anew, so that differences do not add up
                    total[:], count[:] = 0, 0
                    come = range(s, s + size)
                else:
                    come = range(s + size - 1, s + size)
                    gone = step_of(s - 1)
                    lo, hi = cut[gone], cut[gone + 1]
                    np.subtract.at(total, v[lo:hi], x[lo:hi])
                    np.subtract.at(count, v[lo:hi], 1)
                for j in come:
                    lo, hi = cut[step_of(j)], cut[step_of(j) + 1]
                    np.add.at(total, v[lo:hi], x[lo:hi])
                    np.add.at(count, v[lo:hi], 1)
                some = np.flatnonzero(count)
                zeros, low, high = on - len(some), (on - 1) // 2, on // 2
                if high < zeros:
                    out.append((k, first + s, 0.0))
                    continue
                held = np.sort(total[some])
                pick = lambda r: 0.0 if r < zeros else held[r - zeros]  # noqa: B023, E731
                out.append((k, first + s, (pick(low) + pick(high)) / 2))
        return tuple(np.array(c) for c in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def done() -> pa.RecordBatch:
            size, start, median = windows(now, *(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(start, pa.int64()), pa.array(median, pa.float64())], names=["size", "start", "median"])

        for b in batches:
            s, *rest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("stretch", "step", "v", "x"))
            ends = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if lo == hi:
                    continue
                if held and s[lo] != now:
                    yield done()
                    held = []
                now = int(s[lo])
                held.append(tuple(c[lo:hi] for c in rest))
        if held:
            yield done()

    return run
