"""The annotated count matrix: observations, features and long tables of values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = T.StructType([T.StructField("obs_id", T.StringType(), False), T.StructField("ord", T.LongType(), False)])
VAR = T.StructType([T.StructField("var_id", T.StringType(), False), T.StructField("ord", T.LongType(), False)])
COUNTS = T.StructType([T.StructField("obs_id", T.StringType(), False), T.StructField("var_id", T.StringType(), False), T.StructField("value", T.IntegerType(), False)])
INTERVALS = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@dataclass
class CountMatrix:
    """obs (obs_id, ord, ...), var (var_id, ord, ...), counts (obs_id, var_id, value): zeros are absent rows.

    layers: dense long tables by name, obsm: (obs_id, vec array<double>) by name, uns: side tables by name.
    """

    obs: DataFrame
    var: DataFrame
    counts: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, DataFrame] = field(default_factory=dict)

    def need(self, slot: str, name: str) -> DataFrame:
        """A named table, or an error that says what has to run first."""
        found = getattr(self, slot)
        if name not in found:
            raise KeyError(f"{slot} has no {name!r}; it has {sorted(found)}")
        return found[name]

    def select(self, obs: DataFrame | None = None, var: DataFrame | None = None) -> CountMatrix:
        """The part whose ids are in obs (obs_id) and var (var_id)."""

        def cut(df: DataFrame) -> DataFrame:
            for ids, key in ((obs, "obs_id"), (var, "var_id")):
                if ids is not None and key in df.columns:
                    df = df.join(ids.select(key), key, "left_semi")
            return df

        tables = {k: {n: cut(d) for n, d in getattr(self, k).items()} for k in ("layers", "obsm")}
        return CountMatrix(cut(self.obs), cut(self.var), cut(self.counts), **tables, uns=dict(self.uns))

    def dense(self, table: DataFrame | None = None) -> DataFrame:
        """(obs_id, var_id, value) with a row for every cell."""
        cells = self.obs.select("obs_id").join(self.var.select("var_id"))  # every cell of the matrix is the result
        return cells.join(self.counts if table is None else table, ["obs_id", "var_id"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    def feature_major(self, table: DataFrame | None = None) -> DataFrame:
        """(var_id, ord, x array<double>), x in the order of obs.ord, absent cells 0.

        A feature's cells are gathered as they are and put in their places by numpy: work grows with the cells, and a task
        holds about CELLS of them at a time.
        """
        values = (self.counts if table is None else table).join(self.obs.select("obs_id", "ord"), "obs_id")
        n = self.obs.count()
        held = values.groupBy("var_id").agg(F.collect_list(F.struct(F.col("ord").cast("long").alias("at"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))).alias("held"))
        return self.var.select("var_id", F.col("ord").cast("long").alias("ord")).join(held, "var_id", "left").mapInArrow(_filled(n), "var_id string, ord long, x array<double>")

    def write(self, path: str) -> None:
        """One Parquet folder for each slot."""
        for name, df in [("obs", self.obs), ("var", self.var), ("counts", self.counts), *((f"{k}.{n}", d) for k in ("layers", "obsm", "uns") for n, d in getattr(self, k).items())]:
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, layers: tuple[str, ...] = (), obsm: tuple[str, ...] = (), uns: tuple[str, ...] = ()) -> CountMatrix:
        """What write() saved, with the named side tables."""
        load = lambda n: spark.read.parquet(f"{path}/{n}")
        return cls(load("obs"), load("var"), load("counts"), *({n: load(f"{k}.{n}") for n in names} for k, names in (("layers", layers), ("obsm", obsm), ("uns", uns))))


#: Cells of arrays that a task fills before it hands them on.
CELLS = 1 << 20


def _filled(n: int):
    """A function over batches (var_id, ord, held: entries at, v) that puts each row's entries into an array of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(n, 1))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x, held = np.zeros((b.num_rows, n)), b.column("held")
                entries = held.flatten()
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
                at = entries.field("at").to_numpy(zero_copy_only=False)
                ok = (at >= 0) & (at < n)
                flat = row[ok] * n + at[ok].astype(np.int64)
                if len(np.unique(flat)) < len(flat):
                    raise ValueError("a cell is there more than once")
                x.ravel()[flat] = entries.field("v").to_numpy(zero_copy_only=False)[ok]
                yield pa.RecordBatch.from_arrays([b.column("var_id"), b.column("ord"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(x.ravel()))], names=["var_id", "ord", "x"])

    return run


def from_arrays(spark: SparkSession, counts: np.ndarray, row_names=None, col_names=None, input_counts: np.ndarray | None = None, random_counts: np.ndarray | None = None, random_input: np.ndarray | None = None) -> CountMatrix:
    """A matrix from arrays (observations x features); names become strings and default to ordinals.

    An input array becomes the layer "input"; then the counts at random places become side tables.
    """
    counts = np.asarray(counts)
    rows = [str(x) for x in (row_names if row_names is not None else range(counts.shape[0]))]
    cols = [str(x) for x in (col_names if col_names is not None else range(counts.shape[1]))]
    if len(rows) != counts.shape[0] or len(cols) != counts.shape[1]:
        raise ValueError("names do not fit the array")

    def long(a: np.ndarray, names: list[str]) -> DataFrame:
        i, j = np.nonzero(a)
        pdf = pd.DataFrame({"obs_id": np.array(rows, object)[i], "var_id": np.array(names, object)[j], "value": a[i, j].astype(np.int32)})
        return spark.createDataFrame(pdf, COUNTS)

    out = CountMatrix(
        spark.createDataFrame(pd.DataFrame({"obs_id": rows, "ord": np.arange(len(rows))}), OBS),
        spark.createDataFrame(pd.DataFrame({"var_id": cols, "ord": np.arange(len(cols))}), VAR),
        long(counts, cols),
    )
    if input_counts is not None:
        out.layers["input"] = long(np.asarray(input_counts), cols)
        for name, a in (("counts_random", random_counts), ("input_random", random_input)):
            if a is not None:
                out.uns[name] = long(np.asarray(a), [f"r{i}" for i in range(np.asarray(a).shape[1])])
    return out


def concat(parts: dict[str, CountMatrix]) -> CountMatrix:
    """Observations of several matrices with a column batch; features common to all."""
    names = list(parts)
    shared = parts[names[0]].var
    for n in names[1:]:
        shared = shared.join(parts[n].var.select("var_id"), "var_id", "left_semi")
    tag = lambda n, df: df.withColumn("obs_id", F.concat_ws("-", "obs_id", F.lit(n)))
    obs = counts = None
    for n in names:
        o = tag(n, parts[n].obs.select("obs_id", "ord")).withColumn("batch", F.lit(n))
        c = tag(n, parts[n].counts).join(shared.select("var_id"), "var_id", "left_semi").select("obs_id", "var_id", "value")
        obs, counts = o if obs is None else obs.union(o), c if counts is None else counts.union(c)
    return CountMatrix(obs, shared, counts)
