"""The driver's tables as intervals, genes, count matrices, gene sets and embeddings.

Chromosomes are suppliers, positions days since 1992-01-01, an interval a line item as long as its quantity;
genes are parts; observations suppliers; gene sets brands and types. SQL holds the same bindings for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The scaled regulatory rule: bases before, after, and the reach of a domain.
UPSTREAM, DOWNSTREAM, DISTAL, SIZE = 5, 1, 50, 3700


class Tables:
    """Inputs from a folder of the driver's Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def intervals(self) -> DataFrame:
        """(chrom, start, end, strand, summit, score, flag, is_query)."""
        start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        long = F.col("l_quantity").cast("long")
        return self.table("lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), start.alias("start"), (start + long).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (start + F.floor(F.col("l_quantity") / 2)).cast("long").alias("summit"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("flag"), (F.col("l_returnflag") == "R").alias("is_query"))

    @property
    def query(self) -> DataFrame:
        return self.intervals.where("is_query")

    @property
    def sizes(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("string").alias("chrom"), F.lit(SIZE).cast("long").alias("size"))

    @property
    def genes(self) -> DataFrame:
        """(chrom, start, end, strand, gene, ord)."""
        n = self.table("supplier").agg(F.count("*").alias("n"))  # one row
        key = F.col("p_partkey")
        start = key * 37 % 2500 + 1095
        return self.table("part").join(F.broadcast(n)).select((key % F.col("n")).cast("string").alias("chrom"), start.alias("start"), (start + F.col("p_size")).cast("long").alias("end"), F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("g"), key.cast("string")).alias("gene"), key.alias("ord"))

    @property
    def membership(self) -> DataFrame:
        """(term_id, gene): brands and types."""
        gene = F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene")
        part = self.table("part")
        return part.select(F.col("p_brand").alias("term_id"), gene).union(part.select(F.col("p_type").alias("term_id"), gene))

    @property
    def sparse(self) -> DataFrame:
        """(obs_id, var_id, value): line items of a supplier and part."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("obs_id"), F.col("l_partkey").cast("string").alias("var_id")).agg(F.count("*").cast("int").alias("value"))

    @property
    def obs(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("string").alias("obs_id"), F.col("s_suppkey").alias("ord"))

    @property
    def var(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("var_id"), F.col("p_partkey").alias("ord"))

    @property
    def brands(self) -> DataFrame:
        """(var_id, ord) of the denser matrix; ord is the brand's number."""
        return self.table("part").select(F.col("p_brand").alias("var_id")).distinct().withColumn("ord", F.regexp_extract("var_id", r"(\d+)", 1).cast("long"))

    def by_brand(self, where: str = "true", size: bool = False) -> DataFrame:
        """(obs_id, var_id, value): quantity by supplier and brand (and size)."""
        part = self.table("part").select("p_partkey", "p_brand", "p_size")
        name = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")) if size else F.col("p_brand")
        return self.table("lineitem").where(where).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").cast("string").alias("obs_id"), name.alias("var_id")).agg(F.sum("l_quantity").cast("long").alias("value"))

    def cells(self, size: bool = False) -> DataFrame:
        """(obs_id, var_id, value, input), dense: signal without returned-flag A, input with it; with size: by brand and size, the random places."""
        sums, var = self._pairs(size)
        grid = self.obs.select("obs_id").join(var)  # every cell of the matrix is the result
        return grid.join(sums, ["obs_id", "var_id"], "left").na.fill(0, ["value", "input"])

    def places(self) -> DataFrame:
        """cells(size=True) with one of an observation's places that have neither signal nor input for all of these: they
        add nothing to a running sum."""
        sums, var = self._pairs(True)
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        some = sums.join(self.obs.select("obs_id"), "obs_id", "left_semi").select("obs_id", "var_id", count("value"), count("input")).where("value <> 0 or input <> 0")
        empty = self.obs.select("obs_id", F.lit(None).cast("string").alias("var_id"), F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("input"))
        held = some.union(empty).withColumn("_n", F.count("var_id").over(Window.partitionBy("obs_id")))
        return held.join(F.broadcast(var.agg(F.count("*").alias("_all")))).where("var_id is not null or _n < _all").select("obs_id", "var_id", "value", "input")

    def _pairs(self, size: bool) -> tuple[DataFrame, DataFrame]:
        """(obs_id, var_id, value, input) of the pairs that have line items; and (var_id)."""
        part = self.table("part").select("p_partkey", "p_brand", "p_size")
        name = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")) if size else F.col("p_brand")
        var = part.select(name.alias("var_id")).distinct()
        flagged = F.col("l_returnflag") == "A"
        sums = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").cast("string").alias("obs_id"), name.alias("var_id")).agg(F.sum(F.when(~flagged, F.col("l_quantity")).otherwise(0)).cast("long").alias("value"), F.sum(F.when(flagged, F.col("l_quantity")).otherwise(0)).cast("long").alias("input"))
        return sums, var

    @property
    def dense(self) -> DataFrame:
        """(obs_id, var_id, value) by brand, every cell."""
        grid = self.obs.select("obs_id").join(self.brands.select("var_id"))  # every cell of the matrix is the result
        return grid.join(self.by_brand(), ["obs_id", "var_id"], "left").na.fill(0, ["value"])

    @property
    def labels(self) -> DataFrame:
        """(obs_id, label): parity of the supplier's nation."""
        return self.table("supplier").select(F.col("s_suppkey").cast("string").alias("obs_id"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("label"))

    @property
    def rows(self) -> DataFrame:
        """(id, vec, label) of embeddings."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


# ---------------------------------------------------------------- the same in SQL

IV = """iv AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS BIGINT) AS e, l_returnflag AS flag, l_returnflag = 'R' AS q FROM lineitem)"""
GENES = f"""genes AS (SELECT CAST(p_partkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS chrom, p_partkey * 37 % 2500 + 1095 AS s,
    CAST(p_partkey * 37 % 2500 + 1095 + p_size AS BIGINT) AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, concat('g', p_partkey) AS gene, p_partkey AS ord FROM part)"""
DOMAINS = f"""{GENES}, basal AS (SELECT chrom, gene, ord, strand, CASE WHEN strand = '+' THEN s - {UPSTREAM} ELSE e - {DOWNSTREAM} END AS b0, CASE WHEN strand = '+' THEN s + {DOWNSTREAM} ELSE e + {UPSTREAM} END AS b1 FROM genes),
    near AS (SELECT *, coalesce(lead(b0) OVER w, {SIZE}) AS nx, coalesce(lag(b1) OVER w, 0) AS pv FROM basal WINDOW w AS (PARTITION BY chrom ORDER BY b0, ord)),
    dom AS (SELECT chrom, gene, strand, ord, CAST(least(greatest(least(b0, greatest(b0 - {DISTAL}, pv)), 0), {SIZE}) AS BIGINT) AS s,
        CAST(least(greatest(greatest(b1, least(b1 + {DISTAL}, nx)), 0), {SIZE}) AS BIGINT) AS e FROM near)"""
SPARSE = "sp AS (SELECT CAST(l_suppkey AS VARCHAR) AS o, CAST(l_partkey AS VARCHAR) AS v, count(*) AS x FROM lineitem GROUP BY ALL)"
DENSE = """dn AS (SELECT o.o, v.v, coalesce(b.x, 0) AS x FROM (SELECT CAST(s_suppkey AS VARCHAR) AS o FROM supplier) o CROSS JOIN (SELECT DISTINCT p_brand AS v FROM part) v
    LEFT JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS o, p_brand AS v, CAST(sum(l_quantity) AS BIGINT) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) b ON o.o = b.o AND v.v = b.v)"""


def cells_sql(name: str, size: bool = False) -> str:
    """Bindings of Tables.cells() as a common table."""
    var = "concat(p_brand, '-', p_size)" if size else "p_brand"
    return f"""{name} AS (SELECT o.o, v.v, coalesce(b.x, 0) AS x, coalesce(b.i, 0) AS i FROM (SELECT CAST(s_suppkey AS VARCHAR) AS o FROM supplier) o CROSS JOIN (SELECT DISTINCT {var} AS v FROM part) v
    LEFT JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS o, {var} AS v, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS x, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS i
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) b ON o.o = b.o AND v.v = b.v)"""
