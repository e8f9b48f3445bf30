"""The registered queries over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import CountMatrix
from ..operators import annotate, consensus, differential, embedding, enrich, graph, inputs, intervals, matrix, ranking, regions, residuals
from ..operators.scan import bh_fdr
from ..sources import text
from ..sources.tables import settle
from .bindings import DENSE, DISTAL, DOMAINS, DOWNSTREAM, GENES, IV, SIZE, SPARSE, UPSTREAM, Tables, cells_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIDTH = 64  # of interval bins, about twice the median interval


def query(sql: str | None = None):
    """Register a function of Tables as a query, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _r(name: str, digits: int = 6) -> F.Column:
    return F.round(F.col(name), digits).alias(name)


def domains(t: Tables) -> DataFrame:
    return regions.regulatory_domains(t.genes, t.sizes, UPSTREAM, DOWNSTREAM, DISTAL)


def hits(t: Tables) -> DataFrame:
    """(gene, background_hits, query_hits) of every gene with a background hit."""
    return regions.domain_hits(domains(t), t.intervals, "is_query", WIDTH)


HITS = f"{DOMAINS}, {IV}, hit AS (SELECT gene, count(*) AS background_hits, sum(CASE WHEN q THEN 1 ELSE 0 END)::BIGINT AS query_hits FROM dom JOIN iv ON dom.chrom = iv.chrom AND dom.s < iv.e AND iv.s < dom.e GROUP BY gene)"
TOTALS = "tot AS (SELECT count(*) AS m, sum(CASE WHEN q THEN 1 ELSE 0 END)::BIGINT AS n FROM iv)"


# ---------------------------------------------------------------- intervals

@query(f"WITH {GENES}, {IV} SELECT gene, count(*) AS n FROM genes g JOIN iv ON g.chrom = iv.chrom AND g.s < iv.e AND iv.s < g.e GROUP BY gene")
def interval_overlap_count(t: Tables) -> DataFrame:
    return intervals.overlap_count(t.genes, t.intervals, "gene", WIDTH)


@query(f"WITH {GENES}, {IV} SELECT gene FROM genes g WHERE EXISTS (SELECT 1 FROM iv WHERE q AND g.chrom = iv.chrom AND g.s < iv.e AND iv.s < g.e)")
def interval_semi(t: Tables) -> DataFrame:
    return intervals.overlap_semi(t.genes.withColumnRenamed("gene", "name"), t.query, WIDTH).select(F.col("name").alias("gene"))


@query(f"WITH {GENES}, {IV} SELECT gene, greatest(g.s, iv.s) AS start, least(g.e, iv.e) AS stop FROM genes g JOIN iv ON q AND g.chrom = iv.chrom AND g.s < iv.e AND iv.s < g.e")
def interval_intersection(t: Tables) -> DataFrame:
    return intervals.intersection(t.genes.withColumnRenamed("gene", "name"), t.query, WIDTH).select(F.col("name").alias("gene"), "start", F.col("end").alias("stop"))


@query(f"WITH {GENES}, {IV} SELECT gene, iv.s AS peak_start, iv.e AS peak_end FROM genes g JOIN iv ON q AND g.chrom = iv.chrom AND g.s - 10 < iv.e AND iv.s < g.e + 10")
def interval_join_slack(t: Tables) -> DataFrame:
    pairs = intervals.overlap_pairs(t.genes.select("chrom", "start", "end", "gene"), t.query.select("chrom", "start", "end"), WIDTH, slack=10)
    return pairs.select(F.col("l_gene").alias("gene"), F.col("r_start").alias("peak_start"), F.col("r_end").alias("peak_end"))


NEAR = f"""{GENES}, {IV}, qs AS (SELECT DISTINCT chrom, s, e FROM iv WHERE q), p AS (SELECT chrom, CASE WHEN strand = '+' THEN s ELSE e END AS pt, gene FROM genes),
    d AS (SELECT qs.*, p.gene, p.pt, CASE WHEN p.pt IS NULL THEN NULL WHEN pt < s THEN s - pt WHEN pt >= e THEN pt - e + 1 ELSE 0 END AS distance FROM qs LEFT JOIN p ON qs.chrom = p.chrom),
    n AS (SELECT *, row_number() OVER (PARTITION BY chrom, s, e ORDER BY distance, pt, gene) AS k FROM d)"""


def _regions(t: Tables) -> DataFrame:
    return t.query.select("chrom", "start", "end").distinct()


@query(f"WITH {NEAR} SELECT chrom, s AS start, e AS stop, coalesce(gene, 'None') AS gene, CAST(distance AS BIGINT) AS distance FROM n WHERE k = 1")
def nearest_tss(t: Tables) -> DataFrame:
    return intervals.nearest(_regions(t), intervals.tss(t.genes)).select("chrom", "start", F.col("end").alias("stop"), "gene", "distance")


@query(f"WITH {NEAR}, g AS (SELECT chrom, s, e, CASE WHEN distance < {DISTAL} THEN gene ELSE 'None' END AS gene FROM n WHERE k = 1) SELECT chrom, s AS start, e AS stop, concat(gene, '__', row_number() OVER (PARTITION BY gene ORDER BY chrom, s, e)) AS label FROM g")
def label_nearest(t: Tables) -> DataFrame:
    return intervals.label_by_nearest(_regions(t), intervals.tss(t.genes), ["chrom", "start", "end"], DISTAL).select("chrom", "start", F.col("end").alias("stop"), "label")


MERGED = """o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv WHERE q),
    f AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o)"""


@query(f"WITH {IV}, {MERGED} SELECT chrom, min(s) AS start, max(e) AS stop, count(*) AS n FROM f GROUP BY chrom, k HAVING count(*) >= 2")
def merge_naive(t: Tables) -> DataFrame:
    return intervals.merge_overlapping(t.query, 2, tile=256).select("chrom", "start", F.col("end").alias("stop"), "n")


@query(f"""WITH {IV}, ev AS (SELECT chrom, s AS p, 1 AS d FROM iv WHERE q UNION ALL SELECT chrom, e, -1 FROM iv WHERE q), g AS (SELECT chrom, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
    c AS (SELECT chrom, p AS start, lead(p) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM g WINDOW w AS (PARTITION BY chrom ORDER BY p)) SELECT * FROM c WHERE depth > 0""")
def coverage(t: Tables) -> DataFrame:
    return intervals.coverage(t.query).select("chrom", "start", F.col("end").alias("stop"), "depth")


# ---------------------------------------------------------------- regions

@query(f"WITH {DOMAINS} SELECT gene, chrom, s AS start, e AS stop FROM dom")
def regulatory_domains(t: Tables) -> DataFrame:
    return domains(t).select("gene", "chrom", "start", F.col("end").alias("stop"))


@query("WITH g AS (SELECT concat('g', p_partkey * 7 % 1501) AS gene, p_partkey FROM part) SELECT gene, p_partkey FROM g WHERE gene IN (SELECT gene FROM g GROUP BY gene HAVING count(*) = 1)")
def dedup_keep_none(t: Tables) -> DataFrame:
    genes = t.table("part").select(F.concat(F.lit("g"), (F.col("p_partkey") * 7 % 1501).cast("string")).alias("gene"), "p_partkey")
    return regions.drop_repeated(genes)


@query(f"WITH {DOMAINS}, g AS (SELECT {SIZE}.0::DOUBLE * count(*) AS t FROM supplier) SELECT gene, round(sum(greatest((e - s) / t, 1 / t)) * 1e6, 6) AS fraction_ppm FROM dom, g GROUP BY gene")
def domain_fraction(t: Tables) -> DataFrame:
    return regions.domain_fraction(domains(t), t.sizes).select("gene", F.round(F.col("fraction") * 1e6, 6).alias("fraction_ppm"))


@query(f"""WITH {HITS}, {TOTALS} SELECT dom.gene, coalesce(background_hits, 0) AS background_hits, coalesce(query_hits, 0) AS query_hits,
    round((coalesce(query_hits, 0) / n::DOUBLE) / greatest(coalesce(background_hits, 0) / m::DOUBLE, 1e-7), 6) AS fc FROM dom LEFT JOIN hit USING (gene), tot""")
def domain_enrichment(t: Tables) -> DataFrame:
    """The flagship: query and background intervals of every regulatory domain, and their fold change."""
    total = t.intervals.agg(F.count("*").alias("m"), F.sum(F.col("is_query").cast("long")).alias("n"))
    every = domains(t).select("gene").join(hits(t), "gene", "left").na.fill(0).join(F.broadcast(total))
    return every.select("gene", "background_hits", "query_hits", F.round((F.col("query_hits") / F.col("n")) / F.greatest(F.col("background_hits") / F.col("m"), F.lit(1e-7)), 6).alias("fc"))


ACT = "SELECT o AS obs_id, gene, CAST(sum(x) AS BIGINT) AS value FROM act JOIN sp USING (v) GROUP BY ALL"
PEAKS = "pk AS (SELECT CAST(p_partkey AS VARCHAR) AS v, CAST((p_partkey * 13 + 5) % (SELECT count(*) FROM supplier) AS VARCHAR) AS chrom, p_partkey * 53 % 3000 AS s, p_partkey * 53 % 3000 + 20 AS e FROM part)"


def _peaks(t: Tables) -> DataFrame:
    """Every part as a peak of its own, away from its gene."""
    n = t.table("supplier").agg(F.count("*").alias("n"))
    key = F.col("p_partkey")
    return t.table("part").join(F.broadcast(n)).select(key.cast("string").alias("var_id"), ((key * 13 + 5) % F.col("n")).cast("string").alias("chrom"), (key * 53 % 3000).alias("start"), (key * 53 % 3000 + 20).alias("end"))


@query(f"WITH {DOMAINS}, {PEAKS}, {SPARSE}, act AS (SELECT gene, v FROM dom JOIN pk ON dom.chrom = pk.chrom AND dom.s - 10 < pk.e AND pk.s < dom.e + 10) {ACT}")
def gene_activity(t: Tables) -> DataFrame:
    return regions.activity(domains(t), _peaks(t), t.sparse, 10, WIDTH)


@query(f"WITH {GENES}, {PEAKS}, {SPARSE}, p AS (SELECT chrom, CASE WHEN strand = '+' THEN s ELSE e END AS pt, gene FROM genes), act AS (SELECT gene, v FROM p JOIN pk ON p.chrom = pk.chrom AND pt - 30 < pk.e AND pk.s < pt + 1 + 30) {ACT}")
def tss_activity(t: Tables) -> DataFrame:
    return regions.activity(intervals.tss(t.genes), _peaks(t), t.sparse, 30, WIDTH)


@query(f"WITH {GENES}, {IV}, h AS (SELECT flag, gene, count(*) AS n FROM genes g JOIN iv ON g.chrom = iv.chrom AND g.s < iv.e AND iv.s < g.e GROUP BY ALL) SELECT f.flag AS file, g.gene AS var_id, CAST(coalesce(n, 0) AS INTEGER) AS value FROM (SELECT DISTINCT flag FROM iv) f CROSS JOIN genes g LEFT JOIN h ON h.flag = f.flag AND h.gene = g.gene")
def reads_per_region(t: Tables) -> DataFrame:
    return consensus.reads_per_region(t.intervals.withColumnRenamed("flag", "file"), t.genes.withColumnRenamed("gene", "var_id"), width=WIDTH)


# ---------------------------------------------------------------- matrices

@query(f"WITH {SPARSE} SELECT v AS var_id, count(*) AS n FROM sp WHERE x >= 2 GROUP BY v HAVING count(*) >= 3")
def trim_low_counts(t: Tables) -> DataFrame:
    return matrix.trim_low_counts(t.sparse, 3, 2)


@query(f"WITH {SPARSE} SELECT o AS obs_id, CAST(sum(x) AS BIGINT) AS total, count(*) AS n_detected, round(100.0 * sum(CASE WHEN ends_with(v, '0') THEN x ELSE 0 END) / sum(x), 6) AS pct_flagged FROM sp GROUP BY o")
def qc_metrics(t: Tables) -> DataFrame:
    return matrix.qc_metrics(t.sparse, F.col("var_id").endswith("0")).withColumn("pct_flagged", F.round("pct_flagged", 6))


def _factors(t: Tables, method: str) -> DataFrame:
    sparse = method in ("fpkm", "top_fpkm")
    got = matrix.size_factors(t.sparse if sparse else t.by_brand(), t.obs, t.var if sparse else t.brands, method)
    return got.select("obs_id", _r("raw"), _r("size_factor"))


SCALED = "SELECT o AS obs_id, round(raw, 6) AS raw, round(raw / avg(raw) OVER (), 6) AS size_factor FROM f"


@query(f"WITH {SPARSE}, f AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, coalesce(sum(x), 0)::DOUBLE AS raw FROM supplier LEFT JOIN sp ON o = CAST(s_suppkey AS VARCHAR) GROUP BY 1) {SCALED}")
def size_factor_sum(t: Tables) -> DataFrame:
    return _factors(t, "fpkm")


@query(f"""WITH {SPARSE}, l AS (SELECT CAST(p_partkey AS VARCHAR) AS v, p_partkey AS ord, count(x) FILTER (x > 0) AS d0, count(x) FILTER (x > 5) AS d5, count(x) FILTER (x > 10) AS d10, count(x) FILTER (x > 15) AS d15, count(x) FILTER (x > 20) AS d20 FROM part LEFT JOIN sp ON v = CAST(p_partkey AS VARCHAR) GROUP BY ALL),
    top AS (SELECT v, row_number() OVER (ORDER BY d0 DESC, d5 DESC, d10 DESC, d15 DESC, d20 DESC, ord DESC) AS k FROM l), c AS (SELECT CAST(floor(count(*) * 0.05 + 1) AS BIGINT) AS n FROM part),
    f AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, coalesce(sum(x), 0)::DOUBLE AS raw FROM supplier LEFT JOIN (SELECT sp.* FROM sp JOIN top USING (v), c WHERE k <= n) z ON z.o = CAST(s_suppkey AS VARCHAR) GROUP BY 1) {SCALED}""")
def size_factor_top_detected(t: Tables) -> DataFrame:
    return _factors(t, "top_fpkm")


@query(f"WITH {DENSE}, f AS (SELECT o, quantile_cont(x::DOUBLE, 0.75) AS raw FROM dn GROUP BY o) {SCALED}")
def size_factor_upper_quartile(t: Tables) -> DataFrame:
    return _factors(t, "fpkm_uq")


@query(f"WITH {DENSE}, g AS (SELECT v, exp(avg(ln(x::DOUBLE))) AS gm FROM dn WHERE v NOT IN (SELECT v FROM dn WHERE x = 0) GROUP BY v), f AS (SELECT o, median(x / gm) AS raw FROM dn JOIN g USING (v) GROUP BY o) {SCALED}")
def size_factor_median_ratio(t: Tables) -> DataFrame:
    return _factors(t, "deseq")


FACTOR = "f AS (SELECT o, sum(x)::DOUBLE / (SELECT sum(x)::DOUBLE / (SELECT count(*) FROM supplier) FROM sp) AS sf FROM sp GROUP BY o)"


@query(f"WITH {SPARSE}, {FACTOR}, n AS (SELECT count(*) AS n FROM supplier), y AS (SELECT v, x / sf AS y FROM sp JOIN f USING (o)), m AS (SELECT v, sum(y) / n AS mean, n, count(*) AS k FROM y, n GROUP BY v, n) SELECT v AS var_id, round(mean, 6) AS mean, round((sum((y - mean) * (y - mean)) + (n - k) * mean * mean) / n, 6) AS variance FROM y JOIN m USING (v) GROUP BY v, mean, n, k")
def feature_moments(t: Tables) -> DataFrame:
    got = matrix.feature_moments(t.sparse, matrix.size_factors(t.sparse, t.obs, t.var, "fpkm"), t.obs.count())
    return got.select("var_id", _r("mean"), _r("variance"))


@query(f"WITH {cells_sql('c')}, k AS (SELECT avg(1.0::DOUBLE + i) AS k FROM c) SELECT v AS var_id, round(avg(x / ((1.0::DOUBLE + i) / k)), 6) AS mean, round(var_pop(x / ((1.0::DOUBLE + i) / k)), 4) AS variance FROM c, k GROUP BY v")
def feature_moments_nf(t: Tables) -> DataFrame:
    cells = t.cells()
    got = matrix.feature_moments_factors(cells.select("obs_id", "var_id", "value"), cells.select("obs_id", "var_id", (1.0 + F.col("input")).alias("factor")))
    return got.select("var_id", _r("mean"), _r("variance", 4))


LOGCPM = f"{SPARSE}, lc AS (SELECT o, v, ln(1 + x / (sum(x) OVER (PARTITION BY o) / 1e4)) AS y FROM sp)"


@query(f"WITH {LOGCPM} SELECT o AS obs_id, v AS var_id, round(y, 6) AS value FROM lc")
def log_cpm(t: Tables) -> DataFrame:
    return matrix.log_cpm(t.sparse).select("obs_id", "var_id", _r("value"))


@query(f"WITH {DENSE}, m AS (SELECT v, avg(x) AS m, stddev_pop(x) AS s FROM dn GROUP BY v) SELECT o AS obs_id, v AS var_id, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS value FROM dn JOIN m USING (v)")
def standardise(t: Tables) -> DataFrame:
    return matrix.standardise(t.dense.withColumn("value", F.col("value").cast("double")), t.obs.count()).select("obs_id", "var_id", _r("value"))


@query(f"WITH {LOGCPM}, r AS (SELECT v, CAST(v AS BIGINT) AS ord, round(sum(y * y), 6) AS ssr FROM lc GROUP BY v) SELECT v AS var_id, ssr FROM r ORDER BY ssr DESC, ord LIMIT 50")
def top_k_features(t: Tables) -> DataFrame:
    ssr = matrix.sum_of_squares(matrix.log_cpm(t.sparse)).select("var_id", F.col("var_id").cast("long").alias("ord"), _r("ssr"))
    return ranking.top_k_features(ssr, 50).select("var_id", "ssr")


@query(f"WITH {LOGCPM}, m AS (SELECT o, median(y) AS m FROM lc GROUP BY o) SELECT o AS obs_id, round(median(abs(y - m)), 6) AS mad FROM lc JOIN m USING (o) GROUP BY o")
def median_deviation(t: Tables) -> DataFrame:
    return matrix.median_absolute_deviation(matrix.log_cpm(t.sparse), "obs_id", "value").select("obs_id", _r("mad"))


@query(f"WITH {DENSE}, l AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS c FROM supplier), m AS (SELECT v, min(x) AS lo FROM dn GROUP BY v), a AS (SELECT c, v, avg(pow(x - lo, 2)) AS q FROM dn JOIN m USING (v) JOIN l USING (o) GROUP BY ALL) SELECT c AS category, v AS var_id, round(CASE WHEN sum(q) OVER (PARTITION BY v) > 0 THEN q / sum(q) OVER (PARTITION BY v) ELSE 0 END, 6) AS fraction FROM a")
def category_fraction(t: Tables) -> DataFrame:
    return matrix.category_fraction(t.dense, t.labels.withColumnRenamed("label", "category")).select("category", "var_id", _r("fraction"))


@query(f"""WITH {DENSE}, n AS (SELECT count(*) AS n FROM supplier), m AS (SELECT CAST(o AS BIGINT) AS i, CAST(regexp_extract(v, '([0-9]+)', 1) AS BIGINT) AS b, x FROM dn), j AS (SELECT i, dense_rank() OVER (ORDER BY b) - 1 AS j, x FROM m),
    g AS (SELECT least(40, n)::DOUBLE * i / n AS fx, 10.0::DOUBLE * j / 25 AS fy, x, least(40, n) AS h FROM j, n),
    e AS (SELECT floor(fx) + a AS x0, floor(fy) + b AS y0, fx, fy, x, h FROM g, (VALUES (0), (1)) s(a), (VALUES (0), (1)) u(b))
    SELECT CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y, round(sum(x * (1 - abs(x0 - fx) * abs(y0 - fy))) / (1e-9 + sum(1 - abs(x0 - fx) * abs(y0 - fy))), 4) AS value FROM e WHERE x0 < h AND y0 < 10 GROUP BY ALL""")
def raster_grid(t: Tables) -> DataFrame:
    place = t.brands.select("var_id", "ord").toPandas().sort_values("ord")  # 25 brands
    cols = t.spark.createDataFrame(pd.DataFrame({"var_id": place["var_id"], "j": np.arange(len(place))}))
    cells = t.dense.join(F.broadcast(cols), "var_id").select(F.col("obs_id").cast("long").alias("i"), "j", "value")
    return matrix.raster(cells, t.obs.count(), 25, 40, 10).select("x", "y", _r("value", 4))


@query("SELECT concat(CAST(l_suppkey AS VARCHAR), '-', l_returnflag) AS obs_id, l_returnflag AS batch, p_brand AS var_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def concat_batches(t: Tables) -> DataFrame:
    from ..model import CountMatrix, concat

    whole = concat({f: CountMatrix(t.obs, t.brands, t.by_brand(f"l_returnflag = '{f}'")) for f in ("A", "N", "R")})
    return whole.counts.join(whole.obs.select("obs_id", "batch"), "obs_id").select("obs_id", "batch", "var_id", "value")


@query("SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING), 4) AS median FROM orders")
def rolling_median(t: Tables) -> DataFrame:
    return ranking.rolling_median(t.table("orders"), "o_totalprice", ["o_orderkey"], ["o_orderpriority"]).select("o_orderkey", _r("median", 4))


# ---------------------------------------------------------------- multiple tests

@query("""WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 997) / 997.0::DOUBLE AS p FROM part), c AS (SELECT p, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m, p_partkey FROM p),
    r AS (SELECT p_partkey, p, p * m / k AS raw FROM c) SELECT p_partkey, round(p, 9) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 9) AS q FROM r""")
def bh_fdr_global(t: Tables) -> DataFrame:
    p = t.table("part").select("p_partkey", ((F.col("p_partkey") * 7919 % 997) / F.lit(997.0)).alias("p"))
    return bh_fdr(p, "p", "q").select("p_partkey", _r("p", 9), _r("q", 9))


@query(f"""WITH {SPARSE}, p AS (SELECT o, v, 1.0::DOUBLE / (1 + x * x) * ((CAST(v AS BIGINT) % 89 + 1) / 90.0::DOUBLE) AS p FROM sp), c AS (SELECT *, count(*) OVER (PARTITION BY o ORDER BY p) AS k, count(*) OVER (PARTITION BY o) AS m FROM p)
    SELECT o AS obs_id, v AS var_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY o ORDER BY p DESC)), 9) AS q FROM c""")
def bh_fdr_within(t: Tables) -> DataFrame:
    p = t.sparse.withColumn("p", F.lit(1.0) / (1 + F.col("value") * F.col("value")) * ((F.col("var_id").cast("long") % 89 + 1) / F.lit(90.0)))
    return bh_fdr(p, "p", "q", ["obs_id"]).select("obs_id", "var_id", _r("q", 9))


# ---------------------------------------------------------------- control inputs

REFERENCE = f"""{cells_sql('rn', True)}, w AS (SELECT o, row_number() OVER k AS nth, sum(x) OVER k AS c, sum(i) OVER k AS ci, sum(x) OVER (PARTITION BY o) AS tc, sum(i) OVER (PARTITION BY o) AS ti FROM rn WINDOW k AS (PARTITION BY o ORDER BY x, i DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ci::DOUBLE / ti - c::DOUBLE / tc DESC, nth) AS best FROM w),
    lf AS (SELECT o, CASE WHEN ci <= 10 OR c <= 10 THEN ln(tc::DOUBLE / ti) ELSE ln(c::DOUBLE / ci) END AS lfc, ci <= 10 OR c <= 10 AS low FROM b WHERE best = 1)"""
FILLED = f"""{REFERENCE}, {cells_sql('c')}, s AS (SELECT o, sum(i)::DOUBLE AS t FROM c GROUP BY o), sf AS (SELECT o, t / avg(t) OVER () AS sf, count(*) OVER () AS n FROM s), z AS (SELECT c.*, sf, n FROM c JOIN sf USING (o)),
    lv AS (SELECT v, avg(i / sf) AS lv, sum(sf) AS a FROM z GROUP BY v), fl AS (SELECT o, v, x, i, CASE WHEN i < 0.5 THEN CASE WHEN lv * a < 1e-10 THEN sf / n ELSE lv * sf END ELSE i::DOUBLE END * exp(lfc) AS nf FROM z JOIN lv USING (v) JOIN lf USING (o)),
    fo AS (SELECT *, greatest(x::DOUBLE, 0.1) / nf AS fold FROM fl)"""


@query(f"WITH {REFERENCE} SELECT o AS obs_id, round(lfc, 6) AS lfc, low FROM lf")
def input_reference_lfc(t: Tables) -> DataFrame:
    return inputs.reference_lfc(t.places()).select("obs_id", _r("lfc"), "low")


@query(f"""WITH {FILLED}, st AS (SELECT o, sum(i)::DOUBLE / sum(x) * exp(any_value(lfc)) AS st FROM c JOIN lf USING (o) GROUP BY o), k AS (SELECT o, st / (SELECT median(st) FROM st) AS k FROM st)
    SELECT o AS obs_id, v AS var_id, round(nf * fold / CASE WHEN fold > 1 THEN k * (fold - 1) + 1 ELSE 1 / (k * (1 / fold - 1) + 1) END, 5) AS factor FROM fo JOIN k USING (o)""")
def rescale_center_scale(t: Tables) -> DataFrame:
    return inputs.rescale_center_scale(t.cells(), t.places()).select("obs_id", "var_id", _r("factor", 5))


@query(f"WITH {FILLED}, r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(fold, 9), v) AS k FROM fo), m AS (SELECT k, exp(avg(ln(fold))) AS g FROM r GROUP BY k) SELECT o AS obs_id, v AS var_id, round(nf * fold / g, 5) AS factor FROM r JOIN m USING (k)")
def rescale_quantile(t: Tables) -> DataFrame:
    return inputs.rescale_quantile(t.cells(), t.places()).select("obs_id", "var_id", _r("factor", 5))


# ---------------------------------------------------------------- enrichment

def _totals(t: Tables) -> tuple[int, int]:
    row = t.intervals.agg(F.count("*").alias("m"), F.sum(F.col("is_query").cast("long")).alias("n")).first()
    return row["m"], row["n"]


CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


@query(f"""WITH {HITS}, {TOTALS}, k AS (SELECT gene, background_hits AS g, query_hits AS k, m, n, unnest(range(query_hits, least(background_hits, n) + 1)) AS j FROM hit, tot),
    p AS (SELECT gene, g, k, m, n, CASE WHEN k <= 0 THEN 1.0 ELSE least(1.0, sum(exp(({CHOOSE.format('g::DOUBLE', 'j')}) + ({CHOOSE.format('(m - g)::DOUBLE', '(n - j)')}) - ({CHOOSE.format('m::DOUBLE', 'n')})))) END AS p FROM k GROUP BY gene, g, k, m, n)
    SELECT gene, g AS background_hits, k AS query_hits, round(p, 6) AS pvalue, round((k / n::DOUBLE) / greatest(g / m::DOUBLE, 1e-7), 6) AS fc FROM p""")
def hypergeom_enrichment(t: Tables) -> DataFrame:
    m, n = _totals(t)
    return enrich.hypergeometric(hits(t), m, n).select("gene", "background_hits", "query_hits", _r("pvalue"), _r("fc"))


TERMS = "mem AS (SELECT p_brand AS term_id, concat('g', p_partkey) AS gene FROM part UNION SELECT p_type, concat('g', p_partkey) FROM part)"
TERM_SIZES = f"{TERMS}, tm AS (SELECT term_id, count(*) AS n_genes, count(*) FILTER (query_hits >= 1) AS n_hit, sum(query_hits)::BIGINT AS hits FROM mem JOIN hit USING (gene) GROUP BY term_id HAVING count(*) FILTER (query_hits >= 1) >= 3 AND count(*) <= 100000)"
MOST = 100_000


def _genes(t: Tables, scaled: bool = True) -> DataFrame:
    m, n = _totals(t)
    return enrich.expected_hits(hits(t), m if scaled else 1, n if scaled else 1)


@query(f"WITH {HITS}, {TERM_SIZES} SELECT term_id, n_genes, n_hit, hits FROM tm")
def term_hits(t: Tables) -> DataFrame:
    return enrich.term_sizes(_genes(t), t.membership, 3, MOST)


@query(f"""WITH {HITS}, {TOTALS}, {TERM_SIZES}, g AS (SELECT gene, query_hits AS o, background_hits * (n::DOUBLE / m) AS e FROM hit, tot), a AS (SELECT sum(o) AS o, sum(e) AS e FROM g),
    i AS (SELECT term_id, hits, sum(g.o) AS o1, sum(g.e) AS e1 FROM mem JOIN tm USING (term_id) JOIN g USING (gene) GROUP BY ALL)
    SELECT term_id, hits, round(ln(o1 / e1) - ln((o - o1) / (e - e1)), 6) AS beta, round(sqrt(1.0 / o1 + 1.0 / (o - o1)), 6) AS se FROM i, a""")
def poisson_enrichment_beta(t: Tables) -> DataFrame:
    return enrich.poisson_beta(_genes(t), t.membership, 3, MOST).select("term_id", "hits", _r("beta"), _r("se"))


@query(f"""WITH {HITS}, {TERM_SIZES}, g AS (SELECT gene, query_hits AS o, background_hits - query_hits AS f FROM hit), a AS (SELECT sum(o) AS o, sum(f) AS f FROM g),
    i AS (SELECT term_id, hits, sum(g.o) AS o1, sum(g.f) AS f1 FROM mem JOIN tm USING (term_id) JOIN g USING (gene) GROUP BY ALL)
    SELECT term_id, hits, round(ln(o1 / f1::DOUBLE) - ln((o - o1) / (f - f1)::DOUBLE), 6) AS beta, round(sqrt(1.0 / o1 + 1.0 / f1 + 1.0 / (o - o1) + 1.0 / (f - f1)), 6) AS se FROM i, a""")
def binomial_enrichment_beta(t: Tables) -> DataFrame:
    return enrich.binomial_beta(_genes(t, False), t.membership, 3, MOST).select("term_id", "hits", _r("beta"), _r("se"))


@query()
def poisson_enrichment(t: Tables) -> DataFrame:
    return enrich.wald_table(enrich.poisson_beta(_genes(t), t.membership, 3, MOST))


@query()
def nb_enrichment(t: Tables) -> DataFrame:
    return enrich.nb_enrichment(_genes(t), t.membership, 3, MOST)


@query()
def enrichment_per_label(t: Tables) -> DataFrame:
    universe = t.query.select("chrom", "start", "end", F.col("strand").alias("label")).withColumn("region", F.xxhash64("chrom", "start", "end")).dropDuplicates(["region"])
    catalog = t.genes.join(t.table("part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_brand").alias("name")), "gene")
    pairs = intervals.overlap_pairs(catalog.select("chrom", "start", "end", "name"), universe.select("chrom", "start", "end", "region"), WIDTH).select(F.col("l_name").alias("name"), F.col("r_region").alias("region"))
    return enrich.per_label(pairs, universe.select("region", "label"))


@query()
def genes_for_term(t: Tables) -> DataFrame:
    m, n = _totals(t)
    return enrich.genes_for_term(t.membership, enrich.hypergeometric(hits(t), m, n), 0.5)


@query()
def top_terms(t: Tables) -> DataFrame:
    return ranking.top_terms(enrich.wald_table(enrich.poisson_beta(_genes(t), t.membership, 3, MOST)), 10, alpha=0.5)


@query()
def term_clusters(t: Tables) -> DataFrame:
    """Terms that share genes, clustered, each cluster named by its best term."""
    table = enrich.wald_table(enrich.poisson_beta(_genes(t), t.membership, 3, MOST)).select("term_id", F.round(-F.log10("pvalue"), 6).alias("score"))
    ids = table.select("term_id").distinct().withColumn("id", F.abs(F.xxhash64("term_id")))
    near = graph.yule_distances(t.membership, table).join(ids.select(F.col("term_id").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("term_id").alias("b"), F.col("id").alias("dst")), "b")
    edges = near.select("src", "dst", (2.0 - F.col("distance")).alias("weight")).where("weight > 0")
    named = graph.leiden(edges).join(ids, "id").join(table, "term_id")
    lead = ranking.leads(named, "label", "score", "term_id")
    return named.join(lead, "label").select("term_id", "score", scalar.wrap_text(scalar.cap_text(F.col("lead"), 60)).alias("cluster"))


# ---------------------------------------------------------------- differential tests

def _groups(t: Tables) -> DataFrame:
    return differential.two_groups(t.labels, "even")


WELCH = f"""{DENSE}, l AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, s_nationkey % 2 = 0 AS ref FROM supplier), m AS (SELECT v, avg(x) FILTER (NOT ref) AS ma, var_samp(x) FILTER (NOT ref) AS va, count(*) FILTER (NOT ref) AS na, avg(x) FILTER (ref) AS mr, var_samp(x) FILTER (ref) AS vr, count(*) FILTER (ref) AS nr FROM dn JOIN l USING (o) GROUP BY v),
    w AS (SELECT v, (ma - mr) / sqrt(va / na + vr / nr) AS t, pow(va / na + vr / nr, 2) / (pow(va / na, 2) / (na - 1) + pow(vr / nr, 2) / (nr - 1)) AS df FROM m)"""


@query(f"WITH {WELCH} SELECT v AS var_id, round(t, 6) AS t, round(df, 6) AS df FROM w")
def welch_stats(t: Tables) -> DataFrame:
    return differential.welch_stats(t.dense, _groups(t)).select("var_id", _r("t"), _r("df"))


@query(f"WITH {WELCH}, b AS (SELECT 'odd' AS grp, v, t AS score FROM w UNION ALL SELECT 'even', v, -t FROM w) SELECT grp, v AS var_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, v) AS INTEGER) AS rank FROM b")
def rank_groups(t: Tables) -> DataFrame:
    tested = differential.welch_stats(t.dense, _groups(t)).select("var_id", F.col("t").alias("stat"), F.lit(0.0).alias("pvalue"), F.lit(0.0).alias("padj"), F.lit(0.0).alias("lfc"))
    return differential.rank_groups(tested, "odd", "even").select("grp", "var_id", _r("score"), "rank")


@query(f"""WITH {DENSE}, l AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, s_nationkey % 2 = 0 AS ref FROM supplier), r AS (SELECT v, ref, rank() OVER (PARTITION BY v ORDER BY x) + (count(*) OVER (PARTITION BY v, x) - 1) / 2.0::DOUBLE AS k FROM dn JOIN l USING (o))
    SELECT v AS var_id, sum(k) FILTER (NOT ref) - count(*) FILTER (NOT ref) * (count(*) FILTER (NOT ref) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY v""")
def mannwhitney_u(t: Tables) -> DataFrame:
    return differential.mann_whitney_u(t.by_brand(), _groups(t)).select("var_id", "u")


def _brand_factors(t: Tables) -> DataFrame:
    return matrix.size_factors(t.by_brand(), t.obs, t.brands, "fpkm")


@query()
def welch_test(t: Tables) -> DataFrame:
    return differential.welch_test(t.dense, t.by_brand(), _brand_factors(t), _groups(t))


@query()
def mannwhitney_test(t: Tables) -> DataFrame:
    return differential.mann_whitney_test(t.by_brand(), _brand_factors(t), _groups(t))


@query()
def nb_wald_test(t: Tables) -> DataFrame:
    return differential.differential("deseq", 0, t.dense, t.by_brand(), _brand_factors(t), _groups(t))


# ---------------------------------------------------------------- consensus

@query()
def consensus_peaks(t: Tables) -> DataFrame:
    return consensus.merge_peaks(consensus.normalise_peaks(t.query, force_unstranded=True), t.sizes)


@query()
def greedy_merge(t: Tables) -> DataFrame:
    return consensus.greedy_suppression(t.query.select("chrom", "start", "end", "strand", "summit", "score"), tile=256)


# ---------------------------------------------------------------- residuals

def _by_size(t: Tables):
    """The brand-and-size matrix with size factors."""
    counts = settle(t.by_brand(size=True))
    var = counts.select("var_id").distinct().withColumn("ord", F.abs(F.xxhash64("var_id")))
    return annotate.set_size_factors(CountMatrix(t.obs, var, counts), matrix.size_factors(counts, t.obs, var, "fpkm"))


@query()
def nb_residuals(t: Tables) -> DataFrame:
    return residuals.compute_residuals(_by_size(t), clip="auto").layers["residuals"]


@query()
def nb_residuals_input(t: Tables) -> DataFrame:
    """Residuals of the signal where every cell's exposure is its rescaled control input."""
    cells = settle(t.cells())
    whole = CountMatrix(t.obs, t.brands, cells.where("value <> 0").select("obs_id", "var_id", "value"))
    whole.layers["input"] = cells.select("obs_id", "var_id", F.col("input").alias("value"))
    whole = annotate.set_normalisation_factors(whole, inputs.rescale_center_scale(cells, t.places()))
    return residuals.compute_residuals(whole).layers["residuals"]


@query()
def chi_square_features(t: Tables) -> DataFrame:
    whole = residuals.compute_residuals(_by_size(t))
    return ranking.chi_square_features(matrix.sum_of_squares(whole.layers["residuals"]), whole.obs.count() - 1)


@query(f"WITH {DENSE}, m AS (SELECT v, avg(x) AS mu FROM dn GROUP BY v) SELECT o AS obs_id, v AS var_id, round((x - mu) / sqrt(mu + 0.3 * mu * mu), 6) AS value FROM dn JOIN m USING (v) WHERE mu > 0")
def pearson_residuals(t: Tables) -> DataFrame:
    """Residuals of an intercept alone at one exposure, for which the fitted mean is the mean, at a dispersion of 0.3."""
    whole = CountMatrix(t.obs, t.brands, t.by_brand())
    ids = [r["obs_id"] for r in t.obs.orderBy("ord").select("obs_id").collect()]  # a row for each observation
    alphas = t.brands.select("var_id", F.lit(0.3).alias("reg_alpha"))
    return residuals.residuals(settle(whole.feature_major()), alphas, ids, np.ones(len(ids)), np.ones((len(ids), 1)), "pearson", centre=False).select("obs_id", "var_id", _r("value"))


@query()
def elbow_features(t: Tables) -> DataFrame:
    return ranking.elbow_features(matrix.sum_of_squares(matrix.log_cpm(t.sparse)))


@query()
def pseudo_peaks(t: Tables) -> DataFrame:
    cells = t.cells()
    alphas = t.brands.select("var_id", F.lit(0.3).alias("reg_alpha"))
    return residuals.pseudo_peaks(cells, inputs.reference_lfc(t.places()), alphas, alpha=0.5)


# ---------------------------------------------------------------- embeddings and graphs

K = 10
DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"
KNN = f"d AS (SELECT a.vec_id AS src, b.vec_id AS dst, {DIST} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), kn AS (SELECT src, dst, distance, CAST(row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS INTEGER) AS rank FROM d QUALIFY rank <= {K})"


@query(f"WITH {KNN} SELECT src, dst, rank, round(distance, 6) AS distance FROM kn")
def knn_exact(t: Tables) -> DataFrame:
    return graph.knn(t.rows, K).select("src", "dst", "rank", _r("distance"))


@query(f"WITH {KNN} SELECT a.src, a.dst, CAST(count(c.dst) AS INTEGER) AS weight FROM kn a JOIN kn b ON a.src = b.src LEFT JOIN kn c ON c.src = a.dst AND c.dst = b.dst GROUP BY ALL")
def snn_weights(t: Tables) -> DataFrame:
    return graph.snn_weights(graph.knn(t.rows, K))


@query(f"""WITH {KNN}, n AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1), v AS (SELECT src, CAST(e.label AS VARCHAR) AS label, count(*) AS v FROM kn JOIN embeddings e ON dst = vec_id GROUP BY ALL)
    SELECT src AS id, label FROM v JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY src ORDER BY v / sqrt(n + 1.0) DESC, label) = 1""")
def knn_vote(t: Tables) -> DataFrame:
    return graph.knn_vote(graph.knn(t.rows, K), t.rows.select("id", "label"))


@query(f"""WITH {KNN}, n AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1), v AS (SELECT src, CAST(e.label AS VARCHAR) AS label, count(*) AS v FROM kn JOIN embeddings e ON dst = vec_id GROUP BY ALL),
    s AS (SELECT src, label FROM v JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY src ORDER BY v / sqrt(n + 1.0) DESC, label) = 1),
    r AS (SELECT CAST(e.label AS VARCHAR) AS label, avg(CASE WHEN s.label = CAST(e.label AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS r FROM embeddings e LEFT JOIN s ON src = vec_id GROUP BY 1) SELECT round(avg(r), 6) AS accuracy FROM r""")
def loo_knn_accuracy(t: Tables) -> DataFrame:
    return graph.balanced_accuracy(graph.knn_vote(graph.knn(t.rows, K), t.rows.select("id", "label")), t.rows.select("id", "label")).select(_r("accuracy"))


@query()
def knn_approximate(t: Tables) -> DataFrame:
    return graph.knn_approximate(t.rows, K).select("src", "dst", "rank", _r("distance"))


@query()
def cluster_observations(t: Tables) -> DataFrame:
    """Communities of suppliers by the log-scaled counts of their brands."""
    whole = CountMatrix(t.obs, t.brands, t.by_brand(), layers={"logcpm": matrix.log_cpm(t.by_brand())})
    return graph.cluster_rows(whole, "layer", "logcpm")


@query()
def leiden(t: Tables) -> DataFrame:
    return graph.leiden(graph.snn_weights(graph.knn(t.rows, graph.neighbour_count(t.rows.count()))))


@query()
def label_transfer(t: Tables) -> DataFrame:
    return graph.transfer_labels(t.rows.where("id % 2 = 0"), t.rows.where("id % 2 = 1").select("id", "vec"))


@query()
def row_order(t: Tables) -> DataFrame:
    return embedding.hierarchical_order(t.rows.select("id", "vec"))


@query()
def pca_parallel(t: Tables) -> DataFrame:
    features = CountMatrix(t.obs, t.brands, t.by_brand()).feature_major()
    ids = [r["obs_id"] for r in t.obs.orderBy("ord").select("obs_id").collect()]
    return embedding.pca_parallel(features, ids)[0]


@query()
def cca(t: Tables) -> DataFrame:
    ids = [r["obs_id"] for r in t.obs.orderBy("ord").select("obs_id").collect()]
    make = lambda f: CountMatrix(t.obs, t.brands, t.by_brand(f"l_returnflag = '{f}'")).feature_major()
    x, y = embedding.cca(make("A"), make("R"), ids, ids, 5)
    return x.select(F.lit("x").alias("side"), "*").union(y.select(F.lit("y").alias("side"), "*"))


@query()
def layout_2d(t: Tables) -> DataFrame:
    return embedding.layout_rows(t.rows, graph.knn(t.rows, K), epochs=50)


@query()
def cluster_agreement(t: Tables) -> DataFrame:
    found = graph.leiden(graph.snn_weights(graph.knn(t.rows, K)))
    both = found.join(t.rows.select("id", F.col("label").alias("truth")), "id").groupBy("label", "truth").agg(F.count("*").alias("n")).toPandas()
    a, b = np.repeat(both["label"], both["n"]), np.repeat(both["truth"], both["n"])
    return t.spark.createDataFrame([(float(graph.adjusted_mutual_information(a.to_numpy(), b.to_numpy())),)], "ami double")


@query()
def pooled_size_factors(t: Tables) -> DataFrame:
    return matrix.size_factors(t.sparse, t.obs, t.var, "pooled")


@query()
def random_regions(t: Tables) -> DataFrame:
    return text.random_regions(t.sizes, 1000, 50)


# ---------------------------------------------------------------- annotations, reads to a matrix

@query("SELECT CAST(s_suppkey AS VARCHAR) AS obs_id, 1.0::DOUBLE AS d0, CASE WHEN s_nationkey % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS d1, s_acctbal AS d2 FROM supplier")
def design_matrix(t: Tables) -> DataFrame:
    obs = t.labels.join(t.table("supplier").select(F.col("s_suppkey").cast("string").alias("obs_id"), "s_acctbal"), "obs_id")
    return annotate.design_matrix(obs, ["label", "s_acctbal"]).select("obs_id", *[F.col("design")[i].alias(f"d{i}") for i in range(3)])


@query("WITH f AS (SELECT s_suppkey, s_suppkey % 7 + 1.0::DOUBLE AS f FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS obs_id, round(f / (SELECT avg(f) FROM f), 6) AS size_factor FROM f")
def user_size_factors(t: Tables) -> DataFrame:
    given = t.obs.select("obs_id", (F.col("ord") % 7 + 1.0).alias("size_factor"))
    return annotate.set_size_factors(CountMatrix(t.obs, t.var, t.sparse), given).obs.select("obs_id", _r("size_factor"))


@query(f"WITH {SPARSE}, q AS (SELECT o, sum(x) AS total, count(*) AS n, 100.0::DOUBLE * sum(CASE WHEN CAST(v AS BIGINT) % 2 = 0 THEN x ELSE 0 END) / sum(x) AS pct FROM sp GROUP BY o) SELECT o AS obs_id, CAST(total AS BIGINT) AS total, n AS n_detected FROM q WHERE total >= 550 AND n >= 10 AND pct <= 52")
def qc_filter(t: Tables) -> DataFrame:
    return annotate.keep_good(matrix.qc_metrics(t.sparse, F.col("var_id").cast("long") % 2 == 0), min_total=550, min_detected=10, max_pct_flagged=52.0).select("obs_id", "total", "n_detected")


@query("SELECT vec_id AS id, CASE label WHEN 0 THEN 'none' WHEN 3 THEN 'three' ELSE 'other' END AS label FROM embeddings")
def recode_labels(t: Tables) -> DataFrame:
    return annotate.recode(t.rows.select("id", "label"), "label", {0: "none", 3: "three"}, "other")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return annotate.value_counts(t.table("lineitem"), "l_returnflag")


@query(f"WITH {GENES} SELECT gene, coalesce(lag(s) OVER w, -1) AS prev_start, coalesce(lead(s) OVER w, -1) AS next_start FROM genes WINDOW w AS (PARTITION BY chrom ORDER BY s, ord)")
def neighbour_starts(t: Tables) -> DataFrame:
    return annotate.neighbours(t.genes, ["chrom"], ["start", "ord"], ["start"]).select("gene", "prev_start", "next_start")


@query(f"WITH {IV} SELECT DISTINCT chrom, s AS start FROM iv WHERE NOT q EXCEPT SELECT chrom, s FROM iv WHERE q")
def interval_difference(t: Tables) -> DataFrame:
    return annotate.difference(t.intervals.where("not is_query"), t.query, ["chrom", "start"])


READS = "rd AS (SELECT flag AS file, chrom, s, e FROM iv)"


def _samples(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("a", "A", "N"), ("r", "R", "N")], "obs_id string, file string, input string")


def _reads_matrix(t: Tables):
    reads = t.intervals.select(F.col("flag").alias("file"), "chrom", "start", "end")
    even = t.genes.where("ord % 2 = 0").select("chrom", "start", "end", F.col("gene").alias("name"))
    odd = t.genes.where("ord % 2 = 1").select("chrom", "start", "end", F.col("gene").alias("name"))
    return text.matrix_from_reads(reads, even, odd, _samples(t), WIDTH)


@query(f"""WITH {GENES}, {IV}, {READS}, h AS (SELECT file, gene, ord, count(*) AS n FROM genes g JOIN rd ON g.chrom = rd.chrom AND g.s < rd.e AND rd.s < g.e GROUP BY ALL),
    s(obs_id, file, input) AS (VALUES ('a', 'A', 'N'), ('r', 'R', 'N'))
    SELECT CASE WHEN ord % 2 = 0 THEN 'counts' ELSE 'counts_random' END AS part, obs_id, gene AS var_id, CAST(n AS INTEGER) AS value FROM s JOIN h ON s.file = h.file
    UNION ALL SELECT CASE WHEN ord % 2 = 0 THEN 'input' ELSE 'input_random' END, obs_id, gene, CAST(n AS INTEGER) FROM s JOIN h ON s.input = h.file""")
def matrix_from_reads(t: Tables) -> DataFrame:
    """Target, random and shared control counts of two samples, from intervals as reads."""
    m = _reads_matrix(t)
    parts = {"counts": m.counts, "counts_random": m.uns["counts_random"], "input": m.layers["input"], "input_random": m.uns["input_random"]}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "obs_id", "var_id", "value")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {IV}, a AS (SELECT flag AS file, count(*) AS total, sum(CASE WHEN CAST(chrom AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS assigned FROM iv GROUP BY 1), p(file, input) AS (VALUES ('A', 'N'), ('R', 'A'))
    SELECT a.file, a.total, a.assigned, round((a.assigned / a.total) / (b.assigned / b.total), 6) AS signal_noise FROM p JOIN a ON p.file = a.file JOIN a b ON p.input = b.file""")
def mapping_stats(t: Tables) -> DataFrame:
    rows = t.intervals.select(F.col("flag").alias("file"), F.when(F.col("chrom").cast("long") % 2 == 0, "Assigned").otherwise("Unassigned").alias("status"), F.lit(1).alias("n"))
    controls = t.spark.createDataFrame([("A", "N"), ("R", "A")], "file string, input string")
    return text.mapping_stats(rows, controls).select("file", "total", "assigned", _r("signal_noise"))


@query(f"WITH {GENES} SELECT gene AS \"GeneID\", chrom AS \"Chr\", s AS \"Start\", e AS \"End\", strand AS \"Strand\" FROM genes")
def genes_as_saf(t: Tables) -> DataFrame:
    return text.bed_to_saf(t.genes.select("chrom", "start", "end", "strand", F.col("gene").alias("name")), names=True)
