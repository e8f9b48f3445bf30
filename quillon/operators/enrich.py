"""Enrichment of region sets in genes, categories and gene sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import hypergeometric_sf_col, log_gamma, normal_sf, normal_sf_col
from .scan import bh_fdr


def hypergeometric(hits: DataFrame, n_background: int, n_query: int, by: list[str] | None = None) -> DataFrame:
    """hits (..., background_hits, query_hits) with pvalue, fc and fdr.

    pvalue: chance of as many query hits or more if the query were drawn from the background. by: columns of a
    family of tests that is adjusted on its own; the default adjusts all together.
    """
    fc = (F.col("query_hits") / F.greatest(F.lit(float(n_query)), F.lit(1e-7))) / F.greatest(F.col("background_hits") / F.greatest(F.lit(float(n_background)), F.lit(1e-7)), F.lit(1e-7))
    tested = hits.withColumn("pvalue", F.coalesce(hypergeometric_sf_col(F.col("query_hits"), F.lit(n_background), F.col("background_hits"), F.lit(n_query)), F.lit(1.0))).withColumn("fc", fc)
    return bh_fdr(tested, "pvalue", "fdr", by)


def per_label(pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """(name, label, background_hits, query_hits, pvalue, fc, fdr) for every category and label of a universe.

    pairs: (name, region) overlaps of categories with universe regions (region, label). One FDR over the grid.
    """
    sizes = universe.groupBy("label").agg(F.count("*").alias("n_query"))
    total = universe.count()
    back = pairs.groupBy("name").agg(F.count("*").alias("background_hits"))
    query = pairs.join(universe, "region").groupBy("name", "label").agg(F.count("*").alias("query_hits"))
    grid = back.join(sizes).join(query, ["name", "label"], "left").na.fill(0, ["query_hits"])  # labels x categories is the result
    tested = grid.withColumn("pvalue", F.coalesce(hypergeometric_sf_col(F.col("query_hits"), F.lit(total), F.col("background_hits"), F.col("n_query")), F.lit(1.0)))
    fc = (F.col("query_hits") / F.col("n_query")) / F.greatest(F.col("background_hits") / total, F.lit(1e-7))
    return bh_fdr(tested.withColumn("fc", fc), "pvalue", "fdr").drop("n_query")


def expected_hits(hits: DataFrame, n_background: int, n_query: int) -> DataFrame:
    """(gene, observed, expected): background hits scaled to the size of the query."""
    return hits.select("gene", F.col("query_hits").alias("observed"), (F.col("background_hits") * F.lit(n_query / max(n_background, 1))).alias("expected"))


def term_sizes(genes: DataFrame, membership: DataFrame, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
    """(term_id, n_genes, n_hit, hits): terms with min_genes genes with a query hit and max_genes genes of the universe at most."""
    joined = membership.select("term_id", "gene").distinct().join(genes, "gene")
    sums = joined.groupBy("term_id").agg(F.count("*").alias("n_genes"), F.sum((F.col("observed") >= 1).cast("int")).alias("n_hit"), F.sum("observed").alias("hits"))
    return sums.where((F.col("n_hit") >= min_genes) & (F.col("n_genes") <= max_genes))


def _two_sums(genes: DataFrame, membership: DataFrame, terms: DataFrame) -> DataFrame:
    """Observed and expected inside and outside each term."""
    total = genes.agg(F.sum("observed").alias("o"), F.sum("expected").alias("e"))
    inside = membership.select("term_id", "gene").distinct().join(terms.select("term_id", "hits"), "term_id").join(genes, "gene").groupBy("term_id", "hits").agg(F.sum("observed").alias("o1"), F.sum("expected").alias("e1"))
    return inside.join(F.broadcast(total)).withColumn("o0", F.col("o") - F.col("o1")).withColumn("e0", F.col("e") - F.col("e1"))


def _wald(df: DataFrame) -> DataFrame:
    """pvalue of beta > 0 from beta and se, one-sided; fc and FDR."""
    p = F.greatest(normal_sf_col(F.col("beta") / F.col("se")), F.lit(1e-320))
    return bh_fdr(df.withColumn("pvalue", p).withColumn("fc", F.exp("beta")), "pvalue", "fdr")


def poisson_beta(genes: DataFrame, membership: DataFrame, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
    """(term_id, hits, beta, se): Poisson regression of hits on membership in closed form."""
    s = _two_sums(genes, membership, term_sizes(genes, membership, min_genes, max_genes))
    beta = F.log(F.col("o1") / F.col("e1")) - F.log(F.col("o0") / F.col("e0"))
    return s.where("o1 > 0 and o0 > 0 and e1 > 0 and e0 > 0").select("term_id", "hits", beta.alias("beta"), F.sqrt(1.0 / F.col("o1") + 1.0 / F.col("o0")).alias("se"))


def binomial_beta(genes: DataFrame, membership: DataFrame, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
    """(term_id, hits, beta, se): log odds ratio of hits among trials (expected: unscaled background hits)."""
    s = _two_sums(genes, membership, term_sizes(genes, membership, min_genes, max_genes)).withColumn("f1", F.col("e1") - F.col("o1")).withColumn("f0", F.col("e0") - F.col("o0"))
    cells = ("o1", "f1", "o0", "f0")
    beta = F.log(F.col("o1") / F.col("f1")) - F.log(F.col("o0") / F.col("f0"))
    return s.where(" and ".join(f"{c} > 0" for c in cells)).select("term_id", "hits", beta.alias("beta"), F.sqrt(sum((1.0 / F.col(c) for c in cells[1:]), 1.0 / F.col(cells[0]))).alias("se"))


def wald_table(betas: DataFrame) -> DataFrame:
    """(term_id, hits, beta, se, pvalue, fc, fdr)."""
    return _wald(betas)


def nb_two_groups(y: np.ndarray, e: np.ndarray, w: np.ndarray, member: np.ndarray) -> tuple[float, float, float]:
    """beta, its Wald p (one-sided, beta > 0) and alpha of a negative binomial with exposure e and one binary covariate.

    Rows stand for w equal observations. The likelihood is profiled over ln alpha by golden section; inside, the
    two group rates are solved by Newton steps.
    """
    groups = [(y[m], e[m], w[m]) for m in (member, ~member)]
    if any((g[0] * g[2]).sum() <= 0 or (g[1] * g[2]).sum() <= 0 for g in groups):
        return float("nan"), float("nan"), float("nan")

    def rate(g: tuple[np.ndarray, ...], alpha: float) -> float:
        yy, ee, ww = g
        b = np.log((yy * ww).sum() / (ee * ww).sum())
        for _ in range(60):
            mu = ee * np.exp(b)
            score = (ww * (yy - mu) / (1 + alpha * mu)).sum()
            info = (ww * mu * (1 + alpha * yy) / (1 + alpha * mu) ** 2).sum()
            step = np.clip(score / max(info, 1e-300), -2, 2)
            b += step
            if abs(step) < 1e-12:
                break
        return float(b)

    def loglik(ln_alpha: float) -> float:
        alpha, total = float(np.exp(ln_alpha)), 0.0
        for g in groups:
            yy, ee, ww = g
            mu, n = ee * np.exp(rate(g, alpha)), 1 / alpha
            total += float((ww * (log_gamma(yy + n) - log_gamma(np.full_like(yy, n)) - log_gamma(yy + 1) - n * np.log1p(alpha * mu) + yy * (np.log(mu) - np.log(n + mu)))).sum())
        return total

    low, high, ratio = -12.0, 8.0, (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loglik(a), loglik(b)
    for _ in range(45):
        if fa > fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loglik(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loglik(b)
    alpha = float(np.exp((low + high) / 2))
    rates = [rate(g, alpha) for g in groups]
    variance = sum(1 / (ww * ee * np.exp(r) / (1 + alpha * ee * np.exp(r))).sum() for (yy, ee, ww), r in zip(groups, rates, strict=True))
    beta = rates[0] - rates[1]
    return beta, max(float(normal_sf(np.array([beta / np.sqrt(variance)]))[0]), 1e-320), alpha


def nb_enrichment(genes: DataFrame, membership: DataFrame, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
    """(term_id, hits, beta, pvalue, fc, alpha, fdr) by negative binomial regression for each term.

    Genes with equal hits and expectation are one weighted row. The table of those, the same for every term, is
    broadcast: its size follows the number of genes of an annotation, which is checked.
    """
    table = genes.groupBy("observed", "expected").agg(F.count("*").alias("w")).limit(1_000_001).toPandas()
    if len(table) > 1_000_000:
        raise ValueError("over a million different genes")
    shared = genes.sparkSession.sparkContext.broadcast((table["observed"].to_numpy(float), table["expected"].to_numpy(float), table["w"].to_numpy(float)))
    inside = membership.select("term_id", "gene").distinct().join(term_sizes(genes, membership, min_genes, max_genes), "term_id").join(genes, "gene")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, e, w = shared.value
        own = pdf.groupby(["observed", "expected"]).size().reset_index(name="w")
        rest = pd.DataFrame({"observed": y, "expected": e, "w": w}).merge(own, on=["observed", "expected"], how="left", suffixes=("", "_in"))
        rest["w"] -= rest["w_in"].fillna(0)
        rest = rest[rest["w"] > 0]
        both = pd.concat([own.assign(m=True), rest[["observed", "expected", "w"]].assign(m=False)])
        beta, p, alpha = nb_two_groups(both["observed"].to_numpy(float), both["expected"].to_numpy(float), both["w"].to_numpy(float), both["m"].to_numpy(bool))
        return pd.DataFrame({"term_id": [pdf["term_id"].iloc[0]], "hits": [int(pdf["hits"].iloc[0])], "beta": [beta], "pvalue": [p], "fc": [np.exp(beta)], "alpha": [alpha]})

    fits = inside.groupBy("term_id").applyInPandas(fit, "term_id string, hits long, beta double, pvalue double, fc double, alpha double")  # max_genes rows a term
    return bh_fdr(fits.where(~F.isnan("pvalue")), "pvalue", "fdr")


def genes_for_term(term: DataFrame, enriched: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows of enriched (gene, fdr, ...) under alpha that belong to a term (term_id, gene)."""
    return enriched.where(F.col("fdr") < alpha).join(term.select("gene").distinct(), "gene", "left_semi")


def combine_p(ps: Iterator[float]) -> list[float]:
    """Running combination of p-values: 1 - (1 - p_before)(1 - p)."""
    out: list[float] = []
    for p in ps:
        out.append(1 - (1 - (out[-1] if out else 0.0)) * (1 - p))
    return out
