"""Genes, their regulatory domains, and counts of intervals in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_pairs


def drop_repeated(genes: DataFrame, name: str = "gene") -> DataFrame:
    """Genes whose name occurs once: of a repeated name no copy stays."""
    once = genes.groupBy(name).agg(F.count("*").alias("n")).where("n = 1").select(name)
    return genes.join(once, name, "left_semi")


def regulatory_domains(genes: DataFrame, sizes: DataFrame, upstream: int = 5000, downstream: int = 1000, distal: int = 1_000_000) -> DataFrame:
    """genes (chrom, start, end, strand, gene, ord) with their domains as start and end.

    A basal domain reaches `upstream` before and `downstream` after the start of transcription; it extends to the
    neighbours' basal domains, at most by `distal`, and stays within the chromosome. Neighbours are by basal start,
    ties by ord. Any strand but + counts as -. Chromosomes without a size are left out.
    """
    plus = F.col("strand") == "+"
    basal = genes.select("chrom", "strand", "gene", "ord", F.when(plus, F.col("start") - upstream).otherwise(F.col("end") - downstream).alias("b0"), F.when(plus, F.col("start") + downstream).otherwise(F.col("end") + upstream).alias("b1"))
    order = Window.partitionBy("chrom").orderBy("b0", "ord")  # genes of a chromosome: thousands, whatever the data
    known = basal.join(sizes.select("chrom", "size"), "chrom")
    near = known.withColumn("following", F.coalesce(F.lead("b0").over(order), F.col("size"))).withColumn("previous", F.coalesce(F.lag("b1").over(order), F.lit(0)))
    start = F.least("b0", F.greatest(F.col("b0") - distal, "previous"))
    end = F.greatest("b1", F.least(F.col("b1") + distal, "following"))
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("size")).cast("long")
    return near.select("chrom", clip(start).alias("start"), clip(end).alias("end"), "strand", "gene", "ord")


def domain_fraction(domains: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gene, fraction): share of the genome in each gene's domains, each at least one base."""
    total = sizes.agg(F.sum("size").cast("double").alias("genome"))  # one row
    return domains.join(F.broadcast(total)).groupBy("gene").agg(F.sum(F.greatest((F.col("end") - F.col("start")) / F.col("genome"), 1.0 / F.col("genome"))).alias("fraction"))


def domain_hits(domains: DataFrame, background: DataFrame, query_flag: str, width: int | None = None) -> DataFrame:
    """(gene, background_hits, query_hits) in one pass: background intervals carry a boolean that says which are query.

    Genes without a background hit are absent, as nothing can be said of them.
    """
    pairs = overlap_pairs(domains.select("chrom", "start", "end", "gene"), background.select("chrom", "start", "end", query_flag), width)
    return pairs.groupBy(F.col("l_gene").alias("gene")).agg(F.count("*").alias("background_hits"), F.sum(F.col(f"r_{query_flag}").cast("int")).alias("query_hits"))


def activity(domains: DataFrame, peaks: DataFrame, counts: DataFrame, extend: int = 1000, width: int | None = None) -> DataFrame:
    """(obs_id, gene, value): counts of the peaks (chrom, start, end, var_id) near each gene, summed.

    A gene that several of domains' rows name counts a peak once for each of them that is near.
    """
    near = overlap_pairs(domains.select("chrom", "start", "end", "gene"), peaks.select("chrom", "start", "end", "var_id"), width, slack=extend)
    return near.select(F.col("l_gene").alias("gene"), F.col("r_var_id").alias("var_id")).join(counts, "var_id").groupBy("obs_id", "gene").agg(F.sum("value").alias("value"))
