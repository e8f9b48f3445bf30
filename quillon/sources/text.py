"""Text formats as DataFrames: all read by Spark's own readers, so from any store it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CountMatrix
from ..operators.consensus import reads_per_region


def _columns(spark: SparkSession, path: str | list[str], names: list[str], comment: str = "#") -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.length("value") > 0))
    parts = F.split("value", "\t")
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) from name, tab, length."""
    return _columns(spark, path, ["chrom", "size"]).select("chrom", F.col("size").cast("long").alias("size"))


def attribute(name: str, attributes: Column) -> Column:
    """One attribute of a GTF line, or null."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{name}\s+"?([^";]*)"?', 1)
    return F.when(found != "", found)


def gtf_genes(spark: SparkSession, path: str, name: str = "gene_name", biotype: str | None = None) -> DataFrame:
    """(chrom, start, end, strand, gene, biotype, ord): gene lines; starts become 0-based; ord is the order in the file."""
    t = _columns(spark, path, ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]).where("feature = 'gene'")
    genes = t.select("chrom", (F.col("start").cast("long") - 1).alias("start"), F.col("end").cast("long").alias("end"), "strand", attribute(name, F.col("attributes")).alias("gene"), attribute("gene_type", F.col("attributes")).alias("biotype"), F.monotonically_increasing_id().alias("ord"))
    return genes if biotype in (None, "all") else genes.where(F.col("biotype") == biotype)


def gmt(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """terms (term_id, term_name) and membership (term_id, gene) of one or several files; of a term's names the last file's stays."""
    paths = [path] if isinstance(path, str) else path
    parts = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).where(F.length("value") > 0).select(F.lit(i).alias("file"), F.split("value", "\t").alias("f"))
        parts = one if parts is None else parts.union(one)
    terms = parts.select(F.col("f")[0].alias("term_id"), F.struct("file", F.col("f")[1].alias("n")).alias("x")).groupBy("term_id").agg(F.max("x")["n"].alias("term_name"))
    members = parts.select(F.col("f")[0].alias("term_id"), F.explode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("gene")).where("gene <> ''").distinct()
    return terms, members


def regulatory_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, gene): domains given in a file."""
    return _columns(spark, path, ["chrom", "start", "end", "gene"]).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "gene")


def peaks(spark: SparkSession, paths: list[str], kind: str = "narrowPeak") -> DataFrame:
    """(file, chrom, start, end, strand, score, summit): summit from narrowPeak's offset or bed's column 7."""
    if kind not in ("narrowPeak", "bed"):
        raise TypeError(f"unknown peak format {kind!r}")
    out = None
    for i, p in enumerate(paths):
        t = _columns(spark, p, [f"c{j}" for j in range(10)])
        n = lambda j: F.col(f"c{j}").cast("long")
        summit = n(1) + n(9) if kind == "narrowPeak" else n(6)
        one = t.select(F.lit(i).alias("file"), F.col("c0").alias("chrom"), n(1).alias("start"), n(2).alias("end"), F.col("c5").alias("strand"), F.col("c4").cast("double").alias("score"), summit.alias("summit"))
        out = one if out is None else out.unionByName(one)
    return out


def bed_to_saf(regions: DataFrame, names: bool = False) -> DataFrame:
    """(GeneID, Chr, Start, End, Strand): strand "." where there is none; ids are names or the given order."""
    strand = F.coalesce("strand", F.lit(".")) if "strand" in regions.columns else F.lit(".")
    key = F.col("name") if names else F.col("ord").cast("string")
    return regions.select(key.alias("GeneID"), F.col("chrom").alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), strand.alias("Strand"))


def saf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, strand, name) of a SAF file."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(F.col("Chr").alias("chrom"), F.col("Start").cast("long").alias("start"), F.col("End").cast("long").alias("end"), F.col("Strand").alias("strand"), F.col("GeneID").alias("name"))


def random_regions(sizes: DataFrame, n: int = 10_000, length: int = 500, seed: int = 42) -> DataFrame:
    """(chrom, start, end, strand, name): n random places by chromosome size, named r0.. ; the same for a seed."""
    spark = sizes.sparkSession
    order = Window.orderBy("chrom")  # a row for each chromosome
    room = sizes.where(F.col("size") > length).select("chrom", (F.col("size") - length).alias("room")).withColumn("hi", F.sum("room").over(order)).withColumn("lo", F.col("hi") - F.col("room"))
    total = room.agg(F.max("hi").alias("t"))
    draws = spark.range(n).withColumn("u", F.rand(seed)).join(F.broadcast(total)).select("id", F.floor(F.col("u") * F.col("t")).alias("at"))
    return draws.join(F.broadcast(room), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("chrom", (F.col("at") - F.col("lo")).cast("long").alias("start"), (F.col("at") - F.col("lo") + length).cast("long").alias("end"), F.lit(".").alias("strand"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))


def coo_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(obs_id, var_id, value) from Parquet triples that a converter wrote."""
    return spark.read.parquet(path).select(F.col("obs_id").cast("string").alias("obs_id"), F.col("var_id").cast("string").alias("var_id"), F.col("value").cast("int").alias("value"))


def mapping_stats(assigned: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """(file, total, assigned): reads (file, status, n) by file. With controls (file, input) also signal_noise: the share
    assigned over that of the file's input, null for all if two files have one input."""
    stats = assigned.groupBy("file").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("status") == "Assigned", F.col("n")).otherwise(0)).alias("assigned"))
    if controls is None:
        return stats
    share = F.col("assigned") / F.col("total")
    own = stats.join(controls.select("file", "input"), "file")
    apart = controls.agg((F.count("input") == F.countDistinct("input")).alias("apart"))
    of_input = stats.select(F.col("file").alias("input"), share.alias("input_share"))
    return own.join(of_input, "input", "left").join(F.broadcast(apart)).select("file", "total", "assigned", F.when(F.col("apart"), share / F.col("input_share")).alias("signal_noise"))


def with_random(regions: DataFrame, random: DataFrame) -> DataFrame:
    """(chrom, start, end, var_id, is_random): regions (chrom, start, end, name) and then the random ones."""
    some = lambda df, flag: df.select("chrom", "start", "end", F.col("name").alias("var_id"), F.lit(flag).alias("is_random"))
    return some(regions, False).union(some(random, True))


def split_random(counts: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (obs_id, var_id, value) at the regions proper, and at the random ones of with_random()."""
    flagged = counts.join(regions.select("var_id", "is_random"), "var_id")
    return tuple(flagged.where(w).select("obs_id", "var_id", "value") for w in (~F.col("is_random"), F.col("is_random")))


def matrix_from_reads(reads: DataFrame, regions: DataFrame, random: DataFrame, samples: DataFrame, width: int | None = None) -> CountMatrix:
    """The annotated matrix of reads (file, chrom, start, end) over regions and random regions (chrom, start, end, name).

    samples: (obs_id, file[, input]); input names the file of a sample's control, which several may share. Counts of the
    controls become the layer "input" and, at random regions, the table "input_random"; "counts_random" has the samples'.
    """
    every = with_random(regions, random)
    found = reads_per_region(reads, every, "file", width).where("value <> 0")
    has_input = "input" in samples.columns
    counts, at_random = split_random(samples.join(found, "file").select("obs_id", "var_id", "value"), every)
    order = F.row_number().over(Window.orderBy("obs_id")) - 1  # a row for each sample
    names = regions.select(F.col("name").alias("var_id"), "chrom", "start", "end")
    tiles = names.withColumn("ord", F.monotonically_increasing_id())
    out = CountMatrix(samples.select("obs_id", order.cast("long").alias("ord")), tiles, counts, uns={"counts_random": at_random})
    if has_input:
        control = shared_inputs(samples.where(F.col("input").isNotNull()).select("obs_id", "input"), found.select(F.col("file").alias("input"), "var_id", "value"))
        out.layers["input"], out.uns["input_random"] = split_random(control, every)
    return out


def shared_inputs(samples: DataFrame, per_input: DataFrame) -> DataFrame:
    """Counts of each distinct input (input, var_id, value) handed to every sample (obs_id, input) that uses it."""
    return samples.join(per_input, "input").select("obs_id", "var_id", "value")


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated text."""
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def density_track(track: DataFrame, path: str, step: int = 5) -> None:
    """fixedStep lines, one folder for each strand, of (strand, chrom, start, values array<double>)."""
    head = F.concat(F.lit("fixedStep chrom="), F.col("chrom"), F.lit(" start="), (F.col("start") + 1).cast("string"), F.lit(f" step={step}"))
    body = F.concat_ws("\n", F.transform("values", lambda v: F.round(v, 3).cast("string")))
    track.select("strand", F.concat_ws("\n", head, body).alias("value")).write.mode("overwrite").partitionBy("strand").text(path)
