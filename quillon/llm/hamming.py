"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and every distinct code is indexed under each of its segments. A round
of radius r probes all segment values at exactly r bits from the query's. After it every code within
segments * (r + 1) - 1 bits has met the query in some segment, so a query ends once its k-th verified
distance is within that; the others go on to the next radius, where nothing farther than the k-th distance
so far is taken.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def sign_code(vector: str) -> F.Column:
    """A vector's first 64 signs as a long: bit i is set where component i is over zero."""
    bits = F.transform(F.slice(F.col(vector), 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segment(code: str, s: F.Column | int, bits: int) -> F.Column:
    return F.shiftrightunsigned(F.col(code), s * bits if isinstance(s, int) else 0).bitwiseAND((1 << bits) - 1)


def search(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of codes (id long, code long) to each row of queries
    (query_id long, code long), by Hamming distance, ties to the smaller id; a row with the query's id is left out.

    All of them if there are fewer than k. Null ids and codes take no part; a repeated query counts once, ids that
    repeat with one code count once. Equal codes are indexed once, with their k + 1 least ids, which is all that
    k results can use.
    """
    if 64 % segments:
        raise ValueError("segments must divide 64")
    bits = 64 // segments
    least = Window.partitionBy("code").orderBy("id")
    rows = codes.where("id is not null and code is not null").select("id", "code")
    few = rows.groupBy("code", "id").agg(F.lit(1).alias("one")).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    distinct = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    total = distinct.agg(F.sum(F.size("ids"))).first()[0] or 0
    index = materialize(distinct.select("code", "ids", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment("code", s, bits).alias("val")) for s in range(segments)])).alias("x")).select("code", "ids", "x.seg", "x.val"), "segments")
    active = materialize(queries.where("query_id is not null and code is not null").select("query_id", F.col("code").alias("asked"), F.lit(None).cast("int").alias("bound")).distinct(), "queries")
    found = ended = None
    top = Window.partitionBy("query_id").orderBy("distance", "id")
    for r in range(bits + 1):
        masks = F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(bits), r))), ",").cast("array<bigint>")
        probes = active.select("query_id", "asked", "bound", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment("asked", s, bits).alias("own")) for s in range(segments)])).alias("x")).select("query_id", "asked", "bound", "x.seg", "x.own")
        probes = probes.withColumn("mask", F.explode(masks))
        met = probes.select("query_id", "asked", "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val")).join(index.hint("merge"), ["seg", "val"])  # masks multiply the probes, which sizes do not foretell: no side is broadcast
        gap = F.col("asked").bitwiseXOR(F.col("code"))
        # a code is taken where it is met first: no segment before is within r, none after within r - 1
        # and only if it is no farther than the k-th found so far
        first = F.coalesce(F.bit_count(gap) <= F.col("bound"), F.lit(True))
        for s in range(segments):
            near = F.bit_count(F.shiftrightunsigned(gap, s * bits).bitwiseAND((1 << bits) - 1))
            first &= F.when(F.col("seg") > s, near > r).when(F.col("seg") < s, near >= r).otherwise(F.lit(True))
        new = met.where(first).select("query_id", F.bit_count(gap).cast("int").alias("distance"), F.explode("ids").alias("id")).where("id <> query_id")
        every = new if found is None else found.union(new)
        found = materialize(every.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k).drop("nth"), "found", over=[found])
        covered = segments * (r + 1) - 1
        state = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        over = (F.col("n") >= k) & (F.col("far") <= covered) | (F.col("n") >= max(total - 1, 0)) | F.lit(r == bits)
        finished = state.where(over).select("query_id")
        part = found.join(finished, "query_id", "left_semi")
        ended = materialize(part if ended is None else ended.union(part), "ended", over=[ended])
        bounds = state.where(F.col("n") >= k).select("query_id", F.col("far").alias("bound"))
        active = materialize(active.drop("bound").join(finished, "query_id", "left_anti").join(bounds, "query_id", "left"), "queries", over=[active])
        found = materialize(found.join(finished, "query_id", "left_anti"), "found", over=[found])
        if active.isEmpty():
            break
    return ended.withColumn("rank", F.row_number().over(top)).select("query_id", "rank", "id", "distance")

