"""Approximate nearest neighbours by collision counting.

Every block of vectors keeps, for each of a few projections, its vectors sorted by their projection. A query opens a
window around its own projection in every array. The windows widen by virtual rehashing: the same arrays serve every
width. A vector that collides with the query in enough arrays is verified at its exact distance. A query ends in a block
once its window is so wide against its k-th verified distance that nearer vectors would have collided by now.

Projections are the axes of random rotations: those of one rotation share out a distance without loss, so counts tell
near from far better than those of independent directions (the README has figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of one block, and queries that are sent to the executors at a time.
BLOCK, QUERIES = 32_768, 50_000


@dataclass
class Settings:
    """projections: arrays of a block, at most 255; threshold: share of them that must collide; growth: of the window, by
    round; margin: the window over the k-th distance at which a query ends."""

    projections: int = 96
    threshold: float = 0.735
    growth: float = 1.2
    margin: float = 1.2
    seed: int = 11

    def __post_init__(self) -> None:
        if not 1 <= self.projections <= 255:
            raise ValueError("projections must lie in 1..255: collisions are counted in a byte")


def rotations(d: int, projections: int, seed: int) -> np.ndarray:
    """Axes (columns) of random rotations of d dimensions, so long that a distance r has projections of mean square r^2."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(-(-projections // d)):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        found.append(q * np.sign(np.diag(r)) * np.sqrt(d))
    return np.concatenate(found, axis=1)[:, :projections]


class Block:
    """The sorted arrays of at most 65,535 vectors of one length."""

    #: Ranks that are compared with a window at a time.
    AT_ONCE = 1 << 16

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: Settings) -> None:
        self.ids, self.vectors, self.settings = ids, vectors.astype(np.float64), settings
        self.axes = rotations(vectors.shape[1], settings.projections, settings.seed)
        at = (self.vectors @ self.axes).T
        order = np.argsort(at, axis=1, kind="stable")
        self.rank = np.empty(at.shape, np.uint16)  # of each vector in each sorted array
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        ordered = np.take_along_axis(at, order, axis=1)
        # all sorted arrays end to end, moved apart, so that one binary search finds every window
        self.apart = 4 * (np.abs(ordered).max(initial=0.0) + 1.0) * np.arange(len(ordered))
        self.line = (ordered + self.apart[:, None]).ravel()
        self.spread = float(np.std(ordered)) + 1e-12
        self.verified = self.rounds = 0

    def collisions(self, at: np.ndarray, width: float) -> np.ndarray:
        """In how many arrays each vector lies in the window of `width` either side of the query's projection."""
        n, reach = len(self.ids), self.apart[-1] + 1e300
        low, high = np.clip(at - width, -reach, reach), np.clip(at + width, -reach, reach)
        half = (self.apart[1] if len(self.apart) > 1 else np.inf) / 2  # a window beyond the array's own stretch ends there
        first = np.arange(len(at)) * n
        x = np.clip(np.searchsorted(self.line, np.maximum(low, -half) + self.apart, side="left") - first, 0, n)
        y = np.clip(np.searchsorted(self.line, np.minimum(high, half) + self.apart, side="right") - first, 0, n)
        counts, step = np.zeros(n, np.uint8), max(1, self.AT_ONCE // max(n, 1))
        start, size = x.astype(np.uint16)[:, None], np.maximum(y - x, 0).astype(np.uint16)[:, None]
        for j in range(0, len(at), step):  # ranks below the window's start wrap round to large ones
            counts += np.add.reduce((self.rank[j : j + step] - start[j : j + step] < size[j : j + step]).view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, distance) of up to k found for each query, without its own id."""
        s, vectors = self.settings, vectors.astype(np.float64)
        need, at = max(1, int(np.ceil(s.threshold * s.projections))), vectors @ self.axes
        rows, found, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        last = self.spread / 16
        for i in range(len(ids)):
            width, done = last / s.growth**3, np.zeros(len(self.ids), bool)  # queries of a block end at like widths
            got, dist = np.zeros(0, np.int64), np.zeros(0)
            while True:
                new = np.flatnonzero((self.collisions(at[i], width) >= need) & ~done)
                self.rounds += 1
                if len(new):
                    done[new] = True
                    self.verified += len(new)
                    new = new[self.ids[new] != ids[i]]
                    got, dist = np.concatenate([got, self.ids[new]]), np.concatenate([dist, np.sqrt(np.square(self.vectors[new] - vectors[i]).sum(1))])
                    best = np.lexsort((got, dist))[:k]
                    got, dist = got[best], dist[best]
                enough = s.margin * dist[-1] if len(got) == k else np.inf
                if width >= enough or done.all():
                    break
                width = min(width * s.growth, enough)
            last = width
            rows.append(np.full(len(got), i))
            found.append(got)
            scores.append(dist)
        return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.concatenate(found), np.concatenate(scores)


def usable(vector: str) -> F.Column:
    """Vectors that take part: no null, none null or not finite inside, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, settings: Settings | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of every row that is a query, among all other rows.

    Euclidean distance in double precision, nearest first, ties to the smaller key; all candidates if there are
    fewer than k. Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows with a
    null key. Vectors of different lengths are no candidates of each other, as they have no distance. Rows that repeat a
    key are candidates of their own, but none is a neighbour of a query with that key. No vectors or no queries give no rows.
    """
    settings = settings or Settings()
    spark = vectors.sparkSession
    valid = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    schema = "query_id long, id long, score double"
    parts: list[DataFrame] = []
    blocks = -(-valid.where("q").count() // QUERIES)
    for i in range(blocks):  # one block of queries against all vectors at a time
        some = valid.where(F.col("q") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).select("id", "v").toArrow()
        asked = spark.sparkContext.broadcast(_by_length(some.column("id"), some.column("v")))
        part = valid.select("id", "v").mapInArrow(_searcher(asked, k, settings), schema)
        parts.append(part if blocks == 1 else materialize(part, "nearest"))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.union(p)
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _by_length(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    ids, column = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, column))
    size, out = pc.list_value_length(column).to_numpy(zero_copy_only=False), {}
    for d in np.unique(size).tolist():
        some = column.filter(pa.array(size == d)) if (size != d).any() else column
        out[d] = ids.to_numpy()[size == d], some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return out


def _searcher(asked, k: int, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(d: int) -> Iterator[pa.RecordBatch]:
            block = Block(*(np.concatenate(x) for x in zip(*held.pop(d), strict=True)), settings)
            ids, vectors = asked.value[d]
            for i in range(0, len(ids), 1024):
                row, found, score = block.search(ids[i : i + 1024], vectors[i : i + 1024], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1024][row]), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                for d, (ids, vectors) in _by_length(part.column("id"), part.column("v")).items():
                    if d not in asked.value:
                        continue
                    if sum(len(x) for x, _ in held.get(d, [])) + len(ids) > BLOCK:
                        yield from flush(d)
                    held.setdefault(d, []).append((ids, vectors))
        for d in list(held):
            yield from flush(d)

    return run
