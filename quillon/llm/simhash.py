"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into 2 segments of 32 bits. If two fingerprints differ in at most 2 bits (3,
even), one segment differs in at most 1; so that segment is equal, or equal once one bit is deleted. Each
distinct fingerprint is indexed under its 2 segments and their 64 one-wildcard variants; fingerprints that
meet under a key are verified. A key that very many distinct fingerprints share is split exactly by the
other segment's halves, so no key gathers an unbounded number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_schema, gather, keep_first, materialize, scatter, steps, text_hash, tidy
from .components import connected_components, forest

_U = np.uint64
LOW = _U(0xFFFFFFFF)
#: Distinct fingerprints under one segment value from which its keys are split.
HOT = 1024
#: Pairs that a task holds before it contracts them.
HELD = 500_000
#: Fingerprints whose signatures a task deals out at a time.
EMITTED = 10_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        h = np.array([one(line[s:e], seed) for s, e in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)], _U)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, h long, fp long) for every row: its key, text_hash and fingerprint, 64 bits as a signed number; a null text is one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "t"):
                fps = [0 if t is None else fingerprint(t.encode(), shingle, seed) for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(np.array(fps, _U).view(np.int64))], names=["k", "h", "fp"])

    plain = docs.select(F.col(f"`{key}`").alias("k"), text_hash(text).alias("h"), F.col(f"`{text}`").alias("t"))
    return plain.mapInArrow(tidy(run), f"k {docs.schema[key].dataType.simpleString()}, h long, fp long")


def _key(segment: int, pos: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    return _U(segment) << _U(40) | np.asarray(pos, _U) << _U(32) | value


def keys_of(fp: np.ndarray, hot: np.ndarray, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of fp) of every signature. hot: sorted keys that are split by the other segment."""
    found, rows = [], []
    every = np.arange(len(fp))
    for s in (0, 1):
        mine, other = (fp >> _U(32 * s)) & LOW, (fp >> _U(32 * (1 - s))) & LOW
        for pos in range(33):  # 32: no bit deleted
            key = _key(s, pos, mine if pos == 32 else mine & ~(_U(1) << _U(pos)))
            if not len(hot):
                found.append(key)
                rows.append(every)
                continue
            split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            found.append(key[~split])
            rows.append(every[~split])
            which = every[split]
            if not len(which):
                continue
            for half in (0, 1):
                part = (other[which] >> _U(16 * half)) & _U(0xFFFF)
                for sub in range(17) if pos == 32 or distance > 2 else (16,):  # 16: no bit deleted; one bit spent and one left, some half is equal
                    mark = part if sub == 16 else part & ~(_U(1) << _U(sub))
                    found.append((_U(1) << _U(63)) | (key[which] * _U(0x9E3779B97F4A7C15) + (mark << _U(8) | _U(half << 7 | sub)) * _U(0xC2B2AE3D27D4EB4F)) >> _U(1))
                    rows.append(which)
    return np.concatenate(found), np.concatenate(rows)


def _near(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges over all pairs of fingerprints that share a key and differ in at most `distance` bits."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    end = last[np.searchsorted(last, np.arange(len(key)))]
    a, b, held = [], [], 0
    live, gap = np.flatnonzero(end > np.arange(len(key))), 1
    while len(live):
        near = np.bitwise_count(fp[live] ^ fp[live + gap]) <= distance
        if near.any():
            a.append(fp[live[near]])
            b.append(fp[live[near] + gap])
            held += int(near.sum())
            if held > HELD:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        gap += 1
        live = live[end[live] >= live + gap]
    if not a:
        return np.zeros(0, _U), np.zeros(0, _U)
    return forest(np.concatenate(a), np.concatenate(b))


def near_edges(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a long, b long) that connect all fingerprints of `distinct` (fp long) within `distance` <= 3 bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments cover a distance of 3 at most")
    n = distinct.count()
    spark, least = distinct.sparkSession, max(HOT, n // 100_000)
    crowded = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")), F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("v")))).alias("x")).groupBy("x.s", "x.v").count().where(F.col("count") > least)
    hot: list[np.ndarray] = [np.zeros(0, _U)]
    for row in crowded.collect():  # at most 2 n / least, so under 200,000 rows at any size
        v = np.array([row["v"]], np.int64).view(_U)
        pos = np.arange(33)
        hot.append(_key(row["s"], pos, np.where(pos == 32, v, v & ~(_U(1) << np.minimum(pos, 31).astype(_U)))))
    split = spark.sparkContext.broadcast(np.unique(np.concatenate(hot)))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * 66 // 4_000_000 + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(held)
            key, row = keys_of(fp, split.value, distance)
            bucket = ((key * _U(0xD6E8FEB86659FD93)) >> _U(33)).astype(np.int64) % width
            yield from scatter(bucket, width, {"key": key, "fp": fp[row]})

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(_U))
            size += batch.num_rows
            if size >= EMITTED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in gather(batches, {"key": "u8", "fp": "u8"}).values():
            a, b = _near(cols["key"], cols["fp"], distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return distinct.mapInArrow(tidy(emit), blob_schema(["key", "fp"])).repartitionById(width, F.col("bucket")).mapInArrow(tidy(meet), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits. Texts are lower-cased (A-Z only) and cut into words at white space;
    a bit is set if it is in over half the XXH64 of the shingles, repeats included. Fewer words than a shingle:
    the whole sequence is one; none, or a null text: fingerprint zero, linked like any other. component_id: the
    least key reachable over links of at most `distance` bits, the row's own included; null keys have no part in
    that minimum. Repeated rows and keys are rows of their own; an empty table gives an empty one. Equal
    fingerprints are one node, so groups of copies of any size cost one.
    """
    return _grouped(docs, shingle, distance, seed, text, key).select(F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def _grouped(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, h, fp, component, first) of every row: the least fingerprint and the least key of its group."""
    fps = materialize(fingerprints(docs, shingle, seed, text, key), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("k").alias("least")), "distinct")
    roots = connected_components(near_edges(distinct.select("fp"), distance))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("first")), "component").select("fp", "component", "first")
    return fps.join(named, "fp").select("k", "h", "fp", "component", "first")


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs with one document left of each group; columns stay as they are, whatever their names.

    The one with the least key stays; of several rows with that key the one with the least hash of its text, once. Texts
    of one key that are not near each other are groups of their own. Rows with a null key have no part in the choice and all stay.
    """
    return keep_first(docs, _grouped(docs, **settings), settings.get("text", "text"), settings.get("key", "doc_id"))
