"""Best-fit packing by the configuration linear program.

The program has a variable for each way to fill one sequence (a configuration) and a row for each length;
it sees only the histogram of lengths, so its size does not grow with the corpus. Multiplicative weights
solve it: a length is the dearer the more of its demand is open, a knapsack dynamic program prices the
configurations, and those worth most are used until every length is covered. Weights are rounded down to whole
sequences; what that leaves, and a small share of the sequences that go last, best fit places. Executors then give
each piece its place by its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import token_pieces

#: Pieces of one length that one salt numbers, about.
RANKED = 5_000
#: The share of the program's sequences, and their number, that best fit gets back at most, besides what rounding leaves.
RETURNED = (0.045, 2_000)


def _knapsack(lens: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """The most worth that fits in 0..room, lengths ascending."""
    best = np.zeros(room + 1)
    fits = np.searchsorted(lens, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = fits[c]
        best[c] = max(best[c - 1], (best[c - lens[:k]] + worth[:k]).max()) if k else best[c - 1]
    return best


def fractional(lens: np.ndarray, counts: np.ndarray, room: int, share: float = 0.34, rate: float = 0.1, slack: float = 0.5, loose: float = 0.05) -> list[tuple[tuple[int, ...], float]]:
    """A fractional solution that covers every length's count exactly: (configuration, how often), ascending indices into lens (ascending), in the order found.

    In each round a length is worth itself times exp(rate x its open share), and of every length at most `share` of the
    count (one piece, if that is more) is used. Steps are whole, so small counts lose nothing to rounding. A round
    starts a configuration with each open length, longest first, and fills it along the knapsack's table with the longest
    length that is within `loose` of the best: short ones fill up best at the end. A configuration whose worth falls
    behind the table's by more than `slack` waits for the next round and its prices.
    """
    need = counts.astype(float)
    left = need.copy()
    use: list[tuple[tuple[int, ...], float]] = []
    fits = np.searchsorted(lens, np.arange(room + 1), side="right")
    while (left > 0).any():
        price = np.where(left > 0, np.exp(rate * np.ceil(left / need / share - 1e-9) * share), 0.0)
        worth = lens * price
        best = _knapsack(lens, worth, room)
        cap = np.minimum(left, np.maximum(1.0, np.floor(share * need)))
        made = 0
        for lead in np.flatnonzero(left > 0)[::-1].tolist():
            aim = worth[lead] + best[room - lens[lead]]
            while cap[lead] > 0:
                config, c, got = [lead], room - int(lens[lead]), worth[lead]
                while k := fits[c]:
                    value = best[c - lens[:k]] + worth[:k]
                    value[cap[:k] < 1] = -1.0
                    for i in set(config):  # no more of a length than there are
                        if i < k and cap[i] < config.count(i) + 1:
                            value[i] = -1.0
                    top = value.max()
                    if top <= 0:
                        break
                    j = k - 1 - int((value[::-1] >= max(top - loose * best[room], 1e-9)).argmax())
                    config.append(j)
                    got, c = got + worth[j], c - int(lens[j])
                if got < aim * (1 - slack) and made:  # the first of a round always goes on, so rounds end
                    break
                kinds, times = np.unique(config, return_counts=True)
                step = float((cap[kinds] // times).min())
                use.append((tuple(sorted(config)), step))
                left[kinds] -= step * times
                cap[kinds] -= step * times
                made += 1
    return use


def best_fit_decreasing(lens: list[int], room: int) -> list[list[int]]:
    """Bins of lengths: each length, longest first, into the fullest bin that still has room for it."""
    free: list[int] = []  # rooms that some bin has, ascending
    at: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for x in sorted(lens, reverse=True):
        k = bisect_left(free, x)
        if k < len(free):
            left = free[k]
            which = at[left].pop()
            if not at[left]:
                del at[left]
                free.pop(k)
        else:
            left, which = room, len(bins)
            bins.append([])
        bins[which].append(x)
        if left - x not in at:
            at[left - x] = []
            insort(free, left - x)
        at[left - x].append(which)
    return bins


def plan(lens: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) for a histogram; every piece has its place exactly once."""
    by_program, by_best_fit = solve(lens, counts, room)
    return by_program + by_best_fit


def solve(lens: np.ndarray, counts: np.ndarray, room: int) -> tuple[list[tuple[list[int], int]], list[tuple[list[int], int]]]:
    """Sequences that the program's solution gives, rounded down, and those that best fit makes of the rest.

    Best fit also gets back the sequences that the program leaves most room in, and then those it found last, up to a
    bounded share: short pieces that are left fill up what is odd. Of a few shares the one with the fewest sequences stays.
    """
    order = np.argsort(lens)
    lens, counts = np.asarray(lens, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(lens):
        return [], []
    whole, on = np.flatnonzero(lens == room), np.flatnonzero(lens < room)
    use: dict[tuple[int, ...], float] = {}
    for config, often in fractional(lens[on], counts[on], room) if len(on) else []:
        use[config] = use.get(config, 0.0) + often
    rounded = [(lens[on[list(c)]], int(x + 1e-6)) for c, x in use.items()]
    rounded = sorted((x for x in rounded if x[1]), key=lambda x: room - int(x[0].sum()))  # stable: of equals the first found come first
    total, kept = sum(n for _, n in rounded), None
    for back in (0.0, 0.1, 0.2, 0.4, 0.7, 1.0):
        stay, out, left = total - int(min(back * RETURNED[0] * total, back * RETURNED[1])), [], counts.copy()
        left[whole] = 0
        for config, n in rounded:
            n = min(n, stay)
            if n:
                out.append((config.tolist(), n))
                stay -= n
                kinds, times = np.unique(config, return_counts=True)
                left[np.searchsorted(lens, kinds)] -= n * times
        rest = [(b, 1) for b in best_fit_decreasing(np.repeat(lens, left).tolist(), room)]
        if kept is None or sum(n for _, n in out) + len(rest) < kept[0]:
            kept = (sum(n for _, n in out) + len(rest), out, rest)
    return [([room], int(counts[i])) for i in whole] + kept[1], kept[2]


def _layout(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Of each (length, sequences alike): the first rank it serves, its places a sequence, first sequence, first offset."""
    rows, served, sequence = [], {}, 0
    for config, n in bins:
        offset = 0
        for length, times in zip(*np.unique(np.array(config, np.int64), return_counts=True), strict=True):
            length, times = int(length), int(times)
            first = served.get(length, 0)
            rows.append((length << 44 | first, first, times, sequence, offset, length))
            served[length] = first + times * n
            offset += times * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("code", "first", "times", "sequence", "offset", "length"), table.T, strict=True))


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end: int = 0, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece of token_pieces() with its place: sequence_id and offset (long), gapless from 0 in each sequence.

    All documents are packed: null and empty texts are one token, repeated rows are packed as often as they
    are there, documents over `most` tokens are cut. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, most, end, with_ids, text, key), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `most` rows
    lens, counts = np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64)
    layout = spark.sparkContext.broadcast(_layout(plan(lens, counts, most)))
    salts = max(1, int(counts.sum()) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")) - 1).join(before, ["length", "salt"])
    columns = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = layout.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            row = np.searchsorted(t["code"], length << 44 | rank, side="right") - 1
            nth = rank - t["first"][row]
            sequence = t["sequence"][row] + nth // t["times"][row]
            offset = t["offset"][row] + nth % t["times"][row] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, (F.col("before") + F.col("nth")).cast("long").alias("rank")).mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")
