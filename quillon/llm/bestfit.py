"""Best-fit-decreasing packing of token ids into id matrices.

Each task packs the documents it reads, a bounded pool of tokens at a time, so no token crosses the network.
Pieces go longest first into the sequence with the least room that still holds them; a segment tree over
room sizes finds it in a number of steps that depends on the sequence length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import id_column, ids_of, ragged, steps, tidy
from .encoding import ENCODE_BYTES
from .tokens import cuts, document_tokens

#: Tokens that a task packs at a time.
POOL = 4_000_000


class RoomTree:
    """Open sequences by room, in a segment tree over room sizes."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def put(self, room: int, which: int) -> None:
        self.at.setdefault(room, []).append(which)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the least room of at least `least`."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def place(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every piece, and how many sequences there are."""
    tree, sequences = RoomTree(most), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            got, sequences = (most, sequences), sequences + 1
        sequence[i], offset[i] = got[1], most - got[0]
        tree.put(got[0] - n, got[1])
    return sequence, offset, sequences


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end: int = 0, pad: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per packed sequence: shard int, sequence long, n_tokens int, ids binary, cu_seqlens array<int>,
    positions binary, docs array<long>, pieces array<int>.

    ids: `most` little-endian unsigned 32-bit ids, the row of the id matrix, filled up with `pad`. cu_seqlens:
    0 and the end of each segment. positions: `most` little-endian unsigned 32-bit positions that start again
    at 0 in each segment and in the padding. docs, pieces: the document and piece of each segment; pieces of
    one document joined in order are its ids and `end`, nothing lost. (shard, sequence) tells sequences apart;
    shard is the task's number. Null or empty texts are `end` alone, repeated rows are packed each; a null key
    stays null; an empty table gives an empty one. A task packs about POOL tokens at a time, so which documents share a
    sequence follows from how the input is split. The key is an integer column, else TypeError.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)  # chunks it has met in earlier tasks are known
        context = TaskContext.get()
        shard, made = context.partitionId() if context else 0, 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, key_of, piece, length = (np.concatenate(x) for x in zip(*held, strict=True))
            start = np.cumsum(length) - length
            sequence, offset, n = place(length, most)
            ids = np.full(n * most, pad, "<u4")
            order = np.lexsort((offset, sequence))
            used = np.bincount(sequence, length, n).astype(np.int64)
            to = ragged(sequence * most + offset, length)
            ids[to] = tokens[ragged(start, length)]
            positions = np.arange(n * most, dtype=np.int64) - np.repeat(np.arange(n) * most + used, most)  # in the padding
            positions[to] = ragged(np.zeros(len(length), np.int64), length)
            positions = positions.astype("<u4")
            bounds = np.searchsorted(sequence[order], np.arange(n + 1))
            ends = (offset + length)[order]
            cu = [[0, *ends[bounds[s] : bounds[s + 1]].tolist()] for s in range(n)]
            lists = pa.array(bounds.astype(np.int32))
            raw, pos = ids.reshape(n, most), positions.reshape(n, most)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(made, made + n)), pa.array(used.astype(np.int32)),
                    pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array([x.tobytes() for x in pos], pa.binary()),
                    pa.ListArray.from_arrays(lists, id_column(key_of[order])), pa.ListArray.from_arrays(lists, pa.array(piece[order].astype(np.int32))),
                ],
                names=["shard", "sequence", "n_tokens", "ids", "cu_seqlens", "positions", "docs", "pieces"],
            )

        for batch in batches:
            for b in steps(batch, text, ENCODE_BYTES):
                tokens, off = document_tokens(model, b.column(text), end)
                row, piece, length = cuts(off, most)
                held.append((tokens, ids_of(b.column(key))[row], piece, length))
                size += len(tokens)
                if size >= POOL:
                    out = flush()
                    yield out
                    made, held, size = made + out.num_rows, [], 0
        if size:
            yield flush()

    return docs.select(key, text).mapInArrow(tidy(run, hold=True), "shard int, sequence long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, docs array<long>, pieces array<int>")


def write(packed: DataFrame, path: str) -> None:
    """Save packed sequences as Parquet, through Spark's writer, so to any store that Spark reaches."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc long, ids array<int>) of every document of packed sequences; inverse of pack() where keys are unique."""
    from pyspark.sql import functions as F

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, cu, docs, pieces in zip(*(b.column(c).to_pylist() for c in ("ids", "cu_seqlens", "docs", "pieces")), strict=True):
                row = np.frombuffer(ids, "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array([row[s:e] for s, e in zip(cu, cu[1:], strict=False)], pa.list_(pa.int32()))], names=["doc", "piece", "ids"])

    parts = packed.select("ids", "cu_seqlens", "docs", "pieces").mapInArrow(tidy(cut), "doc long, piece int, ids array<int>")
    return parts.groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
