"""Token pieces of documents, as both packers take them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import steps, tidy
from .encoding import ENCODE_BYTES


def document_tokens(model: bpe.Bpe, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and then `end`, flat, and each text's start (one more at the end)."""
    ids, off = model.encode(column)
    out = np.insert(ids, off[1:], end).astype(np.int32)
    return out, off + np.arange(len(off))


def cuts(off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every piece of at most `most` tokens: its text's row, its number in the text, its length."""
    lens = np.diff(off)
    n = -(-lens // most)
    row = np.repeat(np.arange(len(lens)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, piece, np.minimum(lens[row] - piece * most, most)


def token_pieces(docs: DataFrame, vocabulary: str, most: int = 2048, end: int = 0, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long[, ids binary]) of every document.

    A document is its ids followed by `end`; only longer ones than `most` are cut, into pieces of `most` tokens
    and a last one that may be shorter. start: the document's ids before the piece. ids: little-endian unsigned
    32-bit. A null or empty text is `end` alone; every row, repeated ones too, gives its pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)  # chunks it has met in earlier tasks are known
        for batch in batches:
            for b in steps(batch, text, ENCODE_BYTES):
                ids, off = document_tokens(model, b.column(text), end)
                row, piece, length = cuts(off, most)
                at = off[row] + piece * most
                raw = memoryview(ids.astype("<u4").tobytes())
                parts = [raw[4 * s : 4 * e] for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [b.column(key).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * most), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(key, text).mapInArrow(tidy(run, hold=True), f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
