"""Encoding and decoding of whole texts by a byte-level BPE vocabulary (see bpe.py for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import ragged, steps, tidy

#: Text bytes that are encoded at a time.
ENCODE_BYTES = 3 << 20


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) for every row of docs.

    ids are those of the tokenizers library's encode(add_special_tokens=False), without truncation or padding;
    decoded is its decode(ids, skip_special_tokens=False). A null text encodes as the empty one, to no ids and
    an empty string. Rows that repeat give rows that repeat; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)  # chunks it has met in earlier tasks are known
        for batch in batches:
            for b in steps(batch, text, ENCODE_BYTES):
                ids, off = model.encode(b.column(text))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))
                decoded = pa.array([x.decode("utf-8", "replace") for x in _decoded(model, ids, off)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(key), lists, decoded], names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(tidy(run, hold=True), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row of docs, without the ids leaving the worker.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. Nulls as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)  # chunks it has met in earlier tasks are known
        digits = [b"%d," % i for i in range(len(model.text))]
        lens = np.array([len(x) for x in digits], np.int64)
        at, blob = np.cumsum(lens) - lens, np.frombuffer(b"".join(digits), np.uint8)
        for batch in batches:
            for b in steps(batch, text, ENCODE_BYTES):
                ids, off = model.encode(b.column(text))
                size = lens[ids]
                line = blob[ragged(at[ids], size)].tobytes()
                cut = np.concatenate([[0], np.cumsum(size)])[off]
                spelled = [hashlib.sha256(line[s : max(s, e - 1)]).hexdigest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                decoded = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in _decoded(model, ids, off)]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(off)), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(tidy(run, hold=True), f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decoded(model: bpe.Bpe, ids: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
    """Bytes of each text's tokens."""
    whole = model.decode(ids)
    cut = np.concatenate([[0], np.cumsum(model.lens[ids])])[off]
    return (whole[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
