"""Repeated spans by De Bruijn compaction over word k-mers.

Every window of `window` words is an edge. Most edges occur once, so they are pruned first: two equal windows have
the same least hash among their inner `seed` -word grams (their minimiser), hence only windows whose minimiser occurs
twice anywhere can repeat. What is left meets by a 128-bit cryptographic digest of the words at its coordinate, so
equal digests are equal words; each occurrence but the first, by (doc_id, start), is linked to the coordinate of an
earlier one, its source. Edges that follow each other both in their text and in their source make a nonbranching path.
Paths compact where ends meet: the end of one piece and the start of the next have one coordinate and cancel in an
equality of (text, source diagonal, coordinate); what is left are the two ends of each path, which cut the text.
Both exchanges of edges combine in the map task first: content that repeats inside a task sends one entry, so a
passage that a third of all rows share costs one entry for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blob_schema, flat, gather, gram_hash, mix, ragged, scatter, shuffle_width, span_hash, steps, tidy, word_bounds

_U = np.uint64
SEED_WORDS = 8
#: Entries that a map task combines at a time.
COMBINE = 1_000_000


# ---------------------------------------------------------------- texts and their names

def _texts(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, list[str]]:
    """(doc long, mark long, text, extra_0 ...) and the names of the extra columns.

    (doc, mark) names a text: its key and 32 bits of its hash, which tell texts of one key apart. Rows with a null key
    have mark 0 and the text's 64-bit hash for doc, so they are as many names as texts, not one hot group.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer column: earlier copies are those with smaller keys")
    extra = [c for c in docs.columns if c not in (text, key, "n_words", "n_removed")]
    body, k = F.col(f"`{text}`"), F.col(f"`{key}`").cast("long")
    h = F.xxhash64(F.coalesce(body, F.lit("")))
    mark = F.when(k.isNull(), F.lit(0).cast("long")).otherwise(h.bitwiseAND(0xFFFFFFFF).bitwiseOR(1))
    named = docs.select(F.coalesce(k, h).alias("doc"), mark.alias("mark"), body.alias("text"), *[F.col(f"`{c}`").alias(f"extra_{i}") for i, c in enumerate(extra)])
    return named, extra


def _names(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("doc").to_numpy(), b.column("mark").to_numpy().astype(np.uint32)


def _with_lists(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """texts with the (pos, n) of their (doc, mark) as an array `found`. rows lie together by (doc, mark) already."""
    grouped = rows.groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("found"))
    grouped = grouped.select(F.col("doc").alias("of_doc"), F.col("mark").alias("of_mark"), "found").hint("shuffle_hash")
    return texts.join(grouped, (F.col("doc") == F.col("of_doc")) & (F.col("mark") == F.col("of_mark")), how).drop("of_doc", "of_mark")


def _lists(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, first position and number of every list entry."""
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    parent = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    inner = found.flatten()
    return parent, *(inner.field(i).to_numpy().astype(np.int64) for i in range(2))


# ---------------------------------------------------------------- edges

def _minimisers(column: pa.Array, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per window: its text's row, start word, place and hash of its minimiser."""
    data, off = flat(column)
    starts, ends, first = word_bounds(data, off)
    count = np.diff(first)
    have = np.maximum(count - window + 1, 0)
    at = ragged(first[:-1], have)
    row = np.repeat(np.arange(len(count)), have)
    if not len(at):
        return row, at, at, np.zeros(0, _U)
    small = gram_hash(span_hash(data, starts, ends), min(seed, window))
    span = window - min(seed, window) + 1
    low, reach = np.arange(len(small)), 1  # where the least gram is, the leftmost of equals
    while reach < span:
        skip = min(reach, span - reach)
        a, b = low[: len(low) - skip], low[skip:]
        low = np.where(small[a] <= small[b], a, b)
        reach += skip
    return row, at - first[row], low[at], small[low[at]]


def _edges(b: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Row, start word and 128-bit digest, in two halves, of every window that lies in a run of its row."""
    data, off = flat(b.column("text"))
    starts, ends, first = word_bounds(data, off)
    have = np.maximum(np.diff(first) - window + 1, 0)
    at, row = ragged(first[:-1], have), np.repeat(np.arange(b.num_rows), have)
    keep = _wanted(b.column("found"), row)
    at, row = at[keep], row[keep]
    # words with one space after each, so that a window's digest does not depend on the white space between
    size = ends - starts
    line = np.full(int(size.sum()) + len(size), 32, np.uint8)
    place = np.cumsum(size + 1) - size - 1
    line[ragged(place, size)] = data[ragged(starts, size)]
    held, stop = memoryview(line), place + size
    one = hashlib.blake2b
    raw = b"".join([one(held[s:e], digest_size=16).digest() for s, e in zip(place[at].tolist(), stop[at + window - 1].tolist(), strict=True)])
    both = np.frombuffer(raw, _U).reshape(-1, 2)
    return row, at - first[row], np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _spread(h: np.ndarray, width: int) -> np.ndarray:
    return ((h * _U(0x9E3779B97F4A7C15)) >> _U(33)).astype(np.int64) % width


class _Held:
    """Columns gathered up to a number of entries."""

    def __init__(self) -> None:
        self.cols: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, *cols: np.ndarray) -> None:
        self.cols.append(list(cols))
        self.size += len(cols[0])

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.cols, strict=True)]
        self.cols, self.size = [], 0
        return out


SINGLE, MANY, KNOWN = 0, 1, 2
_SEEDS = {"h": "u8", "doc": "i8", "mark": "u4", "pos": "i4", "n": "i4"}
_WINDOWS = {"h": "u8", "g": "u8", "doc": "i8", "mark": "u4", "pos": "i4", "n": "i4"}
_PIECE = ["doc", "mark", "pos", "n", "line"]


def _table(names: list[str], cols: list[np.ndarray]) -> pa.RecordBatch:
    """Columns as long, but for positions and numbers, which are int."""
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if c in ("pos", "n") else np.int64)) for c, x in zip(names, cols, strict=True)], names=names)


def _open_runs(texts: DataFrame, window: int, seed: int, width: int) -> DataFrame:
    """(doc, mark, pos int, n int): runs of windows whose minimiser occurs twice; others cannot repeat."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, mark, pos, n = held.take()
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(h)))
            one, some = order[at[times == 1]], h[order[at[times > 1]]]
            one.sort()
            yield from scatter(_spread(h[one], width), width, {"h": h[one], "doc": doc[one], "mark": mark[one], "pos": pos[one], "n": n[one]}, SINGLE)
            yield from scatter(_spread(some, width), width, {"h": some, "doc": None, "mark": None, "pos": None, "n": None}, MANY)
            known = np.sort(order[np.repeat(times > 1, times)])
            yield from scatter(known % width, width, {"h": None, "doc": doc[known], "mark": mark[known], "pos": pos[known], "n": n[known]}, KNOWN)

        for batch in batches:
            for b in steps(batch):
                row, pos, where, low = _minimisers(b.column("text"), window, seed)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (where[1:] != where[:-1])
                at = np.flatnonzero(new)
                doc, mark = _names(b)
                held.add(low[at], doc[row[at]], mark[row[at]], pos[at].astype(np.int32), np.diff(np.append(at, len(row))).astype(np.int32))
                if held.size >= COMBINE:
                    yield from flush()
        if held.size:
            yield from flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, _SEEDS)
        names = ["doc", "mark", "pos", "n"]
        if KNOWN in got:
            yield _table(names, [got[KNOWN][c] for c in names])
        if SINGLE in got:
            one = got[SINGLE]
            value, times = np.unique(np.concatenate([one["h"], *([got[MANY]["h"]] * 2 if MANY in got else [])]), return_counts=True)
            keep = times[np.searchsorted(value, one["h"])] > 1
            yield _table(names, [one[c][keep] for c in names])

    return texts.select("doc", "mark", "text").mapInArrow(tidy(seeds), blob_schema(_SEEDS)).repartitionById(width, F.col("bucket")).mapInArrow(tidy(shared), "doc long, mark long, pos int, n int")


def _sources(h: np.ndarray, g: np.ndarray, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the first one with its content, by null keys first, then doc, then position; and the entries that are first, each coordinate once."""
    order = np.lexsort((mark, pos, doc, mark != 0, g, h))
    h, g, doc, pos, mark = h[order], g[order], doc[order], pos[order], mark[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    first = (doc == doc[lead]) & (pos == pos[lead]) & ((mark != 0) == (mark[lead] != 0))
    source = np.empty(len(order), np.int64)
    source[order] = order[lead]
    once = first.copy()
    once[1:] &= ~(~new[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]) & (mark[1:] == mark[:-1]))
    source[order[first]] = -1
    return source, np.sort(order[once])


def _pieces(source: np.ndarray, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Entries with a source that follow each other in their text and in their source, as columns of _PIECE.

    line names a source and the distance to it: alike for all pieces of a path."""
    at = np.flatnonzero(source >= 0)
    at = at[np.lexsort((pos[at], mark[at], doc[at]))]
    d, m, p, s = doc[at], mark[at], pos[at].astype(np.int64), source[at]
    if len(at) > 1:  # rows that repeat whole
        fresh = np.append(True, (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1]))
        d, m, p, s = d[fresh], m[fresh], p[fresh], s[fresh]
    sd, sm, sp = doc[s], mark[s], pos[s].astype(np.int64)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1) | (sd[1:] != sd[:-1]) | (sm[1:] != sm[:-1]) | (sp[1:] != sp[:-1] + 1)
    i = np.flatnonzero(new)
    line = mix(mix(sd[i].view(_U) ^ (sm[i].astype(_U) << _U(32))) ^ (p[i] - sp[i]).view(_U))
    return [d[i], m[i], p[i], np.diff(np.append(i, len(d))), line.view(np.int64)]


def _linked(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc, mark, pos, n, line): the windows from word pos to pos+n-1 of a text have the words of those of an earlier source."""
    width = shuffle_width(texts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, doc, mark, pos = held.take()
            source, one = _sources(h, g, doc, mark, pos)
            d, m, p, n, line = _pieces(source, doc, mark, pos)
            yield from scatter(np.arange(len(d)) % width, width, {"h": line.view(_U), "g": None, "doc": d, "mark": m, "pos": p.astype(np.int32), "n": n.astype(np.int32)}, KNOWN)
            yield from scatter(_spread(h[one], width), width, {"h": h[one], "g": g[one], "doc": doc[one], "mark": mark[one], "pos": pos[one], "n": None}, SINGLE)

        for batch in batches:
            for b in steps(batch):
                doc, mark = _names(b)
                row, pos, h, g = _edges(b, window)
                held.add(h, g, doc[row], mark[row], pos.astype(np.int32))
                if held.size >= COMBINE:
                    yield from flush()
        if held.size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, _WINDOWS)
        if KNOWN in got:
            k = got[KNOWN]
            yield _table(_PIECE, [k["doc"], k["mark"], k["pos"], k["n"], k["h"].view(np.int64)])
        if SINGLE in got:
            w = got[SINGLE]
            source, _ = _sources(w["h"], w["g"], w["doc"], w["mark"], w["pos"])
            yield _table(_PIECE, _pieces(source, w["doc"], w["mark"], w["pos"]))

    joined = _with_lists(texts, _open_runs(texts, window, seed, width).repartition("doc", "mark"), "inner")
    return joined.mapInArrow(tidy(windows), blob_schema(_WINDOWS)).repartitionById(width, F.col("bucket")).mapInArrow(tidy(meet), "doc long, mark long, pos int, n int, line long")


def _wanted(found: pa.Array, row: np.ndarray) -> np.ndarray:
    """Which windows (in order of row and position) lie in a run of their row."""
    parent, p, n = _lists(found)
    first = np.searchsorted(row, np.arange(len(found) + 1))
    delta = np.zeros(len(row) + 1, np.int64)
    np.add.at(delta, np.minimum(first[parent] + p, first[parent + 1]), 1)
    np.add.at(delta, np.minimum(first[parent] + p + n, first[parent + 1]), -1)
    return np.flatnonzero(np.cumsum(delta[:-1]) > 0)


# ---------------------------------------------------------------- paths

def _paths(pieces: DataFrame) -> DataFrame:
    """(doc, mark, pos, n) of every path that pieces (doc, mark, pos, n, line) make up.

    The end of a piece and the start of the next on its line fall on one coordinate and cancel there; the starts and
    ends that are left delimit the paths. Rows that repeat count as often as they are there, which changes no path.
    """
    ends = pieces.repartition("doc", "mark").select("doc", "mark", "line", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + F.col("n")).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    left = ends.groupBy("doc", "mark", "line", "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    along = Window.partitionBy("doc", "mark", "line").orderBy("at")
    spans = left.withColumns({"depth": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), "stop": F.lead("at").over(along)}).where("depth > 0")
    return spans.select("doc", "mark", F.col("at").alias("pos"), (F.col("stop") - F.col("at")).alias("n"))


def _kept(size: int, pos: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words no window of a path covers."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, pos, 1)
    np.add.at(delta, np.minimum(pos + n + window - 1, size), -1)
    return np.cumsum(delta[:-1]) == 0


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every column of docs, its text without the words of repeated windows; and n_words, n_removed (long).

    A word goes if a window of `window` consecutive words of its text that covers it also starts earlier: in a
    smaller key, or in the same key at an earlier word. The text that is left is its words joined by one space;
    a text that loses nothing stays as it is. Null: no words, stays null. Texts of under `window` words stay.
    Rows that repeat a key and text are judged alike. Rows with a null key come before all others and, as they have no
    order of their own, in the order of their texts' hashes; those with equal texts are judged alike. The key is
    an integer column, else TypeError. No rows give no rows. Columns of docs called n_words or n_removed are replaced;
    any other name may occur.
    """
    texts, extra = _texts(docs, text, key)
    found = _with_lists(texts, _paths(_linked(texts, window, seed)), "left")
    kinds = "".join(f", extra_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    rest = [f"extra_{i}" for i in range(len(extra))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch):
                column = b.column("text")
                parent, p, n = _lists(b.column("found"))
                bounds = np.searchsorted(parent, np.arange(b.num_rows + 1)).tolist()
                data, off = flat(column)
                count = np.diff(word_bounds(data, off)[2])
                gone, cuts = np.zeros(b.num_rows, np.int64), {}
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    words, at = column[i].as_py().encode().split(), slice(bounds[i], bounds[i + 1])
                    keep = _kept(len(words), p[at], n[at], window)
                    gone[i] = len(words) - int(keep.sum())
                    cuts[i] = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
                if cuts:
                    column = pa.array([cuts.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("mark"), column, *(b.column(c) for c in rest), pa.array(count), pa.array(gone)], names=["doc", "mark", "text", *rest, "n_words", "n_removed"])

    out = found.mapInArrow(tidy(cut), f"doc long, mark long, text string{kinds}, n_words long, n_removed long")
    names = {text: F.col("text"), key: F.when(F.col("mark") != 0, F.col("doc"))} | {c: F.col(f"extra_{i}") for i, c in enumerate(extra)}
    kept = [c for c in docs.columns if c in names]
    return out.select(*[names[c].cast(docs.schema[c].dataType).alias(c) for c in kept], "n_words", "n_removed")


def kept_digest(text: str | None) -> str:
    """SHA-256 of a text's words joined by one space, lowercase hex."""
    return hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()
