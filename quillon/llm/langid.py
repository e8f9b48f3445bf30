"""Language identification of mixed-language text.

Scripts narrow the languages a word can have; byte trigrams score the word in each of those; and a Viterbi
pass with a penalty for every switch labels spans of words. The model is learned here, from labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, steps, tidy

#: Cells of the trigram table, and the script codes that follow them in counts.
CELLS = 1 << 16
#: What a switch of language costs, in nats.
SWITCH = 15.0
#: Languages that can be learned: the model is a table with a column for each, and every executor has it.
MOST_LANGUAGES = 120
#: Rows of each language that are learned from, at most: the bound of the training sample.
LEARNED = 1500

# The script that a UTF-8 lead byte belongs to (0: none, 1: Latin).
SCRIPT = np.zeros(256, np.uint8)
SCRIPT[ord("a") : ord("z") + 1] = 1
SCRIPT[0xC3:0xCA] = 1
SCRIPT[0xCE:0xD0] = 2  # Greek
SCRIPT[0xD0:0xD5] = 3  # Cyrillic
SCRIPT[0xD5:0xD7] = 4  # Armenian, Hebrew
SCRIPT[0xD7] = 4
SCRIPT[0xD8:0xDC] = 5  # Arabic
SCRIPT[0xE0] = 6  # Indic and Thai
SCRIPT[0xE3] = 7  # kana
SCRIPT[0xE4:0xEA] = 7  # Han
SCRIPT[0xEA:0xEE] = 8  # Hangul


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat lower-case bytes with every ASCII character but letters as a space, and each text's start."""
    data, off = flat(pc.utf8_lower(pc.fill_null(column, "")))
    keep = (data >= 0x80) | ((data >= ord("a")) & (data <= ord("z")))
    return np.where(keep, data, np.uint8(32)), off


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))
    stop = solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as flat bytes with a space on each side, their starts and ends there; each word's number of its
    distinct word; and each text's first word."""
    data, off = _letters(column)
    s, e, first = _words(data, off)
    if not len(s):
        return np.array([32], np.uint8), s, e, s, first
    bounds = np.append(s, len(data))  # a word and the spaces after it
    chunks = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    blob, woff = flat(coded.dictionary)
    ws, we, wf = _words(blob, woff)
    return np.concatenate([[np.uint8(32)], blob, [np.uint8(32)]]), ws + 1, we + 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def _cells(blob: np.ndarray) -> np.ndarray:
    """The table cell of the trigram around each byte but the first and last."""
    b = blob.astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _scripts(blob: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The script of most letters of each word: the highest code wins over Latin."""
    if not len(s):
        return np.zeros(0, np.uint8)
    code = SCRIPT[blob]
    return np.maximum.reduceat(code, np.stack([s, e], 1).ravel()[: 2 * len(s)])[::2]


@dataclass
class LanguageModel:
    """Learned languages, ascending; log-probabilities of trigram cells; and which scripts each language is written in."""

    languages: list[str]
    table: np.ndarray  # cells x languages
    scripts: np.ndarray  # languages x 16, bool

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: a score in each language and its number of bytes; and each text's first word."""
        blob, s, e, index, first = _distinct(column)
        n = len(self.languages)
        if not len(index) or not n:
            return np.zeros((len(index), n), np.float32), (e - s)[index] if len(index) else np.zeros(0, np.int64), first
        total = np.zeros((len(blob) - 1, n))
        np.cumsum(self.table[_cells(blob)], axis=0, out=total[1:])
        score = total[e - 1] - total[s - 1]
        script = _scripts(blob, s, e)
        fits = self.scripts[:, script].T
        score = np.where(fits | ~fits.any(1, keepdims=True), score - score.max(1, keepdims=True), -60.0)
        return score[index].astype(np.float32), (e - s)[index], first


def learn(docs: DataFrame, allowed: F.Column | None = None, per_language: int = LEARNED, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """A model of the languages of docs, from rows with a non-null language that `allowed` admits.

    Of each language the `per_language` rows with the least hash of their key are used (all, if it has fewer); that
    bound is the only sampling there is. Rows with a null key, text or language teach nothing, and over MOST_LANGUAGES languages are a ValueError.
    """
    admitted = docs if allowed is None else docs.where(allowed)
    rows = admitted.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    # the least hashes of a language of n rows lie under a share of the hash range that n gives: only those few rows meet
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"))
    hashed = rows.select("l", "k", F.xxhash64("k").alias("h"))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    known = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    sizes = rows.sparkSession.createDataFrame(known, sizes.schema)
    few = hashed.join(F.broadcast(sizes), "l").where(share * F.col("n") <= per_language + 8 * per_language**0.5 + 32)
    least = Window.partitionBy("l").orderBy("h", "k")
    chosen = few.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= per_language).select("l", "k").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in steps(batch, "t"):
                langs = b.column("l").to_pylist()
                for l in set(langs):
                    blob, s, e, index, _ = _distinct(b.column("t").filter(pa.array([x == l for x in langs])))
                    if not len(index):
                        continue
                    times = np.bincount(index, minlength=len(s)).astype(float)
                    weight = np.zeros(len(blob) + 1)
                    np.add.at(weight, s, times)
                    np.add.at(weight, e, -times)
                    table = held.setdefault(l, np.zeros(CELLS + 16))
                    table[:CELLS] += np.bincount(_cells(blob), np.cumsum(weight)[1 : len(blob) - 1], CELLS)
                    table[CELLS:] += np.bincount(_scripts(blob, s, e), times, 16)
        for l, t in held.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["l", "cell", "n"])

    sums = rows.join(chosen.hint("broadcast"), ["k", "l"], "left_semi").select("t", "l").mapInArrow(tidy(count), "l string, cell int, n double").groupBy("l", "cell").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most CELLS + 16 rows a language
    languages = sorted(got["l"].unique().tolist())
    table, scripts = np.zeros((CELLS, len(languages))), np.zeros((len(languages), 16), bool)
    for j, l in enumerate(languages):
        one = got[got["l"] == l]
        full = np.bincount(one["cell"].to_numpy(), one["n"].to_numpy(), CELLS + 16)
        cells, seen = full[:CELLS] + 0.5, full[CELLS:]
        table[:, j] = np.log(cells / cells.sum())
        scripts[j] = seen >= 0.01 * max(seen.sum(), 1)
    return LanguageModel(languages, table.astype(np.float32), scripts)


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: most score over each text, less `switch` for every change; of equals, no change.

    A text whose best single language L loses to no other language by more than `switch` over any stretch keeps
    L throughout: every excursion would cost at least as much as it gains. Only other texts need the full pass.
    """
    n, k = len(first) - 1, score.shape[1]
    if not len(score) or not k:
        return np.zeros(len(score), np.int64)
    total = np.zeros((len(score) + 1, k))
    np.cumsum(score, axis=0, out=total[1:])
    lens = np.diff(first)
    best = (total[first[1:]] - total[first[:-1]]).argmax(1)
    path = np.repeat(best, lens)
    row = np.repeat(np.arange(n), lens)
    worst = np.zeros(n)
    own = total[np.arange(1, len(total)), path] if len(path) else np.zeros(0)
    base = total[first[:-1], best]
    for j in range(k):
        gain = (total[1:, j] - np.repeat(total[first[:-1], j], lens)) - (own - np.repeat(base, lens))
        # running minimum within each text: lift each text below all later ones
        lift = row * (2 * np.abs(gain).max(initial=0) + 1)
        low = np.minimum(np.minimum.accumulate(gain - lift) + lift, 0)
        prior = np.empty_like(low)
        prior[1:] = low[:-1]
        prior[first[:-1][lens > 0]] = 0
        starts = first[:-1][lens > 0]
        if len(starts):
            worst[lens > 0] = np.maximum(worst[lens > 0], np.maximum.reduceat(gain - prior, starts))
    todo = np.flatnonzero(worst > switch)
    todo = todo[np.argsort(-lens[todo], kind="stable")]
    if not len(todo):
        return path
    begin, size = first[todo], lens[todo]
    state = np.zeros((len(todo), k))
    back = [np.zeros((0, k), np.int8)]
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        s = state[:live]
        if t:
            lead = s.argmax(1)
            jump = s[np.arange(live), lead][:, None] - switch > s
            back.append(np.where(jump, lead[:, None], np.arange(k)).astype(np.int8))
            s = np.where(jump, s[np.arange(live), lead][:, None] - switch, s)
        state[:live] = s + score[begin[:live] + t]
    now = state.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        path[begin[:live] + t] = now[:live]
        if t:
            now[:live] = back[t][np.arange(live), now[:live]]
    return path


def _has_letter(column: pa.Array, bytes_of: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, off = _letters(column)
    plain = np.concatenate([[0], np.cumsum((data >= ord("a")) & (data <= ord("z")))])
    out = plain[off[1:]] > plain[off[:-1]]
    for i in np.flatnonzero(~out & (bytes_of > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return out


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, text: str = "text", key: str = "doc_id", spans: bool = False) -> DataFrame:
    """(key, lang_pred, score) for every row; with spans also spans array<struct<word, words, lang>>.

    lang_pred is the language of most letters' bytes after span labelling, score their share (0 to 1). A null
    text, or one without a letter, is `und` with score 0 and has no spans, as has every text if the model has
    no language. Rows that repeat give rows that repeat; an empty table gives an empty one. Words are counted
    over letters only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        k = len(m.languages)
        for batch in batches:
            for b in steps(batch, text):
                column = b.column(text)
                score, size, first = m.scores(column)
                path = viterbi(score, first, switch)
                row = np.repeat(np.arange(b.num_rows), np.diff(first))
                weight = np.bincount(row * max(k, 1) + path, size, b.num_rows * max(k, 1)).reshape(b.num_rows, max(k, 1))
                total = weight.sum(1)
                known = _has_letter(column, total) & (total > 0) & (k > 0)
                best = np.where(known, weight.argmax(1), k)
                share = np.where(known, weight.max(1) / np.maximum(total, 1), 0.0)
                cols = [b.column(key), pa.array(names[best], pa.string()), pa.array(share)]
                if spans:
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                    new &= known[row]
                    at = np.flatnonzero(new)
                    ends = np.append(at[1:], len(path))
                    ends = np.minimum(ends, first[row[at] + 1])
                    inner = pa.StructArray.from_arrays([pa.array((at - first[row[at]]).astype(np.int32)), pa.array((ends - at).astype(np.int32)), pa.array(names[path[at]], pa.string())], names=["word", "words", "lang"])
                    cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(b.num_rows + 1)).astype(np.int32)), inner))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "lang_pred", "score", *["spans"] * spans])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, lang_pred string, score double" + ", spans array<struct<word:int,words:int,lang:string>>" * spans)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose text has a language with at least `least` of its letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for batch in batches:
            for b in steps(batch, text):
                score, size, first = m.scores(b.column(text))
                path = viterbi(score, first)
                row = np.repeat(np.arange(b.num_rows), np.diff(first))
                weight = np.bincount(row * max(k, 1) + path, size, b.num_rows * max(k, 1)).reshape(b.num_rows, max(k, 1))
                good = _has_letter(b.column(text), weight.sum(1)) & (weight.max(1) >= least * weight.sum(1)) & (k > 0)
                yield b.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
