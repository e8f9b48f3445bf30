"""Shared plumbing: shared-folder tables, Arrow slicing, flat-text kernels and blob shuffles."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import getpass
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: doc_id used in place of null: null ids sort before every other id.
NULL_ID = np.iinfo(np.int64).min


# ---------------------------------------------------------------- shared folder

def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets one under /tmp; on a cluster that is an error,
    as its machines share no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master or "local").startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"/tmp/checkpoints/{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, over: Iterable[DataFrame | None] = ()) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Every executor sees the files, so a lost executor costs nothing but its running tasks. The files go when the
    driver's process ends, or when a table that names them in `over` has been written: df was the last to need them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    for old in over:
        if gone := getattr(old, "_quillon_path", None):
            _drop(spark, gone)
    return out


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already  # noqa: BLE001
        return


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: str) -> F.Column:
    """A 64-bit hash of a text column, by which rows of one key are told apart; null and empty are alike."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def keep_first(docs: DataFrame, groups: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of docs with one left of each group: that of the least key, of rows with that key the one of the least text hash.

    groups: (k, h, component) of every row: its key, text_hash and group. Of rows that repeat key and text one stays.
    Rows with a null key have no part in the choice and all stay.
    """
    first = groups.where("k is not null").groupBy("component").agg(F.min(F.struct("k", "h")).alias("x")).select(F.col("x.k").alias("k"), F.col("x.h").alias("h"))
    name = unused(docs, "_hash")
    held = docs.withColumn(name, text_hash(text))
    kept = held.join(first, (held[f"`{key}`"] == first["k"]) & (held[name] == first["h"]), "left_semi").dropDuplicates([key, name]).drop(name)
    return kept.union(docs.where(F.col(f"`{key}`").isNull()))


def shuffle_width(df: DataFrame) -> int:
    """Partitions for a blob shuffle: follows the input's splits, never under the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


# ---------------------------------------------------------------- Arrow

def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with texts handed to Python by the thousand rows at most: documents are longer than most rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 1000 or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, "1000")
    return spark


#: What workers may hold from task to task: things with a reset() that gives their memory back.
held_over: list = []


def let_go() -> None:
    """Give back what this worker holds over."""
    for x in held_over:
        x.reset()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hold: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back when a task ends: Python workers outlive tasks. hold: what earlier tasks held over is of use, else it goes first."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not hold:
            let_go()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other platforms than glibc's
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end, and each string's start in them (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts stay within `most` bytes, if they have more than one row."""
    _, off = flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def ids_of(column: pa.Array) -> np.ndarray:
    """An integer column as int64, null as NULL_ID."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


# ---------------------------------------------------------------- flat text

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+ in flat bytes, and each text's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = off[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[(inner > 0)] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_U = np.uint64
_BASE, _BASE2, _BASE3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407))


def _inverse(x: np.uint64) -> np.uint64:
    return _U(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as many as asked for so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(b: np.uint64) -> np.ndarray:
                x = np.full(n, b, _U)
                x[0] = 1
                return np.multiply.accumulate(x)
            self.up, self.down = run(self.base), run(_inverse(self.base))
        return self.up[:n], self.down[:n]


_powers = {b: _Powers(b) for b in (_BASE2, _BASE3)}
_LANES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
#: Bytes of a span up to which it is hashed in lanes, all spans at once.
LONG_SPAN = 64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each pair: eight bytes at a time through mix(); XXH3 for spans over LONG_SPAN bytes."""
    n = ends - starts
    h = mix(n.astype(_U) * _BASE + _U(0x1234567))
    if not len(n):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    for j in range(0, LONG_SPAN, 8):
        live = live[n[live] > j] if j else live
        if not len(live):
            break
        h[live] = mix((h[live] ^ (lanes[starts[live] + j] & _LANES[np.minimum(n[live] - j, 8)])) + _BASE)
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], 29)
    return h


def gram_hash(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of words; entry i covers words[i:i+k]. second: another one, of words mixed anew."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if second:
        words = mix(words ^ _BASE2)
    up, down = _powers[_BASE3 if second else _BASE2].get(len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + _U(k))


def ragged(offsets: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+lens[i]-1 for every i, end to end."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.arange(total) + np.repeat(offsets - first, lens)


# ---------------------------------------------------------------- blob shuffles

def blob(values: np.ndarray) -> bytes:
    """An array as bytes, after its length: 64-bit hashes as they are, other numbers byte by byte of all (the high ones are alike) and compressed."""
    n = len(values)
    if values.dtype == _U:
        return (2 * n).to_bytes(8, "little") + values.tobytes()
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(n, -1).T.tobytes()
    return (2 * n + 1).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(blobs: list[bytes], kind: str) -> np.ndarray:
    size, parts = np.dtype(kind).itemsize, []
    for x in blobs:
        n, packed = divmod(int.from_bytes(x[:8], "little"), 2)
        if n and packed:
            raw = np.frombuffer(pa.decompress(x[8:], n * size, codec="zstd"), np.uint8)
            parts.append(np.ascontiguousarray(raw.reshape(size, n).T).view(kind)[:, 0])
        elif n:
            parts.append(np.frombuffer(x, kind, offset=8))
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def scatter(part: np.ndarray, width: int, cols: dict[str, np.ndarray | None], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, one binary per column): entries of one bucket stay together, in their order. A column that is None is empty."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(width + 1))
    full = np.flatnonzero(np.diff(bounds))
    arrays = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32))]
    for values in cols.values():
        if values is None:
            arrays.append(pa.array([b""] * len(full), pa.binary()))
            continue
        values = values[order]
        arrays.append(pa.array([blob(values[bounds[b] : bounds[b + 1]]) for b in full], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "kind", *cols])


def blob_schema(cols: Iterable[str]) -> str:
    return "bucket int, kind int, " + ", ".join(f"{c} binary" for c in cols)


def gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[int, dict[str, np.ndarray]]:
    """All blobs of a partition, by kind, as arrays of the given types."""
    found: dict[int, dict[str, list[bytes]]] = {}
    for b in batches:
        marks = b.column("kind").to_pylist()
        for c in kinds:
            for k, x in zip(marks, b.column(c).to_pylist(), strict=True):
                found.setdefault(k, {n: [] for n in kinds})[c].append(x)
    return {k: {c: _unblob(v[c], t) for c, t in kinds.items()} for k, v in found.items()}
