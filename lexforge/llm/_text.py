"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII
characters of the lower-cased text; every other ASCII character separates.
In a regular expression over the lower-cased text: :data:`WORD`.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x00-/:-@\[-^`{-\x7f]+"

#: Bytes of text that are worked on at once; a longer single text is worked on by itself.
CHUNK = 1 << 20

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)

_IS_WORD = np.zeros(256, np.bool_)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
_IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1024)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and the rows' n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def lower(column: pa.Array) -> pa.Array:
    """In lower case; bytes that are no UTF-8 become U+FFFD."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        data = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return pc.utf8_lower(pa.array([None if x is None else x.decode("utf-8", "replace") for x in data.to_pylist()], column.type))


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a row's end."""
    inside = _IS_WORD[raw] if inside is None else inside
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every row, and where each row begins among them (n + 1 offsets)."""
    raw, offsets = flat(lower(column))
    starts, ends = spans(raw, offsets)
    return hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def word_hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def give_back() -> None:
    """Returns to the system what the allocators of Arrow and, where it is glibc's, of C hold but nothing uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, with :func:`give_back` at a task's begin, when Spark has just dropped earlier broadcasts, and at its end.

    Spark keeps its workers, and each would go on holding what the largest of
    its tasks took.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_dir(spark: SparkSession) -> None:
    """Sees to it that checkpoints have a folder: the cluster's, or where a local session names none, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lexforge-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again; that cuts the lineage, too."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of :func:`stored` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A side is broadcast only up to so many bytes.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows are known, by counting them, to be few enough for a broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the table has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
