"""Words and their hashes over Arrow batches, for the operators that run in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

#: Odd multipliers for rolling and mixing; any odd numbers of high entropy do.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words whose hashes a task keeps at most; the table starts anew beyond it.
MOST_CACHED = 200_000


#: Bytes of an Arrow batch.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: rows hold whole texts or sets, and a task keeps a batch in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


class HashCache(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts; a null text is empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def hashed_words(texts: list[bytes], cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words one after the other, and the offset of each text and of the end.

    bytes.split() splits at the six ASCII blanks, as the contracts do.
    """
    parts, ends = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        ends[i + 1] = ends[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, of a row at least."""
    text = batch.column(column)
    size = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    for a, b in zip(*_bounds(part), strict=True):
        yield batch.slice(a, b - a)


def _bounds(part: np.ndarray) -> tuple[list[int], list[int]]:
    new = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return new.tolist(), np.append(new[1:], len(part)).tolist() if len(new) else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """The polynomial hash of each run of ``length`` values, by doubling; not mixed."""
    out, have, power = None, 0, None
    step, size = h, 1
    base = int(BASE)
    whole = 1 << 64
    while True:
        if length & size:
            if out is None:
                out, have = step, size
            else:  # the runs found so far stand before this one
                n = max(0, len(h) - have - size + 1)
                power = np.uint64(pow(base, size, whole))
                out = out[:n] * power + step[have : have + n]
                have += size
        if have == length:
            return out[: max(0, len(h) - length + 1)]
        n = max(0, len(h) - 2 * size + 1)
        step = step[:n] * np.uint64(pow(base, size, whole)) + step[size : size + n]
        size *= 2


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost minimum of each run of ``width`` values, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(h))
    size = 1
    while size < width:
        hop = min(size, width - size)
        a, b = best[: len(best) - hop], best[hop:]
        best = np.where(h[b] < h[a], b, a)
        size += hop
    return best[:n]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(shift, counts) + np.repeat(starts, counts)


def merged(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same rows in batches of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, have = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            have += batch.nbytes
            if have >= size:
                yield joined(waiting)
                waiting, have = [], 0
        if waiting:
            yield joined(waiting)

    return run


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def trim() -> None:
    """Gives freed memory back, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def with_columns(
    df: DataFrame,
    fields: dict[str, DataType],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    drop: tuple[str, ...] = (),
    regroup: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
) -> DataFrame:
    """df with new columns, computed from whole Arrow batches.

    make() is called once in each task and gives the function from a batch to the
    new columns. Columns of df named like a new one, or in drop, go. regroup joins or
    parts batches before that.
    """
    small_batches(df.sparkSession)
    gone = {x.lower() for x in (*fields, *drop)}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in gone]
    schema = StructType([df.schema[k] for k in kept] + [StructField(k, t) for k, t in fields.items()])
    names = [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in regroup(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *of(batch)], names=names)

    return df.mapInArrow(trimmed(run), schema)
