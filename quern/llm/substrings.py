"""Substring deduplication: winnowed anchors, extended both ways to maximal repeats.

A window is ``length`` consecutive words of one document. A word goes if a window
that covers it has a word sequence that also starts earlier: in a document of
smaller id, or earlier in the same one.

Seed: each window's anchor is the run of ANCHOR words in it with the smallest
hash. Equal windows have equal anchors at equal places, so every repeat is found
by joining documents on anchors; about one word in eight starts one. Extend: an
anchor carries fingerprints of the windows that chose it, those that reach left of
it and those that reach right, in order, so its match is extended both ways
where anchors meet, and adjoining matches make maximal repeats. A match needs the
64-bit hash of the anchor and 48 more bits of the window to agree.

Before the shuffle each task drops, block by block, the windows that it has met
in the block and notes them as repeats, so an anchor that a third of all documents
share reaches its reducer at most once from each block.

Null texts have no words. Null ids come after all others, as does an id of 2^63 - 1, which
counts as one. Rows of one id are told apart by the 64-bit hash of their text, and are one
document as to what is earlier: windows of one id and start do not remove each
other, so repeated rows get equal results. Extra columns stay; those named like an
output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quern.llm.common import documents, text_of
from quern.llm.words import HashCache, hashed_words, lowest, mixed, ranges, rolled, slices, small_batches, texts_of, trimmed, with_columns

LENGTH = 20
ANCHOR = 6
#: Windows of a task that are compared at once before the shuffle, which bounds its memory.
BLOCK = 1_500_000
LAST = np.iinfo(np.int64).max
ROWS = "anchor long, id long, row long, start int, n int, prints binary"


def _first_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """For each window, whether one of the same key (and check) starts earlier."""
    order = np.lexsort((start, doc, key) if check is None else (start, doc, check, key))
    k, d, s = key[order], doc[order], start[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        fresh[1:] |= c[1:] != c[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
    late = np.empty(len(k), bool)
    late[order] = (d != d[head]) | (s != s[head])
    return late


def _runs(flags: np.ndarray, group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of set flags with one group and consecutive starts."""
    at = np.flatnonzero(flags)
    if len(at) == 0:
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]]) | (np.diff(start[at]) != 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _seeds(length: int, anchor: int):
    """Documents to rows of ROWS: anchors with prints, and repeats within the task, without prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        held: list[tuple] = []
        words = 0
        for part in (x for batch in batches for x in slices(batch, "text", 4 << 20)):
            held.append(_windows(part, cache, length, anchor))
            words += len(held[-1][0])
            if words >= BLOCK:
                yield from _emitted(held)
                held, words = [], 0
        yield from _emitted(held)

    return run


def _windows(batch: pa.RecordBatch, cache: HashCache, length: int, anchor: int) -> tuple:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    rows = batch.column("row").to_numpy(zero_copy_only=False)
    h, ends = hashed_words(texts_of(batch), cache)
    counts = np.maximum(0, np.diff(ends) - length + 1)
    at = ranges(ends[:-1], counts)  # where each window starts
    doc = np.repeat(np.arange(len(ids)), counts)
    prints = mixed(rolled(h, length))[at]
    seeds = mixed(rolled(h, anchor))
    place = lowest(seeds, length - anchor + 1)[at]
    start = at - np.repeat(ends[:-1], counts)
    return prints, seeds[place] if len(at) else prints, place - at, ids[doc], rows[doc], start


def _emitted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    prints, seed, offset, ids, rows, start = (np.concatenate(x) for x in zip(*held, strict=True))
    late = _first_of(prints, ids, start)
    # repeats within the task
    group = np.cumsum(np.append(False, (np.diff(start) != 1)))
    first, n = _runs(late, group, start)
    yield _batch(ids[first] ^ rows[first], ids[first], rows[first], start[first], n, [b""] * len(first))
    # windows in a row that chose one anchor
    group = np.cumsum(np.append(False, np.diff(offset) != -1))
    first, n = _runs(~late, group, start)
    six = prints.view(np.uint8).reshape(-1, 8)[:, :6]
    every = ranges(first, n)
    data, at = six[every].tobytes(), np.append(0, np.cumsum(n)) * 6
    offsets = pa.py_buffer(at.astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(data)])
    yield _batch(seed[first].view(np.int64), ids[first], rows[first], start[first], n, packed)


def _batch(anchor, ids, rows, start, n, prints) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor, pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array(rows, pa.int64()),
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            prints if isinstance(prints, pa.Array) else pa.array(prints, pa.binary()),
        ],
        names=["anchor", "id", "row", "start", "n", "prints"],
    )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of ROWS by anchor, to the repeats of each document: starts and counts of windows."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    anchor, ids, rows, start, n = (t.column(c).to_numpy() for c in ("anchor", "id", "row", "start", "n"))
    prints = t.column("prints").combine_chunks()
    prints = prints if isinstance(prints, pa.Array) else prints.chunk(0)
    size = np.diff(np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(n) + 1])
    begin = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(n)].astype(np.int64)
    data = np.frombuffer(prints.buffers()[2], np.uint8) if prints.buffers()[2] is not None else np.zeros(0, np.uint8)
    known = np.flatnonzero(size == 0)
    with_prints = np.flatnonzero(size > 0)
    _, inverse, times = np.unique(anchor[with_prints], return_inverse=True, return_counts=True)
    met = with_prints[times[inverse] > 1]
    of = np.repeat(met, n[met])
    step = ranges(np.zeros(len(met), np.int64), n[met])
    window = start[of].astype(np.int64) + step
    at = begin[of] + 6 * step
    key = np.zeros(len(of), np.uint64)
    for i in range(6):
        key |= data[at + i].astype(np.uint64) << np.uint64(8 * i)
    late = _first_of(key, ids[of], window, anchor[of])
    first, many = _runs(late, of, window)
    ids = np.concatenate([ids[known], ids[of[first]]])
    rows = np.concatenate([rows[known], rows[of[first]]])
    pairs = np.stack([np.concatenate([start[known], window[first]]), np.concatenate([n[known], many])], axis=1).astype(np.int32)
    if len(ids) == 0:
        return
    order = np.lexsort((pairs[:, 0], rows, ids))
    ids, rows, pairs = ids[order], rows[order], pairs[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    at = np.append(heads, len(ids))
    runs = [pairs[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(rows[heads]), pa.array(runs, pa.binary())], names=["id", "row", "runs"])


def _cutter(length: int):
    def make():
        def cut(batch: pa.RecordBatch) -> list:
            kept, total, gone = [], [], []
            for text, runs in zip(texts_of(batch), batch.column("_q_runs").to_pylist(), strict=True):
                words = text.split()
                mark = np.zeros(len(words) + 1, np.int64)
                for run in runs or ():
                    pairs = np.frombuffer(run, np.int32).reshape(-1, 2).astype(np.int64)
                    np.add.at(mark, pairs[:, 0], 1)
                    np.add.at(mark, pairs[:, 0] + pairs[:, 1] + length - 1, -1)
                removed = np.cumsum(mark)[:-1] > 0
                total.append(len(words))
                gone.append(int(removed.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~removed)) if gone[-1] else b" ".join(words))
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]

        return cut

    return make


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with kept_text (the kept words, joined by one blank), n_words and n_removed."""
    if not 1 <= anchor <= length:
        raise ValueError("an anchor has 1 to length words")
    keyed = {"_q_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_q_hash": F.xxhash64(text_of(docs))}
    # the text is shuffled once, so a text of another type is read as a string
    df = docs.withColumns(keyed if docs.schema["text"].dataType == StringType() else keyed | {"text": F.col("text").cast("string")})
    small_batches(df.sparkSession)
    plain = df.select("text", F.col("_q_id").alias("id"), F.col("_q_hash").alias("row"))
    seeds = plain.mapInArrow(trimmed(_seeds(length, anchor)), ROWS).repartition("anchor")
    repeats = seeds.mapInArrow(trimmed(_extended), "id long, row long, runs binary")
    # the repeats of one document: no more than it has windows
    merged = repeats.groupBy(F.col("id").alias("_q_id"), F.col("row").alias("_q_hash")).agg(F.collect_list("runs").alias("_q_runs"))
    joined = df.join(merged, ["_q_id", "_q_hash"], "left")
    fields = {"kept_text": StringType(), "n_words": LongType(), "n_removed": LongType()}
    return with_columns(joined, fields, _cutter(length), ("_q_id", "_q_hash", "_q_runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document without its repeats."""
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
