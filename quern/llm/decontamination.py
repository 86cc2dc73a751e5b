"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Texts are lower-cased in A-Z and cut into words of letters and digits (every
character beyond ASCII counts as a letter). A window is 13 consecutive words of a
benchmark item, or all words of a shorter one. A block of items of bounded size is
broadcast as two arrays, the 64-bit hashes of its words and the sorted rolling hashes of its
windows with their places, and a bitmap that rules most windows of documents out.
Candidates agree in a rolling hash and are verified word by word, by the words' hashes.
The spans or the documents can then be removed.

A benchmark above the bound has several blocks. Each is a broadcast of its own; a task scans
its texts, GROUP bytes at a time, with one block after the other and lets go of each
before the next, so no process holds two. Nothing is shuffled.

Null texts have no words; a very long text is read whole, by one task. Items without words have no windows. Items of one id are
one item. A null item id is never reported, though its windows hit. Repeated rows get
equal results. Extra columns stay; those named like an output are replaced. Empty
tables give empty results or no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from quern.llm.common import documents
from quern.llm.words import HashCache, hashed_words, merged, mixed, ranges, rolled, slices, texts_of, with_columns

LENGTH = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bytes of benchmark text in a block. A block takes about four times this.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are scanned with a block at once, and that are read at once.
GROUP, SLICE = 32 << 20, 2 << 20
#: Each byte to itself, in lower case, or to a blank if it is no part of a word.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normal_words(texts: list[bytes], cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' normalised words, and the offset of each text and of the end."""
    return hashed_words([t.translate(TABLE) for t in texts], cache)


# A block is plain data, as it is broadcast: (words, starts, names, windows), where starts has the offset of each item's words,
# names their ids, and windows, by length, (hashes, sorted; the offset of each one's words; bitmap).


def packed(items: list[tuple[str | None, bytes]], length: int) -> tuple:
    """The block of these items."""
    words, starts = normal_words([t for _, t in items], HashCache())
    size = np.diff(starts)
    windows = {}
    for n in np.unique(np.minimum(size, length)).tolist():
        if n == 0:
            continue
        mine = np.flatnonzero(np.minimum(size, length) == n)
        at = ranges(starts[mine], size[mine] - n + 1).astype(np.int32 if len(words) < 1 << 31 else np.int64)
        h = mixed(rolled(words, n))[at]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        bits = max(10, int(len(h)).bit_length() + 5)
        low = h & np.uint64((1 << bits) - 1)
        seen = np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(seen, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        windows[n] = (h, at, seen)
    return words, starts, [x for x, _ in items], windows


def scan(block: tuple, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, item) of each pair of a window of texts, given by their words' hashes, and a window of the block.

    item is the number of the block's item.
    """
    known, starts, _, windows = block
    found = [(np.zeros(0, np.int64),) * 3]
    for n, (hashes, offsets, seen) in windows.items():
        h = mixed(rolled(words, n))
        low = h & np.uint64(len(seen) * 8 - 1)
        at = np.flatnonzero(seen[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        # windows lie within one text
        at = at[ends[np.searchsorted(ends, at, "right")] >= at + n]
        first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        at, place = np.repeat(at, last - first), ranges(first, last - first)
        here = offsets[place].astype(np.int64)
        same = np.ones(len(at), bool)
        for i in range(n):
            same &= words[at + i] == known[here + i]
        at, here = at[same], here[same]
        found.append((at, np.full(len(at), n), np.searchsorted(starts, here, "right") - 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scanner(blocks: list, share: int, cut: bool):
    """Batches to n_words, n_hit, items and contaminated, and with cut the clean text."""

    def make():
        cache = HashCache()

        def of(batch: pa.RecordBatch) -> list:
            parts = [normal_words(texts_of(part), cache) for part in slices(batch, "text", SLICE)]
            met = [set() for _ in range(batch.num_rows)]
            marks = [np.zeros(len(w) + 1, np.int64) for w, _ in parts]
            for shared in blocks:
                block, row = shared.value, 0
                for (words, ends), mark in zip(parts, marks, strict=True):
                    at, n, item = scan(block, words, ends)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + n, -1)
                    texts = np.searchsorted(ends, at, "right") - 1
                    for pair in np.unique(np.stack([texts, item], 1), axis=0).tolist():
                        if (name := block[2][pair[1]]) is not None:
                            met[row + pair[0]].add(name)
                    row += len(ends) - 1
                if len(blocks) > 1 and shared._path is not None:  # read from its file again when next used
                    shared.__dict__.pop("_value", None)
                del block
            counts, hits, masks = [], [], []
            for (_, ends), mark in zip(parts, marks, strict=True):
                hit = np.cumsum(mark)[:-1] > 0
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    counts.append(b - a)
                    hits.append(int(hit[a:b].sum()))
                    if cut:
                        masks.append(hit[a:b])
            flags = [k > 0 and share * k >= n for n, k in zip(counts, hits, strict=True)]
            out = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in met], pa.list_(pa.string())), pa.array(flags, pa.bool_())]
            if cut:
                clean = [_without(t, m) if k else t for t, m, k in zip(texts_of(batch), masks, hits, strict=True)]
                out.append(pa.array(clean, pa.binary()).cast(pa.string()))
            return out

        return of

    return make


def _without(text: bytes, mask: np.ndarray) -> bytes:
    """text without the runs of words that are hit, nor what stands between the words of a run."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(TABLE))]
    out, pos, i = [], 0, 0
    while i < len(spans):
        if mask[i]:
            j = i
            while j + 1 < len(spans) and mask[j + 1]:
                j += 1
            out.append(text[pos : spans[i][0]])
            pos, i = spans[j][1], j
        i += 1
    return b"".join([*out, text[pos:]])


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, share: int = SHARE, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and contaminated; with cut also clean_text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    items = items.distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    shared = []
    for b in range(blocks):
        rows = items.where(block == b).collect()  # about block_bytes, or one item
        shared.append(spark.sparkContext.broadcast(packed([(r["item"], bytes(r["text"])) for r in rows], length)))
    fields = {"n_words": LongType(), "n_hit": LongType(), "items": ArrayType(StringType()), "contaminated": BooleanType()}
    fields |= {"clean_text": StringType()} if cut else {}
    regroup = merged(GROUP) if blocks > 1 else iter
    return with_columns(docs, fields, _scanner(shared, share, cut), regroup=regroup)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the contamination of every document."""
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
