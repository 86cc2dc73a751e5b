"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

A document's set holds its distinct shingles of ``shingle`` words, after A-Z are
lower-cased; a document of fewer words, but not none, has its whole sequence as
the one shingle. Two documents are linked if the Jaccard similarity of their sets
is at least ``threshold``.

Tensored banding: two collections of SIDE small keys each, of WIDTH minhashes, make
the keys of SIDE x SIDE tables by pairing each key of the one with each of the
other, so 2 x SIDE x WIDTH minhashes serve tables that would need SIDE times as many.
A pair at the threshold of 0.8 is missed by all tables with a chance of about
1e-4, one at 0.9 with less than 1e-7.

Documents of equal sets are one class from the start, so copies never meet in the
tables. Each task keeps one class for each key and notes the others that it met
under it, so a key that a third of all documents share reaches its reducer at most
once from each task. Candidates come in rounds. In each star round a bucket's
classes are compared with one of them, so there are no more candidates than rows;
pairs already compared, and pairs already connected, are left out. What is still not
connected within a bucket is compared in the last round by products of 0/1
matrices, and only pairs near the threshold leave a block. Groups too large for that meet by
their rarest shingles, of which two linked sets share one.
Candidates are verified on whole sets of 64-bit shingle hashes. Components come from repeated minimum
labels with pointer jumping, written to the shared folder after each step.

Null texts and texts without words have no set and are linked with nothing. Null
ids come last and are their component's id only where no other is. Rows of one id
are told apart by their sets; repeated rows get equal results. Extra columns stay;
those named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from quern.llm.common import documents, dropped, work_table
from quern.llm.words import HashCache, hashed_words, mixed, rolled, slices, texts_of, trimmed, with_columns

SIDE, WIDTH = 14, 3
THRESHOLD = 0.8
#: Star rounds before the last one.
STARS = 2
#: Nodes of a block of the last round.
GROUP = 512
#: Cells of shingle hashes that are counted to tell rare shingles from common ones, 8 bytes each.
CELLS = 1 << 20
#: Ids up to which the list of documents to verify is broadcast: about 40 bytes each.
MOST_BROADCAST = 1_000_000
LAST = np.iinfo(np.int64).max


def _sets(batch: pa.RecordBatch, column: str, cache: HashCache, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for part in slices(batch, column, 4 << 20) for s in _sets_of(texts_of(part, column), cache, shingle)]


def _sets_of(texts: list[bytes], cache: HashCache, shingle: int) -> list[np.ndarray]:
    h, ends = hashed_words([t.lower() for t in texts], cache)
    every = mixed(rolled(h, shingle)) if len(h) >= shingle else h[:0]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(every[a : b - shingle + 1]))
        else:  # a sequence of another length never equals a shingle
            out.append(mixed(rolled(h[a:b], b - a) + np.uint64(b - a)) if b > a else h[:0])
    return out


def _minhashes(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over the values."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 4096):  # bounded memory for long texts
        np.minimum(out, (values[i : i + 4096, None] * a + b).min(0), out=out)
    return out


def _signer(column: str, shingle: int, side: int, width: int, seed: int = 10):
    def make():
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, 2 * side * width, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, 2 * side * width, np.uint64)
        cache = HashCache()

        def sign(batch: pa.RecordBatch) -> list:
            sizes, ids, halves = [], [], []
            for s in _sets(batch, column, cache, shingle):
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                # the high halves of products with odd numbers are the better hashed ones
                low = mixed(_minhashes(s, a, b) >> np.uint64(24)).reshape(2 * side, width)
                halves.append(mixed(rolled(low.ravel(), width)[::width]).tobytes() if len(s) else None)
            return [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(halves, pa.binary())]

        return sign

    return make


def _grouped_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and nodes sorted by key, with where groups begin and each row's group."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys, nodes, np.flatnonzero(new), np.cumsum(new) - 1


def _rows(keys, nodes, slots, met) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(slots, pa.int64()), pa.array(np.full(len(keys), met))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "node", "slot", "met"])


def _tensored(side: int, most: int = 1_000_000):
    """(node, halves) to (key, node, slot, met): the keys of all tables.

    One row of each key of a block of nodes goes to the key's slot; where a block
    has several nodes of a key, all of them are noted as met and go anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = mixed(np.arange(side * side, dtype=np.uint64) + np.uint64(1)).reshape(side, side)
        step = max(1, most // side**2)
        nodes, halves = [], []

        def flushed():
            n = np.concatenate(nodes)
            h = np.frombuffer(b"".join(halves), np.uint64).reshape(-1, 2 * side)
            keys = mixed((h[:, :side, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:, None, side:] + table)).reshape(-1).view(np.int64)
            keys, every, heads, group = _grouped_keys(keys, np.repeat(n, side * side))
            several = np.diff(np.append(heads, len(keys)))[group] > 1
            yield _rows(keys[heads], every[heads], keys[heads], False)
            yield _rows(keys[several], every[several], keys[several] ^ (every[several] * 31), True)
            nodes.clear()
            halves.clear()

        count = 0
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                nodes.append(part.column("node").to_numpy())
                halves.extend(part.column("halves").to_pylist())
                count += part.num_rows
                if count >= step:
                    yield from flushed()
                    count = 0
        if count:
            yield from flushed()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of rows by slot, to (key, node) of the keys that several nodes have."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    keys, nodes, met = (t.column(c).to_numpy() for c in ("key", "node", "met"))
    yield pa.RecordBatch.from_arrays([pa.array(keys[met]), pa.array(nodes[met])], names=["key", "node"])
    keys, nodes, heads, group = _grouped_keys(keys[~met], nodes[~met])
    several = np.diff(np.append(heads, len(keys)))[group] > 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[several]), pa.array(nodes[several])], names=["key", "node"])


def bucketed(nodes: DataFrame, side: int = SIDE) -> DataFrame:
    """(key, node) of the buckets that hold several of the nodes (node, halves)."""
    keys = nodes.select("node", "halves").mapInArrow(trimmed(_tensored(side)), "key long, node long, slot long, met boolean")
    return keys.repartition("slot").mapInArrow(trimmed(_buckets), "key long, node long")


def signed(docs: DataFrame, shingle: int = 5, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, halves) of docs; row is the text's hash."""
    fields = {"n_shingles": LongType(), "set_id": BinaryType(), "halves": BinaryType()}
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row"))
    return with_columns(rows, fields, _signer("text", shingle, side, width), ("text",))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the smallest node that is reachable."""
    both = work_table(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = work_table(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(ahead, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        before, labels = labels, work_table(jumped, "labels")
        done = labels.where("old != label").limit(1).count() == 0
        dropped(before)
        if done:
            dropped(both)
            return labels.select("node", "label")


def _set_reader(shingle: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            sets = [s.astype(kind).tobytes() for s in _sets(batch, "text", cache, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) to (a, b, shared, joint): the sizes of the sets' intersection and union."""
    for batch in batches:
        shared, joint = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            n = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(n)
            joint.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], names=["a", "b", "shared", "joint"])


class Linker:
    """Compares candidate pairs on whole sets, and keeps what was compared."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, threshold: float):
        self.docs, self.nodes, self.shingle = docs, nodes, shingle
        self.percent = round(100 * threshold)
        self.done: DataFrame | None = None
        self.repeats = nodes.where("copies > 1").limit(1).count() > 0

    def compare(self, pairs: DataFrame) -> int:
        """Compares those of pairs (a < b) that were not; how many were."""
        if self.done is not None:
            pairs = pairs.join(self.done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = work_table(pairs, "pairs")
        count = pairs.count()
        if count == 0 and self.done is not None:
            return 0
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        left = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
        whole = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")
        compared = whole.mapInArrow(trimmed(_compared), "a long, b long, shared long, joint long")
        compared = work_table(compared, "compared")
        self.done = compared if self.done is None else self.done.union(compared)
        return count

    def sets(self, wanted: DataFrame, kind: str = "u8") -> DataFrame:
        """(node, shingles) of the nodes wanted; of kind u4 only half of each hash."""
        wanted = work_table(wanted.join(self.nodes.select("node", "doc_id", "row"), "node"), "wanted")
        if wanted.count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)
        rows = self.docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row"))
        same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["row"] == wanted["row"])
        sets = rows.join(wanted, same).select("node", "text").mapInArrow(trimmed(_set_reader(self.shingle, kind)), "node long, shingles binary")
        # repeated rows give a node's set several times
        return sets.groupBy("node").agg(F.first("shingles").alias("shingles")) if self.repeats else sets

    def links(self) -> DataFrame:
        return self.done.where(100 * F.col("shared") >= self.percent * F.col("joint"))


def _stars(buckets: DataFrame, turn: int) -> DataFrame:
    """(a, b, key) of each bucket's nodes with one of them, another in each turn."""
    heads = buckets.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("head"))
    pairs = buckets.join(heads, "key").where("node != head")
    return pairs.select("key", F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of pairs that labels do not connect."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.withColumnsRenamed({"node": side, "label": f"label_{side}"}), side, "left")
        pairs = pairs.withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    return pairs.where("label_a != label_b")


def _blocked(percent: int):
    """Rows (slot, first, second, node, label, block, values), sorted by the first three, to pairs to verify.

    A group holds two blocks of nodes that share a small key, or one block twice.
    Intersections of all pairs come from products of 0/1 matrices.
    """

    def pairs_of(group: list[tuple]) -> pa.RecordBatch | None:
        first, second = group[0][1:3]
        nodes, labels, blocks = (np.array([r[i] for r in group]) for i in (3, 4, 5))
        if len(group) < 2 or (labels == labels[0]).all():
            return None
        sets = [np.unique(np.frombuffer(r[6], np.uint32)) for r in group]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times[column] > 1
        number = np.cumsum(times > 1) - 1
        owner, column = owner[several], number[column[several]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        columns, step = int((times > 1).sum()), max(1, 8_000_000 // len(sets))
        for start in range(0, columns, step):
            a, b = np.searchsorted(column, [start, start + step])
            m = np.zeros((len(sets), min(step, columns - start)), np.float32)
            m[owner[a:b], column[a:b] - start] = 1
            shared += m @ m.T
        joint = size[:, None] + size[None, :] - shared
        near = (100 * shared >= (percent - 1) * joint) & (labels[:, None] != labels[None, :]) & (nodes[:, None] < nodes[None, :])
        if first != second:
            near &= blocks[:, None] != blocks[None, :]
        i, j = np.nonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:3] != row[:3]:
                    if (found := pairs_of(group)) is not None:
                        yield found
                    group = []
                group.append(row)
        if group and (found := pairs_of(group)) is not None:
            yield found

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to (cell, n): how many of the task's sets have a shingle of that cell of hashes."""
    n = np.zeros(CELLS, np.int64)
    for batch in batches:
        for s in batch.column("shingles"):
            n += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])


def _prefixes(shared, percent: int):
    """(node, label, shingles) to (shingle, node, label, size, place): the rarest shingles, one of which any two linked sets share.

    Sets of which percent in a hundred are shared have the same order of shingles, the rare ones first, so
    the first size - ceil(percent x size / 100) + 1 of either meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [[np.zeros(0, np.int64)] for _ in range(5)]
                for node, label, s in zip(part.column("node").to_pylist(), part.column("label").to_pylist(), part.column("shingles"), strict=True):
                    x = np.frombuffer(s.as_buffer(), np.uint64)
                    first = len(x) - -(-percent * len(x) // 100) + 1
                    x = x[np.lexsort((x, times[(x % np.uint64(CELLS)).astype(np.int64)]))[:first]]
                    for column, values in zip(rows, (x.view(np.int64), np.full(first, node), np.full(first, label), np.full(first, len(s.as_buffer()) // 8), np.arange(first)), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names=["shingle", "node", "label", "size", "place"])

    return run


def _met(percent: int):
    """Rows of _prefixes sorted by shingle, no more than GROUP of one, to pairs whose sizes and places allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = columns if rest is None else [np.concatenate(c) for c in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shingle may go on in the next batch
            rest = [c[whole:] for c in columns]
            yield pairs([c[:whole] for c in columns])
        if rest is not None:
            yield pairs(rest)

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        shingle, node, label, size, place = columns
        found = [np.zeros((0, 2), np.int64)]
        group = np.cumsum(np.append(0, shingle[1:] != shingle[:-1])) if len(shingle) else shingle
        for step in range(1, GROUP):  # each row with the one ``step`` further on in its group
            i = np.arange(len(group) - step) if len(group) > step else np.zeros(0, np.int64)
            i = i[group[i] == group[i + step]]
            if not len(i):
                break
            j = i + step
            most = 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1)
            kept = (label[i] != label[j]) & (100 * most >= percent * (size[i] + size[j] - most))
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1)[kept])
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _rare_pairs(hot: DataFrame, linker: Linker) -> tuple[DataFrame, DataFrame]:
    """(a, b) of nodes that may be linked, of hot (node, label), and the nodes among them that rare shingles do not tell apart.

    What is collected and broadcast is one number for each of CELLS cells of hashes. They only set the order
    of shingles, so no link depends on them.
    """
    spark = hot.sparkSession
    sets = work_table(linker.sets(hot.select("node")).join(hot, "node"), "hot-sets")
    times = np.zeros(CELLS, np.int64)
    for r in sets.mapInArrow(trimmed(_cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        times[r["cell"]] = r["n"]
    shared = spark.sparkContext.broadcast(times.tobytes())
    rows = sets.mapInArrow(trimmed(_prefixes(shared, linker.percent)), "shingle long, node long, label long, size long, place long")
    rows = work_table(rows, "prefixes")
    shared.destroy()
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    common = work_table(common.select("shingle", (F.col("n") > GROUP).alias("much")), "prefix-groups")
    few = rows.join(common.where("not much").select("shingle"), "shingle", "left_semi")
    pairs = few.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(trimmed(_met(linker.percent)), "a long, b long").distinct()
    return pairs, rows.join(common.where("much").select("shingle"), "shingle", "left_semi").select("node").distinct()


def _rest(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, linker: Linker, side: int) -> DataFrame:
    """(a, b) of the pairs that share a bucket, are not connected, and may be linked.

    Nodes of buckets that are not of one component meet by the small keys of the
    first collection, of which each bucket is a part, so that there are SIDE small
    keys a node instead of SIDE x SIDE. Groups of up to GROUP nodes are compared by their sets. Larger
    ones, as of documents that share much boilerplate, meet by their rarest shingles instead, which
    takes rows in proportion to their words. Only nodes whose rarest shingles are those of more than
    GROUP others meet in blocks.
    """
    named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    apart = apart.where("low != high and n > 2").select("key")
    members = work_table(named.join(apart, "key").select("node", "label").distinct(), "members")
    small = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.substring(F.col("halves"), i * 8 + 1, F.lit(8)))).alias("i", "half")
    met = members.join(nodes.select("node", "halves"), "node").select("node", "label", small)
    met = met.withColumn("slot", F.xxhash64("i", "half")).drop("i", "half")
    groups = met.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    groups = groups.where("low != high").select("slot", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    met = work_table(met.join(groups, "slot"), "met")
    hot = met.where("blocks > 1").select("node", "label").distinct()
    rare = None
    if hot.limit(1).count():
        rare, alike = _rare_pairs(hot, linker)
        alike = work_table(alike, "alike")
        left = met.where("blocks > 1").drop("blocks").join(alike, "node")
        blocks = left.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
        met = work_table(met.where("blocks = 1").unionByName(left.join(blocks, "slot")), "met")
    sets = linker.sets(met.select("node").distinct(), "u4")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("slot", "node", "label", "block", other)
    dealt = met.join(sets, "node").select(
        "slot", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "label", "block", "shingles"
    )
    dealt = dealt.repartition("slot", "first", "second").sortWithinPartitions("slot", "first", "second")
    near = dealt.mapInArrow(trimmed(_blocked(linker.percent)), "a long, b long")
    return (near if rare is None else near.union(rare)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = THRESHOLD, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) for each row of docs; row is the text's hash."""
    signs = work_table(signed(docs, shingle, side, width), "signs")
    first = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("order"), "doc_id", "row")
    nodes = signs.where("n_shingles > 0").groupBy("set_id").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("halves").alias("halves")
    )
    copies = F.col("n")  # rows of the class; only rows alike in id and text can repeat a set
    nodes = nodes.select(F.xxhash64("set_id").alias("node"), "set_id", "halves", copies.alias("copies"), "first.*")
    nodes = work_table(nodes, "nodes")
    buckets = work_table(bucketed(nodes, side), "buckets")
    linker = Linker(docs, nodes, shingle, threshold)
    labels = None
    for turn in range(STARS):
        pairs = _stars(buckets, turn).select("a", "b").distinct()
        if labels is not None:
            pairs = _apart(pairs, labels).select("a", "b")
        if linker.compare(pairs) or labels is None:
            labels = components(linker.links())
    if linker.compare(_rest(buckets, labels, nodes, linker, side)):
        labels = components(linker.links())
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("set_id", "label", "order")
    smallest = named.groupBy("label").agg(F.min("order").alias("component"))
    named = named.join(smallest, "label").select("set_id", "component")
    out = signs.select("doc_id", "row", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).when(F.col("component") < LAST, F.col("component"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "row", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup_near(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose component has an earlier document."""
    found = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_q_id"), F.col("row").alias("_q_row")).distinct()
    found = work_table(found, "kept")
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    same = docs["doc_id"].eqNullSafe(found["_q_id"]) & (F.xxhash64(docs["text"]) == found["_q_row"])
    return docs.join(found, same, "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the near-duplicate component of every document."""
    return near_duplicates(documents(spark, sf_dir), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
