"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Nearness is the largest inner product. Vectors get one more component that makes
all of one length, so that the nearest one in distance is the one of largest product; the tree
clusters those. It is fitted on about ``max_fit`` distinct vectors, those of the smallest
hash; every vector is then put into a leaf. A query walks the tree with a priority
queue of nodes by distance. How many leaves it visits is calibrated: about
``calibration`` queries are compared with all vectors, and visits widen until the mean
recall reaches ``recall``. A query that has not met k vectors by then goes on.

Leaves that are neighbours in the tree share a group of about BLOCK_ROWS rows. A
query goes once to each group that has a leaf it visits, with those leaves. Groups are
searched in blocks of rows and of queries of bounded size, so no leaf, however many
equal vectors it holds, is one task's work. Scores are inner products of the original
vectors in double precision, added up in one order, so equal vectors tie exactly.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor those of another length than most (ties: the longer). Null ids take no part.
Every row is a candidate, also one that repeats another, except for queries of its id.
A query that repeats, id and vector, asks once. Different vectors of one id ask each
for itself; ``query_hash``, of the vector, tells them apart. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import share_below, work_table
from quern.llm.words import small_batches, trimmed

K, EVERY = 20, 20
BLOCK_ROWS, BLOCK_QUERIES = 2048, 8192
FOUND = "query_id long, query_hash long, ids binary, scores binary"
RESULT = "query_id long, rank int, vec_id long, score double, query_hash long"


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, score) of each query's k best, in order.

    A matrix product finds what comes near the k best; their scores are then added up
    in one order wherever the vectors stand, so equal vectors tie exactly.
    """
    rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    cut = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
    floor = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), -np.inf)
    q, r = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
    return firsts(q, r, np.einsum("id,id->i", queries[q], rows[r], optimize=False), ids[r], k)


def firsts(q: np.ndarray, r: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of the highest scores of each q, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, r, scores = q[order], r[order], scores[order]
    kept = places(q) < k
    return q[kept], r[kept], scores[kept]


def places(q: np.ndarray) -> np.ndarray:
    """The place of each item within its run of equal ones."""
    head = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return np.arange(len(q)) - head


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of x, at most k and all used, by Lloyd's rounds from spread-out starts."""
    centres = x[rng.integers(len(x))][None]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 1e-12:
        centres = np.vstack([centres, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        home = _closest(x, centres)
        used = np.unique(home)
        centres = np.stack([x[home == j].mean(0) for j in used])
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


# A tree is plain data, as it is broadcast: (longest, nodes), where a node is (centres, children), and a child another node or -1 - leaf.


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1, keepdims=True), 0))])


def grown(sample: np.ndarray, longest: float, rows_each: float, branch: int, leaf_rows: int, seed: int = 4) -> tuple[tuple, int]:
    """The tree of a sample, each vector of which stands for rows_each, and the number of its leaves."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    least = max(8.0, leaf_rows / max(rows_each, 1e-9))

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        if len(x) > least:
            centres = _kmeans(x, int(min(branch, max(2, np.ceil(len(x) / least)))), rng)
            if len(centres) > 1:
                at, home = len(nodes), _closest(x, centres)
                nodes.append((centres, []))
                for j in range(len(centres)):
                    nodes[at][1].append(grow(x[home == j]))
                return at
        leaves += 1
        return -leaves

    x = lifted(sample, longest)
    grow(x)
    if not nodes:
        nodes, leaves = [(x.mean(0)[None] if len(x) else np.zeros((1, sample.shape[1] + 1)), [-1])], 1
    return (longest, nodes), leaves


def homes_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    longest, nodes = tree
    x, out = lifted(x, longest), np.zeros(len(x), np.int32)
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        centres, children = nodes[node]
        near = _closest(x[at], centres)
        for j, child in enumerate(children):
            own = at[near == j]
            if len(own) and child < 0:
                out[own] = -1 - child
            elif len(own):
                stack.append((child, own))
    return out


def visits(tree: tuple, query: np.ndarray) -> Iterator[int]:
    """Leaves, best bin first."""
    nodes, q = tree[1], np.append(query, 0.0)
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        if node < 0:
            yield -1 - node
            continue
        centres, children = nodes[node]
        for d, child in zip(((centres - q) ** 2).sum(1), children, strict=True):
            heapq.heappush(heap, (float(d), child))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v in single precision if it is given so."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of vectors as one row, which a driver gathers in little memory."""
    for b in batches:
        if b.num_rows:
            ids = b.column("vec_id").to_numpy().tobytes() if "vec_id" in b.schema.names else b""
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([_matrix(b.column("v")).tobytes()], pa.binary())], names=["ids", "v"])


def _gathered(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of few rows, on the driver."""
    packs = rows.mapInArrow(trimmed(_packed), "ids binary, v binary").collect()
    x = np.concatenate([np.zeros((0, width)), *(np.frombuffer(p["v"]).reshape(-1, width) for p in packs)])
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p["ids"], np.int64) for p in packs)]), x


def _smallest(x: np.ndarray, most: int) -> np.ndarray:
    """The order of at most ``most`` vectors, by hash."""
    return np.argsort(np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in x], np.uint64), kind="stable")[:most]


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            if b.num_rows:
                leaf = homes_of(tree, _matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return run


def _brute(shared, k: int):
    """(query, vec_id, score, leaf): the k nearest of each calibration query within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        for b in batches:
            if b.num_rows == 0:
                continue
            rows, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            q, r, scores = nearest(queries, ids, _matrix(b.column("v")), rows, k)
            kept = [np.concatenate(x) for x in zip(kept, (q, rows[r], scores, leaf[r]), strict=True)]
            _, at, _ = firsts(kept[0], np.arange(len(kept[0])), kept[2], kept[1], k)
            kept = [x[at] for x in kept]
        q, rows, scores, leaf = kept
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rows), pa.array(scores), pa.array(leaf.astype(np.int32))], names=["query", "vec_id", "score", "leaf"])

    return run


def calibrated(homes: DataFrame, tree: tuple, leaves: int, ids: np.ndarray, vectors: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """How many leaves to visit, and the recall that the queries given then have."""
    if not len(ids):
        return 1, 1.0
    shared = homes.sparkSession.sparkContext.broadcast((ids, vectors))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    exact = homes.mapInArrow(trimmed(_brute(shared, k)), "query long, vec_id long, score double, leaf int").withColumn("rank", F.row_number().over(order))
    wanted: dict[int, list[int]] = {}
    for r in exact.where(F.col("rank") <= k).select("query", "leaf").collect():
        wanted.setdefault(r["query"], []).append(r["leaf"])
    shared.destroy()
    found, total = np.zeros(leaves), 0
    for q, v in enumerate(vectors):
        if mine := wanted.get(q, []):
            place = {leaf: i for i, leaf in enumerate(visits(tree, v))}
            total += 1
            for leaf in mine:
                found[place[leaf]] += 1 / len(mine)
    reached = np.cumsum(found) / max(1, total)
    n = min(int(np.searchsorted(reached, recall - 1e-12)) + 1, leaves)
    return n, float(reached[n - 1]) if total else 1.0


def _visiting(shared, sizes: np.ndarray, group: np.ndarray, n: int, k: int):
    """Queries to (query_id, query_hash, q, group, leaves): a row for each group that holds a leaf to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            at, groups, leaves = [], [], []
            for i, v in enumerate(_matrix(b.column("v"))) if b.num_rows else ():
                met, mine = 0, {}
                for j, leaf in enumerate(visits(tree, v)):
                    if j >= n and met > k:
                        break
                    if sizes[leaf]:
                        met += sizes[leaf]
                        mine.setdefault(int(group[leaf]), []).append(leaf)
                at += [i] * len(mine)
                groups += mine.keys()
                leaves += mine.values()
            part = b.take(pa.array(at, pa.int64()))
            columns = [part.column("vec_id"), part.column("query_hash"), part.column("v"), pa.array(groups, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query_hash", "q", "group", "leaves"])

    return run


def _searched(k: int, step: int = 512):
    """A block of rows and one of queries to a row for each query: its k best in the leaves it visits there."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_hash", "ids", "scores"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            rows, ids, leaf = _matrix(left.column("v")), left.column("vec_id").to_numpy(), left.column("leaf").to_numpy()
            queries, asked, hashes = _matrix(right.column("q")), right.column("query_id").to_numpy(), right.column("query_hash").to_numpy()
            lists = right.column("leaves").combine_chunks()
            to = lists.flatten().to_numpy()
            who = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for one in np.unique(leaf):
                here, askers = np.flatnonzero(leaf == one), who[to == one]
                for a in range(0, len(askers), step):
                    some = askers[a : a + step]
                    q, r, scores = nearest(queries[some], asked[some], rows[here], ids[here], k)
                    best = [np.concatenate(x) for x in zip(best, (some[q], here[r], scores), strict=True)]
                if len(best[0]) > 4 * k * max(step, len(asked)):
                    best = list(firsts(*best, ids[best[1]], k))
            q, r, scores = firsts(*best, ids[best[1]], k)
            ends = np.searchsorted(q, np.arange(len(asked) + 1))
            for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if y > x:
                    for column, value in zip(out, (int(asked[i]), int(hashes[i]), ids[r[x:y]].tobytes(), scores[x:y].tobytes()), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return search


def _merged(k: int):
    """A partition by query of what blocks found, to the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        asked = np.stack([t.column(c).to_numpy() for c in ("query_id", "query_hash")], 1)
        queries, inverse = np.unique(asked, axis=0, return_inverse=True)
        ids = [np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()]
        scores = np.frombuffer(b"".join(t.column("scores").to_pylist()), float)
        query = np.repeat(inverse.ravel(), [len(x) for x in ids])
        ids = np.concatenate(ids)
        q, r, scores = firsts(query, np.arange(len(ids)), scores, ids, k)
        columns = [queries[q, 0], (places(q) + 1).astype(np.int32), ids[r], scores, queries[q, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "rank", "vec_id", "score", "query_hash"])

    return run


def grouped(sizes: np.ndarray, most: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The group of each leaf, of about ``most`` rows or one leaf, and in how many parts of rows each leaf's group is dealt."""
    group, rows = np.zeros(len(sizes), np.int32), []
    for leaf, n in enumerate(sizes.tolist()):
        if not rows or rows[-1] + n > most:
            rows.append(0)
        rows[-1] += n
        group[leaf] = len(rows) - 1
    return group, np.maximum(1, -(-np.array(rows, np.int64) // most))


def _of(place: Column, table: np.ndarray) -> Column:
    return F.element_at(F.lit([int(x) for x in table]), place + 1)


def search(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    max_fit: int = 20_000,
    branch: int = 16,
    leaf_rows: int = 512,
    recall: float = 0.93,
    calibration: int = 200,
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash): the k nearest of each row whose id is divisible by every.

    To the driver go about 1.3 x max_fit distinct vectors, 1.3 x calibration queries, and a
    number for each leaf, of which there are max_fit / 8 at most.
    """
    rows = usable(vectors)
    spark = rows.sparkSession
    small_batches(spark)
    total, longest, distinct, width = rows.agg(
        F.count(F.lit(1)),
        F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))),
        F.approx_count_distinct(F.xxhash64("v"), 0.02),
        F.coalesce(F.max(F.size("v")), F.lit(1)),
    ).first()
    drawn = rows.where(F.xxhash64("v") < share_below(1.3 * max_fit / max(1, distinct))).select("v").distinct()
    _, x = _gathered(drawn, width)
    x = x[_smallest(x, max_fit)]
    tree, leaves = grown(x, longest or 0.0, total / max(1, len(x)), branch, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)
    homes = rows.mapInArrow(trimmed(_homes(shared)), f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, leaf int")
    homes = work_table(homes.withColumn("row", F.monotonically_increasing_id()), "ann-homes")
    sizes = np.zeros(leaves, np.int64)
    for r in homes.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r["leaf"]] = r["count"]
    queries = homes.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").distinct().withColumn("query_hash", F.xxhash64("v"))
    asked = queries.count()
    some = queries.where(F.xxhash64("vec_id", "v") < share_below(1.3 * calibration / max(1, asked))).select("vec_id", "v")
    ids, v = _gathered(some, width)
    at = _smallest(v, calibration)
    n, _ = calibrated(homes, tree, leaves, ids[at], v[at], k, recall)

    group, parts = grouped(sizes)
    query_parts = max(1, -(-asked // BLOCK_QUERIES))
    visited = queries.mapInArrow(
        trimmed(_visiting(shared, sizes, group, n, k)), f"query_id long, query_hash long, q {rows.schema['v'].dataType.simpleString()}, group int, leaves array<int>"
    )
    all_parts = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = homes.withColumn("group", _of(F.col("leaf"), group))
    left = left.withColumn("row_part", F.pmod(F.xxhash64("row"), _of(F.col("group"), parts)).cast("int")).drop("row")
    left = left.withColumn("query_part", all_parts(F.lit(int(query_parts))))
    right = visited.withColumn("query_part", F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(int(query_parts))).cast("int"))
    right = right.withColumn("row_part", all_parts(_of(F.col("group"), parts).cast("int")))
    keys = ("group", "row_part", "query_part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k), FOUND)
    return found.repartition("query_id", "query_hash").mapInArrow(trimmed(_merged(k)), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of every twentieth vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
