"""Toxicity: class-conditional Kneser-Ney models of words and letters.

Two models, of toxic and of ordinary documents, give each word a log-likelihood, and
their difference. As a whole word: a class's discounted count, and for the mass that discounting
saves the shared model, which is the discounted count of both classes together, and for what that saves the
probability of the word's letters in both classes. So a rare expression that only one
class has seen, or none, falls back on the same ground in the other; each class's probabilities
of all words sum to 1. As letters: interpolated Kneser-Ney models of four letters
within words by class, which share the counts of the two lowest orders. A document's score
comes from its length-normalised differences, over the whole text and over its most
toxic passages of a few words, through a logistic curve; as the highest of many passages is higher
than that of few, the curve also knows how many words there are.

The counts cover every labelled training document. They are summed in Spark by
four-letter code, of 20 bits, and for words by the 64-bit hash of the word: each
distinct word keeps its own exact count, so the word counts grow with the input. They
pass through the driver in parts of ``PART`` words, each broadcast by itself. A task
reads one part after the other and keeps only the counts of the words of its present
texts, so no process holds all of them. The letters take 4 MB, two half-precision
numbers a code. The curve is fitted on at most about ``max_curve`` labelled training
documents, half of either class where there are as many, which a first model did not
count; each stands for as many of its class as were there for one drawn.

Only the text is an input of a score. Training labels are taken from rows that are
not held out; a document of several labels counts once for each. Null texts are
empty texts. A very long text is read whole, by one task. Null ids are never labelled. Without labels of both classes each
score is 0. Repeated rows get equal results. Extra columns stay; those named like
an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from quern.llm.common import documents, held_out, replacing
from quern.llm.words import merged, slices, small_batches, trimmed, with_columns

BITS, ORDER, DISCOUNT = 5, 4, 0.75
LETTERS = 1 << BITS
CODES = 1 << (BITS * ORDER)
#: Words in a passage.
PASSAGES = (1, 4, 24)
#: Kinds of counted documents: ordinary, toxic, and the same among those that fit the curve. The words' rows have kind + KINDS.
KINDS = 4
#: Words in a broadcast part of the counts, of 24 bytes each.
PART = 1 << 20
THRESHOLD = 0.7
FEATURES = 2 * (len(PASSAGES) + 1) + 1
#: Rows of labels up to which they are broadcast: 16 bytes each.
MOST_BROADCAST = 2_000_000
#: Words whose counts or differences a task keeps, about.
MOST_CACHED = 100_000
MOST_KNOWN = 250_000
#: Bytes of text that a task takes at once, and for which it reads the parts of the counts once.
SLICE, GROUP = 2 << 20, 32 << 20


def alphabet() -> np.ndarray:
    """Code point to symbol: 0 the edge of a word, 1-26 a-z, 27-30 other letters, 31 all else."""
    table = np.full(0x110000, 31, np.uint8)
    points = np.arange(0x80, 0x110000)
    table[0x80:] = 27 + points % 4
    for i in range(26):
        table[97 + i] = i + 1
    return table


def coded(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four-letter sequences of all words, and where each word's begin."""
    text = "\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = points == 0
    s = np.where(edge, 0, table[points]).astype(np.int64)
    ends = np.flatnonzero(edge)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    code = s.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(s)
        before[k:] = s[:-k]
        code |= np.where(place >= k, before, 0) << (BITS * k)
    return code, starts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, kind) to (code, kind, n), summed within the task; of words the hash, with kind + KINDS."""
    table, words = alphabet(), {}

    def flushed():
        for kind, counts in words.items():
            if not counts:
                continue
            code, starts = coded(list(counts), table)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            each = np.repeat(n, np.diff(np.append(starts, len(code))))
            found, inverse = np.unique(code, return_inverse=True)
            total = np.bincount(inverse, each).astype(np.int64)
            for key, kinds, sums in ((found, kind, total), (hashes(list(counts)).view(np.int64), kind + KINDS, n)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), kinds, np.int32)), pa.array(sums)], names=["code", "kind", "n"])
        words.clear()

    for batch in (x for whole in batches for x in slices(whole, "text", SLICE)):
        for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            words.setdefault(kind, Counter()).update(plain_words(text))
        if sum(map(len, words.values())) > MOST_CACHED:
            yield from flushed()
    yield from flushed()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of counts as one row, which a driver gathers in little memory."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=b.schema.names)


#: ASCII that is neither letter nor digit parts words.
PARTED = {c: 32 for c in range(128) if not chr(c).isalnum()}


def plain_words(text: str | None) -> list[str]:
    return (text or "").lower().translate(PARTED).split()


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class WordCounts:
    """The counts of all words by kind, in broadcast parts, and of each kind their sum."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts, self.waiting, self.size = spark, [], [], 0
        #: of each kind all counts; of the early ones and of all, the distinct words of either class and of both
        self.totals, self.distinct = np.zeros(KINDS), np.zeros((2, 3))

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        """Words not added before, by hash, with a row of counts for each kind."""
        self.totals += n.sum(1)
        for row, early in zip(self.distinct, (False, True), strict=True):
            seen = chosen(n, early) > 0
            row += [*seen.sum(1), seen.any(0).sum()]
        self.waiting.append((key, n.astype(np.float32)))
        self.size += len(key)
        if self.size >= PART:
            self.flush()

    def flush(self) -> None:
        if self.size:
            key, n = np.concatenate([k for k, _ in self.waiting]), np.hstack([n for _, n in self.waiting])
            order = np.argsort(key)
            self.parts.append(self.spark.sparkContext.broadcast((key[order], n[:, order])))
        self.waiting, self.size = [], 0


def chosen(n: np.ndarray, early: bool) -> np.ndarray:
    """The counts of ordinary and of toxic documents: of all, or of those only that do not fit the curve."""
    return n[:2] if early else n[:2] + n[2:]


def counts_of(words: list[str], parts: list, early: bool = False) -> np.ndarray:
    """The exact count of each word in ordinary and in toxic documents."""
    h = hashes(words)
    order = np.argsort(h)
    sought, out = h[order], np.zeros((2, len(words)))
    for part in parts:
        key, n = part.value
        at = np.searchsorted(key, sought)
        at[at == len(key)] = 0
        hit = key[at] == sought
        out[:, order[hit]] = chosen(n[:, at[hit]], early)
        if part._path is not None:  # read from its file again when next used
            part.__dict__.pop("_value", None)
        del key, n
    return out


class Model:
    """For each code the difference of log-likelihoods of its last letter, toxic less ordinary, its log-likelihood
    in both classes together, and what all word counts come to.
    """

    def __init__(self, letters: np.ndarray, totals: np.ndarray, distinct: np.ndarray):
        """letters: a row of counts by code for the ordinary and for the toxic documents; distinct: words of either and of both."""
        self.table, self.shared = np.zeros(CODES, np.float16), np.zeros(CODES, np.float16)
        self.totals = np.maximum([*totals, totals.sum()], 1)
        #: the share of probability that discounting saves, in either class and in both together
        self.saved = DISCOUNT * distinct / self.totals
        both = [(at := np.flatnonzero(n), n[at]) for n in (letters[1], letters[0], letters.sum(0))]
        self.trained = all(len(c) > 0 for c, _ in both)
        if not self.trained:
            return
        three = np.unique(both[2][0] & (LETTERS**3 - 1))
        two, seen = _continued(three, 2)
        one, ends = _continued(two, 1)
        p1 = np.full(LETTERS, 0.5)
        p1[one] += ends
        p1 /= p1.sum()
        p2 = _interpolated(_dense(two, seen, 2), p1)
        levels = []
        for top, counts in both:
            below = {ORDER: (top, counts)}
            for order in range(ORDER - 1, 2, -1):
                below[order] = _continued(below[order + 1][0], order)
            p = p2
            for order in range(3, ORDER):
                p = _interpolated(_dense(*below[order], order), p)
            levels.append((top, counts, p))
        block = CODES // 32
        for start in range(0, CODES, block):
            logs = []
            for top, n, p in levels:
                a, b = np.searchsorted(top, [start, start + block])
                counts = np.zeros(block, np.float32)
                counts[top[a:b] - start] = n[a:b]
                logs.append(np.log(_interpolated(counts, p, start)))
            self.table[start : start + block] = logs[0] - logs[1]
            self.shared[start : start + block] = logs[2]

    def logs(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words in the ordinary and in the toxic class, from their counts there and their letters' in both."""
        counts = np.vstack([counts, counts.sum(0)])
        kept = np.maximum(counts - DISCOUNT, 0) / self.totals[:, None]
        p = kept[2] + self.saved[2] * np.exp(np.maximum(spelled, -600.0))
        return np.log(kept[:2] + self.saved[:2, None] * p)


def restored(data: dict) -> Model:
    """A model from its plain data, as which it is broadcast: executors need not have this module."""
    model = Model.__new__(Model)
    vars(model).update(data)
    return model


def _continued(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` letters of distinct codes, and before how many letters each stands."""
    return np.unique(codes & (LETTERS**order - 1), return_counts=True)


def _dense(codes: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    out = np.zeros(LETTERS**order, np.float32)
    out[codes] = n
    return out


def _interpolated(counts: np.ndarray, lower: np.ndarray, start: int = 0) -> np.ndarray:
    """Kneser-Ney probabilities of the last letter, for codes from start on, given those of the order below."""
    c = counts.reshape(-1, LETTERS)
    total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
    at = (np.arange(start, start + len(counts)) % len(lower)).reshape(c.shape)
    base = lower[at].astype(np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * base) / total
    return np.where(total > 0, p, base).ravel().astype(np.float32)


class Places(dict):
    """Word to its place, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Reader:
    """Texts to features, with the differences of words kept for the task."""

    def __init__(self, model: Model, parts: list, early: bool = False):
        self.model, self.parts, self.early, self.letters = model, parts, early, alphabet()
        self.known, self.values = Places(), np.zeros((0, 2))

    def learn(self) -> None:
        """Makes sure that self.values has the differences of all words of self.known."""
        new = list(islice(self.known, len(self.values), None))
        if not new:
            return
        counts = counts_of(new, self.parts, self.early)
        step = MOST_CACHED
        self.values = np.vstack([self.values, *(self.differences(new[i : i + step], counts[:, i : i + step]) for i in range(0, len(new), step))])

    def differences(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Of each word the difference of its letters, and its own as a whole."""
        code, starts = coded(words, self.letters)
        spelled, shared = (np.add.reduceat(table[code].astype(np.float64), starts) for table in (self.model.table, self.model.shared))
        if not self.model.trained:
            return np.stack([spelled, spelled], 1)
        ordinary, toxic = self.model.logs(counts, shared)
        return np.stack([spelled, toxic - ordinary], 1)

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        """For either model the mean over all words and the highest means over passages; the log of the length."""
        out = np.zeros((len(texts), FEATURES))
        for i, places in enumerate(texts):
            if not len(places):
                continue
            d = self.values[places]
            upto = np.vstack([np.zeros((1, 2)), np.cumsum(d, 0)])
            values = [upto[-1] / len(d)]
            for width in PASSAGES:
                values.append((upto[width:] - upto[:-width]).max(0) / width if len(d) > width else upto[-1] / width)
            out[i, :-1] = np.concatenate(values)
            out[i, -1] = np.log1p(len(d))
        return out

    def over(self, batch: pa.RecordBatch) -> np.ndarray:
        parts, texts, size = [np.zeros((0, FEATURES))], [], 0

        def flush():
            self.learn()
            parts.append(self.features(texts))
            texts.clear()
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
                self.values = np.zeros((0, 2))

        for part in slices(batch, "text", SLICE):
            for text in part.column("text").to_pylist():
                words = plain_words(text)
                texts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            size += SLICE
            if size >= GROUP or len(self.known) > MOST_KNOWN:
                flush()
                size = 0
        flush()
        return np.vstack(parts)


class Curve:
    """Logistic regression with a ridge on standardised features, by Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: dict[int, int], ridge: float = 1.0):
        """sizes: how many rows of each class x and y were drawn from, for which those drawn stand."""
        weight = np.array([sizes[v] / (y == v).sum() for v in y.tolist()])
        self.mean, self.spread = np.zeros(x.shape[1]), np.ones(x.shape[1])
        if len(x):
            self.mean = np.average(x, 0, weight)
            self.spread = np.sqrt(np.average((x - self.mean) ** 2, 0, weight)) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        if len(set(y.tolist())) < 2:
            self.w[-1] = 50.0 if len(y) and y[0] else -50.0
            return
        z = self.scaled(x)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (y - p)) - penalty * self.w
            self.w += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), g)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scaled(x) @ self.w, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, max_curve: int = 6000) -> tuple[Model, list, Curve]:
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    few = marked.count() <= MOST_BROADCAST
    plain = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    rows = plain.join(F.broadcast(marked) if few else marked, "doc_id")
    later = F.crc32(F.concat(F.lit("curve"), F.col("doc_id").cast("string"))) % 4 == 0
    kind = F.col("toxic") + 2 * later.cast("int")
    counted = rows.select("text", kind.alias("kind")).mapInArrow(trimmed(_counted), "code long, kind int, n long")
    each = [F.sum(F.when(F.col("kind") % KINDS == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(KINDS)]
    sums = counted.groupBy("code", (F.col("kind") >= KINDS).alias("word")).agg(*each)
    packed = sums.mapInArrow(trimmed(_packed), ", ".join(f"{c} binary" for c in sums.columns))
    letters, words = np.zeros((KINDS, CODES)), WordCounts(spark)
    for row in packed.toLocalIterator(prefetchPartitions=True):
        code, word = np.frombuffer(row["code"], np.int64), np.frombuffer(row["word"], bool)
        n = np.stack([np.frombuffer(row[f"n{k}"], np.int64) for k in range(KINDS)])
        letters[:, code[~word]] += n[:, ~word]
        words.add(code[word].view(np.uint64), n[:, word])
    words.flush()
    early, model = (Model(chosen(letters, x), chosen(words.totals, x), words.distinct[int(x)]) for x in (True, False))
    early = spark.sparkContext.broadcast(vars(early))
    held = rows.where(later)
    held = held.withColumn("order", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    drawn = F.lit(False)
    for toxic, size in sizes.items():
        least = min(1.0, 1.3 * max_curve / 2 / size)
        # those of the smallest hash
        smallest = F.col("order") < F.lit(int(-(1 << 63) + least * (1 << 64))) if least < 1 else F.lit(True)
        drawn = drawn | ((F.col("toxic") == toxic) & smallest)
    scored = _with_features(held.where(drawn), early, words.parts).select("features", "toxic").limit(2 * max_curve).collect()
    x = np.array([r["features"] for r in scored]).reshape(len(scored), FEATURES)
    curve = Curve(x, np.array([r["toxic"] for r in scored], float), sizes)
    early.destroy()
    del early
    return model, words.parts, curve


def _with_features(df: DataFrame, shared, parts: list) -> DataFrame:
    def make():
        reader = Reader(restored(shared.value), parts, early=True)

        def of(batch: pa.RecordBatch) -> list:
            x = reader.over(batch)
            return [pa.array(x.tolist(), pa.list_(pa.float64()))]

        return of

    return with_columns(df, {"features": ArrayType(DoubleType())}, make, regroup=merged(GROUP))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs with score, from 0 to 1, and predicted, 1 where the score reaches threshold."""
    model, parts, curve = train(docs, labels, **options)
    shared, trained = docs.sparkSession.sparkContext.broadcast(vars(model)), model.trained

    def make():
        reader = Reader(restored(shared.value), parts)

        def of(batch: pa.RecordBatch) -> list:
            x = reader.over(batch)
            p = curve(x) if trained else np.zeros(len(x))
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]

        return of

    return with_columns(docs, {"score": DoubleType(), "predicted": IntegerType()}, make, regroup=merged(GROUP))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the toxicity of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return replacing(out.select("doc_id", "score", "predicted"), {"held_out": held_out(F.col("doc_id"))}).select("doc_id", "held_out", "score", "predicted")
