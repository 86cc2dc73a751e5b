"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its three
letters' vectors, each permuted by its place; a text's vector bundles those of its
trigrams, a language's prototype those of all its training texts. A text gets the
language whose prototype has the largest cosine to it.

Since cosines are linear in the counts, each trigram's products with the
prototypes are tabled once: 64 letter classes make 2^18 trigrams, so that what is
counted, collected and broadcast is bounded by the number of languages: of BLOCK of
them at once in a task. Trigram vectors are almost orthogonal, so a text's length is
taken to be that of its counts; ``score`` is the cosine up to that.

Only the text is an input of a prediction. Prototypes come from all rows that are
not held out and have a language. Texts that are null or have no letter, and all
texts if nothing was learned, are ``und`` with score 0. Ties go to the language
that sorts first. Texts are read whole, however long. Repeated rows get equal results. Extra columns stay; those named
like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quern.llm.common import documents, held_out, replacing
from quern.llm.words import merged, small_batches, trimmed, with_columns

CLASSES, GRAMS = 64, 1 << 18
DIMENSIONS = 2048
#: Languages that are counted, broadcast and compared at once: 1 MB each.
BLOCK = 128
#: Bytes of texts that are compared with a block at once, where there are several.
GROUP = 32 << 20


def letter_classes() -> np.ndarray:
    """Code point to class: 0 no letter, 1-26 a-z, 27-63 other letters."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x40000):  # no letters are assigned beyond
        if chr(c).isalpha():
            table[c] = 27 + c % 37
    table[97:123] = np.arange(1, 27)
    return table


def trigrams(text: str | None, table: np.ndarray) -> np.ndarray:
    """Codes of the trigrams of a text; runs of other characters are one blank. None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], table[points], [0]]).astype(np.int64)
    kept = np.ones(len(s), bool)
    kept[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s = s[kept]
    if not s.any():
        return np.zeros(0, np.int64)
    return (s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within the task for up to BLOCK languages at once."""
    table, sums = letter_classes(), {}

    def flushed():
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            code = trigrams(text, table)
            if len(code):
                if lang not in sums and len(sums) >= BLOCK:
                    yield from flushed()
                np.add.at(sums.setdefault(lang, np.zeros(GRAMS, np.int64)), code, 1)
    yield from flushed()


def bound_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: each letter's vector turned by its place, multiplied."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[codes // CLASSES**2] * second[codes // CLASSES % CLASSES] * letters[codes % CLASSES]


def profiles(counts: dict[str, tuple[np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS, seed: int = 8) -> tuple[list[str], np.ndarray]:
    """(languages, each trigram's product with each of their prototypes, over the length of a trigram's vector)."""
    languages = sorted(counts)
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (CLASSES, dimensions))
    prototypes = np.zeros((len(counts), dimensions), np.float32)
    for row, name in zip(prototypes, languages, strict=True):
        grams, n = counts[name]
        share = (n / np.sqrt((n.astype(float) ** 2).sum())).astype(np.float32)
        for a in range(0, len(grams), 8192):
            row += share[a : a + 8192] @ bound_vectors(grams[a : a + 8192], letters)
        row /= np.sqrt((row**2).sum())
    products = np.zeros((GRAMS, len(counts)), np.float32)
    for a in range(0, GRAMS, 8192):
        products[a : a + 8192] = bound_vectors(np.arange(a, a + 8192), letters) @ prototypes.T
    return languages, products / np.float32(np.sqrt(dimensions))


def predict(code: np.ndarray, languages: list[str], products: np.ndarray) -> tuple[str, float]:
    """The language of largest cosine to a text's trigrams, and that cosine."""
    grams, n = np.unique(code, return_counts=True)
    cosine = (n @ products[grams]) / np.sqrt((n.astype(float) ** 2).sum())
    best = int(np.argmax(cosine))
    return languages[best], float(cosine[best])


def learn(docs: DataFrame, **options) -> list[tuple[list[str], np.ndarray]]:
    """The profiles of all languages, in blocks of BLOCK, in the languages' order."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInArrow(trimmed(_counted), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for k, g in sums.sort_values(["lang", "gram"]).groupby("lang")}
    names = sorted(counts)
    return [profiles({k: counts[k] for k in names[i : i + BLOCK]}, **options) for i in range(0, len(names), BLOCK)]


def identify(docs: DataFrame, learned: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """docs with lang_pred and score, the cosine, from 0 to 1."""
    blocks = [docs.sparkSession.sparkContext.broadcast(x) for x in learned]

    def make():
        table = letter_classes()

        def of(batch: pa.RecordBatch) -> list:
            best = [("und", 0.0)] * batch.num_rows
            for j, shared in enumerate(blocks):
                languages, products = shared.value
                for i, text in enumerate(batch.column("text").to_pylist()):
                    code = trigrams(text, table)
                    if len(code):
                        found = predict(code, languages, products)
                        best[i] = found if j == 0 or found[1] > best[i][1] else best[i]
                if len(blocks) > 1 and shared._path is not None:  # read from its file again when next used
                    shared.__dict__.pop("_value", None)
            return [pa.array([x for x, _ in best], pa.string()), pa.array([min(1.0, max(0.0, x)) for _, x in best], pa.float64())]

        return of

    return with_columns(docs, {"lang_pred": StringType(), "score": DoubleType()}, make, regroup=iter if len(blocks) < 2 else merged(GROUP))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of every document."""
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "lang", "text")))
    return replacing(out, {"held_out": held_out(F.col("doc_id"))}).select("doc_id", "held_out", "lang_pred", "score")
