"""Operators that SQL cannot express, against brute force; hot groups; executors that have no copy of the package."""

import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, common, decontamination, language, mixing, urls

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


# --- nearest neighbours ---


def test_search_of_repeated_rows(spark):
    """Repeated queries ask once, different vectors of an id each for itself, equal scores go by id, every row is a candidate."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(1)
    rows = [(i, x[i].tolist(), "a") for i in range(300)]
    rows += rows[:60] + [(20, x[21].tolist(), "b"), (None, x[5].tolist(), "c"), (40, [1.0] * 6, "d"), (41, [1.0] * 6, "e"), (42, [1.0] * 6, "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(df, k=7, leaf_rows=40, recall=1.0).collect():
        got.setdefault((r.query_id, r.query_hash), []).append((r["rank"], r.vec_id, r.score))
    there = [(i, np.array(v)) for i, v, _ in rows if i is not None]
    asked = {(i, tuple(v)) for i, v in ((i, v.tolist()) for i, v in there) if i % 20 == 0}
    assert len(got) == len(asked) == 17
    found = Counter()
    for i, v in asked:
        best = sorted((-float(np.einsum("d,d->", w, np.array(v))), j) for j, w in there if j != i)[:7]
        found[tuple((k + 1, j, round(-s, 9)) for k, (s, j) in enumerate(best))] += 1
    assert Counter(tuple((k, j, round(s, 9)) for k, j, s in sorted(a)) for a in got.values()) == found


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_of_nothing_and_of_few(spark, kind):
    schema = f"vec_id long, embedding array<{kind}>, score string"
    assert ann.search(spark.createDataFrame([], schema)).collect() == []
    few = [(0, [1.0, 0.0], "x"), (20, [0.5, 0.5], "y"), (3, [0.0, 0.0], "z"), (4, [float("inf"), 1.0], "z"), (5, None, "z"), (6, [1.0], "z")]
    got = ann.search(spark.createDataFrame(few, schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]


def test_a_hot_vector_is_dealt_to_blocks():
    group, parts = ann.grouped(np.array([10, 20000, 5, 8000, 300]), 8192)
    assert group.tolist() == [0, 1, 2, 2, 3] and parts.tolist() == [1, 3, 1, 1]


# --- decontamination ---


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"W{rng.integers(0, 30)}"
    items = [(i % 9 if i % 7 else None, " ".join(word() for _ in range(rng.integers(0, 30)))) for i in range(40)] + [(50, None), (51, "w1 w2"), (51, "w1 w2")]
    docs = [(i, ", ".join([*(word() for _ in range(rng.integers(0, 30))), (items[rng.integers(0, 40)][1] or "").lower()])) for i in range(60)] + [(None, None), (99, ""), (98, "w1-W2! w3")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    want = []
    for i, t in docs:
        w = words(t)
        hit, met = set(), set()
        for key, ids in windows.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    met |= ids - {None}
        want.append((str(i), len(w), len(hit), sorted(map(str, met)), bool(hit) and 20 * len(hit) >= len(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 300):
        got = decontamination.find_contamination(d, b, block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == sorted(want)


def test_memory_of_a_block():
    """A block takes few bytes for each byte of benchmark text."""
    rng = np.random.default_rng(3)
    items = [(str(i), " ".join(f"word{x}" for x in rng.integers(0, 50_000, 400)).encode()) for i in range(400)]
    words, starts, names, windows = decontamination.packed(items, 13)
    size = words.nbytes + starts.nbytes + sum(a.nbytes for w in windows.values() for a in w)
    assert size <= 5 * sum(len(t) for _, t in items)


# --- language ---


def test_language_equals_bundles_of_vectors(spark):
    """The tabled products give the cosines of vectors that are bound and bundled one by one."""
    docs = [(0, "ab ba abba", "x"), (3, "cd dc cddc", "y"), (5, "é ab", "x"), (2, "ab cd", None), (9, "zz", "z"), (None, "dddd", "y"), (8, "123 !", "x"), (6, "\U00031360 \U00031361", "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = language.learn(df, dimensions=256, seed=3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, learned).collect()}
    table, dim = language.letter_classes(), 256
    letters = np.random.default_rng(3).choice(np.array([-1, 1], np.float32), (64, dim)).astype(float)

    def bundle(text):
        s = [0] + [int(table[ord(c)]) for c in text.lower()] + [0]
        s = [c for i, c in enumerate(s) if i == 0 or c or s[i - 1]]
        out, counts = np.zeros(dim), Counter(zip(s, s[1:], s[2:]))
        for (a, b, c), n in counts.items():
            out += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out, np.sqrt(dim * sum(n * n for n in counts.values()))

    held = {r[0] for r in df.where(common.held_out(df["doc_id"])).select("doc_id").collect()}
    sums = {}
    for i, text, lang in docs:
        if i not in held and lang and any(table[ord(c)] for c in text.lower()):
            sums[lang] = sums.get(lang, 0) + bundle(text)[0]
    for i, text, _ in docs:
        if not any(table[ord(c)] for c in text.lower()):
            assert got[i] == ("und", 0.0)
            continue
        v, size = bundle(text)
        cosine = {k: float(v @ p / np.linalg.norm(p) / size) for k, p in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i][0] == best and abs(got[i][1] - min(1, max(0, cosine[best]))) < 1e-4


def test_languages_in_blocks(spark, monkeypatch):
    docs = [(3 * i + 2, " ".join(chr(97 + i) * 2 + chr(97 + j) for j in range(26)), f"l{i:02}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    shown = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in language.identify(df, language.learn(df)).collect())
    whole = shown()
    monkeypatch.setattr(language, "BLOCK", 3)
    assert len(language.learn(df)) >= 3
    assert shown() == whole


# --- mixing ---


def filled(sizes, weights, share, cap):
    """Water filling, one source after the other."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    left, free, out = share * sum(sizes.values()), set(keys), {}
    while free:
        level = left / sum(w[k] for k in free)
        full = [k for k in free if cap * sizes[k] <= level * w[k]]
        for k in full:
            out[k] = cap * sizes[k]
            left -= out[k]
            free.discard(k)
        if not full:
            return out | {k: level * w[k] for k in free}
    return out


CASES = {
    "null ids": lambda i, rng: (None if i % 2 else i, "s", "w " * int(rng.integers(1, 9))),
    "one id": lambda i, rng: (7, f"s{i % 3}", "w " * int(rng.integers(1, 9))),
    "equal rows": lambda i, rng: (7, f"s{i % 2}", "w w w"),
    "a huge document": lambda i, rng: (i, f"s{i % 3}", "w " * (9000 if i == 4 else int(rng.integers(1, 9)))),
    "many sources": lambda i, rng: (i, f"s{i % 97}" if i % 97 else None, "w " * int(rng.integers(0, 90))),
    "a hot source": lambda i, rng: (i, "hot" if i % 3 else f"s{i % 10}", None if i % 50 == 1 else "w " * int(rng.integers(1, 40))),
}


@pytest.mark.parametrize(("case", "weighted"), [("null ids", True), ("one id", False), ("equal rows", True), ("a huge document", False), ("many sources", False), ("a hot source", True)])
def test_mix_of_odd_sources(spark, case, weighted):
    rng = np.random.default_rng(5)
    rows = [(*CASES[case](i, rng), float(rng.integers(-1, 6)), "clash") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w double, target string")
    options = {"weight_column": "w"} if weighted else {}
    got = mixing.mix(df.repartition(3), **options).collect()
    assert len(got) == len(rows)
    if weighted:
        fate = lambda rows: Counter((r.doc_id, r.source, r.text, r.w if r.w > 0 else 1.0, r.taken) for r in rows)
        assert fate(got) == fate(mixing.mix(df.repartition(5), **options).collect())
    sizes = Counter()
    for _, s, t, *_ in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        # within one document, and within half of a typical one if none is huge
        assert abs(taken[s] - want[s]) <= largest[s]
        if case in ("null ids", "one id", "equal rows"):
            assert abs(taken[s] - want[s]) <= 8


def test_inclusion_follows_weights(spark):
    """Over many seeds a document gets the copies its weight gives it to expect, and whole ones for certain."""
    rows = [(i, "s", "w w w w", float(1 + i % 4)) for i in range(240)] + [(1000 + i, "t", "w w w w", 1.0) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w double")
    sums, seeds = Counter(), 2
    for seed in range(seeds):
        for r in mixing.mix(df, weights=(1, 1), share=0.8, weight_column="w", seed=seed).collect():
            sums[r.source, r.w] += r.taken / r.size
            assert r.taken / r.size <= 2
    means = {k: v / seeds / (240 if k[0] == "t" else 60) for k, v in sums.items()}
    assert all(abs(means["s", w] - 0.8 * w / 2.5) < 0.2 for w in (1.0, 2.0, 3.0, 4.0)) and abs(means["t", 1.0] - 0.8) < 0.02


# --- URLs ---


def test_url_trees_on_held_out_urls(spark):
    """Trees of a part of the labelled URLs judge the others as their rules do."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = urls.judge_urls(pages).where("rule is not null").select("page_id", "url", "verdict")
    train, test = ruled.where("page_id % 3 > 0"), ruled.where("page_id % 3 = 0")
    seen = {r.url for r in train.select("url").collect()}
    model = urls.fit([r for r in features(train, True)])
    scored = [(r["verdict"], r["p"]) for r in features(test, False, model) if r["url"] not in seen]
    right = sum((p >= 0.5) == (v == "block") for v, p in scored) / len(scored)
    assert len(scored) > 200 and right >= 0.85, right


def features(df, training, model=None):
    url = F.col("url")
    parts = {f"p_{k}": v for k, v in urls.parsed(url).items()}
    df = df.withColumns(parts)
    named = urls.lexical(url, F.col("p_host"), F.col("p_path"))
    if training:
        return df.select((F.col("verdict") == "block").cast("double").alias("y"), F.xxhash64("url").alias("fold"), *[v.alias(k) for k, v in named.items()]).collect()
    return df.select("url", "verdict", model.score(named).alias("p")).collect()


def test_urls_of_odd_length(spark):
    long = "http://a.com/" + "x1/" * 200_000 + "?" + "a=1&" * 100_000
    pages = spark.createDataFrame([(1, long), (2, long), (3, ""), (None, "://"), (4, "http://é.com/en/😀"), (5, "x://COM/en/")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert got[1].path == got[2].path and len(got[1].path) == 600_001 and got[1].verdict == got[2].verdict
    assert (got[4].host, got[4].rule) == ("é.com", "com/en/") and (got[5].host, got[5].rule) == ("com", "com/en/") and got[3].host == ""


# --- executors without the package ---

ALONE = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {shared!r}).config("spark.sql.warehouse.dir", {shared!r} + "/w").config("spark.executorEnv.PYTHONPATH", os.environ["WORKER_PATH"]).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
def there(_):
    try:
        import quern
        return [True]
    except ImportError:
        return [False]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(there).collect() == [False]
import __spark_entry__
from quern.llm import common
for name, query in __spark_entry__.queries().items():
    if name in {names!r}:
        print(name, query(spark, {sf!r}).count(), flush=True)
common.release(spark)
print("left", [x for x in os.listdir({shared!r}) if x.startswith("quern-")])
spark.stop()
"""


def test_executors_without_the_package(spark, tmp_path):
    """Two executors of their own, whose Python cannot import the package, run the queries that ship models."""
    names = ["op2_substring_dedup", "op4_ann", "op6_decontamination", "op7_toxicity", "op8_language_id", "op10_minhash"]
    script = ALONE.format(repo=str(REPO), shared=str(tmp_path), names=names, sf="/root/testdata/sf0.001")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    env["WORKER_PATH"] = os.pathsep.join(p for p in sys.path if p.endswith((".zip", "/python")) and "pyspark" in p)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    said = [x for x in done.stdout.splitlines() if x.startswith(("op", "left"))]
    assert [x.split()[0] for x in said] == [*names, "left"], done.stderr[-3000:]
    assert said[-1] == "left []"


# --- toxicity ---


def test_word_probabilities_sum_to_one(spark):
    """Each class's probabilities: those of the words seen, and of unseen ones by letters, as counted by hand."""
    from quern.llm import toxicity

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 3))) for _ in range(400)]
    counts = np.array([[sum(w == x for x in part) for w in sorted(set(words))] for part in (words[:300], words[300:])], float)
    vocabulary = sorted(set(words))
    codes, starts = toxicity.coded(vocabulary, toxicity.alphabet())
    letters = np.zeros((2, toxicity.CODES))
    for y in (0, 1):
        np.add.at(letters[y], codes, np.repeat(counts[y], np.diff(np.append(starts, len(codes)))))
    distinct = np.array([*(counts > 0).sum(1), len(vocabulary)])
    model = toxicity.Model(letters, counts.sum(1), distinct)
    # in every context the letters' probabilities sum to 1
    for context in np.unique(codes >> toxicity.BITS):
        p = np.exp(model.shared[context << toxicity.BITS : (context + 1) << toxicity.BITS].astype(float))
        assert abs(p.sum() - 1) < 0.01
    spelled = np.add.reduceat(model.shared[codes].astype(float), starts)
    p = np.exp(model.logs(counts, spelled))
    D = toxicity.DISCOUNT
    for y in (0, 1):
        c, both = counts[y], counts.sum(0)
        shared = np.maximum(both - D, 0) / both.sum() + D * len(vocabulary) / both.sum() * np.exp(spelled)
        want = np.maximum(c - D, 0) / c.sum() + D * (c > 0).sum() / c.sum() * shared
        assert np.allclose(p[y], want)
        # what the words seen lack is what their letters leave to all other words
        rest = D * (c > 0).sum() / c.sum() * D * len(vocabulary) / both.sum() * (1 - np.exp(spelled).sum())
        assert abs(p[y].sum() + rest - 1) < 1e-9


# --- near duplicates ---


def test_family_that_shares_boilerplate(spark, monkeypatch):
    """Unlike documents with much text in common: groups beyond GROUP meet by rare shingles, and no link is lost or added."""
    from quern.llm import minhash

    rng = np.random.default_rng(11)
    monkeypatch.setattr(minhash, "GROUP", 16)
    asked, rare = [], minhash._rare_pairs
    monkeypatch.setattr(minhash, "_rare_pairs", lambda hot, linker: asked.append(hot.count()) or rare(hot, linker))
    common_part = [f"c{i}" for i in range(150)]
    docs = []
    for i in range(260):
        words = [f"u{rng.integers(0, 10**9)}" for _ in range(60)]
        docs.append(common_part + words)
        if i % 8 == 0:  # two links in a row, the ends of which are no link, and one pair just below the threshold
            docs += [common_part + words[: 60 - n] + [f"u{rng.integers(0, 10**9)}" for _ in range(n)] for n in (12, 24, 25)]
    # an alike family: every shingle is one of many
    parts = [[f"p{j}x{k}" for k in range(12)] for j in range(14)]
    docs += [[w for j in sorted(rng.choice(14, 9, replace=False)) for w in parts[j]] for _ in range(60)]
    sets = [{(a, b) for a, b in zip(d, d[1:])} for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(df, shingle=2).collect()
    assert asked and asked[0] > 100
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(docs))}


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity from 0.8 to 0.83, each by itself: what the tables miss is about one in 10,000."""
    from quern.llm import minhash

    rng = np.random.default_rng(12)
    docs, linked = [], 0
    for i in range(700):
        words = [f"x{rng.integers(0, 10**9)}" for _ in range(100)]
        other = words[: 100 - rng.integers(9, 12)]
        other += [f"y{rng.integers(0, 10**9)}" for _ in range(100 - len(other))]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({(v, w) for v, w in zip(d, d[1:])} for d in (words, other))
        linked += 100 * len(a & b) >= 80 * len(a | b)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2)
    found = got.where("not kept").count()
    assert linked > 500 and linked - 1 <= found <= linked


# --- substrings ---


def test_substrings_of_null_and_repeated_ids(spark):
    """Null ids come last and are one document as to what is earlier; the rows of one id are cut each by its own repeats."""
    from quern.llm import substrings

    rng = np.random.default_rng(13)
    parts = [" ".join(f"v{x}" for x in rng.integers(0, 9999, 9)) for _ in range(6)]
    texts = [" ".join(parts[j] for j in rng.integers(0, 6, rng.integers(0, 6))) + f" end{i}" for i in range(40)]
    rows = [(None if i % 3 == 0 else i % 7, t) for i, t in enumerate(texts)] + [(None, None), (2**63 - 1, texts[5])]
    first, last = {}, 2**63 - 1
    for i, t in rows:
        words, at = (t or "").split(), last if i is None else i
        for s in range(len(words) - 7):
            key = tuple(words[s : s + 8])
            first[key] = min(first.get(key, (at, s)), (at, s))
    want = Counter()
    for i, t in rows:
        words, at, gone = (t or "").split(), last if i is None else i, set()
        for s in range(len(words) - 7):
            if first[tuple(words[s : s + 8])] != (at, s):
                gone |= set(range(s, s + 8))
        want[i, t, " ".join(w for j, w in enumerate(words) if j not in gone)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_words", F.lit("clash"))
    got = substrings.dedup_substrings(df, length=8, anchor=3).collect()
    assert Counter((r.doc_id, r.text, r.kept_text) for r in got) == want
