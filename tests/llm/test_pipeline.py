"""The stages one by one and the whole pipeline, against plain versions on small tables."""

import random
import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from quern.llm import common, secrets, toxicity

GIVEN = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The smallest tables, and a few documents with secrets."""
    out, rng = str(tmp_path_factory.mktemp("sf")), random.Random(4)
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    said = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    extra = [(10_000 + i, f"{said(60)} password=hunter{i}abc, {said(5)} AKIA{'ABCD1234' * 2} {said(9)}", "en", f"s{i % 2}", 7) for i in range(9)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{GIVEN}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage kept, by name, read again as the next one reads it."""
    docs, out = common.documents(spark, sf), {}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        docs = out[name] = common.work_table(stage(spark, docs, sf), "test")
    return out


def test_stages_keep_columns(kept):
    for name, _ in cp.STAGES[:-1]:
        assert kept[name].columns == kept["documents"].columns
        assert not rows(kept[name].drop("text", "n_chars")) - rows(kept["documents"].drop("text", "n_chars"))


def test_toxic_ones_go(spark, sf, kept):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(kept["documents"], labels.select("doc_id", "toxic"))
    assert rows(scored.where("predicted = 0").select(*kept["documents"].columns)) == rows(kept["toxicity"])
    gone = kept["documents"].join(kept["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    left = kept["toxicity"].join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 2 and left.where("toxic = 1").count() <= 2


def test_one_of_each_group_stays(kept):
    words = {r.doc_id: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split() for r in kept["toxicity"].collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in kept["near duplicates"].collect()) == sorted(i for i in sets if find(i) == i)


def test_contaminated_ones_go(spark, sf, kept):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
    sizes, left = {len(w) for w in windows}, []
    for r in kept["near duplicates"].collect():
        w, hit = words(r.text), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
        if not hit or 20 * len(hit) < len(w):
            left.append(r.doc_id)
    assert sorted(r.doc_id for r in kept["decontamination"].collect()) == sorted(left)


def test_secrets_are_marked(kept):
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(kept["decontamination"]).collect()}
    assert sum(map(bool, found.values())) >= 9
    after = {r.doc_id: r for r in kept["secrets"].collect()}
    assert len(after) == len(found)
    for r in kept["decontamination"].collect():
        out, pos = "", 0
        for a, b in found[r.doc_id]:
            if a >= pos:
                out, pos = out + (r.text or "")[pos:a] + "[SECRET]", b
            pos = max(pos, b)
        want = out + (r.text or "")[pos:] if found[r.doc_id] else r.text
        assert after[r.doc_id].text == want and (after[r.doc_id].n_chars == len(want) if found[r.doc_id] else after[r.doc_id].n_chars == r.n_chars)


def test_mix_comes_near_its_targets(kept):
    mixed = kept["mixing"].collect()
    sizes = Counter()
    for r in kept["secrets"].collect():
        sizes[r.source] += len((r.text or "").encode().split())
    taken, target = Counter(), {r.source: r.target for r in mixed}
    for r in mixed:
        assert r.taken in (r.size, 2 * r.size) and r.size == len((r.text or "").encode().split())
        taken[r.source] += r.taken
    largest = {s: max(len((r.text or "").encode().split()) for r in kept["secrets"].collect() if r.source == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_the_whole_equals_its_stages(spark, sf, kept):
    assert rows(cp.run(spark, sf)) == rows(kept["mixing"])


def test_odd_documents_pass_through(spark, sf, kept):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, " \t", None, "s", 2), (3, "plain words " * 30_000, "en", "s", 1)], kept["documents"].schema)
    for _, stage in cp.STAGES[:-1]:
        assert rows(stage(spark, odd, sf)) in (rows(odd), rows(odd.where("doc_id is not null")) + rows(odd.where("doc_id is null")))
        assert stage(spark, odd.where("false"), sf).collect() == []
    assert [(r.doc_id, r.size) for r in cp.mixed(spark, odd, sf).collect()] == [(3, 60_000)]
