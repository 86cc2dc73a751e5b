"""What an operator must not lose as its input grows or its values stand elsewhere."""

import random
import string

import numpy as np
from pyspark.sql import functions as F

from quern.llm import secrets, toxicity, urls


def test_word_counts_stay_exact(spark):
    """More distinct words than a table of 2 x 2^19 cells keeps apart; unseen ones stay at zero."""
    letters = string.ascii_lowercase

    def word(i: int, first: str) -> str:
        return first + "".join(letters[i // 26**k % 26] for k in range(5))

    rows = [(d, " ".join(word(i, "q") for i in range(d * 3000, d * 3000 + 3000)) + f" both both toxic{d % 2}", d % 2) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    _, parts, _ = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), max_curve=20)
    learned = {r[0] for r in docs.where(~toxicity.held_out(docs["doc_id"])).select("doc_id").collect()}
    seen = [word(d * 3000 + 7, "q") for d in range(600)]
    want = np.array([[float(d in learned and d % 2 == y) for d in range(600)] for y in (0, 1)])
    assert (toxicity.counts_of(seen, parts) == want).all()
    assert not toxicity.counts_of([word(i, "z") for i in range(5000)], parts).any()
    n = [sum(d % 2 == y for d in learned) for y in (0, 1)]
    assert toxicity.counts_of(["both", "toxic1"], parts).tolist() == [[2 * n[0], 0], [2 * n[1], n[1]]]


def test_secret_after_a_name(spark):
    """name=value: the value is tested by itself, whatever its name."""
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/"
    names = ["AWS_SECRET_ACCESS_KEY=", "sig=", "auth=", "session_id=", "a=b&signature_of_this_request=", ""]
    values = ["".join(rng.choices(letters, k=43)) + "=" for _ in range(300)]
    rows = [(i, f"see {names[i % len(names)]}{v} there", v) for i, v in enumerate(values)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, value string")).collect()
    found = {n: [[s["hit"] for s in r["secrets"]] == [r["value"]] for r in got if names[r["doc_id"] % len(names)] == n] for n in names}
    assert all(sum(x) >= 0.8 * len(x) for x in found.values()), {k: sum(x) for k, x in found.items()}


def test_padding_counts_towards_the_length(spark):
    rng = random.Random(6)
    rows = [(i, "a " + "".join(rng.choices(string.ascii_letters + string.digits, k=18)) + "== b") for i in range(200)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r["secrets"]) == 1 and len(r["secrets"][0]["hit"]) == 20 for r in got) >= 140


def test_copies_of_a_url_train_once(spark, monkeypatch):
    """A hot URL, the first in the order of hashes, leaves room for the others."""
    rows = [f"http://{'x.com/en' if i % 2 else 'x.org/fr/y.net/de'}/p{i}" for i in range(400)] + [f"http://y.net/de/p{i}" for i in range(400)]
    pages = spark.createDataFrame([(u,) for u in rows], "url string")
    ruled = pages.where("url rlike '://(x.com/en|y.net/de)/'")
    hot = ruled.orderBy(F.xxhash64("url")).first()["url"]
    pages = pages.union(spark.createDataFrame([(hot,)] * 3000, "url string"))
    seen, fit = [], urls.fit
    monkeypatch.setattr(urls, "fit", lambda rows: seen.extend(rows) or fit(rows))
    out = urls.judge_urls(pages, max_train=500)
    assert len(seen) == 500 and 150 < sum(r["y"] for r in seen) < 250
    assert out.count() == 3800 and out.where("rule is null").count() == 200


def test_rare_toxic_documents_reach_the_curve(spark):
    """Few documents of one class are all drawn for the curve."""
    rng = random.Random(7)
    plain, bad = ([f"{p}{w}" for w in ("lor", "tam", "rin", "sol", "ved", "kun")] for p in ("a", "x"))
    rows = [(i, " ".join(rng.choices(plain, k=40) + (rng.choices(bad, k=10) if i % 50 == 0 else [])), int(i % 50 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    out = toxicity.score_toxicity(docs, docs.select("doc_id", "toxic"), max_curve=8).cache()
    assert out.where("toxic = 1 and predicted = 1").count() >= 27
    assert out.where("toxic = 0 and predicted = 1").count() <= 15
