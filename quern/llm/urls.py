"""URL filters: host and path rules, and boosted trees over lexical features.

Native: parsing, features and scoring are DataFrame expressions. The trees are
fitted on the driver from at most ``max_train`` distinct labelled URLs, those of the
smallest hash; about 1.3 times as many are moved there, whatever the size of the input.
Shares of suffixes and endings come, in training, from rows of other folds only.

A null URL, or one without ``://``, has an empty host and path; no rule fits it,
and the trees score it like any other. Repeated rows get equal results. Without
labelled URLs, or with labels of one kind only, the score is that share, or 0.5.
Extra columns stay; those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, replacing, share_below

#: Fixed values of the contract: verdict, rule.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", "fragment", "suffix", "ending")
MAX_RULES = 2000
#: Folds by which the shares of suffixes and endings are taken.
FOLDS = 5


def parsed(url: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    return {"host": ascii_lower(F.regexp_extract(u, "://([^/?#]*)", 1)), "path": F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)}


def ruled(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    Rules are tried longest first. The list is part of the plan, so it is bounded.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules can be part of a plan")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    n = F.length(s).cast("double")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def _count(s: Column, chars: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no statistics; suffix and ending are still names."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "length": F.length(u).cast("double"),
        "depth": _count(F.regexp_replace(path, "/+$", ""), "/"),
        "digits": F.when(F.length(u) > 0, _count(u, "0123456789") / F.length(u)).otherwise(0.0),
        "entropy": _entropy(F.concat(host, path)),
        "params": F.when(rest == "", 0.0).otherwise(_count(rest, "&") + 1.0),
        "labels": _count(host, "."),
        "hyphens": _count(u, "-_"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "suffix": F.regexp_extract(host, r"([^.]*\.[^.]*)$|^([^.]*)$", 0),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
    }


@dataclass
class UrlModel:
    """base + the sum of the trees is the log-odds of a block."""

    base: float
    trees: list
    suffix: dict[str, float]
    ending: dict[str, float]
    prior: float

    def score(self, features: dict[str, Column]) -> Column:
        named = features | {
            "suffix": _looked_up(features["suffix"], self.suffix, self.prior),
            "ending": _looked_up(features["ending"], self.ending, self.prior),
        }
        columns = [named[f] for f in FEATURES]
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _walk(tree, columns)
        return 1.0 / (1.0 + F.exp(-total))


def _looked_up(name: Column, table: dict[str, float], prior: float) -> Column:
    if not table:
        return F.lit(prior)
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(prior))


def _walk(tree, columns: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, low, high = tree
    return F.when(columns[feature] <= cut, _walk(low, columns)).otherwise(_walk(high, columns))


def _leaf(g: np.ndarray, h: np.ndarray, rate: float, damp: float) -> float:
    return float(rate * g.sum() / (h.sum() + damp))


def _grow(x: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, damp: float, least: int):
    """A tree over binned features: (feature, cut, low, high), or a leaf's value."""
    gs, hs = g[rows], h[rows]
    if depth == 0 or len(rows) < 2 * least:
        return _leaf(gs, hs, rate, damp)
    whole, best = gs.sum() ** 2 / (hs.sum() + damp), (1e-6, None, None)
    for f, e in enumerate(edges):
        if len(e) == 0:
            continue
        b, k = x[rows, f], len(e) + 1
        gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (gs, hs, np.ones(len(rows))))
        gain = gl**2 / (hl + damp) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + damp) - whole
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, i)
    _, f, i = best
    if f is None:
        return _leaf(gs, hs, rate, damp)
    low = x[rows, f] <= i
    args = (depth - 1, rate, damp, least)
    return f, float(edges[f][i]), _grow(x, edges, g, h, rows[low], *args), _grow(x, edges, g, h, rows[~low], *args)


def _shares(names: list[str], y: np.ndarray, prior: float, least: int) -> dict[str, float]:
    """Smoothed share of blocks for each name of ``least`` rows or more."""
    sums: dict[str, list[float]] = {}
    for name, v in zip(names, y, strict=True):
        s = sums.setdefault(name, [0.0, 0.0])
        s[0] += v
        s[1] += 1
    return {k: float((s + 10 * prior) / (n + 10)) for k, (s, n) in sums.items() if n >= least}


def _out_of_fold(names: list[str], y: np.ndarray, fold: np.ndarray, prior: float, least: int) -> np.ndarray:
    """Each row's share by name, from the rows of other folds, so that no row's own label is among its features."""
    out, names_of = np.zeros(len(y)), np.array(names, object)
    for f in range(FOLDS):
        others = _shares(names_of[fold != f].tolist(), y[fold != f], prior, least)
        mine = np.flatnonzero(fold == f)
        out[mine] = [others.get(names[i], prior) for i in mine]
    return out


def fit(rows: list, rounds: int = 24, depth: int = 3, rate: float = 0.3, damp: float = 1.0, bins: int = 32, least: int = 20) -> UrlModel:
    """Boosts trees of logistic loss on rows of the features, fold (any integer) and y, 1 for a block.

    A leaf has ``least`` rows or more, and so has a suffix or ending whose share counts;
    so there are len(rows) / least of either at most.
    """
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(y) == 0:
        return UrlModel(0.0, [], {}, {}, 0.5)
    prior, fold = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)), np.array([r["fold"] % FOLDS for r in rows])
    named = {f: [r[f] for r in rows] for f in ("suffix", "ending")}
    suffix, ending = (_shares(named[f], y, prior, least) for f in ("suffix", "ending"))
    values = np.stack([_out_of_fold(named[f], y, fold, prior, least) if f in named else np.array([r[f] for r in rows], float) for f in FEATURES], axis=1)
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(len(FEATURES))]
    x = np.stack([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log(prior / (1 - prior)))
    margin, trees, everything = np.full(len(y), base), [], np.arange(len(y))
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, edges, y - p, p * (1 - p), everything, depth, rate, damp, least)
        trees.append(tree)
        margin += _predict(tree, values)
    return UrlModel(base, trees, suffix, ending, prior)


def _predict(tree, values: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(values), tree)
    f, cut, low, high = tree
    return np.where(values[:, f] <= cut, _predict(low, values), _predict(high, values))


def judge_urls(pages: DataFrame, rules=RULES, max_train: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score.

    URLs that a rule fits are the labelled ones. ``max_train`` distinct ones of them,
    those of the smallest hash of the URL, train the trees, which judge the URLs that
    no rule fits. Copies of a URL count once.
    """
    url = F.col("url").cast("string")
    df = pages.withColumns({f"_q_{k}": v for k, v in parsed(url).items()})
    df = df.withColumn("_q_rule", ruled(F.col("_q_host"), F.col("_q_path"), rules))
    features = lexical(url, F.col("_q_host"), F.col("_q_path"))
    y = (F.col("_q_rule.verdict") == "block").cast("double")
    ruled_ones = df.where(F.col("_q_rule").isNotNull()).select(url.alias("_q_url"), "_q_host", "_q_path", y.alias("y"))
    distinct = ruled_ones.agg(F.approx_count_distinct(F.xxhash64("_q_url"), 0.02)).first()[0]
    # those of the smallest hash: about 1.3 x max_train reach the driver, whatever the input
    train = ruled_ones.where(F.xxhash64("_q_url") < share_below(1.3 * max_train / max(1, distinct))).distinct()
    named = lexical(F.col("_q_url"), F.col("_q_host"), F.col("_q_path"))
    order = F.xxhash64("_q_url").alias("order")
    rows = train.select("y", order, F.xxhash64(F.lit("fold"), "_q_url").alias("fold"), *[v.alias(k) for k, v in named.items()]).collect()
    model = fit(sorted(rows, key=lambda r: r["order"])[:max_train])
    df = df.withColumns({f"_q_f_{k}": v for k, v in features.items()})
    df = df.withColumn("_q_score", model.score({k: F.col(f"_q_f_{k}") for k in features}))
    learned = F.when(F.col("_q_score") >= threshold, "block").otherwise("allow")
    out = replacing(
        df,
        {
            "host": F.col("_q_host"),
            "path": F.col("_q_path"),
            "rule": F.col("_q_rule.rule"),
            "verdict": F.coalesce(F.col("_q_rule.verdict"), learned),
            "score": F.col("_q_score"),
        },
    )
    return out.drop("_q_host", "_q_path", "_q_rule", "_q_score", *[f"_q_f_{k}" for k in features])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
