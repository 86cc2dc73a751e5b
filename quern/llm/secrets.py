"""Secret scans: patterns, and a randomness test battery over long tokens.

Native: every step is a DataFrame expression.

Base spans come from three patterns. The battery looks at each further run of
token letters, which padding ("=") can only end, so that of name=value both sides are
runs of their own, and, where slashes part a run, at each part by itself: it infers the encoding (decimal, hex, base32, base64), then asks
whether the run could be uniform noise in that alphabet, by chi-squared tests of
the symbols and of the letter classes, a runs test about the middle of the
alphabet and a lag-1 serial correlation. The four p-values combine by the
Bonferroni rule. Ordinary words get p near 0, noise gets p spread over 0 to 1.

Which p is high enough depends on the length: for each encoding and length class
the whole corpus gives a histogram of p, whose upper half tells how many runs are
noise (Storey's estimate), and the cut is the lowest at which the share of
ordinary runs above it is at most ``fdr``.

Null texts are empty texts. Repeated rows each get their own, equal result. Null
ids stay as they are, extra columns stay, and columns of the input that are named
like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, documents, labelled, matched, redacted, replacing, running, span_text, text_of, work_table

#: Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS = "0123456789"
#: Encodings: alphabet, and the share of upper-case letters, lower-case letters and others in it.
ENCODINGS = {
    "dec": (DIGITS, (0, 0, 10)),
    "hex": (DIGITS + "abcdef", (0, 6, 10)),
    "base32": (UPPER + "234567", (26, 0, 6)),
    "base64": (UPPER + LOWER + DIGITS + "+/", (26, 26, 12)),
}
BINS = 50


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, to about 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.07056))


def _chi_tail(x: Column, df: int) -> Column:
    """P(X > x) for chi-squared X by the cube-root rule."""
    v = 2.0 / (9.0 * df)
    return _upper_tail((F.pow(x / float(df), F.lit(1 / 3)) - (1.0 - v)) / v**0.5)


#: Letters of a token that are arrays at once.
LETTERS = 1024


def _sums(s: Column, alphabet: str) -> Column:
    """Over the places of s's letters in the alphabet: total, squares, products of neighbours, changes of half, first and last."""
    half, f = len(alphabet) / 2.0, ("total", "squares", "products", "turns", "first", "last")
    zero = F.struct(*[F.lit(x).alias(k) for k, x in zip(f, (0.0, 0.0, 0.0, 0.0, -1.0, -1.0), strict=True)])

    def add(a: Column, v: Column) -> Column:
        new = a["last"] < 0
        turned = F.when(new | ((a["last"] >= half) == (v >= half)), 0.0).otherwise(1.0)
        values = (a["total"] + v, a["squares"] + v * v, a["products"] + F.when(new, 0.0).otherwise(a["last"] * v), a["turns"] + turned, F.when(new, v).otherwise(a["first"]), v)
        return F.struct(*[x.alias(k) for k, x in zip(f, values, strict=True)])

    places = lambda part: F.transform(F.split(part, ""), lambda c: F.position(c, F.lit(alphabet)).cast("double") - 1.0)
    parts = F.filter(F.split(s, r"(?<=\G.{%d})" % LETTERS), lambda x: x != "")
    return F.aggregate(parts, zero, lambda a, part: F.aggregate(places(part), a, add))


def _tests(s: Column, alphabet: str, classes: tuple[int, int, int]) -> Column:
    """The combined p-value of s, all of whose letters are in the alphabet."""
    a = len(alphabet)
    squares = F.aggregate(F.lit(list(alphabet)), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    upper, lower = (F.length(s) - F.length(F.translate(s, x, "")) for x in (UPPER, LOWER))

    def combined(t: Column) -> Column:
        n = t["n"]
        # the exact mean and variance of the statistic under noise, for short runs
        x2 = t["squares"] * float(a) / n - n
        p = [_upper_tail((x2 - (a - 1.0)) / F.sqrt(2.0 * (a - 1) * (n - 1) / n))]
        counts = (t["upper"], t["lower"], n - t["upper"] - t["lower"])
        used = [(c, w / a) for c, w in zip(counts, classes, strict=True) if w]
        if len(used) > 1:
            x = reduce(lambda acc, y: acc + y, [F.pow(c - n * w, F.lit(2.0)) / (n * w) for c, w in used])
            p.append(_chi_tail(x, len(used) - 1))
        p.append(2.0 * _upper_tail(F.abs(t["sums"]["turns"] - (n - 1) / 2.0) / F.sqrt((n - 1) / 4.0)))
        total, mean = t["sums"]["total"], t["sums"]["total"] / n
        spread = t["sums"]["squares"] - total * mean
        lag = t["sums"]["products"] - mean * (total - t["sums"]["last"]) - mean * (total - t["sums"]["first"]) + (n - 1) * mean * mean
        # all letters alike: no spread, which no noise has
        p.append(F.when(spread > 1e-6, 2.0 * _upper_tail(F.abs(lag / spread + 1.0 / n) * F.sqrt(n))).otherwise(0.0))
        return F.least(F.lit(1.0), F.least(*p) * float(len(p)))

    known = F.struct(F.length(s).cast("double").alias("n"), squares.alias("squares"), upper.alias("upper"), lower.alias("lower"), _sums(s, alphabet).alias("sums"))
    # a lambda, so that each count is made once
    return F.transform(F.array(known), combined)[0]


def battery(token: Column) -> Column:
    """(encoding, length class, p) of a token; the length class is floor(log2(length))."""
    s = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    dec, hexa, b32 = s.rlike("^[0-9]+$"), s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), s.rlike("^[A-Z2-7]+$")
    encoding = F.when(dec, "dec").when(hexa, "hex").when(b32, "base32").otherwise("base64")
    p = (
        F.when(F.length(s) < 2, 0.0)
        .when(dec, _tests(s, *ENCODINGS["dec"]))
        .when(hexa, _tests(F.lower(s), *ENCODINGS["hex"]))
        .when(b32, _tests(s, *ENCODINGS["base32"]))
        # a padding letter within a run is no base64
        .when(F.contains(s, F.lit("=")), 0.0)
        .otherwise(_tests(s, *ENCODINGS["base64"]))
    )
    size = F.floor(F.log2(F.greatest(F.length(s), F.lit(1)).cast("double"))).cast("int")
    return F.struct(encoding.alias("encoding"), size.alias("size"), p.alias("p"))


def _scanned(docs: DataFrame, min_token: int) -> DataFrame:
    """docs with _q_base and _q_tokens: the base spans, and the further runs, and their parts between slashes, with their tests."""
    df = docs.withColumn("_q_text", text_of(docs))
    # a run begins where no run letter stands before; the lookahead skips short ones early, and of name=value lets short names match, which go below
    token = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{%d})[A-Za-z0-9+/_-]+=*" % min_token
    part = r"(?=[A-Za-z0-9+_=-]{%d})[A-Za-z0-9+_-]++=*+" % min_token
    part = rf"(?<=/){part}|(?<![A-Za-z0-9+/_-]){part}(?=/)"
    df = matched(
        df,
        {
            "assign": (ASSIGN, None),
            "access": (ACCESS, F.contains("_q_text", F.lit("AKIA"))),
            "hex": (HEX, None),
            "token": (token, None),
            "part": (part, F.contains("_q_text", F.lit("/"))),
        },
        "_q_text",
    )
    assign = F.filter("_q_assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    access = F.filter("_q_access", lambda s: F.length(s["hit"]) >= 20)
    base = F.concat(labelled(assign, "assign", 0), labelled(access, "access", 1), labelled(F.col("_q_hex"), "hex", 2))
    df = df.withColumn("_q_base", F.array_sort(base))
    long = [labelled(F.filter(f"_q_{k}", lambda t: F.length(t["hit"]) >= min_token), k, r) for k, r in (("token", 3), ("part", 4))]
    df = df.withColumn("_q_all", F.when(F.size(long[0]) > 0, F.array_sort(F.concat("_q_base", *long))).otherwise(long[0]))
    # a run is free if the base spans before it end before it, and the next begins after it
    df = running(df, {"_q_ended": F.transform("_q_all", lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0))}, "max")
    far = F.lit((1 << 31) - 1)
    df = running(df, {"_q_next": F.transform(F.reverse("_q_all"), lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(far))}, "min")
    beside = F.zip_with(F.col("_q_ended"), F.reverse("_q_next"), lambda e, n: F.struct(e.alias("ended"), n.alias("next")))
    all_of = F.zip_with(F.col("_q_all"), beside, lambda s, b: F.struct(s.alias("s"), b.alias("b")))
    free = F.filter(all_of, lambda x: (x["s"]["rank"] > 2) & (x["b"]["ended"] <= x["s"]["start"]) & (x["b"]["next"] >= x["s"]["end"]))
    names = ("start", "rank", "end", "kind", "hit")
    tested = F.transform(free, lambda x: F.struct(*[x["s"][n].alias(n) for n in names], battery(x["s"]["hit"]).alias("test")))
    return df.withColumn("_q_tokens", tested).drop("_q_assign", "_q_access", "_q_hex", "_q_token", "_q_part", "_q_all", "_q_ended", "_q_next", "_q_text")


def cuts(histogram: list[tuple[str, int, int, int]], fdr: float, least: float = 0.02) -> dict[tuple[str, int], float]:
    """The cut of p for each (encoding, length class) that has one, from counts by bin of p."""
    strata: dict[tuple[str, int], list[int]] = {}
    for encoding, size, b, n in histogram:
        strata.setdefault((encoding, size), [0] * (BINS + 1))[b] += n
    out = {}
    for key, counts in sorted(strata.items()):
        noise = min(sum(counts), 2 * sum(counts[BINS // 2 :]))
        for b in range(int(least * BINS), BINS):
            above = sum(counts[b:])
            if above and max(0.0, above - noise * (1 - b / BINS)) <= fdr * above:
                out[key] = b / BINS
                break
    return out


def find_secrets(docs: DataFrame, fdr: float = 0.05, min_token: int = 20, with_text: bool = True) -> DataFrame:
    """docs with n_assign, n_access, n_hex, and secrets: array of (start, rank, end, kind, hit).

    One pass over all texts finds the spans, tests the runs and writes both to the
    shared folder; from there come the histogram, of at most encodings x length classes
    x 51 rows, and the result. Without with_text the text is left out of both.
    """
    scanned = _scanned(docs, min_token)
    scanned = work_table(scanned if with_text else scanned.drop("text"), "secrets-tested")
    test = F.explode("_q_tokens.test").alias("test")
    bins = scanned.select(test).groupBy("test.encoding", "test.size", F.floor(F.col("test.p") * BINS).cast("int").alias("bin")).count()
    found = cuts([tuple(r) for r in bins.collect()], fdr)

    def passes(t: Column) -> Column:
        out = F.lit(False)
        for (encoding, size), cut in found.items():
            out = out | ((t["test"]["encoding"] == encoding) & (t["test"]["size"] == size) & (t["test"]["p"] >= cut))
        return out

    names = ("start", "rank", "end", "kind", "hit")
    df = scanned.withColumn("_q_passed", F.transform(F.filter("_q_tokens", passes), lambda t: F.struct(*[t[n].alias(n) for n in names])))
    # a part of a run that passed whole is no secret of its own
    df = running(df, {"_q_covered": F.transform("_q_passed", lambda t: F.when(t["rank"] == 3, t["end"]).otherwise(0))}, "max")
    own = F.filter(F.zip_with(F.col("_q_passed"), F.col("_q_covered"), lambda t, c: F.struct(t.alias("t"), c.alias("c"))), lambda x: (x["t"]["rank"] == 3) | (x["c"] <= x["t"]["start"]))
    random = labelled(F.transform(own, lambda x: x["t"]), "random", 3)
    count = lambda kind: F.size(F.filter("_q_base", lambda s: s["kind"] == kind)).cast("long")
    out = replacing(
        df,
        {f"n_{k}": count(k) for k in KINDS[:3]}
        | {"base": F.col("_q_base"), "secrets": F.array_sort(F.concat("_q_base", random))},
    )
    return out.drop("_q_base", "_q_tokens", "_q_passed", "_q_covered")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs, of the same columns, with every secret replaced by mark and n_chars counted anew."""
    found = find_secrets(docs.select("text", F.struct("*").alias("_q_row")), with_text=False, **options)
    found = redacted(found, "_q_cut", F.coalesce(F.col("_q_row.text").cast("string"), F.lit("")), F.col("secrets"), mark)
    fresh = F.when(F.size("secrets") == 0, F.col("_q_row.text")).otherwise(F.col("_q_cut"))
    out = found.select("_q_row", fresh.alias("_q_new"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_q_new").alias("text"))
        elif c == "n_chars":
            changed = ~F.col("_q_new").eqNullSafe(F.col("_q_row.text"))
            columns.append(F.when(changed, F.length("_q_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_q_row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"_q_row.`{c}`").alias(c))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the secrets of every document."""
    out = find_secrets(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans")
    )
