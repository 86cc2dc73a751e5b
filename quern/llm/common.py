"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import scratch_dir

#: Fixed values of the contracts: a word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_paths: WeakKeyDictionary = WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's work tables."""
    return f"{scratch_dir(spark)}/quern-{spark.sparkContext.applicationId}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a recoverable lineage cut."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any more."""
    for table in tables:
        if (path := _paths.pop(table, None)) is not None:
            _deleted(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all work tables of this application: call it once the results are written."""
    _deleted(spark, work_dir(spark))


def share_below(share: float) -> Column:
    """A bound on a 64-bit hash, below which about this share of all hashes lies."""
    return F.lit(int(min((1 << 63) - 1, -(1 << 63) + share * (1 << 64))))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model learns from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def replacing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, in place of any that bear the same names."""
    kept = [c for c in df.columns if c.lower() not in {k.lower() for k in columns}]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in columns.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


#: Items of an array that are scanned at once; see running().
CHUNK = 256


def running(df: DataFrame, arrays: dict[str, Column], of: str) -> DataFrame:
    """df with, by name, the running "sum", "max" or "min" of arrays of ints.

    Spark's aggregate() copies an array for each item that it appends, so an array is
    scanned in chunks, whose totals are scanned after that: work grows little faster
    than the array. What a lambda reads is used twice or zipped, since Spark would else
    move its expression into the lambda.
    """
    join = {"sum": lambda a, x: a + x, "max": F.greatest, "min": F.least}[of]
    zero = F.lit({"sum": 0, "max": -(1 << 31), "min": (1 << 31) - 1}[of]).cast("int")
    none = F.array().cast("array<int>")

    def scan(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))
        step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(join(a["at"], x))).alias("out"))
        return F.aggregate(xs, start, step, lambda a: a["out"])

    def parts(v: Column) -> Column:
        n = F.size(v)
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda j: F.slice(v, j * CHUNK + 1, CHUNK))
        return F.when(n > CHUNK, F.transform(cut, scan)).when(n > 0, F.array(scan(v))).otherwise(F.array().cast("array<array<int>>"))

    def shifted(local: Column, ends: Column) -> Column:
        each = F.zip_with(local, F.slice(ends, F.lit(1), F.size(local)), lambda x, e: F.transform(x, lambda y: join(e, y)))
        return F.when(F.size(local) > 1, F.flatten(each)).when(F.size(local) == 1, local[0]).otherwise(none)

    df = df.withColumns({f"_r_values_{k}": v for k, v in arrays.items()})
    df = df.withColumns({f"_r_parts_{k}": parts(F.col(f"_r_values_{k}")) for k in arrays})
    totals = {k: F.transform(f"_r_parts_{k}", lambda x: F.element_at(x, -1)) for k in arrays}
    df = df.withColumns({k: shifted(F.col(f"_r_parts_{k}"), F.concat(F.array(zero), scan(t))) for k, t in totals.items()})
    return df.drop(*[f"_r_{x}_{k}" for k in arrays for x in ("values", "parts")])


def matched(df: DataFrame, patterns: dict[str, tuple[str, Column | None]], text: str, near: int = 0) -> DataFrame:
    """Adds for each kind the array of its non-overlapping matches as _q_<kind>: (start, end, hit).

    patterns: kind to (pattern, a cheap test that a text can match or None). The
    text is split only where the pattern was found; piece i precedes match i, so
    offsets, in code points, are running sums of lengths. With near, a match also has
    before and after: what stands next to it, so many letters at most, up to the next
    match of its kind.
    """
    none = F.array().cast("array<string>")
    found = {}
    for kind, (pattern, test) in patterns.items():
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        found[f"_q_hit_{kind}"] = hits if test is None else F.when(test, hits).otherwise(none)
    df = df.withColumns(found)
    df = df.withColumns(
        {f"_q_cut_{k}": F.when(F.size(f"_q_hit_{k}") > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, (p, _) in patterns.items()}
    )
    both = {k: (F.col(f"_q_hit_{k}"), F.col(f"_q_cut_{k}")) for k in patterns}
    lengths = {f"_q_upto_{k}": F.zip_with(F.slice(cut, F.lit(1), F.size(hits)), hits, lambda c, h: F.length(c) + F.length(h)) for k, (hits, cut) in both.items()}
    df = running(df, lengths, "sum")

    def spans(hits: Column, cut: Column, upto: Column) -> Column:
        out = F.zip_with(hits, upto, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
        if not near:
            return out
        left, right = (F.slice(cut, F.lit(i), F.size(hits)) for i in (1, 2))
        beside = F.zip_with(left, right, lambda a, b: F.struct(F.substring(a, -near, near).alias("before"), F.substring(b, 1, near).alias("after")))
        return F.zip_with(out, beside, lambda s, c: F.struct(*[s[x].alias(x) for x in ("start", "end", "hit")], *[c[x].alias(x) for x in ("before", "after")]))

    df = df.withColumns({f"_q_{k}": spans(hits, cut, F.col(f"_q_upto_{k}")) for k, (hits, cut) in both.items()})
    return df.drop(*[f"_q_{x}_{k}" for k in patterns for x in ("hit", "cut", "upto")])


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """Spans of one kind as (start, rank, end, kind, hit), so that sorting goes by start, then kind."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit")),
    )


def redacted(df: DataFrame, name: str, text: Column, spans: Column, mark: str) -> DataFrame:
    """df with name: text with every span, sorted by start, replaced by mark; spans that overlap share one.

    The text is cut at every CHUNK spans, so that no cut scans all of it.
    """
    df = df.withColumns({"_q_whole": text, "_q_spans": spans})
    df = running(df, {"_q_upto": F.transform("_q_spans", lambda s: s["end"])}, "max")
    upto, at, n = F.col("_q_upto"), F.col("_q_spans"), F.size("_q_spans")
    before = F.concat(F.array(F.lit(0)), F.slice(upto, F.lit(1), F.greatest(n - 1, F.lit(0))))
    df = df.withColumn("_q_gaps", F.when(n > 0, F.zip_with(before, at, lambda p, s: F.struct(p.alias("pos"), s["start"].alias("start")))))
    n = F.coalesce(F.size("_q_gaps"), F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda j: F.slice("_q_gaps", j * CHUNK + 1, CHUNK))
    far = lambda c: F.greatest(F.element_at(c, -1)["pos"], F.element_at(c, -1)["start"])
    parts = F.transform(
        chunks,
        lambda c: F.struct(c.alias("gaps"), c[0]["pos"].alias("pos"), F.substring(F.col("_q_whole"), c[0]["pos"] + 1, far(c) - c[0]["pos"]).alias("part")),
    )
    cut = lambda p, g: F.when(g["start"] >= g["pos"], F.concat(F.substring(p["part"], g["pos"] - p["pos"] + 1, g["start"] - g["pos"]), F.lit(mark))).otherwise("")
    joined = F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda g: cut(p, g)), "")), "")
    rest = F.substring(F.col("_q_whole"), F.element_at(upto, -1) + 1, F.length("_q_whole"))
    df = df.withColumn(name, F.when(n <= 0, F.col("_q_whole")).otherwise(F.concat(joined, rest)))
    return df.drop("_q_whole", "_q_spans", "_q_upto", "_q_gaps")
