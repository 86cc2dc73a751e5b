"""Mixing sources to target weights by Pareto order sampling.

Native: every step is a DataFrame expression.

The targets come from weights by water filling: sources take their share of the
total by weight, none more than ``cap`` times its size. Within a source a document
expects copies in proportion to its weight, none more than ``cap``, so that they come to the target.
Each first gets the whole copies that this makes certain. The rest is
drawn: documents are ranked by Pareto's u / (1 - u) divided by f / (1 - f), where u
is a hash in (0, 1) and f the inclusion probability, what is left of the expected
copies, and the first ones whose sizes come nearest the rest are taken once more. One
document is then added or left out where that brings the source nearer.

No source is gathered in one task, nor all sources: levels are found by sums, and the
place where a rest runs out by sums over ever finer buckets of the rank, of which
only the last is ordered. The texts are cut into words once.

Null texts have no words. The null source is a source of its own and comes last.
Null ids are allowed. Rows that agree in id, source, text and weight are numbered, and each is drawn
for itself: how many of them are taken is fixed, which of them is not. A weight that is null
or not above 0 counts as 1. Extra columns stay; those named like an output are
replaced. The result is a function of the rows alone, so reruns agree. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, documents, text_of, work_table

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Buckets of the rank: LEVELS times 2^BITS within one of the level before. The last one of a source holds about its rows / 2^21.
LEVELS, BITS = 3, 7
#: Equal rows that one task numbers.
BLOCK = 1 << 16
#: Rows of about 100 bytes up to which a table is broadcast.
MOST_BROADCAST = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table to join with, of so many rows at most: broadcast if that allows it."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with at: the number of each row, from 0, in the order of key, which is unique."""
    df = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_q_at", F.monotonically_increasing_id())
    df = work_table(df, "mix-order")
    part = F.shiftright("_q_at", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, so_far = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(so_far)
        so_far += sizes.get(p, 0)
    at = F.element_at(F.lit(before), part + 1) + F.col("_q_at").bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("at", at.cast("long")).drop("_q_at")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (key, source_size) with target: the lesser of cap x size and level x weight, which come to share of all sizes."""
    w = F.element_at(F.lit([float(x) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    df = numbered(sources, "key").select("key", "source_size", w.alias("w"), (cap * F.col("source_size")).alias("limit"))
    full, level, capped = 0.0, 0.0, -1
    while True:  # the level rises until no more sources are capped
        fits = F.col("limit") <= level * F.col("w")
        row = df.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(fits, F.col("limit"))).alias("full"), F.sum(F.when(~fits, F.col("w"))).alias("left"), F.count_if(fits).alias("n")
        ).first()
        if row["n"] == capped:
            break
        full, capped = row["full"] or 0.0, row["n"]
        level = (share * (row["total"] or 0) - full) / row["left"] if row["left"] else float("inf")
    return df.select("key", "source_size", F.least(F.col("limit"), level * F.col("w")).alias("target"))


def copies(groups: DataFrame, sources: DataFrame, cap: float, n: int) -> DataFrame:
    """groups (key, w, words) with whole and part: of the copies that documents of that weight expect. n: how many sources there are."""
    groups = groups.join(few(sources.select("key", "target"), n), "key")
    state = groups.groupBy("key").agg(F.when(F.sum("words") > 0, F.first("target") / F.sum(F.col("words") * F.col("w"))).alias("rate"), F.lit(0).cast("long").alias("n"))
    while True:  # the rates rise until no more groups are capped
        at = groups.join(few(state, n), "key")
        fits = F.col("rate") * F.col("w") >= cap
        left, full = F.sum(F.when(~fits, F.col("words") * F.col("w"))), F.coalesce(F.sum(F.when(fits, F.col("words"))), F.lit(0))
        rate = F.when(left > 0, (F.first("target") - cap * full) / left).otherwise(F.first("rate"))
        fresh = work_table(at.groupBy("key").agg(rate.alias("rate"), F.count_if(fits).alias("n"), F.first("n").alias("was")), "mix-rate")
        if fresh.where("n != was").limit(1).count() == 0:
            break
        state = fresh.drop("was")
    expected = F.least(F.lit(cap), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("w"))
    return at.select("key", "w", "words", F.floor(expected).alias("whole"), (expected - F.floor(expected)).alias("part"))


def _named(docs: DataFrame, weight: Column, with_text: bool) -> DataFrame:
    """A row table: the row itself, key (nulls last), size, weight, two hashes of the row and its number."""
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    size = F.size(F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))).cast("long")
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), key, F.col("text").cast("string"), weight]
    kept = [f"`{c}`" for c in docs.columns if with_text or c != "text"]
    rows = docs.select(F.struct(*kept).alias("row"), key.alias("key"), size.alias("size"), weight.alias("w"), F.xxhash64(*same).alias("h"), F.xxhash64(F.lit(1), *same).alias("g"))
    return work_table(rows.withColumn("m", F.monotonically_increasing_id()), "mix-rows")


def _equals(rows: DataFrame) -> tuple[DataFrame, int] | None:
    """(m, j), the number of each row among equal ones, from 0, and how many rows that are; None where no rows are equal. No group is one task's work."""
    again = work_table(rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "mix-equal")
    n = again.count()
    if n == 0:
        return None
    block = F.pmod(F.xxhash64("m"), F.ceil(F.col("n") / BLOCK)).cast("int")
    mine = work_table(rows.select("h", "g", "m").join(few(again, n), ["h", "g"]).withColumn("block", block).drop("n"), "mix-blocks")
    sizes = mine.groupBy("h", "g", "block").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("h", "g").orderBy("block")
    sizes = sizes.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("h", "g", "block").orderBy("m"))
    mine = mine.withColumn("rank", rank).join(sizes, ["h", "g", "block"])
    out = work_table(mine.select("m", (F.col("before") + F.col("rank") - 1).alias("j")), "mix-numbers")
    return out, out.count()


def _placed(rows: DataFrame, equals: tuple[DataFrame, int] | None, fates: tuple[DataFrame, int], seed: int) -> DataFrame:
    """rows with whole, part, place, by Pareto's odds, within (0, 1), and tie."""
    df = rows.withColumn("j", F.lit(0).cast("long")) if equals is None else rows.join(few(*equals), "m", "left").withColumn("j", F.coalesce("j", F.lit(0)))
    df = df.join(few(*fates), ["key", "w"])
    bits = F.xxhash64(F.lit(seed), "h", "g", "j").bitwiseAND(F.lit((1 << 52) - 1))
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    place = F.when(F.col("part") > 0, odds / (1 + odds))
    return df.withColumns({"place": place, "tie": F.xxhash64(F.lit(seed), "j", "g", "h")})


def _bucket(level: int) -> Column:
    return F.floor(F.col("place") * float(1 << (BITS * level)))


def _drawn() -> Column:
    inside = F.struct("place", "tie") <= F.struct(F.col("end.place"), F.col("end.tie"))
    early = F.col("edge").isNull() | (_bucket(LEVELS) < F.col("edge")) | ((_bucket(LEVELS) == F.col("edge")) & F.coalesce(inside, F.lit(False)))
    return F.coalesce(F.col("place").isNotNull() & (F.col("rest") > 0) & early, F.lit(False))


def _plan(ranked: DataFrame, rests: DataFrame, cap: float, n: int) -> DataFrame:
    """(key, rest, before, edge, end, upto, swap): what decides each document's draw, a row for each source."""
    state = rests.withColumns({"before": F.lit(0.0), "edge": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        inside = ranked.join(few(state, n), "key").where(_bucket(level - 1) == F.col("edge"))
        words = inside.groupBy("key", _bucket(level).alias("bucket")).agg(F.sum("size").cast("double").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))  # at most 2^BITS rows of a source
        over = words.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
        edges = over.groupBy("key").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before"))
        state = work_table(state.drop("before", "edge").join(edges, "key", "left"), "mix-edges")

    # the last document taken there
    last = ranked.join(few(state, n), "key").where(_bucket(LEVELS) == F.col("edge"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("place", "tie"))
    last = last.withColumn("upto", upto).withColumn("gap", F.abs(F.col("upto") - F.col("rest")))
    ends = last.groupBy("key").agg(F.min(F.struct("gap", "place", "tie", "upto")).alias("end"))
    all_of = ranked.groupBy("key").agg(F.sum("size").cast("double").alias("words"))
    state = state.join(ends, "key", "left").join(all_of, "key", "left")
    none = F.col("end").isNotNull() & (F.col("end.gap") >= F.abs(F.col("before") - F.col("rest")))
    upto = F.when(F.col("edge").isNull(), F.coalesce("words", F.lit(0.0))).when(none, F.col("before")).otherwise(F.col("end.upto"))
    state = work_table(state.withColumns({"upto": upto, "end": F.when(~none, F.col("end"))}).drop("words"), "mix-ends")

    # the document whose change brings the source nearest its target, if that is nearer than now
    gap, drawn = F.col("rest") - F.col("upto"), _drawn()
    moved = F.when(drawn, -F.col("size")).otherwise(F.col("size"))
    closer = (F.abs(gap - moved) < F.abs(gap)) & (F.col("whole") + F.when(drawn, 0).otherwise(1) <= cap)
    change = F.struct(F.abs(gap - moved).alias("left"), "place", "tie")
    swaps = ranked.join(few(state, n), "key").where(closer).groupBy("key").agg(F.min(change).alias("swap"))
    return work_table(state.join(swaps, "key", "left"), "mix-plan")


def length_weight(text: Column) -> Column:
    """A document's weight by its length: the number of binary digits of its letters."""
    return F.floor(F.log2(F.coalesce(F.length(text), F.lit(0)) + 1.0)) + 1.0


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 9, weight_column: str | None = None, with_text: bool = True
) -> DataFrame:
    """docs with size, source_size, target and taken, the words that the mix takes.

    weight_column: a weight of a document within its source, which expected copies
    follow; without it all weigh alike. No document is taken more than cap times, rounded up.
    Without with_text the text is left out.
    """
    weight = F.lit(1.0) if weight_column is None else F.col(weight_column).cast("double")
    rows = _named(docs, F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0), with_text)
    groups = work_table(rows.groupBy("key", "w").agg(F.sum("size").alias("words")), "mix-groups")
    sums = work_table(groups.groupBy("key").agg(F.sum("words").alias("source_size")), "mix-sums")
    n, n_groups = sums.count(), groups.count()
    sources = work_table(targets(sums, weights, share, cap), "mix-targets")
    fates = work_table(copies(groups, sources, cap, n), "mix-copies")
    certain = fates.groupBy("key").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    rests = work_table(sources.join(certain, "key").select("key", (F.col("target") - F.col("certain")).alias("rest")), "mix-rests")
    fates = (fates.drop("words"), n_groups)
    equals = _equals(rows)
    placed = _placed(rows.drop("row"), equals, fates, seed).where("place is not null and size > 0")
    ranked = work_table(placed.select("key", "place", "tie", "size", "whole"), "mix-ranked")
    plan = _plan(ranked, rests, cap, n)
    df = _placed(rows, equals, fates, seed).join(few(plan.join(sources, "key"), n), "key")
    changed = (F.col("swap.place") == F.col("place")) & (F.col("swap.tie") == F.col("tie"))
    drawn = _drawn() != F.coalesce(changed & (F.col("size") > 0), F.lit(False))
    taken = (F.col("whole") + drawn.cast("int")) * F.col("size")
    out = df.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c.lower() not in added and (with_text or c != "text")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: what the mix takes of every document, longer ones weighing more."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text").withColumn("_q_weight", length_weight(F.col("text")))
    return mix(docs, weight_column="_q_weight", with_text=False).select("doc_id", "size", "source_size", "target", "taken")
