"""Load operators: pure functions from the target and its source to the new target.

Parquet tables know no MERGE, so each operator gives the whole new table, which
``swap_table`` puts in the old one's place. The table of a dataset with buckets is
partitioned by hash of its keys, and only the buckets that a load changes are rewritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.keys import sk
from quern.sources.scratch import scratch_path
from quern.spec import LAYERS, Dataset


@dataclass(frozen=True)
class RunContext:
    run_id: str
    ts: datetime

    def fill(self, text: str, cutoff: datetime | None = None) -> str:
        """text with the placeholders for the run id, its time and the cutoff."""
        values = {"load_run_id": self.run_id, "load_timestamp": f"{self.ts:%Y-%m-%d %H:%M:%S.%f}"}
        if cutoff is not None:
            values["DELTA_CUTOFF"] = f"{cutoff:%Y-%m-%d %H:%M:%S}"
        for name, value in values.items():
            text = re.sub(r"\{{1,2}\s*" + name + r"\s*\}{1,2}", lambda _, v=value: f"'{v}'", text)
        if re.search(r"\{{1,2}\s*DELTA_CUTOFF", text):
            raise ValueError("the filter needs a cutoff, and no policy gives one")
        return text


def _same(keys: list[str], left: str = "t", right: str = "s") -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`"))
    return on


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"source keys {keys} repeat")


def merge(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """target with source's rows in place of those of equal keys, and the rest of them added.

    Null keys match nothing. The source's columns are cast to the target's types.
    """
    if not keys:
        raise ValueError("a merge needs keys")
    if check:
        check_unique(source.where(" and ".join(f"`{k}` is not null" for k in keys)), keys)
    fresh = source.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema.fields])
    kept = target.alias("t").join(fresh.select(*keys).alias("s"), _same(keys), "left_anti")
    return kept.unionByName(fresh)


def delete_missing(target: DataFrame, source: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """target without the rows in scope whose keys source lacks; a null scope keeps a row."""
    inside = F.coalesce(F.expr(scope), F.lit(False))
    flagged = target.withColumn("_q_in", inside)
    marked = flagged.alias("t").join(source.select(*keys).distinct().withColumn("_q_hit", F.lit(True)).alias("s"), _same(keys), "left")
    return marked.where(~F.col("_q_in") | F.col("_q_hit").isNotNull()).select(*[F.col(f"t.`{c}`") for c in target.columns])


def rewrite_scope(text: str, names: dict[str, str], columns: list[str]) -> str:
    """A source filter with each identifier replaced by the target's name, whatever its case or underscores."""
    plain = lambda s: s.replace("_", "").lower()
    table = {plain(c): c for c in columns} | {plain(k): v for k, v in names.items()}
    parts = re.split(r"('(?:[^']|'')*')", text)
    known = lambda m: table.get(plain(m[1]), m[0])
    return "".join(p if p.startswith("'") else re.sub(r"(?:[A-Za-z_]\w*\.)?\b([A-Za-z_]\w*)\b(?!\s*\()", known, p) for p in parts)


VERSION = ("version_started_at", "version_ended_at", "version_state", "load_run_id")
#: What a history may hold besides; it says when a row was written.
LOADED = "loaded_at"


def scd2(
    history: DataFrame | None, base: DataFrame, key: str, ctx: RunContext, hash_column: str = "row_hash", reopen: bool = False, version_key: str = "hist_key", pepper: str = "", check: bool = True, stamped: bool = False
) -> DataFrame:
    """history after one run: changed and deleted versions are closed, changed and new ones opened.

    A key that was deleted and comes back stays closed unless reopen is set. A null
    hash on either side means unchanged. A key that repeats in base is an error. With
    stamped, or where the base has loaded_at, each version has the time it was written. One join of the versions with
    the base gives both what is closed and what is opened.
    """
    ts, run = F.lit(ctx.ts), F.lit(ctx.run_id)
    columns = [c for c in base.columns if c not in (*VERSION, LOADED)]
    stamped = stamped or LOADED in base.columns
    if check:
        check_unique(base.where(F.col(key).isNotNull()), [key])
    new_key = lambda k: sk({key: k, "version_started_at": ts}, pepper)

    def opened(value, state: Column) -> list[Column]:
        out = [new_key(value(key)).alias(version_key), *[value(c).alias(c) for c in columns]]
        out += [ts.alias("version_started_at"), F.lit(None).cast("timestamp").alias("version_ended_at"), state.alias("version_state"), run.alias("load_run_id")]
        return out + ([ts.alias(LOADED)] if stamped else [])

    if history is None:
        return base.select(*opened(lambda c: F.col(f"`{c}`"), F.lit("new")))
    h, b = F.struct(*[F.col(f"`{c}`") for c in history.columns]).alias("h"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("b")
    old, now = history.select(F.col(key).alias("_q_key"), h), base.select(F.col(key).alias("_q_base"), b)
    j = old.join(now, F.col("_q_key") == F.col("_q_base"), "full")
    is_open = F.col("h").isNotNull() & F.col("h.version_ended_at").isNull()
    fresh = F.col("h").isNull()
    if reopen:  # each base row meets all versions of its key: the first one speaks for those without an open one
        first = Window.partitionBy(F.coalesce("_q_key", "_q_base")).orderBy(is_open.desc(), F.col(f"h.{version_key}"))
        j = j.withColumn("_q_place", F.when(F.col("_q_base").isNotNull(), F.row_number().over(first)))
        fresh = fresh | ((F.col("_q_place") == 1) & ~is_open)
    j = j.withColumn("_q_open", is_open)
    changed = F.col("_q_open") & F.coalesce(F.col(f"h.{hash_column}") != F.col(f"b.{hash_column}"), F.lit(False))
    closed = changed | (F.col("_q_open") & F.col("_q_base").isNull())
    kept = [
        F.col(f"h.`{c}`").alias(c) for c in (version_key, *columns, "version_started_at")
    ] + [
        F.when(F.col("_q_closed"), ts).otherwise(F.col("h.version_ended_at")).alias("version_ended_at"),
        F.when(F.col("_q_changed"), "changed").when(F.col("_q_closed"), "deleted").otherwise(F.col("h.version_state")).alias("version_state"),
        F.when(F.col("_q_closed"), run).otherwise(F.col("h.load_run_id")).alias("load_run_id"),
    ]
    if stamped:
        kept.append(F.when(F.col("_q_closed"), ts).otherwise(F.col(f"h.{LOADED}")).alias(LOADED))
    begun = opened(lambda c: F.col(f"b.`{c}`"), F.when(F.col("_q_changed"), "changed").otherwise("new"))
    j = j.withColumns({"_q_changed": changed, "_q_closed": closed, "_q_fresh": fresh})
    versions = F.array(F.when(F.col("h").isNotNull(), F.struct(*kept)), F.when(F.col("_q_changed") | F.col("_q_fresh"), F.struct(*begun)))
    return j.select(F.explode(F.filter(versions, lambda v: v.isNotNull())).alias("v")).select("v.*")


def ranked_stage(branches: list[tuple[DataFrame, int | None]], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The union of branches, of which each key's row comes from the branch of the lowest ordinal.

    Columns that a branch lacks are null. Ties within a branch go by order, then by
    all columns.
    """
    if not keys:
        raise ValueError("a ranked stage needs business keys")
    out = None
    for df, ordinal in branches:
        part = df.withColumn("_q_ordinal", F.lit(999999 if ordinal is None else ordinal))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = [F.col(c).asc_nulls_first() for c in sorted(out.columns) if c not in keys]
    window = Window.partitionBy(*keys).orderBy("_q_ordinal", *(order or []), *rest)
    return out.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn", "_q_ordinal")


def identity_stage(branches: list[tuple[DataFrame, str]]) -> DataFrame:
    """The union of branches, each row with the identity of its source."""
    out = None
    for df, identity in branches:
        part = df.select(F.lit(identity).alias("source_identity_id"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def plan_load(dataset: Dataset) -> str:
    """external, view, historize, full, append or merge."""
    layer = LAYERS[dataset.layer]
    mode, kind = dataset.mode or layer.mode, dataset.materialization or layer.materialization
    if kind in ("external", "view"):
        return kind
    if dataset.name.endswith("_hist"):
        return "historize"
    if mode == "snapshot":
        raise NotImplementedError("snapshot loads")
    if mode == "merge" and not (dataset.layer == "rawcore" and dataset.keys and dataset.inputs):
        return "full"
    return mode


def restored(spark: SparkSession, name: str) -> bool:
    """Whether the table exists, once a swap that failed between its renames is undone."""
    if spark.catalog.tableExists(name):
        return True
    if not spark.catalog.tableExists(f"{name}__old"):
        return False
    spark.sql(f"alter table {name}__old rename to {name}")
    return True


def swap_table(df: DataFrame, name: str) -> None:
    """Writes df beside the table and puts it in its place; the old one goes last, so a failure loses nothing."""
    spark: SparkSession = df.sparkSession
    fresh, old = f"{name}__new", f"{name}__old"
    there = restored(spark, name)
    spark.sql(f"drop table if exists {fresh}")
    df.write.saveAsTable(fresh)
    spark.sql(f"drop table if exists {old}")
    if there:
        spark.sql(f"alter table {name} rename to {old}")
    spark.sql(f"alter table {fresh} rename to {name}")
    spark.sql(f"drop table if exists {old}")


BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _numbers(df: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets of df's rows: no more numbers than there are buckets."""
    return sorted(r[0] for r in df.select(bucket_of(keys, buckets)).distinct().collect())


def rewrite_buckets(table: str, keys: list[str], buckets: int, touched: list[int], change) -> None:
    """Puts change(rows of the buckets touched) in their place; no other bucket is read or written.

    The new rows are complete in the scratch folder before the first bucket is replaced. Run again, a load that
    failed between its buckets ends as it would have: merges and histories of one run do not add up.
    """
    if not touched:
        return
    spark = SparkSession.active()
    there = spark.table(table)
    fresh = change(there.where(F.col(BUCKET).isin(touched)).drop(BUCKET)).withColumn(BUCKET, bucket_of(keys, buckets))
    path = scratch_path(spark, "buckets")
    fresh.select(*[F.col(f"`{c}`") for c in there.columns]).write.parquet(path)
    rows, name = spark.read.parquet(path), "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(name, before)
    for b in sorted(set(touched) - {r[0] for r in rows.select(BUCKET).distinct().collect()}):
        spark.sql(f"alter table {table} drop if exists partition ({BUCKET} = {b})")


def _load_buckets(dataset: Dataset, df: DataFrame, mode: str, ctx: RunContext, table: str, pepper: str) -> None:
    spark, keys, n = df.sparkSession, dataset.keys, dataset.buckets
    target = spark.table(table).drop(BUCKET)
    if mode == "merge":
        check_unique(df.where(" and ".join(f"`{k}` is not null" for k in keys)), keys)
        gone = target.limit(0)
        if dataset.detect_deletes and dataset.scope:
            scoped = target.where(F.coalesce(F.expr(dataset.scope), F.lit(False)))
            gone = scoped.alias("t").join(df.select(*keys).alias("s"), _same(keys), "left_anti")
        touched = sorted({*_numbers(df, keys, n), *_numbers(gone, keys, n)})

        def change(rows: DataFrame) -> DataFrame:
            if dataset.detect_deletes and dataset.scope:
                rows = delete_missing(rows, df, keys, dataset.scope)
            return merge(rows, df, keys, check=False)

    else:
        check_unique(df.where(F.col(keys[0]).isNotNull()), keys[:1])
        options = {"version_key": f"{dataset.name}_key", "pepper": pepper, "stamped": LOADED in {c.name for c in dataset.columns}, "check": False}
        whole = scd2(target, df, keys[0], ctx, **options)
        # what this run writes bears its id and time
        mine = (F.col("load_run_id") == ctx.run_id) & ((F.col("version_started_at") == F.lit(ctx.ts)) | (F.col("version_ended_at") == F.lit(ctx.ts)))
        touched = _numbers(whole.where(mine), keys[:1], n)

        def change(rows: DataFrame) -> DataFrame:
            return scd2(rows, df.where(bucket_of(keys[:1], n).isin(touched)), keys[0], ctx, **options)

    rewrite_buckets(table, keys if mode == "merge" else keys[:1], n, touched, change)


def load(dataset: Dataset, df: DataFrame, ctx: RunContext, table: str | None = None, pepper: str = "") -> str:
    """Materializes df as the dataset by its load mode; the mode used. An external table is left as it is."""
    spark, table = df.sparkSession, table or dataset.name
    mode = plan_load(dataset)
    if mode == "external":
        return mode
    there = mode != "view" and restored(spark, table)
    if mode == "view":
        df.createOrReplaceTempView(table)
    elif mode == "append":
        df.write.mode("append").saveAsTable(table)
    elif dataset.buckets and there and mode in ("historize", "merge"):
        _load_buckets(dataset, df, mode, ctx, table, pepper)
    elif dataset.buckets and mode in ("historize", "merge"):
        options = {"version_key": f"{dataset.name}_key", "pepper": pepper, "stamped": LOADED in {c.name for c in dataset.columns}}
        rows = scd2(None, df, dataset.keys[0], ctx, **options) if mode == "historize" else df
        keys = dataset.keys[:1] if mode == "historize" else dataset.keys
        rows.withColumn(BUCKET, bucket_of(keys, dataset.buckets)).repartition(BUCKET).write.partitionBy(BUCKET).saveAsTable(table)
    elif mode == "historize":
        swap_table(scd2(spark.table(table) if there else None, df, dataset.keys[0], ctx, version_key=f"{dataset.name}_key", pepper=pepper, stamped=LOADED in {c.name for c in dataset.columns}), table)
    elif mode == "merge" and there:
        target = spark.table(table)
        if dataset.detect_deletes and dataset.scope:
            target = delete_missing(target, df, dataset.keys, dataset.scope)
        swap_table(merge(target, df, dataset.keys), table)
    else:
        swap_table(df, table)
    return mode
