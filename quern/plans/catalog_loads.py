"""Registered queries of loads into tables, of generated datasets, and of joins and aggregates by declaration."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.governance import evolution, migration, runs
from quern.operators import loads
from quern.plans import generation as g
from quern.plans.catalog import _SCD2_SQL, _shown, _snapshot, declared, outcome, plan, query, table_name
from quern.plans.nodes import Aggregate, Join, JoinEdge, Measure, Predicate, Scan, Select, Sort, build
from quern.sources.scratch import scratch_path
from quern.spec import Column, Dataset, Reference
from quern.streaming.ingest import windowed_counts

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
R1, R2 = loads.RunContext("r1", T1), loads.RunContext("r2", T2)


def kept(t, name: str) -> DataFrame:
    """The rows of a table that goes: they are copied to the scratch folder first."""
    path = scratch_path(t.spark, name)
    t.spark.table(name).write.parquet(path)
    t.spark.sql(f"drop table {name}")
    return t.spark.read.parquet(path)


CORE = Dataset("rc_customer", "rawcore", (Column("c_custkey", "BIGINT", "key"), Column("c_name"), Column("c_acctbal", "DECIMAL(12,2)")), ("stg_customer",))


# --- load modes ---


@query("load_full", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    """The second load replaces the first whole."""
    name, full = table_name("full"), replace(CORE, mode="full")
    for rest in (1, 0):
        loads.load(full, t["customer"].where(f"c_custkey % 2 = {rest}").select("c_custkey", "c_name"), R1, name)
    return kept(t, name)


@query("load_append", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    name, append = table_name("append"), replace(CORE, mode="append")
    for where in ("true", "c_custkey % 2 = 0"):
        loads.load(append, t["customer"].where(where).select("c_custkey", "c_name"), R1, name)
    return kept(t, name)


@query("load_view", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _(t):
    name = table_name("view")
    mode = loads.load(Dataset("v", "serving"), t["customer"].select("c_custkey", F.upper("c_name").alias("c_name")), R1, name)
    return t.spark.table(name) if mode == "view" else None


@query("load_external_skipped", "SELECT c_custkey, c_name FROM customer")
def _(t):
    """An external table keeps its rows, whatever is loaded."""
    name = table_name("external")
    t["customer"].select("c_custkey", "c_name").write.saveAsTable(name)
    mode = loads.load(replace(CORE, materialization="external"), t["customer"].select("c_custkey", F.lit("over").alias("c_name")), R1, name)
    out = kept(t, name)
    return out.where(F.lit(mode == "external"))


_STAGE = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0"


@query(
    "load_merge_with_deletes",
    f"""WITH old AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0), stage AS ({_STAGE})
SELECT * FROM stage UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM stage) AND NOT c_acctbal >= 100""",
)
def _(t):
    """Deletes within the scope, then updates and inserts; the scope's names are rewritten, and texts are cast to the target's types."""
    name = table_name("merge")
    scope = loads.rewrite_scope("s.AcctBal >= 100 and 'AcctBal' <> ''", {"AcctBal": "c_acctbal"}, [c.name for c in CORE.columns])
    core = replace(CORE, mode="merge", detect_deletes=True, scope=scope)
    first = t["customer"].where("c_custkey % 7 <> 0").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
    loads.load(core, first, R1, name)
    stage = t["customer"].where("c_custkey % 11 <> 0")
    stage = stage.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "changed").otherwise(F.col("c_name")).alias("c_name"), F.col("c_acctbal").cast("string").alias("c_acctbal"))
    loads.load(core, stage, R2, name)
    return kept(t, name)


@query(
    "load_merge_in_buckets",
    f"""WITH old AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0), stage AS ({_STAGE} AND c_custkey < 40)
SELECT * FROM stage UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM stage) AND NOT c_custkey < 60""",
)
def _(t):
    """The same as a merge of the whole, but buckets without a change stay as they are."""
    name = table_name("buckets")
    core = replace(CORE, mode="merge", detect_deletes=True, scope="c_custkey < 60", buckets=64)
    rows = t["customer"].select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "changed").otherwise(F.col("c_name")).alias("new"), "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
    loads.load(core, rows.where("c_custkey % 7 <> 0").drop("new"), R1, name)
    loads.load(core, rows.where("c_custkey % 11 <> 0 and c_custkey < 40").select("c_custkey", F.col("new").alias("c_name"), "c_acctbal"), R2, name)
    return kept(t, name).drop(loads.BUCKET)


@query("scd2_in_buckets", f"SELECT k, row_hash, started, ended, version_state, load_run_id FROM ({_SCD2_SQL})")
def _(t):
    name = table_name("versions")
    hist = Dataset("rc_k_hist", "rawcore", (Column("k", "BIGINT", "key"),), buckets=64)
    for n, ctx in ((1, R1), (2, R2)):
        loads.load(hist, _snapshot(t, n), ctx, name)
    return _shown(kept(t, name))


@declared(
    "load_modes",
    "layer string, mode string, outcome string",
    [
        ("raw", None, "full"), ("stage", None, "view"), ("rawcore", None, "merge"), ("rawcore without keys", None, "full"), ("bizcore", None, "full"), ("serving", "merge", "view"),
        ("rawcore", "append", "append"), ("rawcore", "snapshot", "NotImplementedError: snapshot loads"), ("rawcore history", None, "historize"), ("rawcore, external", "merge", "external"),
    ],
)
def _(t):
    cases = [
        ("raw", Dataset("a", "raw")), ("stage", Dataset("a", "stage")), ("rawcore", CORE), ("rawcore without keys", replace(CORE, columns=CORE.columns[1:])), ("bizcore", Dataset("a", "bizcore")),
        ("serving", Dataset("a", "serving", mode="merge")), ("rawcore", replace(CORE, mode="append")), ("rawcore", replace(CORE, mode="snapshot")),
        ("rawcore history", replace(CORE, name="rc_customer_hist")), ("rawcore, external", replace(CORE, mode="merge", materialization="external")),
    ]
    return [(name, d.mode, outcome(lambda d=d: loads.plan_load(d))) for name, d in cases]


@declared(
    "load_refusals",
    "what string, outcome string",
    [
        ("merge, repeated keys", "ValueError: source keys ['k'] repeat"), ("merge without keys", "ValueError: a merge needs keys"),
        ("history, repeated keys", "ValueError: source keys ['k'] repeat"), ("ranked stage without keys", "ValueError: a ranked stage needs business keys"),
    ],
)
def _(t):
    df = t.spark.createDataFrame([("1", "a"), ("1", "b")], "k string, row_hash string")
    return [
        ("merge, repeated keys", outcome(lambda: loads.merge(df, df, ["k"]))),
        ("merge without keys", outcome(lambda: loads.merge(df, df, []))),
        ("history, repeated keys", outcome(lambda: loads.scd2(None, df, "k", R1))),
        ("ranked stage without keys", outcome(lambda: loads.ranked_stage([(df, 1)], []))),
    ]


# --- generated datasets ---

ORDERS = g.SourceTable(
    "erp", "Orders",
    (Column("Order Key", "BIGINT", "key", False, source="o_orderkey"), Column("Status", "STRING", source="o_orderstatus"), Column("Price", "DECIMAL(12,2)", source="o_totalprice")),
)
PEPPER = "pepper"
_KEY = "sha256(concat_ws('|', 'order_key~' || CAST(o_orderkey AS VARCHAR), 'pepper'))"
_HASH = "sha256(concat_ws('|', {status}, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)))"


def generated(t, status, ctx) -> DataFrame:
    """Raw, stage and core rows of orders through the generated datasets."""
    by_name = {d.name: d for d in g.generate([ORDERS], PEPPER)}
    raw = by_name["raw_erp_orders"]
    rows = g.projected(t["orders"].withColumn("o_orderstatus", status), replace(raw, columns=raw.columns), ctx)
    stage = g.projected(rows, by_name["stg_erp_orders"], ctx)
    return g.projected(stage, by_name["rc_erp_orders"], ctx)


@query(
    "generated_core",
    f"""SELECT {_KEY} AS rc_erp_orders_key, o_orderkey AS order_key, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
  {_HASH.format(status='o_orderstatus')} AS row_hash, 'r1' AS load_run_id, TIMESTAMP '2024-01-01' AS loaded_at FROM orders""",
)
def _(t):
    out = generated(t, F.col("o_orderstatus"), R1)
    return out.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))


_NEW = "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END"


def _version(at: str) -> str:
    return f"sha256(concat_ws('|', 'rc_erp_orders_key~' || k, 'version_started_at~{at} 00:00:00', 'pepper'))"


@query(
    "hist_generated_load",
    f"""WITH o AS (SELECT {_KEY} AS k, o_orderkey, o_orderstatus <> {_NEW} AS changed, {_HASH.format(status='o_orderstatus')} AS h1, {_HASH.format(status=_NEW)} AS h2,
  o_orderkey % 5 <> 0 AS in1, o_orderkey % 6 <> 0 AS in2 FROM orders)
SELECT {_version('2024-01-01')} AS rc_erp_orders_hist_key, k AS rc_erp_orders_key, h1 AS row_hash, '2024-01-01' AS started, CASE WHEN NOT in2 OR changed THEN '2024-02-01' END AS ended,
  CASE WHEN NOT in2 THEN 'deleted' WHEN changed THEN 'changed' ELSE 'new' END AS version_state, CASE WHEN NOT in2 OR changed THEN 'r2' ELSE 'r1' END AS load_run_id,
  CASE WHEN NOT in2 OR changed THEN '2024-02-01' ELSE '2024-01-01' END AS loaded FROM o WHERE in1
UNION ALL SELECT {_version('2024-02-01')}, k, h2, '2024-02-01', NULL, CASE WHEN in1 THEN 'changed' ELSE 'new' END, 'r2', '2024-02-01' FROM o WHERE in2 AND (NOT in1 OR changed)""",
)
def _(t):
    """Two loads of the generated history: keys with the pepper, and the time each version was written."""
    name, hist = table_name("hist"), {d.name: d for d in g.generate([ORDERS], PEPPER)}["rc_erp_orders_hist"]
    first = generated(t, F.col("o_orderstatus"), R1).where("order_key % 5 <> 0")
    second = generated(t, F.expr(_NEW.lower().replace("then 'x'", "then 'X'")), R2).where("order_key % 6 <> 0")
    for rows, ctx in ((first, R1), (second, R2)):
        loads.load(hist, rows, ctx, name, PEPPER)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = kept(t, name)
    return out.select(
        "rc_erp_orders_hist_key", "rc_erp_orders_key", "row_hash", day("version_started_at").alias("started"), day("version_ended_at").alias("ended"), "version_state", "load_run_id", day("loaded_at").alias("loaded"),
    )


@query(
    "scd2_reopened",
    """SELECT o_orderkey AS k, 1 AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'deleted' ELSE 'new' END AS version_state FROM orders
UNION ALL SELECT o_orderkey, 2, 'new' FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(t):
    """A key that goes and comes back opens a version again, if that is asked for."""
    base = t["orders"].select(F.col("o_orderkey").alias("k"), F.sha2("o_orderstatus", 256).alias("row_hash"))
    history = loads.scd2(None, base, "k", R1)
    history = loads.scd2(history, base.where("k % 3 <> 0"), "k", R2)
    again = loads.scd2(history, base, "k", loads.RunContext("r3", datetime(2024, 3, 1)), reopen=True)
    return again.select("k", F.when(F.month("version_started_at") == 1, 1).otherwise(2).alias("version"), "version_state")


@query(
    "projection_rules",
    """SELECT sha256(concat_ws('|', 'c_custkey~' || CAST(c_custkey AS VARCHAR))) AS customer_key, 'r1' AS load_run_id, sha256(concat_ws('|', c_name, coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null_replaced'))) AS row_hash,
  upper(c_name) || '!' AS loud, 2 * c_custkey AS twice, c_name AS named, nullif(c_nationkey, 3) AS nation, c_mktsegment AS wanted FROM customer WHERE c_acctbal > 0""",
)
def _(t):
    """Where a column's value comes from: the key, the run, the hash, an expression, in braces or from a template, its source, its name."""
    dataset = Dataset(
        "rc_customer", "rawcore",
        (
            Column("customer_key", "STRING(64)", "surrogate", key_expression=g.key_expression(["c_custkey"])), Column("load_run_id", "STRING(64)", "technical"), Column("row_hash", "STRING(64)", "technical"),
            Column("loud", expression="{{ upper(c_name) || '!' }}"), Column("twice", "BIGINT", expression=g.filled("2 * {expr:key}", names={"key": "c_custkey"})),
            Column("named", source="c_name"), Column("nation", "INTEGER"), Column("hidden", query_derived=True, source="c_mktsegment"), Column("wanted", query_derived=True, source="c_mktsegment"),
            Column("gone", active=False),
        ),
        where="c_acctbal > 0",
    )
    return g.projected(t["customer"].withColumn("nation", F.nullif("c_nationkey", F.lit(3))), dataset, R1, ("wanted",))


@query(
    "fk_generated",
    "SELECT o_orderkey AS id, o_custkey AS customer, sha256(concat_ws('|', 'c_custkey~' || CAST(o_custkey AS VARCHAR), 'pepper')) AS buyer_rc_customer_key FROM orders",
)
def _(t):
    parent = g.with_keys(Dataset("rc_customer", "rawcore", (Column("c_custkey", "BIGINT", "key"),)), PEPPER)
    child = Dataset("rc_orders", "rawcore", (Column("id", "BIGINT", "key", source="o_orderkey"), Column("customer", "BIGINT", source="o_custkey")))
    child = g.with_reference(child, Reference("rc_orders", "rc_customer", {"c_custkey": "customer"}, "buyer"), parent)
    stage = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return g.projected(stage, child, R1)


# --- joins and aggregates ---

plan("scan_function", Select(Scan("range(0, 100)"), {"id": "id", "half": "id / 2"}), "SELECT range AS id, range / 2 AS half FROM range(0, 100)")
plan(
    "join_bare_names",
    Join(
        Scan("orders"),
        (
            JoinEdge(Scan("customer"), (Predicate("o_custkey", "=", "c_custkey"), Predicate("o_totalprice", ">=", "c_acctbal * 10"), Predicate("o_totalprice", "!=", "0"), Predicate("c_name", "IS NOT NULL")), "inner"),
            JoinEdge(Select(Scan("customer"), {"c_custkey": "c_custkey", "segment": "c_mktsegment"}), (Predicate("c_custkey", "=", "c_custkey"), Predicate("c_acctbal", ">", "1000")), "left", "i2"),
        ),
        {"o_orderkey": "i1.o_orderkey", "c_name": "i2.c_name", "segment": "i3.segment"},
    ),
    """SELECT o_orderkey, c.c_name, s.c_mktsegment AS segment FROM orders JOIN customer c ON o_custkey = c.c_custkey AND o_totalprice >= c.c_acctbal * 10 AND o_totalprice <> 0
LEFT JOIN customer s ON c.c_custkey = s.c_custkey AND c.c_acctbal > 1000""",
)
plan(
    "join_range_in_buckets",
    Join(
        Scan("orders"),
        (JoinEdge(Select(Scan("supplier"), {"s_suppkey": "s_suppkey", "low": "s_acctbal * 20", "high": "s_acctbal * 20 + 300"}), (Predicate("o_totalprice", "BETWEEN", ("low", "high")),), "left", bucket=500.0),),
        {"o_orderkey": "i1.o_orderkey", "s_suppkey": "i2.s_suppkey"},
    ),
    "SELECT o_orderkey, s_suppkey FROM orders LEFT JOIN supplier ON o_totalprice BETWEEN s_acctbal * 20 AND s_acctbal * 20 + 300",
)
plan(
    "join_like_of_parts",
    Join(Scan("part"), (JoinEdge(Scan("nation"), (Predicate("p_name", "LIKE", "concat('%', n_nationkey, '%')"),), "inner"),), {"p_partkey": "i1.p_partkey", "n_name": "i2.n_name"}),
    "SELECT p_partkey, n_name FROM part JOIN nation ON p_name LIKE '%' || n_nationkey || '%'",
)
plan(
    "agg_needed_inputs",
    Aggregate(Select(Scan("orders"), {"status": "o_orderstatus"}, "o_totalprice > 1000"), {"status": "status", "o_orderpriority": "priority"}, {"n": Measure("COUNT", "o_custkey"), "last": Measure("MAX", "o_orderkey")}),
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(o_custkey) AS n, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2",
)


@query("agg_string_agg_of_parts", "SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return build(Aggregate(Scan("part"), {"p_brand": "p_brand"}, {"types": Measure("STRING_AGG", "p_type", order_by=(Sort("p_type"),)), "n": Measure("COUNT")}), t)


# --- streams, migrations and logs, on tables ---


@query("stream_watermarked_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    """A stream of the table's files, in the order of time, with a watermark: closed windows only, and one late row to close the last ones."""
    source, name, path = scratch_path(t.spark, "stream"), table_name("stream"), scratch_path(t.spark, "checkpoint")
    events = t["events"].select("ts", "event_type")
    events.write.parquet(f"{source}/1")
    far = t.spark.createDataFrame([(datetime(2200, 1, 1), "end")], "ts timestamp_ntz, event_type string").select(F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), "event_type")
    for turn in (1, 2):
        if turn == 2:
            far.write.parquet(f"{source}/2")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{source}/*")
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        write = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("append").option("checkpointLocation", path)
        write.trigger(availableNow=True).toTable(name).awaitTermination()
    out = kept(t, name)
    return out.where("event_type <> 'end'").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


OLD = [Dataset("rc_part", "rawcore", (Column("p_partkey", "BIGINT", "key"), Column("p_name", "STRING(40)"), Column("p_size", "INTEGER"), Column("p_brand")))]
NEW = [
    Dataset(
        "rc_item", "rawcore",
        (Column("p_partkey", "BIGINT", "key"), Column("item_name", "STRING(8)", former_names=("p_name",)), Column("p_size", "BIGINT"), Column("listed", "DATE")), former_names=("rc_part",),
    ),
    Dataset("rc_shelf", "rawcore", (Column("shelf", "INTEGER", "key"),)),
]


@query(
    "migration_executed",
    "SELECT p_partkey, left(p_name, 8) AS item_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS DATE) AS listed FROM part",
)
def _(t):
    """A renamed table with a renamed and shortened column, a wider one, a new one, and one dropped."""
    tag = uuid.uuid4().hex[:8]
    named = lambda ds: [replace(d, name=f"{d.name}_{tag}", former_names=tuple(f"{n}_{tag}" for n in d.former_names)) for d in ds]
    old, new = named(OLD), named(NEW)
    t["part"].select("p_partkey", "p_name", "p_size", "p_brand").write.saveAsTable(old[0].name)
    actions = migration.plan(old, new, allow_drop=True)
    done = migration.execute(t.spark, actions, old, new, allow_lossy=True, allow_drop=True)
    shelf = t.spark.table(new[1].name)
    whole = len(done) == 7 and shelf.columns == ["shelf"]
    t.spark.sql(f"drop table {new[1].name}")
    return kept(t, new[0].name).where(F.lit(whole))


@query("truncate_on_rebuild", "SELECT c_custkey, left(c_name, 10) AS c_name FROM customer")
def _(t):
    old, new = (Dataset("t", "rawcore", (Column("c_custkey", "BIGINT", "key"), Column("c_name", f"STRING({n})"))) for n in (30, 10))
    return evolution.migrate(t["customer"].select("c_custkey", "c_name"), old, new, allow_lossy=True)


@declared(
    "run_log_rows",
    "target_dataset string, run_kind string, mode string, status string, status_reason string, blocked_by string, attempt_no int, columns int",
    [
        ("raw_a", "ingestion", "full", "success", None, None, 1, 28), ("stg_a", "sql", "view", "error", "retry_exhausted", None, 2, 28),
        ("rc_a", "sql", "merge", "skipped", "blocked_by_dependency", "stg_a", 1, 28),
    ],
)
def _(t):
    datasets = {"raw_a": Dataset("raw_a", "raw"), "stg_a": Dataset("stg_a", "stage"), "rc_a": replace(CORE, name="rc_a")}
    inputs = {"raw_a": (), "stg_a": ("raw_a",), "rc_a": ("stg_a",)}

    def step(name):
        if name == "stg_a":
            raise ValueError("no")

    name = table_name("log")
    results = runs.execute(inputs, step, retries=1, fail_fast=False)
    runs.log_run(t.spark, name, runs.run_rows("b1", datasets, results, T1))
    df = t.spark.table(name)
    out = [(r.target_dataset, r.run_kind, r.mode, r.status, r.status_reason, r.blocked_by, r.attempt_no, len(df.columns)) for r in df.collect()]
    t.spark.sql(f"drop table {name}")
    return out
