"""The registered queries of the core operators, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import loads
from quern.plans.nodes import (
    Aggregate, Branch, Join, JoinEdge, Measure, Predicate, Scan, Select, Sort, Union, WindowColumn, WindowNode, build,
)
from quern.sources import landing
from quern.streaming.ingest import windowed_counts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables(Mapping):
    """Reads a table when a plan asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __contains__(self, name) -> bool:
        return name in TABLES

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def plan(name: str, node, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(node, Tables(spark, sf_dir))
    SQL[name] = sql


def query(name: str, sql: str):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        SQL[name] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- scans, projections, filters ---

plan("scan_nation", Scan("nation"), "SELECT * FROM nation")
plan(
    "project_expressions",
    Select(Scan("lineitem"), {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "net": "cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(6,2))", "flags": "concat(l_returnflag, '/', l_linestatus)", "big": "l_quantity >= 25"}),
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(6,2)) AS net, l_returnflag || '/' || l_linestatus AS flags, l_quantity >= 25 AS big FROM lineitem",
)
plan(
    "filter_static_increment",
    Select(Scan("orders"), {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}, "o_orderstatus = 'F' and o_orderdate >= timestamp_ntz'1995-01-01 00:00:00'"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'",
)
plan("distinct_rows", Select(Scan("lineitem"), {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, distinct=True), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
plan(
    "order_limit_offset",
    Select(Scan("orders"), {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}, order_by=(Sort("o_totalprice", "desc", "last"), Sort("o_orderkey")), limit=50, offset=10),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10",
)
plan(
    "subquery_scan",
    Select(Select(Scan("customer"), {"id": "c_custkey", "seg": "c_mktsegment"}, "c_acctbal > 0"), {"id": "id"}, "seg = 'BUILDING'"),
    "SELECT id FROM (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) u WHERE seg = 'BUILDING'",
)
plan(
    "scalar_nodes",
    Select(Scan("customer"), {"c_custkey": "c_custkey", "both": "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')", "joined": "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'))", "nulled": "concat(c_name, nullif(c_mktsegment, 'BUILDING'))", "cut": "substring(c_name, 1, 5)", "digest": "sha2(c_name, 256)", "text": "cast(c_nationkey as string)"}),
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS both, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING')) AS joined, c_name || nullif(c_mktsegment, 'BUILDING') AS nulled, substring(c_name, 1, 5) AS cut, sha256(c_name) AS digest, CAST(c_nationkey AS VARCHAR) AS text FROM customer",
)

# --- joins: some customers lack orders, some nations are dropped, so that outer sides show ---

_ROWS = Select(Scan("customer"), {"c_custkey": "c_custkey", "k": "if(c_custkey % 10 = 0, null, c_nationkey)"})
_ROWS_SQL = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer)"
for _how in ("inner", "left", "right", "full"):
    plan(
        f"join_{_how}",
        Join(_ROWS, (JoinEdge(Select(Scan("nation"), {"n_nationkey": "n_nationkey + 3", "n_name": "n_name"}), (Predicate("i1.k", "=", "i2.n_nationkey"),), _how),), {"c_custkey": "i1.c_custkey", "n_name": "i2.n_name"}),
        f"SELECT c_custkey, n_name FROM {_ROWS_SQL} c {_how.upper()} JOIN (SELECT n_nationkey + 3 AS n_nationkey, n_name FROM nation) n ON c.k = n.n_nationkey",
    )
plan("join_cross", Join(Scan("region"), (JoinEdge(Scan("nation"), (), "cross"),), {"r_name": "i1.r_name", "n_name": "i2.n_name"}), "SELECT r_name, n_name FROM region CROSS JOIN nation")
plan(
    "join_between",
    Join(Scan("part"), (JoinEdge(Scan("region"), (Predicate("i1.p_size", "BETWEEN", ("i2.r_regionkey * 10", "i2.r_regionkey * 10 + 9")),), "inner"),), {"p_partkey": "i1.p_partkey", "r_name": "i2.r_name"}),
    "SELECT p_partkey, r_name FROM part JOIN region ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 9",
)
plan(
    "join_like",
    Join(Scan("nation"), (JoinEdge(Scan("region"), (Predicate("i1.n_name", "LIKE", "concat('%', i2.r_regionkey, '%')"),), "left"),), {"n_name": "i1.n_name", "r_name": "i2.r_name"}),
    "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_name LIKE '%' || r_regionkey || '%'",
)
plan(
    "join_in_list",
    Join(Scan("nation"), (JoinEdge(Scan("region"), (Predicate("i1.n_regionkey", "=", "i2.r_regionkey"), Predicate("i2.r_regionkey", "IN", ("0", "2"))), "left"),), {"n_name": "i1.n_name", "r_name": "i2.r_name"}),
    "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey IN (0, 2)",
)
plan(
    "join_null_tests",
    Join(_ROWS, (JoinEdge(Scan("region"), (Predicate("i1.k", "IS NULL"), Predicate("i2.r_regionkey", "<", "2")), "inner"),), {"c_custkey": "i1.c_custkey", "r_name": "i2.r_name"}),
    f"SELECT c_custkey, r_name FROM {_ROWS_SQL} c JOIN region ON c.k IS NULL AND r_regionkey < 2",
)
plan(
    "join_semi",
    Join(Scan("customer"), (JoinEdge(Select(Scan("orders"), None, "o_totalprice > 400000"), (Predicate("i1.c_custkey", "=", "i2.o_custkey"),), "semi"),), {"c_custkey": "i1.c_custkey"}),
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
plan(
    "join_anti",
    Join(Scan("customer"), (JoinEdge(Select(Scan("orders"), None, "o_totalprice > 400000"), (Predicate("i1.c_custkey", "=", "i2.o_custkey"),), "anti"),), {"c_custkey": "i1.c_custkey"}),
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
_CHAIN = Join(
    Scan("lineitem"),
    (
        JoinEdge(Scan("orders"), (Predicate("i1.l_orderkey", "=", "i2.o_orderkey"),), "inner"),
        JoinEdge(Scan("customer"), (Predicate("i2.o_custkey", "=", "i3.c_custkey"),), "inner"),
        JoinEdge(Scan("nation"), (Predicate("i3.c_nationkey", "=", "i4.n_nationkey"),), "inner"),
        JoinEdge(Scan("region"), (Predicate("i4.n_regionkey", "=", "i5.r_regionkey"),), "inner"),
    ),
    {"r_name": "i5.r_name", "n_name": "i4.n_name", "price": "cast(i1.l_extendedprice as decimal(18,2))"},
)
plan(
    "join_chain_5",
    Aggregate(_CHAIN, {"r_name": "r_name", "n_name": "n_name"}, {"revenue": Measure("SUM", "price"), "n": Measure("COUNT")}),
    "SELECT r_name, n_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
plan(
    "join_market_segments",
    Aggregate(
        Join(Scan("orders"), (JoinEdge(Scan("customer"), (Predicate("i1.o_custkey", "=", "i2.c_custkey"),), "inner"),), {"segment": "i2.c_mktsegment", "price": "cast(i1.o_totalprice as decimal(18,2))"}),
        {"segment": "segment"},
        {"n": Measure("COUNT"), "total": Measure("SUM", "price")},
    ),
    "SELECT c_mktsegment AS segment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)

# --- aggregates ---

_LINES = Select(Scan("lineitem"), {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "qty": "cast(l_quantity as decimal(18,2))", "supp": "if(l_suppkey % 7 = 0, null, l_suppkey)"})
_LINES_SQL = "(SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS supp FROM lineitem)"
plan(
    "agg_grouped",
    Aggregate(_LINES, {"l_returnflag": "flag", "l_linestatus": "status"}, {"total": Measure("SUM", "qty"), "low": Measure("MIN", "qty"), "high": Measure("MAX", "qty"), "mean": Measure("AVG", "supp"), "n": Measure("COUNT")}),
    f"SELECT l_returnflag AS flag, l_linestatus AS status, sum(qty) AS total, min(qty) AS low, max(qty) AS high, avg(supp) AS mean, count(*) AS n FROM {_LINES_SQL} t GROUP BY 1, 2",
)
plan("agg_global", Aggregate(_LINES, {}, {"total": Measure("SUM", "qty"), "n": Measure("COUNT"), "known": Measure("COUNT", "supp")}), f"SELECT sum(qty) AS total, count(*) AS n, count(supp) AS known FROM {_LINES_SQL} t")
plan("agg_count_distinct", Aggregate(_LINES, {"l_returnflag": "flag"}, {"n": Measure("COUNT_DISTINCT", "supp")}), f"SELECT l_returnflag AS flag, count(DISTINCT supp) AS n FROM {_LINES_SQL} t GROUP BY 1")
plan("agg_distinct_sum_avg", Aggregate(_LINES, {"l_returnflag": "flag"}, {"s": Measure("SUM", "qty", True), "a": Measure("AVG", "supp", True)}), f"SELECT l_returnflag AS flag, sum(DISTINCT qty) AS s, avg(DISTINCT supp) AS a FROM {_LINES_SQL} t GROUP BY 1")
plan(
    "agg_string_agg_ordered",
    Aggregate(Scan("nation"), {"n_regionkey": "region"}, {"names": Measure("STRING_AGG", "n_name", delimiter="; ", order_by=(Sort("n_name", "desc", "last"),))}),
    "SELECT n_regionkey AS region, string_agg(n_name, '; ' ORDER BY n_name DESC NULLS LAST) AS names FROM nation GROUP BY 1",
)
plan(
    "agg_having",
    Aggregate(Scan("orders"), {"o_custkey": "o_custkey"}, {"n": Measure("COUNT")}, having="n > 15"),
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
)

# --- windows ---

_W = Select(Scan("orders"), {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "day": "date_trunc('month', o_orderdate)", "price": "cast(o_totalprice as decimal(18,2))"})
_W_SQL = "(SELECT o_orderkey, o_custkey, date_trunc('month', o_orderdate) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)"
_TOTAL, _TIES = (Sort("day", "asc", "first"), Sort("o_orderkey")), (Sort("day", "asc", "first"),)
_ROWS_ORDER, _TIES_ORDER = "ORDER BY day NULLS FIRST, o_orderkey", "ORDER BY day NULLS FIRST"
for _name, _fn, _args, _order, _call in (
    ("row_number", "ROW_NUMBER", (), _TOTAL, "row_number()"),
    ("rank", "RANK", (), _TIES, "rank()"),
    ("dense_rank", "DENSE_RANK", (), _TIES, "dense_rank()"),
    ("ntile", "NTILE", (4,), _TOTAL, "ntile(4)"),
    ("lag", "LAG", ("o_orderkey", 2, -1), _TOTAL, "lag(o_orderkey, 2, -1)"),
    ("lead", "LEAD", ("o_orderkey", 1), _TOTAL, "lead(o_orderkey, 1)"),
    ("first_value", "FIRST_VALUE", ("o_orderkey",), _TOTAL, "first_value(o_orderkey)"),
    ("last_value", "LAST_VALUE", ("o_orderkey",), _TOTAL, "last_value(o_orderkey)"),
    ("nth_value", "NTH_VALUE", ("o_orderkey", 3), _TOTAL, "nth_value(o_orderkey, 3)"),
    ("sum", "SUM", ("price",), _TIES, "sum(price)"),
    ("avg", "AVG", ("o_orderkey",), _TOTAL, "avg(o_orderkey)"),
    ("min", "MIN", ("price",), _TIES, "min(price)"),
    ("max", "MAX", ("price",), _TIES, "max(price)"),
    ("count", "COUNT", (), _TIES, "count(*)"),
    ("sum_whole", "SUM", ("price",), (), "sum(price)"),
):
    _by = {_TOTAL: _ROWS_ORDER, _TIES: _TIES_ORDER, (): ""}[_order]
    _cast = {"SUM": "decimal(38,2)", "ROW_NUMBER": "bigint", "RANK": "bigint", "DENSE_RANK": "bigint", "NTILE": "bigint"}.get(_fn)
    _out = f"cast(v as {_cast})" if _cast else "v"
    plan(
        f"win_{_name}",
        Select(WindowNode(_W, {"v": WindowColumn(_fn, _args, ("o_custkey",), _order)}), {"o_orderkey": "o_orderkey", "v": _out}),
        f"SELECT o_orderkey, {_out} AS v FROM (SELECT o_orderkey, {_call} OVER (PARTITION BY o_custkey {_by}) AS v FROM {_W_SQL} t) u",
    )
plan(
    "win_multi_key",
    WindowNode(Select(Scan("nation"), {"n_name": "n_name", "n_regionkey": "n_regionkey", "odd": "n_nationkey % 2"}), {"place": WindowColumn("RANK", (), ("n_regionkey", "odd"), (Sort("odd", "desc", "last"), Sort("n_name", "desc", "last")))}),
    "SELECT n_name, n_regionkey, n_nationkey % 2 AS odd, rank() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey % 2 DESC, n_name DESC) AS place FROM nation",
)

# --- set operations ---

_A = Branch(Scan("customer"), {"id": "c_custkey", "nation": "c_nationkey"})
_B = Branch(Scan("supplier"), {"id": "s_suppkey", "nation": "s_nationkey"})
_A_SQL, _B_SQL = "SELECT c_custkey AS id, c_nationkey AS nation FROM customer", "SELECT s_suppkey, s_nationkey FROM supplier"
plan("union_all", Union((_A, _B), ("id", "nation")), f"{_A_SQL} UNION ALL {_B_SQL}")
plan("union_distinct", Union((Branch(_A.input, {"nation": "c_nationkey"}), Branch(_B.input, {"nation": "s_nationkey"})), ("nation",), "union"), "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
plan(
    "union_nested",
    Aggregate(Union((Branch(Union((_A, _B), ("id", "nation")), {"nation": "nation"}), Branch(Scan("nation"), {"nation": "n_nationkey"})), ("nation",)), {"nation": "nation"}, {"n": Measure("COUNT")}),
    f"SELECT nation, count(*) AS n FROM (SELECT nation FROM ({_A_SQL} UNION ALL {_B_SQL}) a UNION ALL SELECT n_nationkey FROM nation) u GROUP BY 1",
)

# --- keys ---


def _key_sql(pairs: list[tuple[str, str]], pepper: str = "") -> str:
    parts = [f"'{n}~' || coalesce(CAST({v} AS VARCHAR), 'null_replaced')" for n, v in sorted(pairs)]
    return f"sha256(concat_ws('|', {', '.join(parts + ([repr(pepper)] if pepper else []))}))"


@query("sk_single", f"SELECT c_custkey, {_key_sql([('c_custkey', 'c_custkey')])} AS customer_key FROM customer")
def _(t):
    return t["customer"].select("c_custkey", keys.sk(["c_custkey"]).alias("customer_key"))


@query("sk_composite", f"SELECT c_custkey, {_key_sql([('b', 'c_name'), ('a', 'nullif(c_nationkey, 3)')], 'xyz')} AS k FROM customer")
def _(t):
    names = {"b": F.col("c_name"), "a": F.nullif("c_nationkey", F.lit(3))}
    return t["customer"].select("c_custkey", keys.sk(names, "xyz").alias("k"))


@query("sk_from_text", f"SELECT c_custkey, {_key_sql([('c_name', 'c_name'), ('c_nationkey', 'c_nationkey')], 'p')} AS k FROM customer")
def _(t):
    return t["customer"].select("c_custkey", keys.parse(keys.key_expression(["c_nationkey", "c_name"], "p")).alias("k"))


@query("fk_orders_customer", f"SELECT o_orderkey, {_key_sql([('c_custkey', 'o_custkey')])} AS customer_key FROM orders")
def _(t):
    return t["orders"].select("o_orderkey", keys.fk({"c_custkey": "o_custkey"}).alias("customer_key"))


@query("fk_matches_parent", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    parent = t["customer"].select(keys.sk(["c_custkey"]).alias("customer_key"), "c_name")
    return t["orders"].select("o_orderkey", keys.fk({"c_custkey": "o_custkey"}).alias("customer_key")).join(parent, "customer_key").select("o_orderkey", "c_name")


_HASH_SQL = "sha256(concat_ws('|', coalesce(c_name, 'null_replaced'), coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null_replaced'), coalesce(c_mktsegment, 'null_replaced')))"


@query("row_hash_customer", f"SELECT c_custkey, {_HASH_SQL} AS row_hash FROM customer")
def _(t):
    df = t["customer"].withColumn("n", F.nullif("c_nationkey", F.lit(3)))
    return df.select("c_custkey", keys.row_hash(["c_name", "n", "c_mktsegment"]).alias("row_hash"))


# --- loads ---

_TARGET_SQL = "(SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)"
_STAGE_SQL = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)"


def _target(t):
    return t["customer"].where("c_custkey % 7 <> 0").select("c_custkey", "c_name", "c_mktsegment")


def _stage(t):
    df = t["customer"].where("c_custkey % 11 <> 0")
    return df.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query("merge_upsert", f"SELECT * FROM {_STAGE_SQL} s UNION ALL SELECT * FROM {_TARGET_SQL} t WHERE NOT EXISTS (SELECT 1 FROM {_STAGE_SQL} s WHERE s.c_custkey = t.c_custkey)")
def _(t):
    return loads.merge(_target(t), _stage(t), ["c_custkey"])


@query(
    "delete_missing_scoped",
    f"SELECT * FROM {_TARGET_SQL} t WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') < 'H', false) OR EXISTS (SELECT 1 FROM {_STAGE_SQL} s WHERE s.c_custkey = t.c_custkey)",
)
def _(t):
    return loads.delete_missing(_target(t), _stage(t), ["c_custkey"], "nullif(c_mktsegment, 'BUILDING') < 'H'")


_RANKED_SQL = """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o) AS n FROM (
    SELECT c_custkey, c_name, c_mktsegment, NULL AS c_acctbal, 2 AS o FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, upper(c_name), NULL, c_acctbal, 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE n = 1
"""


@query("stage_ranked_union", _RANKED_SQL)
def _(t):
    a = t["customer"].where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment")
    b = t["customer"].where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), "c_acctbal")
    return loads.ranked_stage([(a, 2), (b, 1)], ["c_custkey"])


@query(
    "stage_identity_union",
    "SELECT 'aw1' AS source_identity_id, c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'aw2', c_custkey, NULL, c_acctbal FROM customer WHERE c_custkey % 3 = 0",
)
def _(t):
    a = t["customer"].where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    b = t["customer"].where("c_custkey % 3 = 0").select("c_custkey", "c_acctbal")
    return loads.identity_stage([(a, "aw1"), (b, "aw2")])


_T1, _T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
_SNAP = {
    1: "SELECT o_orderkey AS k, sha256(o_orderstatus) AS row_hash FROM orders WHERE o_orderkey % 5 <> 0",
    2: "SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS row_hash FROM orders WHERE o_orderkey % 6 <> 0",
}


def _snapshot(t, n: int) -> DataFrame:
    o = t["orders"]
    status = F.col("o_orderstatus") if n == 1 else F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return o.where(f"o_orderkey % {4 + n} <> 0").select(F.col("o_orderkey").alias("k"), F.sha2(status, 256).alias("row_hash"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("k", "row_hash", F.date_format("version_started_at", "yyyy-MM-dd").alias("started"), F.date_format("version_ended_at", "yyyy-MM-dd").alias("ended"), "version_state", "load_run_id")


@query("scd2_first_load", f"SELECT k, row_hash, '2024-01-01' AS started, CAST(NULL AS VARCHAR) AS ended, 'new' AS version_state, 'r1' AS load_run_id FROM ({_SNAP[1]})")
def _(t):
    return _shown(loads.scd2(None, _snapshot(t, 1), "k", loads.RunContext("r1", _T1)))


_SCD2_SQL = f"""
WITH a AS ({_SNAP[1]}), b AS ({_SNAP[2]})
SELECT a.k, a.row_hash, '2024-01-01' AS started, CASE WHEN b.k IS NULL OR a.row_hash <> b.row_hash THEN '2024-02-01' END AS ended,
  CASE WHEN b.k IS NULL THEN 'deleted' WHEN a.row_hash <> b.row_hash THEN 'changed' ELSE 'new' END AS version_state,
  CASE WHEN b.k IS NULL OR a.row_hash <> b.row_hash THEN 'r2' ELSE 'r1' END AS load_run_id
FROM a LEFT JOIN b ON a.k = b.k
UNION ALL SELECT b.k, b.row_hash, '2024-02-01', NULL, 'changed', 'r2' FROM b JOIN a ON a.k = b.k WHERE a.row_hash <> b.row_hash
UNION ALL SELECT b.k, b.row_hash, '2024-02-01', NULL, 'new', 'r2' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)
"""


@query("scd2_second_load", _SCD2_SQL)
def _(t):
    first = loads.scd2(None, _snapshot(t, 1), "k", loads.RunContext("r1", _T1))
    return _shown(loads.scd2(first, _snapshot(t, 2), "k", loads.RunContext("r2", _T2)))


# --- ingestion ---


@query("json_path_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t["events"].select("event_id", landing.json_path(F.col("props"), "$.k").alias("k"))


@query("land_json_payload", "SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props AS payload, 'r1' AS load_run_id, CAST(json_extract_string(props, '$.none') AS VARCHAR) AS missing FROM events")
def _(t):
    out = landing.landed(t["events"], {"k": ("$.k", "INTEGER"), "missing": ("$.none", "STRING")}, loads.RunContext("r1", _T1), "props")
    return out.drop("loaded_at")


@query("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return windowed_counts(t["events"], "ts", "event_type")


def table_name(what: str) -> str:
    """A name that no other run has: queries drop the tables they make."""
    return f"q_{what}_{uuid.uuid4().hex[:12]}"


def outcome(call: Callable[[], object]) -> str:
    """What a call gives, or the error it raises, as text."""
    try:
        return str(call())
    except Exception as e:  # noqa: BLE001 - the outcome is what the query shows
        return f"{type(e).__name__}: {e}"


def declared(name: str, columns: str, expected: list[tuple]):
    """Registers a function that gives rows about declarations, not of tables; the SQL states those that are right."""
    fields = [c.split() for c in columns.split(", ")]
    types = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}

    def literal(value, kind: str) -> str:
        text = "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
        return f"CAST({text} AS {types[kind]})"

    rows = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for r in expected)

    def register(f: Callable[[Tables], list[tuple]]):
        QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(f(Tables(spark, sf_dir)), columns)
        SQL[name] = f"SELECT * FROM (VALUES {rows}) t({', '.join(n for n, _ in fields)})"
        return f

    return register


# these register themselves
from quern.plans import catalog_declared, catalog_ingest, catalog_loads  # noqa: E402, F401
