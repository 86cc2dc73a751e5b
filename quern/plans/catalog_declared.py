"""Registered queries of checks, contracts, types, changes, runs and reviews: they work on declarations and give rows."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime

from pyspark.sql import types as T

from quern.functions import keys
from quern.governance import evolution, migration, review, runs, validation
from quern.operators import loads
from quern.plans import generation as g
from quern.plans import nodes as n
from quern.plans.catalog import declared, outcome, table_name
from quern.plans.catalog_loads import NEW, OLD, ORDERS, PEPPER
from quern.spec import Column, Dataset, Reference
from quern.types import LogicalType, drift

COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "customer": ["c_custkey", "c_name"]}
ORDER_SCAN = n.Scan("orders")
TREE = n.Aggregate(
    n.Join(ORDER_SCAN, (n.JoinEdge(n.Scan("customer"), (n.Predicate("i1.o_custkey", "=", "i2.c_custkey"),)),), {"name": "i2.c_name", "price": "i1.o_totalprice"}),
    {"name": "customer"}, {"total": n.Measure("SUM", "price"), "n": n.Measure("COUNT"), "names": n.Measure("STRING_AGG", "name")},
)


# --- types, keys, templates ---


@declared(
    "type_drift",
    "actual string, desired string, class string",
    [
        ("varchar(10)", "varchar(20)", "widening"), ("varchar(20)", "varchar(10)", "narrowing"), ("text", "varchar(5)", "equivalent"), ("decimal(10,2)", "numeric(12,2)", "widening"),
        ("decimal(10,4)", "decimal(12,2)", "narrowing"), ("int", "bigint", "widening"), ("bigint", "smallint", "narrowing"), ("date", "datetime", "widening"), ("timestamp", "date", "narrowing"),
        ("decimal(10,2)", "double", "widening"), ("double", "decimal(10,2)", "incompatible"), ("struct<a:int>", "map(string,int)", "equivalent"), ("uuid", "bool", "incompatible"),
    ],
)
def _(t):
    pairs = [
        ("varchar(10)", "varchar(20)"), ("varchar(20)", "varchar(10)"), ("text", "varchar(5)"), ("decimal(10,2)", "numeric(12,2)"), ("decimal(10,4)", "decimal(12,2)"), ("int", "bigint"),
        ("bigint", "smallint"), ("date", "datetime"), ("timestamp", "date"), ("decimal(10,2)", "double"), ("double", "decimal(10,2)"), ("struct<a:int>", "map(string,int)"), ("uuid", "bool"),
    ]
    return [(a, b, drift(LogicalType.parse(a), LogicalType.parse(b))) for a, b in pairs]


@declared(
    "logical_types",
    "given string, name string, spark string",
    [
        ("bigint", "BIGINT", "bigint"), ("decimal(12,2)", "DECIMAL", "decimal(12,2)"), ("float", "FLOAT", "double"), ("array<int>", "JSON", "string"), ("timestamp_ntz", "TIMESTAMP", "timestamp"),
        ("binary", "BINARY", "binary"), ("interval day", "ValueError", None),
    ],
)
def _(t):
    out = []
    for text in ("bigint", "decimal(12,2)", "float", "array<int>", "timestamp_ntz", "binary"):
        kind = LogicalType.of(T.StructType.fromDDL(f"c {text}")["c"].dataType)
        out.append((text, kind.name, kind.spark().simpleString()))
    return [*out, ("interval day", outcome(lambda: LogicalType.of(T.DayTimeIntervalType(0, 0))).split(":")[0], None)]


@declared(
    "key_language",
    "text string, outcome string",
    [
        ("CONCAT('a, (', COL(\"k\"), \")\")", "a, (7)"), ("concat_ws('-', {expr:k}, {expr:none}, 'z')", "7-z"), ("COALESCE({expr:none}, 'token')", "token"),
        ("HASH256('a'", "ValueError: a comma or a closing bracket is missing"), ("UPPER('a')", "ValueError: UPPER with 1 arguments is no key function"), ("COALESCE('a')", "ValueError: COALESCE with 1 arguments is no key function"),
    ],
)
def _(t):
    df = t.spark.createDataFrame([("7", None)], "k string, none string")
    texts = ("CONCAT('a, (', COL(\"k\"), \")\")", "concat_ws('-', {expr:k}, {expr:none}, 'z')", "COALESCE({expr:none}, 'token')", "HASH256('a'", "UPPER('a')", "COALESCE('a')")
    return [(x, outcome(lambda x=x: df.select(keys.parse(x)).first()[0])) for x in texts]


@declared(
    "sql_templates",
    "text string, outcome string",
    [
        ("{alias}.a + 1", "s.a + 1"), ("{expr:a} || {expr:b}", "s.x || upper(s.y)"), ("{expr:c}", "ValueError: nothing is bound to c in {expr:c}"), ("{{ a + 1 }}", "a + 1"),
        ("{{load_run_id}} {load_timestamp}", "'r1' '2024-01-01 00:00:00.000000'"), ("ts > {{DELTA_CUTOFF}}", "ValueError: the filter needs a cutoff, and no policy gives one"),
    ],
)
def _(t):
    names, ctx = {"a": "s.x", "b": "upper(s.y)"}, loads.RunContext("r1", datetime(2024, 1, 1))
    out = [(x, outcome(lambda x=x: g.filled(x, "s", names))) for x in ("{alias}.a + 1", "{expr:a} || {expr:b}", "{expr:c}")]
    out.append(("{{ a + 1 }}", g.unwrapped("{{ a + 1 }}").strip()))
    return out + [(x, outcome(lambda x=x: ctx.fill(x))) for x in ("{{load_run_id}} {load_timestamp}", "ts > {{DELTA_CUTOFF}}")]


@declared(
    "scope_rewrite",
    "given string, rewritten string",
    [
        ("ModifiedDate >= {{DELTA_CUTOFF}} AND is_deleted_flag = 0", "upd_date >= {{DELTA_CUTOFF}} AND isdeletedflag = 0"), ("s.MODIFIED_DATE > '2024 ModifiedDate'", "upd_date > '2024 ModifiedDate'"),
        ("lower(name) = 'x'", "lower(Name) = 'x'"),
    ],
)
def _(t):
    texts = ("ModifiedDate >= {{DELTA_CUTOFF}} AND is_deleted_flag = 0", "s.MODIFIED_DATE > '2024 ModifiedDate'", "lower(name) = 'x'")
    return [(x, loads.rewrite_scope(x, {"ModifiedDate": "upd_date"}, ["isdeletedflag", "Name"])) for x in texts]


# --- contracts and checks of trees ---


@declared(
    "contracts",
    "tree string, columns string",
    [("scan", "o_orderkey, o_custkey, o_totalprice, o_orderdate"), ("aggregate", "customer, total, n, names"), ("window", "o_orderkey, o_custkey, o_totalprice, o_orderdate, place"), ("clash", "ValueError: duplicate output columns: ['a', 'A']")],
)
def _(t):
    window = n.WindowNode(ORDER_SCAN, {"place": n.WindowColumn("RANK", (), ("o_custkey",), (n.Sort("o_orderkey"),)), "off": n.WindowColumn("COUNT", active=False)})
    trees = {"scan": ORDER_SCAN, "aggregate": TREE, "window": window, "clash": n.Select(ORDER_SCAN, {"a": "o_orderkey", "A": "o_custkey"})}
    return [(name, outcome(lambda x=x: ", ".join(n.contract(x, COLUMNS)))) for name, x in trees.items()]


@declared("contract_changes", "change string, name string", [("added", "c"), ("removed", "a"), ("unchanged", "b")])
def _(t):
    return [(k, x) for k, names in evolution.contract_diff(["a", "b"], ["b", "c"]).items() for x in names]


@declared(
    "query_badges",
    "tree string, query string, contract string, determinism string",
    [
        ("aggregate", "aggregate", "valid", "names: STRING_AGG without an order"), ("one window", "windownode", "valid", "n: no partition, so one task sorts all rows"),
        ("scan", "scan", "valid", "deterministic"), ("unknown", "scan", "no such table: none", "deterministic"),
    ],
)
def _(t):
    trees = {"aggregate": TREE, "one window": n.WindowNode(ORDER_SCAN, {"n": n.WindowColumn("ROW_NUMBER", (), (), (n.Sort("o_orderkey"),))}), "scan": ORDER_SCAN, "unknown": n.Scan("none")}
    return [(name, *validation.badges(x, COLUMNS).values()) for name, x in trees.items()]


@declared(
    "tree_faults",
    "tree string, fault string",
    [
        ("join without predicates", "join i2: a cross join has no predicates, and any other join has some"), ("join of a later input", "join i2: i3 is not part of the join yet"),
        ("join not tied", "join i2: no predicate ties it to what stands before it; that is a cross join"), ("operator", "join i2: no such operator: ~"), ("between one", "join i2: BETWEEN does not take 'i2.c_custkey'"),
        ("aggregate", "a: no input column none"), ("aggregate", "b: no such aggregate: MEDIAN"), ("aggregate", "c: SUM needs a column"), ("union", "union: branch 1 does not map b"),
        ("union", "union: branch 1 maps c, which the contract lacks"), ("window", "a: RANK needs an order"), ("window", "b: NTILE takes a whole number, not 0"), ("window", "c: LAG takes a whole number, not -1"),
        ("window", "d: no such window function: MODE"), ("window", "e: NTH_VALUE takes 2 to 2 arguments"), ("sort", "select: not a sort order: up"),
    ],
)
def _(t):
    edge = lambda *p, how="inner", left=None: n.Join(ORDER_SCAN, (n.JoinEdge(n.Scan("customer"), p, how, left),), {"k": "i1.o_orderkey"})
    same, by = n.Predicate("i1.o_custkey", "=", "i2.c_custkey"), (n.Sort("o_orderkey"),)
    trees = {
        "join without predicates": edge(), "join of a later input": edge(same, left="i3"), "join not tied": edge(n.Predicate("i1.o_custkey", "=", "7")),
        "operator": edge(n.Predicate("i1.o_custkey", "~", "i2.c_custkey")), "between one": edge(n.Predicate("i1.o_custkey", "BETWEEN", "i2.c_custkey")),
        "aggregate": n.Aggregate(ORDER_SCAN, {}, {"a": n.Measure("MAX", "none"), "b": n.Measure("MEDIAN", "o_custkey"), "c": n.Measure("SUM")}),
        "union": n.Union((n.Branch(ORDER_SCAN, {"a": "o_orderkey", "c": "o_custkey"}),), ("a", "b")),
        "window": n.WindowNode(ORDER_SCAN, {
            "a": n.WindowColumn("RANK"), "b": n.WindowColumn("NTILE", (0,), (), by), "c": n.WindowColumn("LAG", ("o_custkey", -1), (), by),
            "d": n.WindowColumn("MODE"), "e": n.WindowColumn("NTH_VALUE", ("o_custkey",), (), by),
        }),
        "sort": n.Select(ORDER_SCAN, None, order_by=(n.Sort("o_custkey", "up"),)),
    }
    return [(name, fault) for name, x in trees.items() for fault in validation.check_tree(x, COLUMNS)]


@declared(
    "tree_refusals",
    "tree string, outcome string",
    [
        ("hidden cross join", "ValueError: join i2: no predicate ties it to what stands before it; that is a cross join"), ("missing mapping", "ValueError: a branch does not map ['b']"),
        ("empty contract", "ValueError: a union needs a contract and branches"), ("window without order", "ValueError: RANK needs an order"), ("window of a column that exists", "ValueError: window columns that exist already: ['o_custkey']"),
        ("buckets of a full join", "ValueError: buckets need one BETWEEN, a width above 0, and an inner, left, semi or anti join"),
    ],
)
def _(t):
    between = n.Predicate("o_totalprice", "BETWEEN", ("c_custkey", "c_custkey + 1"))
    trees = {
        "hidden cross join": n.Join(ORDER_SCAN, (n.JoinEdge(n.Scan("customer"), (n.Predicate("o_custkey", "=", "7"),), "inner"),), {"k": "i1.o_orderkey"}),
        "missing mapping": n.Union((n.Branch(ORDER_SCAN, {"a": "o_orderkey"}),), ("a", "b")), "empty contract": n.Union((n.Branch(ORDER_SCAN, {"a": "o_orderkey"}),), ()),
        "window without order": n.WindowNode(ORDER_SCAN, {"r": n.WindowColumn("RANK")}), "window of a column that exists": n.WindowNode(ORDER_SCAN, {"O_CUSTKEY": n.WindowColumn("COUNT")}),
        "buckets of a full join": n.Join(ORDER_SCAN, (n.JoinEdge(n.Scan("customer"), (between,), "full", bucket=1.0),), {"k": "i1.o_orderkey"}),
    }
    return [(name, outcome(lambda x=x: n.build(x, t))) for name, x in trees.items()]


@declared(
    "output_types",
    "tree string, name string, type string",
    [
        ("aggregate", "customer", "STRING"), ("aggregate", "total", "DECIMAL(12,2)"), ("aggregate", "mean", "DECIMAL(12,2)"), ("aggregate", "n", "BIGINT"), ("aggregate", "names", "STRING"),
        ("window", "o_custkey", "BIGINT"), ("window", "price", "DECIMAL(12,2)"), ("window", "place", "INTEGER"), ("window", "before", "DECIMAL(12,2)"), ("select", "key", "BIGINT"), ("select", "made", "STRING"),
    ],
)
def _(t):
    types = {"orders": {"o_custkey": "BIGINT", "price": "DECIMAL(12,2)"}}
    scan, by = n.Scan("orders"), (n.Sort("o_custkey"),)
    trees = {
        "aggregate": n.Aggregate(scan, {"status": "customer"}, {"total": n.Measure("SUM", "price"), "mean": n.Measure("AVG", "price"), "n": n.Measure("COUNT_DISTINCT", "price"), "names": n.Measure("STRING_AGG", "price")}),
        "window": n.WindowNode(scan, {"place": n.WindowColumn("RANK", (), (), by), "before": n.WindowColumn("LAG", ("price",), (), by)}),
        "select": n.Select(scan, {"key": "o_custkey", "made": "price + 1"}),
    }
    return [(name, c, x) for name, tree in trees.items() for c, x in n.output_types(tree, types).items()]


# --- datasets ---

STAGE = Dataset("stg_c", "stage")
MERGED = Dataset("rc_c", "rawcore", (Column("k", "BIGINT", "key"),), ("stg_c",))


@declared(
    "dataset_faults",
    "dataset string, fault string",
    [
        ("view that merges", "v: a view takes no merge load"), ("bizcore that merges", "b: only rawcore merges"), ("bizcore that merges", "b: a merge needs keys"), ("bizcore that merges", "b: a merge needs one stage input, not 0"),
        ("deletes without a scope", "rc_c: deletes need a scope"), ("history", "rc_c_hist: a history needs loaded_at"), ("unknown layer", "x: no such layer: gold"), ("unknown input", "v: no such input: none"),
        ("columns", "v: column a repeats"), ("columns", "v.b: more than one expression"), ("columns", "v.c: unknown logical type: BLOB5"), ("materialization", "v: no such materialization: cube"),
    ],
)
def _(t):
    hist = g.history(g.with_keys(MERGED))
    cases = {
        "fine": MERGED, "view that merges": Dataset("v", "serving", mode="merge"), "bizcore that merges": Dataset("b", "bizcore", mode="merge"),
        "deletes without a scope": replace(MERGED, detect_deletes=True), "history": replace(hist, inputs=(), columns=tuple(c for c in hist.columns if c.name != "loaded_at")),
        "unknown layer": Dataset("x", "gold"), "unknown input": Dataset("v", "serving", inputs=("none",)),
        "columns": Dataset("v", "serving", (Column("a"), Column("A"), Column("b", expression="1", key_expression="'x'"), Column("c", "BLOB5"))), "materialization": Dataset("v", "serving", materialization="cube"),
    }
    return [(name, fault) for name, d in cases.items() for fault in validation.check_dataset(d, [STAGE, MERGED])]


@declared(
    "query_policy",
    "dataset string, changing boolean, refusal string",
    [("rc_c", False, "rc_c: no query trees in layer rawcore"), ("bc_c", False, None), ("bc_c", True, "bc_c: frozen while sv_c use it"), ("sv_c", True, None)],
)
def _(t):
    biz, serving = Dataset("bc_c", "bizcore"), Dataset("sv_c", "serving", inputs=("bc_c",))
    every = [MERGED, biz, serving]
    return [(d.name, c, "; ".join(validation.may_query(d, every, c)) or None) for d, c in ((MERGED, False), (biz, False), (biz, True), (serving, True))]


@declared(
    "reconcile_steps",
    "policy string, action string, name string, before string, after string",
    [
        ("strict", "widen", "a", "INTEGER", "BIGINT"), ("strict", "rename", "c", "b", "c"), ("strict", "add", "n", None, "DATE"), ("strict", "block", "i", "BIGINT", "INTEGER"), ("strict", "keep", "old", None, None),
        ("lossy", "widen", "a", "INTEGER", "BIGINT"), ("lossy", "rename", "c", "b", "c"), ("lossy", "add", "n", None, "DATE"), ("lossy", "rebuild", "i", "BIGINT", "INTEGER"), ("lossy", "keep", "old", None, None),
        ("new", "create", None, None, None),
    ],
)
def _(t):
    d = Dataset("t", "rawcore", (Column("a", "BIGINT"), Column("c", former_names=("b",)), Column("n", "DATE"), Column("i", "INTEGER"), Column("j", "JSON")))
    actual = T.StructType.fromDDL("a int, b string, old string, i bigint, j string")
    cases = {"strict": (actual, False), "lossy": (actual, True), "new": (None, False)}
    return [(name, s.action, s.column, s.before, s.after) for name, (a, lossy) in cases.items() for s in validation.reconcile(d, a, lossy)]


@declared(
    "generated_datasets",
    "dataset string, mode string, columns string",
    [
        ("raw_erp_orders", None, "order_key, status, price, load_run_id, loaded_at"), ("stg_erp_orders", None, "order_key, status, price"),
        ("rc_erp_orders", "full", "rc_erp_orders_key, order_key, status, price, row_hash, load_run_id, loaded_at"),
        ("rc_erp_orders_hist", "historize", "rc_erp_orders_hist_key, rc_erp_orders_key, order_key, status, price, row_hash, version_started_at, version_ended_at, version_state, load_run_id, loaded_at"),
        ("history key", None, "HASH256(CONCAT_WS('|', CONCAT('rc_erp_orders_key', '~', COALESCE({expr:rc_erp_orders_key}, 'null_replaced')), CONCAT('version_started_at', '~', COALESCE({expr:version_started_at}, 'null_replaced')), 'pepper'))"),
        ("history roles", None, "surrogate, key, business, business, business, technical, technical, technical, technical, technical, technical"),
        ("incremental source", None, "nav"), ("superset", None, "id BIGINT not null, name STRING, city STRING"), ("name", None, "rc_aw_groesse_cm"),
    ],
)
def _(t):
    made = g.generate([ORDERS], PEPPER)
    hist = made[-1]
    a, b = (Column("id", "INTEGER", nullable=False), Column("name", nullable=False)), (Column("id", "BIGINT", nullable=False), Column("city"))
    wide = ", ".join(f"{c.name} {c.type}{'' if c.nullable else ' not null'}" for c in g.superset([a, b]))
    sap, nav = (g.SourceTable(s, "t", (), primary=s == "nav", incremental=True) for s in ("sap", "nav"))
    return [
        *[(d.name, d.mode, ", ".join(c.name for c in d.columns)) for d in made],
        ("history key", None, hist.columns[0].key_expression), ("history roles", None, ", ".join(c.role for c in hist.columns)),
        ("incremental source", None, g.incremental_source([sap, nav]).system), ("superset", None, wide), ("name", None, g.dataset_name("rawcore", "AW", "Größe (cm)")),
    ]


@declared(
    "reference_sync",
    "step string, columns string, former string",
    [("not all keys mapped", "a, b", None), ("mapped", "a, b, rc_p_key", None), ("prefix changed", "a, b, buyer_rc_p_key", "rc_p_key"), ("unknown column", "ValueError: rc_c lacks ['z']", None)],
)
def _(t):
    parent = g.with_keys(Dataset("rc_p", "rawcore", (Column("k", "BIGINT", "key"), Column("l", "BIGINT", "key"))))
    child = Dataset("rc_c", "rawcore", (Column("a", "BIGINT"), Column("b", "BIGINT")))
    partial, whole = Reference("rc_c", "rc_p", {"k": "a"}), Reference("rc_c", "rc_p", {"k": "a", "l": "b"})
    one = g.with_reference(child, whole, parent)
    two = g.with_reference(one, replace(whole, prefix="buyer"), parent)
    say = lambda d: ", ".join(c.name for c in d.columns)
    return [
        ("not all keys mapped", say(g.with_reference(child, partial, parent)), None), ("mapped", say(one), None), ("prefix changed", say(two), ", ".join(two.columns[-1].former_names)),
        ("unknown column", outcome(lambda: g.with_reference(child, replace(whole, mapping={"k": "a", "l": "z"}), parent)), None),
    ]


# --- changes ---


@declared(
    "architecture_changes",
    "kind string, dataset string, name string, before string, after string, drift string",
    [
        ("rename", "rc_item", None, "rc_part", "rc_item", None), ("rename", "rc_item", "item_name", "p_name", "item_name", None), ("change", "rc_item", "item_name", "STRING(40)", "STRING(8)", "narrowing"),
        ("change", "rc_item", "p_size", "INTEGER", "BIGINT", "widening"), ("add", "rc_item", "listed", None, "DATE", None), ("drop", "rc_item", "p_brand", None, None, None), ("add", "rc_shelf", None, None, None, None),
    ],
)
def _(t):
    return [(c.kind, c.dataset, c.column, c.before, c.after, c.drift) for c in evolution.diff(OLD, NEW)]


@declared(
    "migration_plan",
    "action string, strategy string, dataset string, name string, previous string, decision string",
    [
        ("RENAME_DATASET", "RENAME_TABLE", "rc_item", None, "rc_part", "ALLOW"), ("CREATE_DATASET", "CREATE_TABLE", "rc_shelf", None, None, "ALLOW"), ("DROP_DATASET", "DROP_TABLE", "rc_gone", None, None, "BLOCKED_BY_POLICY"),
        ("REBUILD_DATASET", "REBUILD", "rc_flag", None, None, "REQUIRES_PREFLIGHT"), ("RENAME_COLUMN", "RENAME_COLUMN", "rc_item", "item_name", "p_name", "ALLOW"),
        ("ALTER_COLUMN", "ALTER_TABLE", "rc_item", "item_name", None, "REQUIRES_PREFLIGHT"), ("ALTER_COLUMN", "ALTER_TABLE", "rc_item", "p_size", None, "REQUIRES_PREFLIGHT"), ("ADD_COLUMN", "ALTER_TABLE", "rc_item", "listed", None, "ALLOW"),
        ("DROP_COLUMN", "ALTER_TABLE", "rc_item", "p_brand", None, "BLOCKED_BY_POLICY"), ("RETIRE_COLUMN", "METADATA_ONLY", "rc_flag", "a", None, "METADATA_ONLY"), ("UNRETIRE_COLUMN", "METADATA_ONLY", "rc_flag", "b", None, "METADATA_ONLY"),
        ("DROP_COLUMN", "ALTER_TABLE", "rc_x_hist", "v", None, "BLOCKED_BY_POLICY"),
    ],
)
def _(t):
    flag = Dataset("rc_flag", "rawcore", (Column("a"), Column("b", active=False)), mode="full")
    hist = Dataset("rc_x_hist", "rawcore", (Column("k"), Column("v")))
    old = [*OLD, Dataset("rc_gone", "rawcore"), flag, hist]
    new = [*NEW, replace(flag, mode="append", columns=(Column("a", active=False), Column("b"))), replace(hist, columns=hist.columns[:1])]
    return [(a.action, a.strategy, a.dataset, a.column, a.previous, a.decision) for a in migration.plan(old, new)]


@declared(
    "migration_refusals",
    "what string, outcome string",
    [("blocked", "ValueError: policy blocks: DROP_COLUMN rc_item.p_brand"), ("lossy", "ValueError: item_name: narrowing change is not allowed"), ("scoped to another", "()"), ("drop allowed", "ALLOW"), ("drop of a history", "BLOCKED_BY_POLICY")],
)
def _(t):
    df = t.spark.createDataFrame([], "p_partkey bigint, p_name string, p_size int, p_brand string")
    drop = evolution.Change("drop", "rc_x", "v")
    return [
        ("blocked", outcome(lambda: migration.execute(t.spark, migration.plan(OLD, NEW), OLD, NEW))),
        ("lossy", outcome(lambda: evolution.migrate(df, OLD[0], NEW[0]))),
        ("scoped to another", str(migration.plan(OLD, NEW, {"rc_other"}))),
        ("drop allowed", evolution.decide(drop, allow_drop=True)),
        ("drop of a history", evolution.decide(replace(drop, dataset="rc_x_hist"), allow_drop=True)),
    ]


@declared(
    "state_fingerprints",
    "pair string, same boolean, letters int",
    [("order of datasets", True, 64), ("a type", False, 64), ("a former name", False, 64)],
)
def _(t):
    of = lambda ds: evolution.fingerprint(evolution.state(ds))
    base = of([STAGE, MERGED])
    others = {
        "order of datasets": [MERGED, STAGE], "a type": [STAGE, replace(MERGED, columns=(Column("k", "INTEGER", "key"),))], "a former name": [STAGE, replace(MERGED, former_names=("rc_old",))],
    }
    return [(name, of(ds) == base, len(of(ds))) for name, ds in others.items()]


@declared(
    "safe_renames",
    "what string, outcome string",
    [
        ("column", "a (former b), c"), ("column taken", "ValueError: cannot rename b to c"), ("dataset", "rc_new <- stg_c (former rc_c); rc_new_hist <- rc_new (former rc_c_hist); sv <- rc_new"),
        ("dataset taken", "ValueError: cannot rename rc_c to sv: sv"), ("back again", "rc_c"),
    ],
)
def _(t):
    d = Dataset("t", "rawcore", (Column("b"), Column("c")))
    every = [MERGED, Dataset("rc_c_hist", "rawcore", inputs=("rc_c",)), Dataset("sv", "serving", inputs=("rc_c",))]
    former = lambda x: f" (former {', '.join(x.former_names)})" if x.former_names else ""
    say = lambda ds: "; ".join(f"{x.name} <- {', '.join(x.inputs)}{former(x)}" for x in ds)
    new = evolution.renamed_dataset(every, "rc_c", "rc_new")
    return [
        ("column", ", ".join(f"{c.name}{former(c)}" for c in evolution.renamed(d, "b", "a").columns)), ("column taken", outcome(lambda: evolution.renamed(d, "b", "c"))),
        ("dataset", say(new)), ("dataset taken", outcome(lambda: evolution.renamed_dataset(every, "rc_c", "sv"))), ("back again", evolution.renamed_dataset(new, "rc_new", "rc_c")[0].name),
    ]


@declared(
    "review_flow",
    "what string, outcome string",
    [
        ("decisions", "{'ALLOW': 4, 'REQUIRES_PREFLIGHT': 2, 'BLOCKED_BY_POLICY': 1}"), ("promotion", "blocked"), ("approval of a blocked one", "ValueError: policy blocks this promotion"), ("with drops allowed", "preflight"),
        ("no word yet", "pending"), ("one of two", "pending"), ("both", "approved"), ("one against", "rejected"), ("changed mind", "approved"), ("of another promotion", "stale"), ("no change", "unchanged"),
        ("one environment", "ValueError: a promotion needs two environments"),
    ],
)
def _(t):
    strict, loose = review.report(OLD, NEW), review.report(OLD, NEW, allow_drop=True)
    blocked, asked = review.promotion(strict, "dev", "prod"), review.promotion(loose, "dev", "prod")
    at = [datetime(2024, 1, i) for i in (1, 2, 3)]
    one, two, no = review.approval(asked, "one", True, at[0]), review.approval(asked, "two", True, at[1]), review.approval(asked, "two", False, at[0])
    return [
        ("decisions", str(strict["counts"])), ("promotion", blocked["status"]), ("approval of a blocked one", outcome(lambda: review.approval(blocked, "one", True, at[0]))), ("with drops allowed", asked["status"]),
        ("no word yet", review.review_status(asked, [])), ("one of two", review.review_status(asked, [one], 2)), ("both", review.review_status(asked, [one, two], 2)), ("one against", review.review_status(asked, [one, no])),
        ("changed mind", review.review_status(asked, [one, no, two])), ("of another promotion", review.review_status(blocked, [one])), ("no change", review.promotion(review.report(OLD, OLD), "dev", "prod")["status"]),
        ("one environment", outcome(lambda: review.promotion(strict, "dev", "dev"))),
    ]


@declared("shadow_compare", "what string, action string, name string", [("missing", "widen", "a"), ("unexpected", "create", None), ("same", "add", "n")])
def _(t):
    widen, add, create = validation.Step("widen", "a", "INTEGER", "BIGINT"), validation.Step("add", "n", after="DATE"), validation.Step("create")
    got = review.shadow_compare([widen, add], [add, create])
    return [(what, s["action"], s["column"]) for what, steps in got.items() for s in steps]


# --- runs ---

GRAPH = {"raw_a": (), "raw_b": (), "stg_a": ("raw_a",), "stg_b": ("raw_b",), "rc_a": ("stg_a",), "rc_a_hist": ("rc_a",), "bc": ("rc_a", "stg_b")}


@declared(
    "lineage_of_datasets",
    "start string, direction string, dataset string, distance int",
    [
        ("bc", "up", "rc_a", 1), ("bc", "up", "stg_b", 1), ("bc", "up", "stg_a", 2), ("bc", "up", "raw_b", 2), ("bc", "up", "raw_a", 3),
        ("raw_a", "down", "stg_a", 1), ("raw_a", "down", "rc_a", 2), ("raw_a", "down", "bc", 3), ("raw_a", "down", "rc_a_hist", 3), ("raw_a", "down, 1", "stg_a", 1),
    ],
)
def _(t):
    cases = (("bc", "up", False, None), ("raw_a", "down", True, None), ("raw_a", "down, 1", True, 1))
    return [(start, way, d, k) for start, way, down, depth in cases for d, k in runs.lineage(GRAPH, start, down, depth).items()]


@declared(
    "load_waves",
    "wave int, datasets string",
    [(1, "raw_a, raw_b"), (2, "stg_a, stg_b"), (3, "rc_a"), (4, "bc, rc_a_hist"), (0, "ValueError: a cycle among ['a', 'b']")],
)
def _(t):
    cycle = outcome(lambda: runs.levels({"a": ("b",), "b": ("a",)}))
    return [*[(i, ", ".join(w)) for i, w in enumerate(runs.levels(GRAPH), 1)], (0, cycle)]


def failing(name: str):
    if name == "stg_a":
        raise RuntimeError("no")
    return {"status": "error", "message": "bad"} if name == "stg_b" else None


@declared(
    "run_outcomes",
    "policy string, dataset string, status string, kind string, attempts int, reason string, blocked_by string",
    [
        ("go on", "raw_a", "success", "load", 1, "", ""), ("go on", "raw_b", "success", "load", 1, "", ""), ("go on", "stg_a", "error", "exception", 2, "retry_exhausted", ""), ("go on", "stg_b", "error", "load", 2, "retry_exhausted", ""),
        ("go on", "rc_a", "blocked", "blocked", 0, "blocked_by_dependency", "stg_a"), ("go on", "bc", "blocked", "blocked", 0, "blocked_by_dependency", "rc_a"), ("go on", "rc_a_hist", "blocked", "blocked", 0, "blocked_by_dependency", "rc_a"),
        ("stop", "raw_a", "success", "load", 1, "", ""), ("stop", "raw_b", "success", "load", 1, "", ""), ("stop", "stg_a", "error", "exception", 1, "error", ""), ("stop", "stg_b", "aborted", "aborted", 0, "fail_fast_abort", ""),
        ("stop", "rc_a", "blocked", "blocked", 0, "blocked_by_dependency", "stg_a"), ("stop", "bc", "blocked", "blocked", 0, "blocked_by_dependency", "rc_a"), ("stop", "rc_a_hist", "blocked", "blocked", 0, "blocked_by_dependency", "rc_a"),
    ],
)
def _(t):
    found = {"go on": runs.execute(GRAPH, failing, retries=1, fail_fast=False, parallel=2), "stop": runs.execute(GRAPH, failing)}
    return [(policy, r.dataset, r.status, r.kind, r.attempts, r.reason, r.blocked_by) for policy, results in found.items() for r in results]


@declared(
    "run_manifest",
    "what string, value string",
    [("dependencies of bc", "rc_a, stg_b"), ("nodes", "bc, raw_a, raw_b, rc_a, rc_a_hist, stg_a, stg_b"), ("wave 3", "rc_a"), ("fresh", "None"), ("stale", "RuntimeError: the plan is stale; plan again")],
)
def _(t):
    m = runs.manifest(GRAPH)
    return [
        ("dependencies of bc", ", ".join(m["dependencies"]["bc"])), ("nodes", ", ".join(m["nodes"])), ("wave 3", ", ".join(m["waves"][2])),
        ("fresh", outcome(lambda: runs.check_fresh(m["fingerprint"], m["waves"]))), ("stale", outcome(lambda: runs.check_fresh(m["fingerprint"], m["waves"][:-1]))),
    ]


@declared(
    "run_differences",
    "what string, value string",
    [
        ("added", "['new']"), ("removed", "['raw_b']"), ("reordered", "True"), ("inputs", "{'bc': [['rc_a', 'stg_b'], ['rc_a']], 'stg_b': [['raw_b'], []]}"), ("policy", "{'continue_on_error': [True, False], 'max_retries': [1, 0]}"),
        ("newly blocked", "['bc', 'rc_a', 'rc_a_hist']"), ("newly aborted", "['stg_a']"), ("status of stg_a", "['success', 'aborted']"), ("snapshot", "plan, policy, results, run_id"), ("last logged", "{\"cursor\": 2}"), ("never logged", "None"),
    ],
)
def _(t):
    graph = {k: v for k, v in GRAPH.items() if k != "raw_b"} | {"stg_b": (), "bc": ("rc_a",), "new": ()}
    before = runs.snapshot("1", runs.execute(GRAPH, lambda _: None), GRAPH, 1, False)
    after = runs.snapshot("2", runs.execute(graph, failing), graph)
    d = runs.run_diff(before, after)
    name = table_name("batches")
    for i in (1, 2):
        runs.log_batch(t.spark, name, f"b{i}", datetime(2024, 1, i), "root", json.dumps({"cursor": i}), 3)
    last, never = runs.last_snapshot(t.spark, name, "root"), runs.last_snapshot(t.spark, f"{name}_none", "root")
    t.spark.sql(f"drop table {name}")
    return [
        ("added", str(d["added"])), ("removed", str(d["removed"])), ("reordered", str(d["reordered"])), ("inputs", str(d["inputs"])), ("policy", str(d["policy"])), ("newly blocked", str(d["newly_blocked"])),
        ("newly aborted", str(d["newly_aborted"])), ("status of stg_a", str(d["status"]["stg_a"])), ("snapshot", ", ".join(sorted(json.loads(after)))), ("last logged", str(last)), ("never logged", str(never)),
    ]
