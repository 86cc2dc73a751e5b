import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import keys
from quern.governance import evolution, runs
from quern.operators import loads
from quern.plans import nodes as n
from quern.sources import landing, readers
from quern.spec import Column, Dataset, Reference
from quern.streaming.ingest import merge_stream
from quern.types import LogicalType, drift

CTX = loads.RunContext("r2", datetime(2024, 2, 1))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("varchar(10)", "varchar(20)", "widening"), ("varchar(20)", "varchar(10)", "narrowing"), ("string", "varchar(5)", "equivalent"),
        ("decimal(10,2)", "decimal(12,2)", "widening"), ("decimal(10,4)", "decimal(12,2)", "narrowing"), ("int", "bigint", "widening"),
        ("bigint", "int", "narrowing"), ("date", "timestamp", "widening"), ("decimal(10,2)", "double", "widening"), ("double", "decimal(10,2)", "incompatible"),
        ("struct<a:int>", "map(string,int)", "equivalent"),
    ],
)
def test_drift(a, b, want):
    assert drift(LogicalType.parse(a), LogicalType.parse(b)) == want


def test_unknown_type():
    with pytest.raises(ValueError):
        LogicalType.parse("blob5")
    assert LogicalType.parse("blob5", strict=False).name == "BLOB5"


def test_key_language(spark):
    df = spark.createDataFrame([("x, (y)", None)], "a string, b string")
    text = keys.key_expression(["b", "a"], "it's")
    assert df.select(keys.parse(text) == keys.sk(["a", "b"], "it's")).first()[0]
    assert df.select(keys.parse("CONCAT('a, (', COL(\"a\"), \")\")")).first()[0] == "a, (x, (y))"
    assert df.select(keys.parse("concat_ws('-', {expr:b}, {expr:a}, 'z')")).first()[0] == "x, (y)-z"
    for bad in ("HASH256('a'", "UPPER('a')", "'a' 'b'", "COALESCE('a')", ""):
        with pytest.raises(ValueError):
            keys.parse(bad)


def test_foreign_key_equals_parent(spark):
    ref = Reference("child", "parent", {"bk": "c"}, "x")
    df = spark.createDataFrame([("7", "7")], "bk string, c string")
    assert ref.column == "x_parent_key" and df.select(keys.fk(ref.mapping) == keys.sk(["bk"])).first()[0]


def test_plan_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    bad = [
        n.Scan("none"),
        n.Join(df, (n.JoinEdge(df, (), "inner"),), {"a": "i1.a"}),
        n.Join(df, (n.JoinEdge(df, (n.Predicate("i1.a", "=", "i2.a"),), "cross"),), {"a": "i1.a"}),
        n.Union((n.Branch(df, {"a": "a"}),), ("a", "b")),
        n.WindowNode(df, {"a": n.WindowColumn("COUNT")}),
        n.WindowNode(df, {"r": n.WindowColumn("RANK")}),
        n.WindowNode(df, {"r": n.WindowColumn("NTILE", (0,), (), (n.Sort("a"),))}),
        n.Aggregate(df, {"a": "a"}, {}),
        n.Aggregate(df, {}, {"m": n.Measure("MEDIAN", "a")}),
    ]
    for node in bad:
        with pytest.raises(ValueError):
            n.build(node, {})


def test_contract_and_warnings():
    node = n.Aggregate(n.Scan("t"), {"a": "k"}, {"s": n.Measure("STRING_AGG", "b")})
    assert n.contract(node, {"t": ["a", "b"]}) == ["k", "s"] and n.warnings(node) == ["s: STRING_AGG without an order"]
    with pytest.raises(ValueError):
        n.contract(n.WindowNode(n.Scan("t"), {"A": n.WindowColumn("COUNT")}), {"t": ["a"]})


def test_merge_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c"), (None, "m")], "k int, v string")
    assert {tuple(r) for r in loads.merge(t, s, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")}
    with pytest.raises(ValueError):
        loads.merge(t, s.union(s), ["k"])


def test_delete_and_scope(spark):
    t = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, None)], "k int, upd_date int")
    s = spark.createDataFrame([(1,)], "k int")
    scope = loads.rewrite_scope("s.ModifiedDate >= 3 and name <> 'ModifiedDate'", {"ModifiedDate": "upd_date"}, ["k"])
    assert scope == "upd_date >= 3 and name <> 'ModifiedDate'"
    assert rows(loads.delete_missing(t, s, ["k"], "upd_date >= 3"), "k") == [(1,), (3,), (4,)]


def test_history(spark):
    first = loads.scd2(None, spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, row_hash string"), "k", loads.RunContext("r1", datetime(2024, 1, 1)))
    second = loads.scd2(first, spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, row_hash string"), "k", CTX)
    assert rows(second, "k", "row_hash", "version_state", F.col("version_ended_at").isNull()) == [
        ("a", "1", "new", True), ("b", "1", "changed", False), ("b", "2", "changed", True), ("c", "1", "deleted", False), ("d", "1", "new", True),
    ]
    back = spark.createDataFrame([("c", "1")], "k string, row_hash string")
    later = loads.RunContext("r3", datetime(2024, 3, 1))
    assert loads.scd2(second, back, "k", later).where("k = 'c'").count() == 1
    assert loads.scd2(second, back, "k", later, reopen=True).where("k = 'c'").count() == 2


def test_swap_that_failed_between_its_renames(spark):
    core = Dataset("t_torn", "rawcore", (Column("k", "INTEGER", "key"), Column("v")), ("s",))
    spark.sql("drop table if exists t_torn")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.mode("overwrite").saveAsTable("t_torn__old")
    loads.load(core, spark.createDataFrame([(2, "c")], "k int, v string"), CTX)
    assert rows(spark.table("t_torn"), "k", "v") == [(1, "a"), (2, "c")]
    assert not spark.catalog.tableExists("t_torn__old")


def test_load_modes_and_swap(spark):
    core = Dataset("rc_t", "rawcore", (Column("k", "INTEGER", "key"), Column("v")), ("stg_t",))
    assert [loads.plan_load(Dataset("x", layer)) for layer in ("raw", "stage", "rawcore", "bizcore", "serving")] == ["full", "view", "full", "full", "view"]
    assert loads.plan_load(core) == "merge" and loads.plan_load(Dataset("rc_t_hist", "rawcore")) == "historize"
    loads.load(core, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), CTX)
    loads.load(core, spark.createDataFrame([(2, "c")], "k int, v string"), CTX)
    assert rows(spark.table("rc_t"), "k", "v") == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        loads.ranked_stage([(spark.range(1), 1)], [])


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Internal ID;customer;note\n1;Müller;"say ""a;b"""\n2;Schmidt;\n'.encode())
    df = readers.read(spark, readers.Source("csv", str(tmp_path / "a.csv"), {"delimiter": ";"}))
    assert rows(readers.with_normal_names(df), "internal_id", "note") == [("1", 'say "a;b"'), ("2", None)]
    (tmp_path / "b.jsonl").write_text('{"a": 1, "d": "2024-01-05"}\n\n{"a": 2, "d": "2023-01-05"}\n')
    source = readers.Source("jsonl", str(tmp_path / "b.jsonl"), increment="d >= {{DELTA_CUTOFF}}", incremental=True)
    assert rows(readers.read(spark, source, CTX, readers.cutoff(CTX.ts, 2, "month")), "a") == [(1,)]
    with pytest.raises(ValueError):
        readers.read(spark, source, CTX)
    with pytest.raises(ValueError):
        readers.read(spark, readers.Source("excel", "x", {"header_row": 0}))


def test_cutoffs():
    assert readers.cutoff(datetime(2024, 3, 31), 1, "month") == datetime(2024, 2, 29)
    assert readers.cutoff(datetime(2024, 1, 31), 1, "month") == datetime(2023, 12, 31)
    assert readers.cutoff(datetime(2024, 2, 29), 1, "year") == datetime(2023, 2, 28)


def test_rest(spark):
    assert readers.records({"data": {"items": [{"a": 1}, 3]}}, "data.items") == [{"a": 1}] and readers.records({"a": 1}) == [{"a": 1}]
    answers = {None: (200, {"d": [{"x": 1}], "next": "p2"}), "p2": (200, {"d": [{"x": 2}]})}
    df = readers.pages(spark, lambda at: answers[at], "d")
    assert [json.loads(r.payload)["x"] for r in df.orderBy("page").collect()] == [1, 2]
    waits, tries = [], iter([(503, None), (429, None), (200, "ok")])
    assert readers.fetched(lambda: next(tries), sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        readers.fetched(lambda: (404, None), sleep=waits.append)


def test_landing_and_guess(spark):
    df = spark.createDataFrame([('{"a": {"b": [{"c": 5}]}}',), ('{"a": 1}',)], "payload string")
    out = landing.landed(df, {"c": ("$.a.b[0].c", "INTEGER")}, CTX)
    assert [r.c for r in out.collect()] == [5, None] and out.columns == ["c", "payload", "load_run_id", "loaded_at"]
    got = landing.guessed([{"Cust ID": "1", "d": "2024-01-01", "x": "1.5", "n": 1}, {"Cust ID": "2", "d": "2024-01-01 10:00", "x": "", "n": 5_000_000_000}])
    assert {k: v["type"] for k, v in got.items()} == {"cust_id": "INTEGER", "d": "TIMESTAMP", "x": "DECIMAL", "n": "BIGINT"}
    assert got["cust_id"]["key"] and got["x"]["nullable"] and not got["n"]["key"]


def test_evolution(spark):
    old = Dataset("t", "rawcore", (Column("a", "INTEGER"), Column("b"), Column("gone")))
    new = Dataset("t", "rawcore", (Column("a", "BIGINT"), Column("c", former_names=("b",)), Column("d", "DATE")))
    got = {(c.kind, c.column): evolution.decide(c) for c in evolution.diff([old], [new])}
    assert got == {("change", "a"): "REQUIRES_PREFLIGHT", ("rename", "c"): "ALLOW", ("add", "d"): "ALLOW", ("drop", "gone"): "BLOCKED_BY_POLICY"}
    moved = evolution.migrate(spark.createDataFrame([(1, "x", "y")], "a int, b string, gone string"), old, new)
    assert moved.dtypes == [("a", "bigint"), ("c", "string"), ("d", "date"), ("gone", "string")]
    assert evolution.renamed(old, "b", "z").columns[1].former_names == ("b",)
    with pytest.raises(ValueError):
        evolution.renamed(old, "b", "A")


def test_history_of_many_runs_equals_steps(spark):
    """One join gives what closing and opening step by step would."""
    import random

    rng = random.Random(3)
    history, plain = None, {}
    for turn in range(1, 6):
        now = {k: rng.choice("abN") for k in range(20) if rng.random() < 0.7}
        ctx = loads.RunContext(f"r{turn}", datetime(2024, turn, 1))
        base = spark.createDataFrame([(str(k), None if v == "N" else v) for k, v in now.items()], "k string, row_hash string")
        history = loads.scd2(history, base, "k", ctx, stamped=True)
        history = spark.createDataFrame(history.collect(), history.schema)
        for k in list(plain):
            for v in [v for v in plain[k] if v[2] is None]:
                if k not in now:
                    v[2:] = [turn, "deleted"]
                elif "N" not in (now[k], v[0]) and now[k] != v[0]:
                    v[2:] = [turn, "changed"]
                    plain[k].append([now[k], turn, None, "changed"])
        for k in now:
            plain.setdefault(k, [[now[k], turn, None, "new"]])
    got = sorted((int(r.k), r.row_hash or "N", r.version_started_at.month, r.version_ended_at.month if r.version_ended_at else None, r.version_state, r.loaded_at.month) for r in history.collect())
    assert got == sorted((k, *v, v[2] or v[1]) for k, vs in plain.items() for v in vs)


def test_runs():
    graph = {"a": (), "b": ("a",), "c": ("b",), "d": ()}
    assert runs.levels(graph) == [["a", "d"], ["b"], ["c"]] and runs.lineage(graph, "c") == {"b": 1, "a": 2} and runs.lineage(graph, "a", True, 1) == {"b": 1}
    with pytest.raises(ValueError):
        runs.levels({"a": ("b",), "b": ("a",)})
    calls = []

    def step(name):
        calls.append(name)
        if name == "a":
            return {"status": "error", "message": "no"}

    got = {r.dataset: (r.status, r.attempts) for r in runs.execute(graph, step, retries=1, fail_fast=False)}
    assert got == {"a": ("error", 2), "d": ("success", 1), "b": ("blocked", 0), "c": ("blocked", 0)}
    one, two = runs.snapshot("1", runs.execute(graph, lambda _: None)), runs.snapshot("2", runs.execute(graph, step, fail_fast=False))
    assert set(runs.snapshot_diff(one, two)) == {"a", "b", "c"}
    with pytest.raises(RuntimeError):
        runs.check_fresh("x", graph)


def test_stream_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    for part in (df.where("o = 1"), df.where("o = 2")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        merge_stream(spark, str(tmp_path / "in"), df.schema, "streamed", ["k"], "o", str(tmp_path / "cp"))
    assert rows(spark.table("streamed"), "k", "v") == [(1, "b"), (2, "c")]


def test_untouched_buckets_stay(spark, tmp_path):
    """A load of few keys leaves the files of all other buckets alone, and an emptied bucket goes."""
    core = Dataset("t_buckets", "rawcore", (Column("k", "INTEGER", "key"), Column("v")), ("s",), "merge", detect_deletes=True, scope="k >= 90", buckets=16)
    spark.sql("drop table if exists t_buckets")
    loads.load(core, spark.createDataFrame([(k, "a") for k in range(100)], "k int, v string"), CTX)
    files = lambda: {r[0] for r in spark.table("t_buckets").select("_metadata.file_path").distinct().collect()}
    before = files()
    loads.load(core, spark.createDataFrame([(3, "b"), *((k, "a") for k in range(90, 100))], "k int, v string"), CTX)
    assert rows(spark.table("t_buckets"), "k", "v") == [(k, "b" if k == 3 else "a") for k in range(100)]
    assert len(before & files()) >= 4
    loads.load(core, spark.createDataFrame([(3, "b")], "k int, v string"), CTX)
    assert rows(spark.table("t_buckets"), "k", "v") == [(k, "b" if k == 3 else "a") for k in range(90)]
    one = Dataset("t_one", "rawcore", core.columns, ("s",), "merge", detect_deletes=True, scope="true", buckets=512)
    spark.sql("drop table if exists t_one")
    for given in ([(1, "a"), (2, "a")], [(2, "a")]):
        loads.load(one, spark.createDataFrame(given, "k int, v string"), CTX)
    assert rows(spark.table("t_one"), "k", "v") == [(2, "a")]
