from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import types as T

from quern.functions import keys
from quern.governance import review, validation
from quern.operators import loads
from quern.plans import generation as g
from quern.plans import nodes as n
from quern.spec import Column, Dataset, Reference

CTX = loads.RunContext("r1", datetime(2024, 2, 1))
PERSON = (Column("BusinessEntityID", "STRING", "key", False), Column("Größe", "INTEGER"))


def test_names():
    assert g.target_name("AW", "Größe (cm)") == "aw_groesse_cm" and g.dataset_name("serving", "a b") == "a_b"


def test_generation_of_two_systems():
    two = replace(g.SourceTable("aw2", "Person", PERSON, "aw", "AW2", 2), columns=(*PERSON[:1], Column("Größe", "BIGINT"), Column("city")))
    got = {d.name: d for d in g.generate([two, g.SourceTable("aw1", "Person", PERSON, "aw", "AW1", 1, True, True)])}
    assert list(got) == ["raw_aw1_person", "raw_aw2_person", "stg_aw_person", "rc_aw_person", "rc_aw_person_hist"]
    stage, core, hist = got["stg_aw_person"], got["rc_aw_person"], got["rc_aw_person_hist"]
    assert stage.inputs == ("raw_aw1_person", "raw_aw2_person")
    assert [(c.name, c.type, c.nullable) for c in stage.columns] == [
        ("source_identity_id", "STRING", False), ("businessentityid", "STRING", False), ("groesse", "BIGINT", True), ("city", "STRING", True),
    ]
    assert core.mode == "merge" and core.columns[0].name == "rc_aw_person_key" and core.keys == ["source_identity_id", "businessentityid"]
    assert hist.columns[0].name == "rc_aw_person_hist_key" and hist.keys == ["rc_aw_person_key"] and loads.plan_load(hist) == "historize"
    assert [x for d in got.values() for x in validation.check_dataset(d, list(got.values()))] == []
    with pytest.raises(ValueError):
        g.generate([two, replace(two, system="AW2")])


def test_generation_without_keys():
    assert [d.name for d in g.generate([g.SourceTable("s", "t", (Column("v"),))])] == ["raw_s_t", "stg_s_t", "rc_s_t"]
    assert g.generate([]) == []


def test_incremental_source():
    a, b = (g.SourceTable(s, "t", (), incremental=True) for s in "ab")
    assert g.incremental_source([a, replace(b, primary=True)]).system == "b" and g.incremental_source([a, b]) is a and g.incremental_source([]) is None


def test_projection_and_history(spark):
    got = {d.name: d for d in g.generate([g.SourceTable("s", "t", (Column("id", "INTEGER", "key"), Column("v")))])}
    stage = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    core = g.projected(stage, got["rc_s_t"], CTX)
    assert core.columns == ["rc_s_t_key", "id", "v", "row_hash", "load_run_id", "loaded_at"]
    same = core.select((core.rc_s_t_key == keys.sk(["id"])) & (core.row_hash == keys.row_hash(["v"]))).collect()
    assert [r[0] for r in same] == [True, True]
    loads.load(got["rc_s_t_hist"], core.drop("load_run_id", "loaded_at"), CTX)
    assert set(spark.table("rc_s_t_hist").columns) == {c.name for c in got["rc_s_t_hist"].columns}
    with pytest.raises(ValueError):
        g.projected(stage.drop("v"), got["rc_s_t"], CTX)


def test_foreign_keys():
    parent = g.with_keys(Dataset("p", "rawcore", (Column("bk", "STRING", "key"),)))
    child = Dataset("c", "rawcore", (Column("pbk"),))
    assert g.with_reference(child, Reference("c", "p", {}), parent) == child
    linked = g.with_reference(child, Reference("c", "p", {"bk": "pbk"}), parent)
    assert linked.columns[-1].name == "p_key" and "{expr:pbk}" in linked.columns[-1].key_expression and "'bk'" in linked.columns[-1].key_expression
    again = g.with_reference(linked, Reference("c", "p", {"bk": "pbk"}, "main"), parent)
    assert [(c.name, c.former_names) for c in again.columns[1:]] == [("main_p_key", ("p_key",))]


def test_imports(spark):
    schema = T.StructType.fromDDL("id int, amount decimal(10,2), d struct<x:int,y:string>")
    assert [(c.name, c.type, c.role) for c in g.columns_of(schema, ("ID",))] == [("id", "INTEGER", "key"), ("amount", "DECIMAL(10,2)", "business"), ("d", "JSON", "business")]
    assert [(c.name, c.source) for c in g.import_json(schema)][-1] == ("d_y", "$.d.y")
    old = (Column("id", "INTEGER", expression="id + 1"), Column("gone"))
    assert [(c.name, c.type, c.expression, c.active) for c in g.synced(old, (Column("ID", "BIGINT"), Column("new")))] == [
        ("id", "BIGINT", "id + 1", True), ("gone", "STRING", None, False), ("new", "STRING", None, True),
    ]
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("imported")
    assert [c.role for c in g.import_table(spark, "imported", ("k",))] == ["key", "business"]


def test_tree_checks():
    tables = {"t": ["a", "b"]}
    bad = [
        (n.Scan("x"), 1),
        (n.Aggregate(n.Scan("t"), {"z": "z"}, {"m": n.Measure("SUM")}), 2),
        (n.Join(n.Scan("t"), (n.JoinEdge(n.Scan("t"), (n.Predicate("i1.a", "BETWEEN", ("1",)),)),), {"a": "i1.a"}), 1),
        (n.Union((n.Branch(n.Scan("t"), {"a": "a", "q": "b"}),), ("a", "b")), 2),
        (n.WindowNode(n.Scan("t"), {"r": n.WindowColumn("LAG", ("z", -1), ("y",))}), 4),
        (n.Select(n.Scan("t"), order_by=(n.Sort("q", "up"),)), 2),
    ]
    assert [len(validation.check_tree(node, tables)) for node, _ in bad] == [count for _, count in bad]
    good = n.Aggregate(n.Scan("t"), {"a": "a"}, {"s": n.Measure("STRING_AGG", "b")})
    assert validation.badges(good, tables) == {"query": "aggregate", "contract": "valid", "determinism": "s: STRING_AGG without an order"}


def test_dataset_checks():
    stage, core = Dataset("stg", "stage"), Dataset("rc", "rawcore", (Column("a"), Column("A", "odd")), ("stg",), "merge", detect_deletes=True)
    assert len(validation.check_dataset(core, [stage, core])) == 4
    assert validation.check_dataset(Dataset("v", "serving", inputs=("none",)), []) == ["v: no such input: none"]
    biz = Dataset("b", "bizcore")
    assert validation.may_query(core, []) and not validation.may_query(biz, [], True) and validation.may_query(biz, [Dataset("s", "serving", inputs=("b",))], True)


def test_reconcile_and_shadow():
    d = Dataset("t", "rawcore", (Column("a", "BIGINT"), Column("c", former_names=("b",)), Column("n", "DATE"), Column("i", "INTEGER"), Column("j", "JSON")))
    actual = T.StructType.fromDDL("a int, b string, old string, i bigint, j string")
    steps = validation.reconcile(d, actual)
    assert [(s.action, s.column) for s in steps] == [("widen", "a"), ("rename", "c"), ("add", "n"), ("block", "i"), ("keep", "old")]
    assert "rebuild" in [s.action for s in validation.reconcile(d, actual, True)] and validation.reconcile(d, None) == [validation.Step("create")]
    got = review.shadow_compare(steps, [*steps[1:], validation.Step("create")])
    assert [len(got[k]) for k in ("missing", "unexpected", "same")] == [1, 1, 4]


def test_review():
    old = [Dataset("t", "rawcore", (Column("a", "INTEGER"), Column("b")))]
    new = [Dataset("t", "rawcore", (Column("a", "BIGINT"), Column("b")))]
    fine = review.promotion(review.report(old, new), "dev", "prod")
    assert fine["status"] == "preflight" and review.promotion(review.report(old, old), "dev", "prod")["status"] == "unchanged"
    yes = review.approval(fine, "one", True, CTX.ts)
    assert review.review_status(fine, []) == "pending" and review.review_status(fine, [yes]) == "approved" and review.review_status(fine, [yes], 2) == "pending"
    blocked = review.promotion(review.report(old, [Dataset("t", "rawcore", old[0].columns[:1])]), "dev", "prod")
    assert blocked["status"] == "blocked" and review.review_status(blocked, [yes]) == "stale"
    with pytest.raises(ValueError):
        review.approval(blocked, "one", True, CTX.ts)
