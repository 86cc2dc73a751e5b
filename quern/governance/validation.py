"""What is wrong with query trees, datasets and tables, found before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

from quern.plans import nodes as n
from quern.spec import LAYERS, Dataset
from quern.types import LogicalType, drift

#: Layers whose datasets may hold query trees.
QUERY_LAYERS = ("bizcore", "serving")


def children(node) -> list:
    if isinstance(node, n.Join):
        return [node.first, *(e.right for e in node.edges)]
    if isinstance(node, n.Union):
        return [b.input for b in node.branches]
    return [node.input] if hasattr(node, "input") else []


def check_tree(node, tables: Mapping[str, list[str]]) -> list[str]:
    """All that is wrong in a tree, inputs first; tables gives the columns of the scans."""
    out = [x for child in children(node) for x in check_tree(child, tables)]
    if out:
        return out
    if isinstance(node, n.Scan):
        return [] if node.table in tables or n.CALL.match(node.table) else [f"no such table: {node.table}"]
    try:
        n.contract(node, tables)
    except ValueError as e:
        out.append(str(e))
    return out + {n.Select: _select, n.Join: _join, n.Aggregate: _aggregate, n.Union: _union, n.WindowNode: _window}[type(node)](node, tables)


def _attempt(call, *args) -> list[str]:
    try:
        call(*args)
    except ValueError as e:
        return [str(e)]
    return []


def _lacking(what: str, used, columns: list[str]) -> list[str]:
    known = {c.lower() for c in columns}
    return [f"{what}: no input column {c}" for c in used if c is not None and c.lower() not in known]


def _order(what: str, order, columns: list[str]) -> list[str]:
    bad = [f"{what}: not a sort order: {s.direction}" for s in order if s.direction.lower() not in ("asc", "desc") or s.nulls not in (None, "first", "last")]
    return bad + _lacking(what, [s.column for s in order], columns)


def _select(node: n.Select, tables) -> list[str]:
    return _order("select", node.order_by, n.contract(node, tables))


def _join(node: n.Join, tables) -> list[str]:
    out = [] if node.edges else ["join: nothing to join"]
    for i, e in enumerate(node.edges, 2):
        how = e.how.lower()
        if how not in n.JOINS:
            out.append(f"join i{i}: no such type: {e.how}")
        elif bool(e.predicates) == (how == "cross"):
            out.append(f"join i{i}: a cross join has no predicates, and any other join has some")
        for p in e.predicates:
            op = p.op.upper()
            takes = {"IS NULL": p.right is None, "IS NOT NULL": p.right is None, "IN": isinstance(p.right, tuple) and bool(p.right)}
            takes["BETWEEN"] = isinstance(p.right, tuple) and len(p.right) == 2
            if op not in n.OPERATORS:
                out.append(f"join i{i}: no such operator: {p.op}")
            elif not takes.get(op, isinstance(p.right, str)):
                out.append(f"join i{i}: {op} does not take {p.right!r}")
        if not out and (wrong := n.connected(e, i)):
            out.append(wrong)
    return out


def _aggregate(node: n.Aggregate, tables) -> list[str]:
    columns = n.contract(n.with_inputs(node), tables)
    if isinstance(node.input, n.Select):  # what a select leaves out must be there before it
        columns = [c for c in columns if c in (node.input.columns or columns) or c in n.contract(node.input.input, tables)]
    out = _lacking("aggregate", node.keys, columns) + ([] if node.measures else ["aggregate: no measures"])
    for name, m in node.measures.items():
        function = m.function.upper()
        if function not in n.MEASURES:
            out.append(f"{name}: no such aggregate: {m.function}")
        elif m.column is None and function != "COUNT":
            out.append(f"{name}: {function} needs a column")
        out += _lacking(name, [m.column], columns) + _order(name, m.order_by, columns)
    return out


def _union(node: n.Union, tables) -> list[str]:
    out = [] if node.contract and node.branches else ["union: no contract or no branches"]
    for i, b in enumerate(node.branches, 1):
        out += [f"union: branch {i} does not map {c}" for c in node.contract if c not in b.mapping]
        out += [f"union: branch {i} maps {c}, which the contract lacks" for c in b.mapping if c not in node.contract]
    return out


def _window(node: n.WindowNode, tables) -> list[str]:
    columns, out = n.contract(node.input, tables), []
    for name, w in node.columns.items():
        function = w.function.upper()
        if function not in n.WINDOW_RULES:
            out.append(f"{name}: no such window function: {w.function}")
            continue
        least, most, ordered = n.WINDOW_RULES[function]
        if not least <= len(w.args) <= most:
            out.append(f"{name}: {function} takes {least} to {most} arguments")
        if ordered and not w.order_by:
            out.append(f"{name}: {function} needs an order")
        number = 0 if function == "NTILE" else 1 if function in ("LAG", "LEAD", "NTH_VALUE") else None
        for i, a in enumerate(w.args):
            if i == number and (isinstance(a, bool) or not isinstance(a, int) or a < (0 if function in ("LAG", "LEAD") else 1)):
                out.append(f"{name}: {function} takes a whole number, not {a!r}")
            elif i == 0 and function != "NTILE":
                out += _lacking(name, [a], columns)
        out += _lacking(name, w.partition_by, columns) + _order(name, w.order_by, columns)
    return out


def badges(node, tables: Mapping[str, list[str]]) -> dict[str, str]:
    """A tree's state at a glance: whether it is valid, whether its result depends on chance, and its kind."""
    wrong, chance = check_tree(node, tables), n.warnings(node)
    kind = "scan" if isinstance(node, n.Scan) else type(node).__name__.lower()
    return {"query": kind, "contract": "; ".join(wrong) or "valid", "determinism": "; ".join(chance) or "deterministic"}


def dependents(name: str, datasets: list[Dataset]) -> list[str]:
    return sorted(d.name for d in datasets if name in d.inputs)


def may_query(dataset: Dataset, datasets: list[Dataset], changing: bool = False) -> list[str]:
    """Why a dataset may not hold a query tree, or, if changing, not have it changed."""
    out = [] if dataset.layer in QUERY_LAYERS else [f"{dataset.name}: no query trees in layer {dataset.layer}"]
    users = dependents(dataset.name, datasets) if changing else []
    return out + ([f"{dataset.name}: frozen while {', '.join(users)} use it"] if users else [])


def check_dataset(dataset: Dataset, datasets: list[Dataset]) -> list[str]:
    """What is wrong with a dataset's layer, materialization, load mode, inputs and columns."""
    by_name, name = {d.name: d for d in datasets}, dataset.name
    if dataset.layer not in LAYERS:
        return [f"{name}: no such layer: {dataset.layer}"]
    layer = LAYERS[dataset.layer]
    kind, mode = dataset.materialization or layer.materialization, dataset.mode or layer.mode
    out = [f"{name}: no such input: {i}" for i in dataset.inputs if i not in by_name and dataset.layer != "raw"]
    if kind not in ("table", "view", "external"):
        out.append(f"{name}: no such materialization: {kind}")
    if kind == "view" and (mode in ("merge", "append", "historize") or dataset.detect_deletes):
        out.append(f"{name}: a view takes no {mode} load")
    if mode == "merge" and kind != "view":
        stages = [i for i in dataset.inputs if i in by_name and by_name[i].layer == "stage"]
        if dataset.layer != "rawcore":
            out.append(f"{name}: only rawcore merges")
        if not dataset.keys:
            out.append(f"{name}: a merge needs keys")
        if len(stages) != 1:
            out.append(f"{name}: a merge needs one stage input, not {len(stages)}")
    if dataset.detect_deletes and not dataset.scope:
        out.append(f"{name}: deletes need a scope")
    if mode == "historize" or name.endswith("_hist"):
        have = {c.name for c in dataset.columns}
        lacks = [c for c in ("row_hash", "version_started_at", "version_ended_at", "version_state", "load_run_id", "loaded_at") if c not in have]
        out += [f"{name}: a history needs {c}" for c in lacks] + ([] if dataset.keys else [f"{name}: a history needs an entity key"])
    names = [c.name.lower() for c in dataset.columns]
    out += [f"{name}: column {c} repeats" for c in sorted({c for c in names if names.count(c) > 1})]
    for c in dataset.columns:
        if sum(x is not None for x in (c.expression, c.key_expression)) > 1:
            out.append(f"{name}.{c.name}: more than one expression")
        out += [f"{name}.{c.name}: {e}" for e in _attempt(LogicalType.parse, c.type)]
    return out


@dataclass(frozen=True)
class Step:
    """action: create, add, rename, widen, rebuild, keep or block."""

    action: str
    column: str | None = None
    before: str | None = None
    after: str | None = None


def reconcile(dataset: Dataset, actual: T.StructType | None, allow_lossy: bool = False) -> list[Step]:
    """The steps that bring a table to its dataset's columns. Columns no longer declared are kept.

    A narrowing or incompatible change is blocked unless lossy changes are allowed, when it
    means a rebuild.
    """
    if actual is None:
        return [Step("create")]
    there = {f.name.lower(): f for f in actual.fields}
    wanted = {c.name.lower() for c in dataset.columns}
    out, used = [], set()
    for c in dataset.columns:
        if not c.active:
            continue
        f = there.get(c.name.lower())
        if f is None:
            former = [x for x in c.former_names if x.lower() in there and x.lower() not in wanted | used]
            if len(former) > 1:
                out.append(Step("block", c.name, ", ".join(former), "more than one former name"))
                continue
            if not former:
                out.append(Step("add", c.name, after=c.type))
                continue
            f = there[former[0].lower()]
            out.append(Step("rename", c.name, f.name, c.name))
        used.add(f.name.lower())
        have = LogicalType.of(f.dataType)
        # text holds whatever Spark has no type for
        want = LogicalType.of(c.logical.spark()) if have.name == "STRING" else c.logical
        kind = drift(have, want)
        if kind == "widening":
            out.append(Step("widen", c.name, have.name, c.type))
        elif kind != "equivalent":
            out.append(Step("rebuild" if allow_lossy else "block", c.name, have.name, c.type))
    return out + [Step("keep", f.name) for name, f in there.items() if name not in used | wanted]
