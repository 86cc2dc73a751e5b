"""The query algebra: trees of nodes, checked and turned into DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sort:
    """nulls: first, last, or None for the engine's own placement."""

    column: str
    direction: str = "asc"
    nulls: str | None = None

    def spark(self) -> Column:
        if self.direction.lower() not in ("asc", "desc") or self.nulls not in (None, "first", "last"):
            raise ValueError(f"not a sort order: {self}")
        name = self.direction.lower() + (f"_nulls_{self.nulls}" if self.nulls else "")
        return getattr(F.col(self.column), name)()

    def sql(self) -> str:
        return f"`{self.column}` {self.direction}" + (f" nulls {self.nulls}" if self.nulls else "")


@dataclass(frozen=True)
class Scan:
    """A table, or a call of a table function, such as range(0, 10)."""

    table: str


@dataclass(frozen=True)
class Select:
    """columns: output name to SQL expression; None keeps all."""

    input: object
    columns: Mapping[str, str] | None = None
    where: str | None = None
    distinct: bool = False
    order_by: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Predicate:
    left: str
    op: str = "="
    right: str | tuple[str, ...] | None = None


@dataclass(frozen=True)
class JoinEdge:
    """right joins what stands before it, as alias i1, i2, ... by place; left names the alias it joins, i1 unless it says so.

    Bare names in predicates go to the side that has them: where both have, on the left of a predicate to
    left, on its right to the new side. bucket makes a BETWEEN of numbers an equal join: each row of the new side meets the
    others through the buckets, of that width, that its range touches, so no side is compared whole with the other.
    """

    right: object
    predicates: tuple[Predicate, ...] = ()
    how: str = "left"
    left: str | None = None
    bucket: float | None = None


@dataclass(frozen=True)
class Join:
    first: object
    edges: tuple[JoinEdge, ...]
    columns: Mapping[str, str]
    where: str | None = None


@dataclass(frozen=True)
class Measure:
    function: str
    column: str | None = None
    distinct: bool = False
    delimiter: str = ","
    order_by: tuple[Sort, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    """keys: input column to output name; measures: output name to measure."""

    input: object
    keys: Mapping[str, str]
    measures: Mapping[str, Measure]
    having: str | None = None


@dataclass(frozen=True)
class Branch:
    """mapping: output name to the branch's column."""

    input: object
    mapping: Mapping[str, str]


@dataclass(frozen=True)
class Union:
    branches: tuple[Branch, ...]
    contract: tuple[str, ...]
    mode: str = "union_all"


@dataclass(frozen=True)
class WindowColumn:
    function: str
    args: tuple = ()
    partition_by: tuple[str, ...] = ()
    order_by: tuple[Sort, ...] = ()
    active: bool = True


@dataclass(frozen=True)
class WindowNode:
    input: object
    columns: Mapping[str, WindowColumn]


#: Window functions, with the least and most arguments and whether an order is needed; aggregates, join types and operators.
WINDOW_RULES = {
    "ROW_NUMBER": (0, 0, True), "RANK": (0, 0, True), "DENSE_RANK": (0, 0, True), "NTILE": (1, 1, True),
    "LAG": (1, 3, True), "LEAD": (1, 3, True), "FIRST_VALUE": (1, 1, True), "LAST_VALUE": (1, 1, True),
    "NTH_VALUE": (2, 2, True), "SUM": (1, 1, False), "AVG": (1, 1, False), "MIN": (1, 1, False),
    "MAX": (1, 1, False), "COUNT": (0, 1, False),
}
MEASURES = ("SUM", "MIN", "MAX", "AVG", "COUNT", "COUNT_DISTINCT", "STRING_AGG")
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "LIKE", "IN", "BETWEEN", "IS NULL", "IS NOT NULL")


CALL = re.compile(r"\w+\(.*\)$", re.S)
NAME = re.compile(r"('(?:[^']|'')*')|(?<![\w.`])([A-Za-z_]\w*)(?!\w)(?!\s*[.(])")


def qualified(text: str, left: str, right: str, left_columns: set[str], right_columns: set[str], side: str) -> str:
    """text with each bare name given the alias of the side that has it, or of side if both have."""

    def named(m: re.Match) -> str:
        name = m[2]
        if name is None or (name.lower() not in left_columns and name.lower() not in right_columns):
            return m[0]
        both = name.lower() in left_columns and name.lower() in right_columns
        return f"{side if both else left if name.lower() in left_columns else right}.{name}"

    return NAME.sub(named, text)


def connected(edge: JoinEdge, i: int) -> str | None:
    """What is wrong with how the edge of input i is tied to the inputs before it, given qualified predicates."""
    if edge.left is not None and edge.left not in {f"i{k}" for k in range(1, i)}:
        return f"join i{i}: {edge.left} is not part of the join yet"
    if edge.how.lower() == "cross":
        return None
    text = " ".join(" ".join([p.left, *([p.right] if isinstance(p.right, str) else p.right or ())]) for p in edge.predicates)
    used = {int(x) for x in re.findall(r"\bi(\d+)\.", text)}
    if i not in used or not used & set(range(1, i)):
        return f"join i{i}: no predicate ties it to what stands before it; that is a cross join"
    return None


def build(node, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The DataFrame of a tree; tables gives the scans."""
    if isinstance(node, DataFrame):
        return node
    if isinstance(node, Scan):
        if CALL.match(node.table):
            return SparkSession.active().sql(f"select * from {node.table}")
        if node.table not in tables:
            raise ValueError(f"no such table: {node.table}")
        return tables[node.table]
    return {Select: _select, Join: _join, Aggregate: _aggregate, Union: _union, WindowNode: _window}[type(node)](node, tables)


def _select(node: Select, tables) -> DataFrame:
    df = build(node.input, tables)
    df = df.where(F.expr(node.where)) if node.where else df
    if node.columns is not None:
        df = df.select(*[F.expr(e).alias(n) for n, e in node.columns.items()])
    df = df.distinct() if node.distinct else df
    df = df.orderBy(*[s.spark() for s in node.order_by]) if node.order_by else df
    df = df.offset(node.offset) if node.offset else df
    return df if node.limit is None else df.limit(node.limit)


def condition(p: Predicate) -> Column:
    op, right = p.op.upper(), p.right
    if op not in OPERATORS:
        raise ValueError(f"no such operator: {p.op}")
    if op.startswith("IS"):
        if right is not None:
            raise ValueError(f"{op} takes no right side")
        return F.expr(f"({p.left}) {op}")
    if op in ("IN", "BETWEEN"):
        if not isinstance(right, tuple) or not right or (op == "BETWEEN" and len(right) != 2):
            raise ValueError(f"{op} takes a tuple on its right")
        return F.expr(f"({p.left}) in ({', '.join(right)})" if op == "IN" else f"({p.left}) between ({right[0]}) and ({right[1]})")
    if not isinstance(right, str):
        raise ValueError(f"{op} takes one right side")
    return F.expr(f"({p.left}) {op} ({right})")


def _join(node: Join, tables) -> DataFrame:
    first = build(node.first, tables)
    columns = {"i1": {c.lower() for c in first.columns}}
    df = first.alias("i1")
    for i, edge in enumerate(node.edges, 2):
        how = JOINS.get(edge.how.lower())
        if how is None or bool(edge.predicates) == (how == "cross"):
            raise ValueError("a cross join has no predicates, and any other join has some")
        right, mine = build(edge.right, tables), f"i{i}"
        columns[mine], left = {c.lower() for c in right.columns}, edge.left or "i1"
        put = lambda text, side: qualified(text, left, mine, columns.get(left, set()), columns[mine], side)  # noqa: B023, E731
        to = lambda r: tuple(put(x, mine) for x in r) if isinstance(r, tuple) else put(r, mine) if isinstance(r, str) else r  # noqa: B023, E731
        edge = replace(edge, predicates=tuple(replace(p, left=put(p.left, left), right=to(p.right)) for p in edge.predicates))
        if wrong := connected(edge, i):
            raise ValueError(wrong)
        right = right.alias(mine)
        if how == "cross":
            df = df.crossJoin(right)
        else:
            on = condition(edge.predicates[0])
            for p in edge.predicates[1:]:
                on = on & condition(p)
            if edge.bucket is not None:
                df, right = _bucketed(df, right, mine, edge, how)
                on = (F.col("_q_at") == F.col(f"{mine}._q_bucket")) & on
            df = df.join(right, on, how)
            df = df.drop("_q_at") if edge.bucket is not None else df
    df = df.where(F.expr(node.where)) if node.where else df
    return df.select(*[F.expr(e).alias(n) for n, e in node.columns.items()])


def _bucketed(df: DataFrame, right: DataFrame, mine: str, edge: JoinEdge, how: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a range join with the bucket of each value and the buckets of each range."""
    ranges = [p for p in edge.predicates if p.op.upper() == "BETWEEN"]
    if len(ranges) != 1 or edge.bucket <= 0 or how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("buckets need one BETWEEN, a width above 0, and an inner, left, semi or anti join")
    low, high = (F.floor(F.expr(x) / F.lit(float(edge.bucket))) for x in ranges[0].right)
    touched = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("_q_at", F.floor(F.expr(ranges[0].left) / F.lit(float(edge.bucket)))), right.withColumn("_q_bucket", touched).alias(mine)


def measure(m: Measure) -> Column:
    name = m.function.upper()
    if name not in MEASURES:
        raise ValueError(f"no such aggregate: {m.function}")
    distinct = m.distinct or name == "COUNT_DISTINCT"
    if name.startswith("COUNT"):
        if m.column is None:
            return F.count(F.lit(1))
        return F.count_distinct(F.col(m.column)) if distinct else F.count(F.col(m.column))
    if m.column is None:
        raise ValueError(f"{name} needs a column")
    inner = f"{'distinct ' if distinct else ''}`{m.column}`"
    if name != "STRING_AGG":
        return F.expr(f"{name.lower()}({inner})")
    text = m.delimiter.replace("\\", "\\\\").replace("'", "\\'")
    order = ", ".join(s.sql() for s in m.order_by)
    return F.expr(f"listagg({inner}, '{text}')" + (f" within group (order by {order})" if order else ""))


def with_inputs(node: Aggregate):
    """The input of an aggregate; a select that leaves out columns the aggregate takes gives them too."""
    inner = node.input
    if not isinstance(inner, Select) or inner.columns is None or inner.distinct:
        return inner
    taken = [*node.keys, *(m.column for m in node.measures.values()), *(s.column for m in node.measures.values() for s in m.order_by)]
    missing = sorted({c for c in taken if c is not None and c.lower() not in {x.lower() for x in inner.columns}})
    return replace(inner, columns={**inner.columns, **{c: f"`{c}`" for c in missing}}) if missing else inner


def _aggregate(node: Aggregate, tables) -> DataFrame:
    if not node.measures:
        raise ValueError("an aggregate needs measures")
    df = build(with_inputs(node), tables)
    measures = [measure(m).alias(n) for n, m in node.measures.items()]
    df = df.groupBy(*[F.col(k).alias(n) for k, n in node.keys.items()]).agg(*measures) if node.keys else df.agg(*measures)
    return df.where(F.expr(node.having)) if node.having else df


def _union(node: Union, tables) -> DataFrame:
    if not node.contract or not node.branches:
        raise ValueError("a union needs a contract and branches")
    out = None
    for branch in node.branches:
        missing = [c for c in node.contract if c not in branch.mapping]
        if missing:
            raise ValueError(f"a branch does not map {missing}")
        part = build(branch.input, tables).select(*[F.expr(branch.mapping[c]).alias(c) for c in node.contract])
        out = part if out is None else out.union(part)
    return out if node.mode.lower() in ("union_all", "all") else out.distinct()


def window_column(w: WindowColumn) -> Column:
    name = w.function.upper()
    if name not in WINDOW_RULES:
        raise ValueError(f"no such window function: {w.function}")
    least, most, ordered = WINDOW_RULES[name]
    if not least <= len(w.args) <= most:
        raise ValueError(f"{name} takes {least} to {most} arguments")
    if ordered and not w.order_by:
        raise ValueError(f"{name} needs an order")
    for i, a in enumerate(w.args):
        counted = name == "NTILE" or (i == 1 and name in ("LAG", "LEAD", "NTH_VALUE"))
        if counted and (not isinstance(a, int) or a < (0 if name in ("LAG", "LEAD") else 1)):
            raise ValueError(f"{name} takes a whole number, not {a!r}")
    args = [F.col(a) if i == 0 and name != "NTILE" else a for i, a in enumerate(w.args)]
    call = F.count(args[0] if args else F.lit(1)) if name == "COUNT" else getattr(F, name.lower())(*args)
    spec = Window.partitionBy(*w.partition_by)
    return call.over(spec.orderBy(*[s.spark() for s in w.order_by]) if w.order_by else spec)


def _window(node: WindowNode, tables) -> DataFrame:
    df = build(node.input, tables)
    clash = {c.lower() for c in df.columns} & {c.lower() for c in node.columns}
    if clash:
        raise ValueError(f"window columns that exist already: {sorted(clash)}")
    return df.select("*", *[window_column(w).alias(n) for n, w in node.columns.items() if w.active])


def contract(node, tables: Mapping[str, list[str]]) -> list[str]:
    """The output columns of a tree, without building it; clashes are errors."""
    if isinstance(node, Scan):
        out = list(tables[node.table])
    elif isinstance(node, Select):
        out = list(node.columns) if node.columns is not None else contract(node.input, tables)
    elif isinstance(node, Join):
        out = list(node.columns)
    elif isinstance(node, Aggregate):
        out = [*node.keys.values(), *node.measures]
    elif isinstance(node, Union):
        out = list(node.contract)
    else:
        out = [*contract(node.input, tables), *(n for n, w in node.columns.items() if w.active)]
    if len({c.lower() for c in out}) < len(out):
        raise ValueError(f"duplicate output columns: {out}")
    return out


def output_types(node, tables: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """Logical types of a tree's output by rule: a count is a BIGINT, a rank an INTEGER, other aggregates keep their
    column's type, a column its own; whatever else an expression gives is a STRING until it is declared.
    """
    if isinstance(node, Scan):
        return dict(tables[node.table])
    if isinstance(node, Select):
        known = output_types(node.input, tables)
        return known if node.columns is None else {n: known.get(e, "STRING") for n, e in node.columns.items()}
    if isinstance(node, Join):
        sides = {f"i{i}.{c}": t for i, x in enumerate([node.first, *(e.right for e in node.edges)], 1) for c, t in output_types(x, tables).items()}
        return {n: sides.get(e, "STRING") for n, e in node.columns.items()}
    if isinstance(node, Union):
        known = output_types(node.branches[0].input, tables)
        return {c: known.get(node.branches[0].mapping.get(c), "STRING") for c in node.contract}
    known = output_types(node.input, tables)
    if isinstance(node, Aggregate):
        out = {n: known.get(k, "STRING") for k, n in node.keys.items()}
        return out | {n: _measured(m.function, m.column, known) for n, m in node.measures.items()}
    return known | {n: _measured(w.function, w.args[0] if w.args else None, known) for n, w in node.columns.items() if w.active}


def _measured(function: str, column: object, known: Mapping[str, str]) -> str:
    name = function.upper()
    if name.startswith("COUNT"):
        return "BIGINT"
    if name in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE"):
        return "INTEGER"
    return "STRING" if name == "STRING_AGG" else known.get(column, "STRING")


def warnings(node) -> list[str]:
    """What makes a tree's result depend on chance, or gathers all rows in one task."""
    out = []
    if isinstance(node, Aggregate):
        out += [f"{n}: STRING_AGG without an order" for n, m in node.measures.items() if m.function.upper() == "STRING_AGG" and not m.order_by]
    if isinstance(node, WindowNode):
        out += [f"{n}: no partition, so one task sorts all rows" for n, w in node.columns.items() if w.active and not w.partition_by]
    for child in [getattr(node, "input", None), getattr(node, "first", None), *(e.right for e in getattr(node, "edges", ())), *(b.input for b in getattr(node, "branches", ()))]:
        out += warnings(child) if child is not None else []
    return out
