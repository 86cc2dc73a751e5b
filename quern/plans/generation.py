"""Datasets of the raw, stage, core and history layers from declared sources, and the columns of imported tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.keys import key_expression, parse, row_hash
from quern.operators.loads import RunContext
from quern.sources.landing import flat_paths
from quern.sources.readers import normalized
from quern.spec import LAYERS, Column, Dataset, Reference
from quern.types import LogicalType, drift

#: Letters that names spell out.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}

RUN_COLUMNS = (Column("load_run_id", "STRING(64)", "technical", False), Column("loaded_at", "TIMESTAMP", "technical", False))
VERSION_COLUMNS = (
    Column("version_started_at", "TIMESTAMP", "technical", False), Column("version_ended_at", "TIMESTAMP", "technical"),
    Column("version_state", "STRING(20)", "technical", False), *RUN_COLUMNS,
)


@dataclass(frozen=True)
class SourceTable:
    """A table of one system. Tables of one group and name feed one stage.

    identity marks its rows there; otherwise the lowest ordinal wins for each key.
    """

    system: str
    name: str
    columns: tuple[Column, ...]
    group: str | None = None
    identity: str | None = None
    ordinal: int | None = None
    primary: bool = False
    incremental: bool = False
    active: bool = True
    json: bool = False


def target_name(*parts: str) -> str:
    """Parts joined by underscores, umlauts spelled out and other letters beyond ASCII left out."""
    text = "_".join(p for p in parts if p)
    text = re.sub("|".join(SPELLED), lambda m: SPELLED[m[0]], text)
    return normalized(text.encode("ascii", "ignore").decode())


def dataset_name(layer: str, *parts: str) -> str:
    return target_name(LAYERS[layer].prefix, *parts)


def incremental_source(tables: list[SourceTable]) -> SourceTable | None:
    """The table whose filter drives increments: the primary system's, else the first incremental one."""
    found = [t for t in tables if t.incremental]
    return next((t for t in found if t.primary), found[0] if found else None)


def _common(a: Column, b: Column) -> Column:
    """One column for two branches: the wider type, text where neither is wider."""
    kind = drift(a.logical, b.logical)
    wide = b.type if kind == "widening" else a.type if kind in ("narrowing", "equivalent") else "STRING"
    return replace(a, type=wide, nullable=a.nullable or b.nullable, role=a.role if a.role == b.role else "business")


def superset(branches: list[tuple[Column, ...]]) -> tuple[Column, ...]:
    """The columns of all branches by name; what one branch lacks may be null."""
    out: dict[str, Column] = {}
    for i, columns in enumerate(branches):
        names = {c.name for c in columns}
        for c in columns:
            out[c.name] = _common(out[c.name], c) if c.name in out else replace(c, nullable=c.nullable or i > 0)
        out = {n: c if n in names else replace(c, nullable=True) for n, c in out.items()}
    return tuple(out.values())


def _raw(t: SourceTable) -> Dataset:
    business = tuple(replace(c, name=target_name(c.name), source=c.source or c.name) for c in t.columns if c.active)
    payload = (Column("payload", "STRING", "technical"),) if t.json else ()
    return Dataset(dataset_name("raw", t.system, t.name), "raw", (*business, *payload, *RUN_COLUMNS))


def with_keys(dataset: Dataset, pepper: str = "") -> Dataset:
    """The dataset with its surrogate key before and its row hash after its columns."""
    keys = dataset.keys
    if not keys:
        return dataset
    first = Column(f"{dataset.name}_key", "STRING(64)", "surrogate", False, key_expression=key_expression(keys, pepper))
    last = Column("row_hash", "STRING(64)", "technical", False)
    return replace(dataset, columns=(first, *dataset.columns, last))


def history(dataset: Dataset, pepper: str = "") -> Dataset:
    """The history of a core dataset: its columns, nullable; its surrogate key is the key of the entity.

    The key of a version covers that key, the time the version began, and the pepper.
    """
    base = next((c for c in dataset.columns if c.role == "surrogate"), None)
    if base is None:
        raise ValueError(f"{dataset.name} has no surrogate key to follow")
    plain = {"key": "business", "surrogate": "key"}
    kept = [
        replace(c, role=plain.get(c.role, c.role), nullable=True, key_expression=None, expression=None, source=c.name)
        for c in dataset.columns if c.name not in {x.name for x in (*RUN_COLUMNS, *VERSION_COLUMNS)}
    ]
    name = f"{dataset.name}_hist"
    version = Column(f"{name}_key", "STRING(64)", "surrogate", False, key_expression=key_expression([base.name, "version_started_at"], pepper))
    return Dataset(name, dataset.layer, (version, *kept, *VERSION_COLUMNS), (dataset.name,), "historize")


def generate(tables: list[SourceTable], pepper: str = "") -> list[Dataset]:
    """Raw datasets, and for each group of tables of one name a stage, a core dataset and its history.

    Without key columns there is no surrogate key, hence no history.
    """
    groups: dict[tuple[str, str], list[SourceTable]] = {}
    for t in sorted((t for t in tables if t.active), key=lambda t: (t.ordinal is None, t.ordinal or 0, t.system, t.name)):
        groups.setdefault((target_name(t.group or t.system), target_name(t.name)), []).append(t)
    out: list[Dataset] = []
    for (group, name), members in groups.items():
        raws = [_raw(t) for t in members]
        business = superset([tuple(replace(c, source=c.name) for c in r.columns if c.role in ("business", "key")) for r in raws])
        if all(t.identity for t in members):
            business = (Column("source_identity_id", "STRING", "key", False), *business)
        stage = Dataset(dataset_name("stage", group, name), "stage", business, tuple(r.name for r in raws))
        core_columns = tuple(replace(c, source=c.name) for c in business)
        incremental = incremental_source(members) is not None
        core = with_keys(Dataset(dataset_name("rawcore", group, name), "rawcore", core_columns, (stage.name,), "merge" if incremental else "full"), pepper)
        core = replace(core, columns=(*core.columns, *RUN_COLUMNS))
        out += [*raws, stage, core, *([history(core, pepper)] if core.keys else [])]
    names = [d.name for d in out]
    if len(set(names)) < len(names):
        raise ValueError(f"dataset names clash: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return out


def with_reference(child: Dataset, ref: Reference, parent: Dataset) -> Dataset:
    """The child with the foreign key of a reference, once each key column of the parent is mapped.

    A renamed key keeps its old names.
    """
    if set(parent.keys) - set(ref.mapping) or not parent.keys:
        return child
    missing = set(ref.mapping.values()) - {c.name for c in child.columns}
    if missing:
        raise ValueError(f"{child.name} lacks {sorted(missing)}")
    text = next(c.key_expression for c in parent.columns if c.role == "surrogate")
    text = re.sub(r"\{expr:([^}]+)\}", lambda m: "{expr:" + ref.mapping[m[1].strip()] + "}", text)
    link = f"{ref.parent}:{','.join(sorted(ref.mapping.values()))}"
    old = next((c for c in child.columns if c.role == "foreign" and c.lineage_key == link), None)
    former = () if old is None else (*old.former_names, old.name) if old.name != ref.column else old.former_names
    fresh = Column(ref.column, "STRING(64)", "foreign", True, key_expression=text, lineage_key=link, former_names=tuple(dict.fromkeys(former)))
    if old is not None:
        return replace(child, columns=tuple(fresh if c is old else c for c in child.columns))
    if ref.column in {c.name for c in child.columns}:
        raise ValueError(f"{child.name} has a column {ref.column} already")
    return replace(child, columns=(*child.columns, fresh))


def unwrapped(text: str) -> str:
    """An expression without the double braces it may stand in."""
    return re.sub(r"^\s*\{\{(.*)\}\}\s*$", r"\1", text, flags=re.S)


def filled(text: str, alias: str | None = None, names: dict[str, str] | None = None) -> str:
    """A template of SQL text: {alias} becomes the alias, {expr:name} the expression that names has for it."""

    def bound(m: re.Match) -> str:
        if m[1] not in (names or {}):
            raise ValueError(f"nothing is bound to {m[1]} in {text}")
        return names[m[1]]

    text = text.replace("{alias}", alias) if alias else text
    return re.sub(r"\{expr:([A-Za-z0-9_]+)\}", bound, text)


def projected(df: DataFrame, dataset: Dataset, ctx: RunContext, needed: tuple[str, ...] = ()) -> DataFrame:
    """The active columns of a dataset from its input.

    A value comes from the key expression, the run, the row hash, the expression, the source
    column or the column of the same name, whichever comes first. Columns a query derives are
    hidden unless needed. One select, so that the scan reads only what is used.
    """
    hashed = [c.source or c.name for c in dataset.columns if c.active and c.role == "business" and not c.query_derived and c.expression is None]
    run = {"load_run_id": F.lit(ctx.run_id), "loaded_at": F.lit(ctx.ts)}
    there = {c.lower() for c in df.columns}
    out = []
    for c in dataset.columns:
        if not c.active or (c.query_derived and c.name not in needed):
            continue
        if c.key_expression:
            value = parse(c.key_expression, lambda n: F.col(f"`{n}`"))
        elif c.role == "technical" and c.name in run:
            value = run[c.name]
        elif c.role == "technical" and c.name == "row_hash" and "row_hash" not in there:
            value = row_hash(hashed)
        elif c.expression:
            value = F.expr(ctx.fill(unwrapped(c.expression)))
        else:
            name = next((n for n in (c.source, c.name) if n and n.lower() in there), None)
            if name is None:
                raise ValueError(f"{dataset.name}.{c.name}: the input has no such column")
            value = F.col(f"`{name}`")
        out.append(value.cast(c.logical.spark()).alias(c.name))
    rows = df.where(F.expr(ctx.fill(dataset.where))) if dataset.where else df
    rows = rows.select(*out)
    return rows.distinct() if dataset.distinct else rows


# --- imports ---


def type_text(kind: LogicalType) -> str:
    if kind.name == "DECIMAL" and kind.precision is not None:
        return f"DECIMAL({kind.precision},{kind.scale or 0})"
    return f"{kind.name}({kind.length})" if kind.length is not None else kind.name


def columns_of(schema: T.StructType, keys: tuple[str, ...] = ()) -> tuple[Column, ...]:
    """The columns of a schema; keys are never null."""
    wanted = {k.lower() for k in keys}
    missing = wanted - {f.name.lower() for f in schema.fields}
    if missing:
        raise ValueError(f"no such key columns: {sorted(missing)}")
    return tuple(
        Column(f.name, type_text(LogicalType.of(f.dataType)), "key" if f.name.lower() in wanted else "business", f.nullable and f.name.lower() not in wanted)
        for f in schema.fields
    )


def import_table(spark: SparkSession, name: str, keys: tuple[str, ...] = ()) -> tuple[Column, ...]:
    """The columns of a table the catalogue knows, with their comments; no row is read.

    Spark's catalogue holds no keys, so they are named.
    """
    notes = {c.name: c.description for c in spark.catalog.listColumns(name)}
    return tuple(replace(c, comment=notes.get(c.name)) for c in columns_of(spark.table(name).schema, keys))


@dataclass(frozen=True)
class Imported:
    """The columns of a table, its primary key in order, and its links: (parent, child column, parent column)."""

    columns: tuple[Column, ...]
    primary: tuple[str, ...]
    links: tuple[tuple[str, str, str], ...]


def _metadata(rows, *names: str) -> list[tuple]:
    out = []
    while rows.next():
        out.append(tuple(rows.getString(n) for n in names))
    return out


def import_jdbc(spark: SparkSession, url: str, table: str, schema: str | None = None) -> Imported:
    """The columns, primary key, foreign keys and comments of a table of a database, from its driver; no row is read."""
    columns = spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{table}" if schema else table).load().schema
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        about = con.getMetaData()
        primary = [n for _, n in sorted((int(p), n) for n, p in _metadata(about.getPrimaryKeys(None, schema, table), "COLUMN_NAME", "KEY_SEQ"))]
        links = _metadata(about.getImportedKeys(None, schema, table), "PKTABLE_NAME", "FKCOLUMN_NAME", "PKCOLUMN_NAME")
        notes = dict(_metadata(about.getColumns(None, schema, table, "%"), "COLUMN_NAME", "REMARKS"))
    finally:
        con.close()
    found = tuple(replace(c, comment=notes.get(c.name) or None) for c in columns_of(columns, tuple(primary)))
    return Imported(found, tuple(primary), tuple(sorted(links)))


def import_guess(guess: dict[str, dict]) -> tuple[Column, ...]:
    """Columns from the guess over a sample of a file."""
    return tuple(Column(n, g["type"], "key" if g["key"] else "business", g["nullable"] and not g["key"]) for n, g in guess.items())


def import_json(schema: T.StructType, guess: dict[str, dict] | None = None) -> tuple[Column, ...]:
    """Columns of records of a service: structs opened one level, the path as the source."""
    known = guess or {}
    return tuple(Column(n, known.get(n, {}).get("type", "STRING"), source=path) for n, path in flat_paths(schema).items())


def synced(old: tuple[Column, ...], new: tuple[Column, ...]) -> tuple[Column, ...]:
    """Declared columns after another import: types follow it, what was declared by hand stays, what is gone is inactive."""
    fresh = {c.name.lower(): c for c in new}
    out = []
    for c in old:
        n = fresh.pop(c.name.lower(), None)
        out.append(replace(c, active=False) if n is None else replace(c, type=n.type, nullable=n.nullable, source=n.source or c.source, active=True))
    return (*out, *fresh.values())
