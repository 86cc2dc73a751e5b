"""Schema state, its changes, what they ask for, and what policy allows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.spec import Column, Dataset
from quern.types import LogicalType, drift


def state(datasets: list[Dataset]) -> dict:
    return {d.name: asdict(d) for d in sorted(datasets, key=lambda d: d.name)}


def fingerprint(value) -> str:
    """sha-256 of the value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Change:
    """kind: add, drop, rename or change, of a dataset or a column."""

    kind: str
    dataset: str
    column: str | None = None
    before: str | None = None
    after: str | None = None
    drift: str | None = None


def matched_columns(old: tuple[Column, ...], new: tuple[Column, ...]) -> dict[str, str]:
    """New column name to old: by lineage key, by name, by a former name that one old column has."""
    left = {c.name: c for c in old}
    out: dict[str, str] = {}
    for rule in ("lineage", "name", "former"):
        for c in new:
            if c.name in out:
                continue
            if rule == "lineage":
                found = [n for n, o in left.items() if c.lineage_key and o.lineage_key == c.lineage_key]
            else:
                found = [n for n in left if n == c.name] if rule == "name" else [n for n in left if n in c.former_names]
            if len(found) == 1:
                out[c.name] = found[0]
                del left[found[0]]
    return out


#: What of a dataset, beside its columns, decides what its table holds.
SHAPE = ("mode", "materialization", "where", "distinct", "detect_deletes", "scope")


def diff(old: list[Dataset], new: list[Dataset]) -> list[Change]:
    before, out = {d.name: d for d in old}, []
    for d in sorted(new, key=lambda d: d.name):
        was = before.pop(d.name, None)
        if was is None:
            former = [n for n in d.former_names if n in before and before[n].layer == d.layer]
            if len(former) != 1:
                out.append(Change("add", d.name))
                continue
            was = before.pop(former[0])
            out.append(Change("rename", d.name, before=was.name, after=d.name))
        shape = [{f: getattr(x, f) for f in SHAPE if getattr(x, f)} for x in (was, d)]
        if shape[0] != shape[1]:
            out.append(Change("change", d.name, before=json.dumps(shape[0]), after=json.dumps(shape[1])))
        pairs = matched_columns(was.columns, d.columns)
        old_columns = {c.name: c for c in was.columns}
        for c in d.columns:
            o = old_columns.get(pairs.get(c.name, ""))
            if o is None:
                out.append(Change("add", d.name, c.name, after=c.type))
                continue
            if o.name != c.name:
                out.append(Change("rename", d.name, c.name, o.name, c.name))
            kind = drift(o.logical, c.logical)
            if kind != "equivalent":
                out.append(Change("change", d.name, c.name, o.type, c.type, kind))
            elif o.nullable != c.nullable:
                out.append(Change("change", d.name, c.name, *(("null" if x.nullable else "not null") for x in (o, c)), "nullability"))
            if o.active != c.active:
                out.append(Change("unretire" if c.active else "retire", d.name, c.name))
        out += [Change("drop", d.name, n) for n in old_columns if n not in pairs.values()]
    return out + [Change("drop", n) for n in before]


def decide(change: Change, allow_drop: bool = False, allow_history_drop: bool = False) -> str:
    """ALLOW, BLOCKED_BY_POLICY, REQUIRES_PREFLIGHT or METADATA_ONLY.

    What the preflight of a change finds is up to reconcile() and migrate(), which refuse lossy
    changes unless they are allowed.
    """
    if change.kind in ("retire", "unretire"):
        return "METADATA_ONLY"
    if change.kind == "drop" and change.column is None:
        return "BLOCKED_BY_POLICY"
    if change.kind == "drop":
        history = change.dataset.endswith("_hist")
        return "ALLOW" if allow_drop and (allow_history_drop or not history) else "BLOCKED_BY_POLICY"
    return "REQUIRES_PREFLIGHT" if change.kind == "change" else "ALLOW"


def _declared(df: DataFrame, name: str, dataset: Dataset) -> LogicalType:
    """The type of a table's column: Spark's, with the length that the dataset declares for text."""
    have = LogicalType.of(df.schema[name].dataType)
    said = next((c.logical for c in dataset.columns if c.name == name), have)
    return said if have.name == "STRING" and said.name == "STRING" else have


def migrate(df: DataFrame, old: Dataset, new: Dataset, allow_lossy: bool = False, allow_drop: bool = False) -> DataFrame:
    """A table of the old shape in the new one: renamed, cast, with new columns null; one select, no shuffle."""
    pairs = matched_columns(old.columns, new.columns)
    there = set(df.columns)
    out = []
    for c in new.columns:
        source = pairs.get(c.name)
        kind = c.logical.spark()
        if source is None or source not in there:
            out.append(F.lit(None).cast(kind).alias(c.name))
            continue
        class_ = drift(_declared(df, source, old), c.logical)
        if class_ in ("narrowing", "incompatible") and not allow_lossy:
            raise ValueError(f"{c.name}: {class_} change is not allowed")
        value = F.col(f"`{source}`")
        value = value.try_cast(kind) if allow_lossy else value.cast(kind)
        if c.logical.name == "STRING" and c.logical.length is not None:
            # a table's text may be longer than its declaration, which a rebuild enforces
            value = F.substring(value, 1, c.logical.length) if allow_lossy else value
        out.append(value.alias(c.name))
    kept = [] if allow_drop else [c for c in df.columns if c not in pairs.values() and c not in {x.name for x in new.columns}]
    return df.select(*out, *[F.col(f"`{c}`") for c in kept])


def renamed(dataset: Dataset, old: str, new: str) -> Dataset:
    """The dataset with a column renamed and its old name kept among the former ones."""
    names = {c.name.lower() for c in dataset.columns}
    if old.lower() not in names or new.lower() in names:
        raise ValueError(f"cannot rename {old} to {new}")
    change = lambda c: replace(c, name=new, former_names=_former(c.former_names, c.name, new)) if c.name.lower() == old.lower() else c
    return replace(dataset, columns=tuple(map(change, dataset.columns)))


def _former(names: tuple[str, ...], old: str, new: str) -> tuple[str, ...]:
    return tuple(x for x in dict.fromkeys((*names, old)) if x.lower() != new.lower())


def renamed_dataset(datasets: list[Dataset], old: str, new: str) -> list[Dataset]:
    """All datasets with one renamed: its old name kept, its history renamed along, and both where they are inputs.

    A name that a dataset has, or had as another one's former name, is taken.
    """
    by_name = {d.name.lower(): d for d in datasets}
    if old.lower() not in by_name:
        raise ValueError(f"no dataset {old}")
    pairs = {old: new} | ({f"{old}_hist": f"{new}_hist"} if f"{old}_hist".lower() in by_name else {})
    for was, name in pairs.items():
        takers = [d.name for d in datasets if d.name not in pairs and name.lower() in {x.lower() for x in (d.name, *d.former_names)}]
        if takers or not name.strip():
            raise ValueError(f"cannot rename {was} to {name}: {', '.join(takers) or 'no name'}")
    out = []
    for d in datasets:
        if d.name in pairs:
            d = replace(d, name=pairs[d.name], former_names=_former(d.former_names, d.name, pairs[d.name]))
        out.append(replace(d, inputs=tuple(pairs.get(i, i) for i in d.inputs)))
    return out


def contract_diff(before: list[str], after: list[str]) -> dict[str, list[str]]:
    return {
        "added": [c for c in after if c not in before],
        "removed": [c for c in before if c not in after],
        "unchanged": [c for c in after if c in before],
    }
