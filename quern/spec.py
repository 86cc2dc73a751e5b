"""Declarations: layers, datasets, columns, joins, references and source branches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from quern.types import LogicalType

#: Fixed values of the key policy.
NULL_TOKEN, PAIR, JOINER = "null_replaced", "~", "|"


@dataclass(frozen=True)
class Layer:
    name: str
    prefix: str
    materialization: str = "table"
    historize: bool = False
    mode: str = "full"
    surrogate_keys: bool = False


#: The default layers.
LAYERS = {
    "raw": Layer("raw", "raw"),
    "stage": Layer("stage", "stg", "view"),
    "rawcore": Layer("rawcore", "rc", "table", True, "merge", True),
    "bizcore": Layer("bizcore", "bc", "table", True, "full", True),
    "serving": Layer("serving", "", "view"),
}


@dataclass(frozen=True)
class Column:
    """role: business, key, surrogate, foreign, technical. Exactly one expression, at most, says where the value comes from."""

    name: str
    type: str = "STRING"
    role: str = "business"
    nullable: bool = True
    expression: str | None = None
    key_expression: str | None = None
    source: str | None = None
    lineage_key: str | None = None
    former_names: tuple[str, ...] = ()
    active: bool = True
    query_derived: bool = False
    comment: str | None = None

    @property
    def logical(self) -> LogicalType:
        return LogicalType.parse(self.type)


@dataclass(frozen=True)
class Dataset:
    name: str
    layer: str
    columns: tuple[Column, ...] = ()
    inputs: tuple[str, ...] = ()
    mode: str | None = None
    materialization: str | None = None
    where: str | None = None
    distinct: bool = False
    detect_deletes: bool = False
    scope: str | None = None
    former_names: tuple[str, ...] = ()
    #: Partitions of the table by hash of its keys; with some, a load rewrites those only that it changes.
    buckets: int = 0

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "key"]

    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.logical.spark(), c.nullable, {"logical": c.type, "role": c.role}) for c in self.columns if c.active]
        )


@dataclass(frozen=True)
class Reference:
    """A dataset's link to its parent: parent key component to child column."""

    child: str
    parent: str
    mapping: dict[str, str] = field(default_factory=dict)
    prefix: str = ""

    @property
    def column(self) -> str:
        return f"{self.prefix}_{self.parent}_key" if self.prefix else f"{self.parent}_key"
