"""Logical types, their Spark types, and the classes of type drift."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: Logical type to its other names.
ALIASES = {
    "STRING": ("TEXT", "VARCHAR", "CHAR", "NVARCHAR", "NCHAR"),
    "INTEGER": ("INT", "INT32", "SMALLINT"),
    "BIGINT": ("INT64", "LONG", "HUGEINT"),
    "DECIMAL": ("NUMERIC",),
    "FLOAT": ("DOUBLE", "FLOAT64"),
    "BOOLEAN": ("BOOL",),
    "DATE": (),
    "TIME": (),
    "TIMESTAMP": ("DATETIME", "TIMESTAMPTZ"),
    "BINARY": ("BYTES",),
    "UUID": (),
    "JSON": ("STRUCT", "MAP", "ARRAY", "LIST"),
}
CANONICAL = {name: k for k, names in ALIASES.items() for name in (k, *names)}


@dataclass(frozen=True)
class LogicalType:
    name: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None

    @classmethod
    def parse(cls, text: str, strict: bool = True) -> LogicalType:
        """Reads "decimal(12,2)", "varchar(20)", "struct<a:int>" and the like."""
        m = re.match(r"\s*([A-Za-z0-9_]+)\s*(?:[(<]\s*(.*?)\s*[)>])?\s*$", text, re.S)
        name = CANONICAL.get(m[1].upper()) if m else None
        if name is None:
            if strict:
                raise ValueError(f"unknown logical type: {text}")
            return cls(text.strip().upper())
        numbers = [int(x) for x in re.findall(r"\d+", m[2] or "")] if name in ("STRING", "DECIMAL") else []
        if name == "STRING":
            return cls(name, length=numbers[0] if numbers else None)
        if name == "DECIMAL" and numbers:
            return cls(name, precision=numbers[0], scale=numbers[1] if len(numbers) > 1 else 0)
        return cls(name)

    @classmethod
    def of(cls, kind: T.DataType, strict: bool = True) -> LogicalType:
        """The logical type of a Spark type; one that has none, as an interval, is an error, or keeps its name if not strict."""
        if isinstance(kind, T.DecimalType):
            return cls("DECIMAL", precision=kind.precision, scale=kind.scale)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return cls("JSON")
        table = {
            T.StringType: "STRING", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.LongType: "BIGINT",
            T.DoubleType: "FLOAT", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
            T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BINARY",
        }
        if isinstance(kind, (T.VarcharType, T.CharType)):
            return cls("STRING", length=kind.length)
        if isinstance(kind, T.VariantType):
            return cls("JSON")
        if type(kind) not in table:
            return cls.parse(kind.simpleString(), strict)
        return cls(table[type(kind)])

    def spark(self) -> T.DataType:
        if self.name == "DECIMAL":
            return T.DecimalType(self.precision or 38, self.scale or 0)
        return {
            "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(),
            "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "BINARY": T.BinaryType(),
        }.get(self.name, T.StringType())


def drift(actual: LogicalType, desired: LogicalType) -> str:
    """equivalent, widening, narrowing or incompatible, going from actual to desired."""
    a, d = actual, desired
    if a.name != d.name:
        wider = {("INTEGER", "BIGINT"), ("DATE", "TIMESTAMP"), ("DECIMAL", "FLOAT")}
        if (a.name, d.name) in wider:
            return "widening"
        return "narrowing" if (d.name, a.name) in wider - {("DECIMAL", "FLOAT")} else "incompatible"
    if a.name == "STRING" and None not in (a.length, d.length):
        pairs = [(a.length, d.length)]
    elif a.name == "DECIMAL" and None not in (a.precision, d.precision, a.scale, d.scale):
        pairs = [(a.scale, d.scale), (a.precision, d.precision)]
    else:
        pairs = []
    for have, want in pairs:
        if have != want:
            return "widening" if want > have else "narrowing"
    return "equivalent"
