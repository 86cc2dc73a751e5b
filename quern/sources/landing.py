"""Landing of JSON records, and the guess of columns from samples."""

from __future__ import annotations

import json
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.loads import RunContext
from quern.sources.readers import normalized
from quern.types import LogicalType

PATH = re.compile(r"\$(?:\.[A-Za-z_][\w-]*|\[\d+\])*$")


def json_path(payload: Column, path: str) -> Column:
    """The value at $.a.b or $.a[0].b as text; what is missing is null."""
    if not PATH.match(path):
        raise ValueError(f"not a path: {path}")
    return F.get_json_object(payload, path)


def landed(df: DataFrame, columns: dict[str, tuple[str, str]], ctx: RunContext, payload: str = "payload", strict: bool = False) -> DataFrame:
    """Business columns by (path, logical type), the payload, the run and its time.

    Values that do not fit their type are null, or errors if strict.
    """
    out = []
    for name, (path, kind) in columns.items():
        value, to = json_path(F.col(payload), path), LogicalType.parse(kind).spark()
        out.append((value.cast(to) if strict else value.try_cast(to)).alias(name))
    return df.select(*out, F.col(payload).alias("payload"), F.lit(ctx.run_id).alias("load_run_id"), F.lit(ctx.ts).alias("loaded_at"))


def as_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows as JSON objects that keep the original column names."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(payload))


def flat_paths(schema: T.StructType) -> dict[str, str]:
    """Normalized name to JSON path, structs opened one level."""
    out = {}
    for f in schema.fields:
        inner = f.dataType.fields if isinstance(f.dataType, T.StructType) else ()
        for path in [f"{f.name}.{x.name}" for x in inner] or [f.name]:
            out[normalized(path)] = f"$.{path}"
    return out


#: Each kind absorbs those before it.
ORDER = ("BOOLEAN", "INTEGER", "BIGINT", "DECIMAL", "FLOAT", "DATE", "TIMESTAMP", "STRING", "JSON")


def kind_of(value) -> str | None:
    """The logical type of one sampled value; None for nulls and empty text."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "INTEGER" if -(1 << 31) <= value < 1 << 31 else "BIGINT"
    if isinstance(value, float):
        return "FLOAT"
    if isinstance(value, (dict, list, tuple)):
        return "JSON"
    if isinstance(value, datetime):
        return "TIMESTAMP"
    if isinstance(value, date):
        return "DATE"
    text = str(value).strip()
    if re.fullmatch(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?", text):
        return "TIMESTAMP"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        return "DATE"
    if re.fullmatch(r"[+-]?\d{1,18}", text):
        return kind_of(int(text))
    if re.fullmatch(r"[+-]?\d+\.\d+", text):
        return "DECIMAL"
    return "BOOLEAN" if text.lower() in ("true", "false") else "STRING"


def promoted(kinds: list[str]) -> str:
    return max(kinds, key=ORDER.index) if kinds else "STRING"


def guessed(rows: list[dict]) -> dict[str, dict]:
    """For each column of sampled rows its type, whether it may be null, and whether it looks like a key."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    out = {}
    for name in names:
        values = [r[name] for r in rows if r.get(name) not in (None, "")]
        distinct = len({json.dumps(v, sort_keys=True, default=str) for v in values})
        keyed = bool(re.search(r"(^|_)(id|uuid|key)$", normalized(name)))
        out[normalized(name)] = {
            "type": promoted([k for v in values if (k := kind_of(v))]),
            "nullable": len(values) < len(rows),
            "key": keyed and bool(rows) and len(values) >= 0.95 * len(rows) and distinct >= 0.99 * max(1, len(values)),
        }
    return out


def guess(df: DataFrame, sample: int = 1000) -> dict[str, dict]:
    """guessed() over at most sample rows."""
    return guessed([r.asDict(recursive=True) for r in df.limit(sample).collect()])
