"""Surrogate keys, foreign keys, row hashes, and the small language they are written in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.spec import JOINER, NULL_TOKEN, PAIR

_TOKEN = re.compile(r"""\s*(?:(\{expr:[^}]+\})|('(?:[^']|'')*'|"(?:[^"]|"")*")|([A-Za-z_][A-Za-z0-9_]*)|([(),]))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"cannot read key expression at: {text[pos:]!r}")
        kind = ("ref", "text", "name", "mark")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        pos = m.end()
    return out


def parse(text: str, resolve: Callable[[str], Column] = F.col) -> Column:
    """The Column of a key expression; resolve gives the Column of a name."""
    text = re.sub(
        r"(?i)\bcol\s*\(([^()]*)\)", lambda m: "{expr:" + m[1].strip().strip("\"'`[]") + "}", text
    )
    stream = tokens(text)
    column, rest = _expression(stream, resolve)
    if rest:
        raise ValueError(f"unexpected {rest[0][1]!r} in key expression")
    return column


def _expression(stream: list[tuple[str, str]], resolve) -> tuple[Column, list]:
    if not stream:
        raise ValueError("key expression ends early")
    (kind, value), rest = stream[0], stream[1:]
    if kind == "ref":
        return resolve(value[6:-1].strip()), rest
    if kind == "text":
        return F.lit(value[1:-1].replace(value[0] * 2, value[0])), rest
    if kind != "name" or not rest or rest[0] != ("mark", "("):
        raise ValueError(f"unexpected {value!r} in key expression")
    args, rest = [], rest[1:]
    while rest and rest[0] != ("mark", ")"):
        arg, rest = _expression(rest, resolve)
        args.append(arg)
        if rest and rest[0] == ("mark", ","):
            rest = rest[1:]
        elif not rest or rest[0] != ("mark", ")"):
            raise ValueError("a comma or a closing bracket is missing")
    if not rest:
        raise ValueError("a closing bracket is missing")
    return _call(value.upper(), args), rest[1:]


def _call(name: str, args: list[Column]) -> Column:
    if name == "HASH256" and len(args) == 1:
        return F.sha2(args[0].cast("string"), 256)
    if name == "CONCAT" and args:
        return F.concat(*[a.cast("string") for a in args])
    if name == "COALESCE" and len(args) == 2:
        return F.coalesce(args[0].cast("string"), args[1])
    if name == "CONCAT_WS" and len(args) > 1:
        # the separator may be any expression, so null parts are left out by hand
        parts = F.filter(F.array(*[a.cast("string") for a in args[1:]]), lambda x: x.isNotNull())
        join = lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, args[0], x))
        return F.aggregate(parts, F.lit(None).cast("string"), join, lambda acc: F.coalesce(acc, F.lit("")))
    raise ValueError(f"{name} with {len(args)} arguments is no key function")


def key_expression(names: Iterable[str], pepper: str = "", null_token: str = NULL_TOKEN) -> str:
    """The text of a surrogate key over names; their order does not matter."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"CONCAT({quoted(n)}, {quoted(PAIR)}, COALESCE({{expr:{n}}}, {quoted(null_token)}))" for n in sorted(names)]
    return f"HASH256(CONCAT_WS({', '.join([quoted(JOINER), *parts, *([quoted(pepper)] if pepper else [])])}))"


def sk(values: dict[str, Column] | Iterable[str], pepper: str = "", null_token: str = NULL_TOKEN) -> Column:
    """Surrogate key: sha-256 of name~value pairs, by name, and the pepper, joined by |."""
    values = values if isinstance(values, dict) else {n: F.col(n) for n in values}
    pairs = [F.concat(F.lit(n + PAIR), F.coalesce(values[n].cast("string"), F.lit(null_token))) for n in sorted(values)]
    return F.sha2(F.concat_ws(JOINER, *pairs, *([F.lit(pepper)] if pepper else [])), 256)


def fk(mapping: dict[str, str], pepper: str = "", null_token: str = NULL_TOKEN) -> Column:
    """The parent's key with each component's value taken from the child's column."""
    return sk({parent: F.col(child) for parent, child in mapping.items()}, pepper, null_token)


def row_hash(names: Iterable[str], null_token: str = NULL_TOKEN) -> Column:
    """sha-256 of the values in the order given; no names and no pepper."""
    values = [F.coalesce(F.col(n).cast("string"), F.lit(null_token)) for n in names]
    return F.sha2(F.concat_ws(JOINER, *values) if values else F.lit("no_columns"), 256)
