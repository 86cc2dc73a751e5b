"""Readers of files, databases and paged services, and the filters they take."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.loads import RunContext
from quern.sources.scratch import scratch_table

#: Answers that are worth another try.
RETRY = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Source:
    """format: csv, json, jsonl, parquet, table, jdbc, rest or excel."""

    format: str
    path: str
    options: dict = field(default_factory=dict)
    where: str | None = None
    increment: str | None = None
    incremental: bool = False
    columns: tuple[str, ...] = ()


def normalized(name: str) -> str:
    """Lower case, with every other character an underscore, at most 100 of them."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", name)).strip("_").lower()[:100]


def with_normal_names(df: DataFrame) -> DataFrame:
    names = [normalized(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash once normalized: {df.columns}")
    return df.toDF(*names)


def _csv(spark: SparkSession, s: Source) -> DataFrame:
    o = {"header": True, "sep": s.options.get("delimiter", ","), "quote": s.options.get("quotechar", '"'), "escape": '"'}
    df = spark.read.options(**o, multiLine=s.options.get("multiline", False), encoding=s.options.get("encoding", "UTF-8").replace("utf-8-sig", "UTF-8")).csv(s.path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def _json(spark: SparkSession, s: Source) -> DataFrame:
    """JSON lines; format json wants arrays of objects, one a file."""
    if s.format == "json":
        heads = spark.read.text(s.path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("head"))
        if heads.where("head != '['").limit(1).count():
            raise ValueError(f"{s.path} does not hold arrays of JSON objects")
    df = spark.read.json(s.path, multiLine=s.format == "json")
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{s.path} does not hold JSON objects")
    return df


BOUNDS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def _jdbc(spark: SparkSession, s: Source) -> DataFrame:
    """The database gets the filters and the column list; see read().

    A whole table comes over one connection, in one task, unless the options give bounds for parts of it
    or ask for that with single.
    """
    options = dict(s.options)
    if not options.pop("single", False) and any(o not in options for o in BOUNDS):
        raise ValueError(f"{s.path}: give {', '.join(BOUNDS)}, or single=True for a table that one task can read")
    return spark.read.format("jdbc").option("dbtable", s.path).options(**options).load()


#: Where a workbook keeps its parts.
_SHEET, _LINK, _ID = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/package/2006/relationships}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_EXCEL = 10_000_000


def _excel(spark: SparkSession, s: Source) -> DataFrame:
    """A sheet of a workbook as text columns, read on the driver: a file may have MOST_EXCEL bytes.

    options: sheet_name or sheet_index (from 0), not both; header_row (from 1); max_rows. A cell without a
    name above it is col_1, col_2, ... by its place.
    """
    o = s.options
    if o.get("sheet_name") is not None and o.get("sheet_index") is not None:
        raise ValueError("a sheet has a name or an index, not both")
    if o.get("header_row", 1) < 1:
        raise ValueError("header_row counts from 1")
    files = spark.read.format("binaryFile").load(s.path)
    large = files.where(F.col("length") > MOST_EXCEL).select("path").limit(1).collect()
    if large:
        raise ValueError(f"{large[0]['path']} has more than {MOST_EXCEL} bytes")
    found = files.select("content").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{s.path} is not one workbook")
    cells = list(_cells(bytes(found[0]["content"]), o.get("sheet_name"), o.get("sheet_index") or 0))
    at = o.get("header_row", 1) - 1
    head = cells[at] if len(cells) > at else []
    width = max(map(len, cells[at:]), default=0)
    names = [(head[i] or "").strip() or f"col_{i + 1}" if i < len(head) else f"col_{i + 1}" for i in range(width)]
    rows = [tuple(r[i] if i < len(r) else None for i in range(width)) for r in cells[at + 1 :] if any(x is not None for x in r)]
    rows = rows[: o["max_rows"]] if o.get("max_rows") is not None else rows
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) if names else "col_1 string")


def _cells(content: bytes, name: str | None, index: int) -> Iterator[list[str | None]]:
    """The rows of a sheet, each a list of texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        there = set(z.namelist())
        sheets = [(x.get("name"), x.get(_ID)) for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        chosen = [link for n, link in sheets if n == name] if name is not None else [link for _, link in sheets[index : index + 1]]
        if index < 0 or not chosen:
            raise ValueError(f"no sheet {name if name is not None else index}; there are {[n for n, _ in sheets]}")
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_LINK}Relationship")}
        texts = []
        if "xl/sharedStrings.xml" in there:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
                texts.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        target = links[chosen[0]].lstrip("/")
        sheet = ElementTree.fromstring(z.read(target if target in there else f"xl/{target}"))
    last = 0
    for row in sheet.iter(f"{_SHEET}row"):
        number = int(row.get("r", last + 1))
        yield from ([] for _ in range(number - last - 1))
        last, out = number, []
        for c in row.iter(f"{_SHEET}c"):
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            place = len(out)
            if letters:
                place = 0
                for x in letters:
                    place = place * 26 + ord(x) - 64
                place -= 1
            out += [None] * (place - len(out))
            value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
            text = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else value.text if value is not None else None
            if c.get("t") == "s" and text is not None:
                text = texts[int(text)]
            out.append({"1": "true", "0": "false"}.get(text, text) if c.get("t") == "b" else text)
        yield out


READERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "csv": _csv,
    "json": _json,
    "jsonl": _json,
    "ndjson": _json,
    "parquet": lambda spark, s: spark.read.parquet(s.path),
    "table": lambda spark, s: spark.table(s.path),
    "jdbc": _jdbc,
    "excel": _excel,
}


def read(spark: SparkSession, source: Source, ctx: RunContext | None = None, cutoff: datetime | None = None) -> DataFrame:
    """The rows of a source that its filters keep; they reach the scan or the database."""
    if source.format not in READERS:
        raise ValueError(f"no reader for {source.format}")
    df = READERS[source.format](spark, source)
    texts = [source.where] + ([source.increment] if source.incremental else [])
    for text in filter(None, texts):
        df = df.where(F.expr((ctx or RunContext("", datetime.min)).fill(text, cutoff)))
    return df.select(*source.columns) if source.columns else df


def cutoff(now: datetime, amount: int, unit: str) -> datetime:
    """now less a number of days, months or years."""
    if unit == "day":
        return now - timedelta(days=amount)
    months = amount * {"month": 1, "year": 12}[unit]
    year, month = divmod(now.year * 12 + now.month - 1 - months, 12)
    last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day if month < 11 else 31
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


@dataclass(frozen=True)
class IncrementPolicy:
    """How far an environment's increments look back. unit: day, month or year."""

    environment: str
    amount: int
    unit: str
    active: bool = True


def cutoff_of(source: Source, policies: list[IncrementPolicy], environment: str, now: datetime) -> datetime | None:
    """The cutoff of a source in an environment, by the last active policy there is for it; None without an increment or a policy."""
    found = [p for p in policies if p.active and p.environment == environment]
    if not (source.increment or "").strip() or not found or found[-1].amount <= 0 or found[-1].unit not in ("day", "month", "year"):
        return None
    return cutoff(now, found[-1].amount, found[-1].unit)


def lands(integrate: bool, own: bool | None, system: bool) -> bool:
    """Whether a source gets a raw table: its own word counts, else its system's; without integration none does."""
    return integrate is True and (system if own is None else own)


def ingest_mode(integrate: bool, own: bool | None, system: bool, mode: str) -> str:
    """none, external or native: who brings the rows of a source to its raw table."""
    if mode not in ("none", "external", "native"):
        raise ValueError(f"no such way of ingestion: {mode}")
    if not lands(integrate, own, system):
        return "none"
    if mode == "none":
        raise ValueError("a raw table is wanted, but nothing ingests it")
    return mode


def records(payload, path: str | None = None) -> list[dict]:
    """The objects at a dotted path of a page; one object is a list of one."""
    for step in filter(None, (path or "").split(".")):
        payload = payload.get(step) if isinstance(payload, dict) else None
    found = [payload] if isinstance(payload, dict) else payload if isinstance(payload, list) else []
    return [x for x in found if isinstance(x, dict)]


def fetched(get: Callable[[], tuple[int, object]], attempts: int = 3, wait: float = 2.0, sleep=time.sleep):
    """The body of an answer; some errors are tried again after a wait that grows."""
    for i in range(1, attempts + 1):
        status, body = get()
        if status < 400:
            return body
        if status not in RETRY or i == attempts:
            raise RuntimeError(f"status {status} after {i} attempts")
        sleep(wait * i)


class TooManyPages(RuntimeError):
    """A service has more pages than are allowed; what was read is kept nowhere."""


def pages(
    spark: SparkSession, fetch: Callable[[object], tuple[int, dict]], record_path: str | None, cursor: str = "page_token", next_key: str = "next", size: int = 100, most: int = 10_000,
    start: object = None, most_empty: int = 3, save: Callable[[object], None] | None = None, rows_each: int = 10_000, sleep=time.sleep,
) -> DataFrame:
    """Pages of a service as text rows (page, payload), by token or by offset, from start on.

    A page is one request after the other, so the driver reads them, but it keeps rows_each of them at most
    and writes the rest to the scratch folder. More than most pages are an error; more than
    most_empty empty ones in a row end the reading. save gets the cursor behind the last page, once all is written.
    """
    if cursor not in ("page_token", "offset"):
        raise ValueError(f"no such cursor: {cursor}")
    table = scratch_table(spark, "page int, payload string", "pages")
    rows, at, n, empty = [], (0 if start is None else start) if cursor == "offset" else start, 0, 0
    while True:
        if n == most:
            raise TooManyPages(f"more than {most} pages")
        body = fetched(lambda a=at: fetch(a), sleep=sleep)
        found = records(body, record_path)
        rows += [(n, json.dumps(x, sort_keys=True)) for x in found]
        n, empty = n + 1, 0 if found else empty + 1
        if len(rows) >= rows_each:
            table.add(rows)
            rows = []
        if cursor == "page_token":
            at = body.get(next_key) if isinstance(body, dict) else None
            more = bool(at)
        else:
            at, more = at + len(found), len(found) >= size
        if not more or empty > most_empty:
            break
    table.add(rows)
    if save is not None:
        save(at)
    return table.read()


@dataclass(frozen=True)
class BatchRules:
    """What a batch of records must hold. strict makes missing keys, drift of keys and empty pages errors."""

    required: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None
    signatures: int = 3
    empty_pages: int = 3
    strict: bool = False


def check_pages(df: DataFrame, rules: BatchRules, pages_read: int | None = None) -> list[str]:
    """What is wrong with rows (page, payload): keys that some rows lack, more sets of keys by page than allowed, runs
    of empty pages, counts of rows. One aggregation by page, then one over pages; a wrong count is an error, and so is all else if strict.
    """
    names = F.json_object_keys("payload")
    lacks = [F.count_if(~F.coalesce(F.array_contains("keys", k), F.lit(False))).alias(f"no_{i}") for i, k in enumerate(rules.required)]
    by_page = df.withColumn("keys", names).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.flatten(F.collect_set("keys"))).alias("keys"), *lacks)
    by_page = by_page.withColumn("signature", F.xxhash64(F.array_distinct("keys")))
    total = by_page.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("signature").alias("signatures"), F.count(F.lit(1)).alias("pages"), *[F.sum(f"no_{i}").alias(f"no_{i}") for i in range(len(lacks))]).first()
    out = [f"{k}: {total[f'no_{i}']} rows without it" for i, k in enumerate(rules.required) if total[f"no_{i}"]]
    if total["signatures"] > rules.signatures:
        out.append(f"{total['signatures']} sets of keys, more than {rules.signatures}")
    if pages_read is not None and pages_read - total["pages"] > rules.empty_pages:
        out.append(f"{pages_read - total['pages']} empty pages, more than {rules.empty_pages}")
    if rules.strict and out:
        raise ValueError("; ".join(out))
    if (rules.least is not None and total["n"] < rules.least) or (rules.most is not None and total["n"] > rules.most):
        raise ValueError(f"{total['n']} rows, not {rules.least} to {rules.most}")
    return out


def check_batch(df: DataFrame, required: tuple[str, ...] = (), least: int = 0, most: int | None = None) -> list[str]:
    """What is wrong with a batch: row count, and required values that are missing."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{i}") for i, c in enumerate(required)]).first()
    out = [f"{c}: {counts[f'no_{i}']} rows without it" for i, c in enumerate(required) if counts[f"no_{i}"]]
    if counts["n"] < least or (most is not None and counts["n"] > most):
        out.append(f"{counts['n']} rows")
    return out
