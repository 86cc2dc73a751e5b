"""Registered queries of the readers: tables are written in a format, read back through its reader, and compared with the table."""

from __future__ import annotations

import io
import shutil
import zipfile
from datetime import datetime
from pathlib import Path
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.governance import runs
from quern.operators.loads import RunContext
from quern.plans import generation
from quern.plans.catalog import declared, outcome, query, table_name
from quern.sources import landing, readers
from quern.sources.readers import BatchRules, IncrementPolicy, Source
from quern.sources.scratch import scratch_path

NOW = datetime(1998, 3, 31, 12)
CTX = RunContext("r1", NOW)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file where Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(bytearray(content))
    out.close()


@query("read_csv", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || '; "' || c_mktsegment || '"' AS note, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer""")
def _(t):
    path = scratch_path(t.spark, "csv")
    note = F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('"'))
    t["customer"].select("c_custkey", note.alias("note"), "c_acctbal").write.csv(path, header=True, sep=";", quote='"', escape='"')
    return readers.read(t.spark, Source("csv", path, {"delimiter": ";"}))


@query("read_json_array", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "json")
    rows = t["supplier"].withColumn("part", F.col("s_suppkey") % 8)
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return readers.read(t.spark, Source("json", path, columns=("s_suppkey", "s_name", "s_acctbal")))


@query("read_jsonl", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "jsonl")
    t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return readers.read(t.spark, Source("ndjson", path))


_FILTERED = Source("parquet", "", where="o_orderstatus = 'F'", increment="o_orderdate >= {{DELTA_CUTOFF}}", incremental=True, columns=("o_orderkey", "o_orderdate"))
_POLICIES = [IncrementPolicy("dev", 9, "day", False), IncrementPolicy("prod", 1, "day"), IncrementPolicy("dev", 37, "month")]


@query("read_parquet_increment", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-02-28 12:00:00'")
def _(t):
    source = Source(**{**vars(_FILTERED), "path": f"{t.sf_dir}/orders.parquet"})
    return readers.read(t.spark, source, CTX, readers.cutoff_of(source, _POLICIES, "dev", NOW))


@query("read_parquet_whole", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return readers.read(t.spark, Source(**{**vars(_FILTERED), "path": f"{t.sf_dir}/orders.parquet", "incremental": False}), CTX)


@query("read_view", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    t["customer"].createOrReplaceTempView("q_read_view")
    return readers.read(t.spark, Source("table", "q_read_view", where="c_mktsegment = 'BUILDING'", columns=("c_custkey", "c_name")))


def database(spark: SparkSession) -> str:
    """A database in memory, of the driver that comes with Spark; each JVM has its own, so executors do not see this one."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return "jdbc:derby:memory:quern;create=true"


def shared_database(df: DataFrame, table: str) -> str:
    """A database with a table of these rows, which the driver and all executors can read.

    One JVM alone can write to a Derby database: executors write the rows as text, the driver imports them file
    by file. Packed as a JAR, uncompressed for reads at any place, it is read-only and opens in every JVM.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "database")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() != "file":
        raise ValueError(f"{path}: the database needs a mounted folder")
    database(spark)
    folder = Path(at.toUri().getPath())
    url, manager = f"jdbc:derby:{folder}/quern", spark._jvm.java.sql.DriverManager
    # quoted, "" is an empty text; without quotes, it is null
    fields = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(",", *fields).alias("value")).write.text(f"{path}/rows")
    df.limit(0).write.format("jdbc").options(url=f"{url};create=true", dbtable=table).save()  # no rows, no task: the driver alone connects
    con = manager.getConnection(url)
    try:
        load = con.prepareCall("call syscs_util.syscs_import_table(null, ?, ?, ',', '\"', 'UTF-8', 0)")
        for part in sorted((folder / "rows").glob("part-*")):
            load.setString(1, table.upper())
            load.setString(2, str(part))
            load.execute()
    finally:
        con.close()
        try:
            manager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # that it is shut down
                raise
    with zipfile.ZipFile(folder / "quern.jar", "w") as z:
        for x in (folder / "quern").rglob("*"):
            z.write(x, x.relative_to(folder))
    for x in ("rows", "quern"):
        shutil.rmtree(folder / x)
    return f"jdbc:derby:jar:({folder}/quern.jar)quern"


@query("read_jdbc_parts", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey < 20")
def _(t):
    url = shared_database(t["supplier"].select("s_suppkey", "s_name", "s_nationkey"), "supplier")
    bounds = {"partitionColumn": "s_suppkey", "lowerBound": "1", "upperBound": "1000", "numPartitions": "4"}
    return readers.read(t.spark, Source("jdbc", "supplier", {"url": url, **bounds}, where="s_nationkey < 20"))


@declared(
    "import_jdbc",
    "name string, type string, role string, parent string",
    [("BRANCH", "INTEGER", "key", "REGION"), ("ID", "BIGINT", "key", None), ("NOTE", "STRING", "business", None), ("primary", "ID, BRANCH", None, None)],
)
def _(t):
    url = database(t.spark)
    con = t.spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        run = con.createStatement()
        if not con.getMetaData().getTables(None, "APP", "LINKED", None).next():
            run.execute("create table region (region_id int primary key)")
            run.execute("create table linked (id bigint not null, branch int not null references region(region_id), note varchar(20), primary key (id, branch))")
    finally:
        con.close()
    found = generation.import_jdbc(t.spark, url, "LINKED", "APP")
    parents = {child: parent for parent, child, _ in found.links}
    out = [(c.name, c.type.split("(")[0], c.role, parents.get(c.name)) for c in sorted(found.columns, key=lambda c: c.name)]
    return [*out, ("primary", ", ".join(found.primary), None, None)]


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small workbook: texts among the shared ones, numbers in place, and cells that are left out."""
    shared: list[str] = []
    out = io.BytesIO()
    spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        for i, rows in enumerate(sheets.values(), 1):
            text = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    at = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        shared.append(v)
                        cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
                    else:
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                text.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {spaces}><sheetData>{''.join(text)}</sheetData></worksheet>")
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/workbook.xml", f"<workbook {spaces}><sheets>{named}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {spaces}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>")
    return out.getvalue()


@query("read_excel", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS VARCHAR) AS col_3 FROM nation")
def _(t):
    path = scratch_path(t.spark, "excel") + ".xlsx"
    rows = [[r.n_nationkey, r.n_name, None if r.n_regionkey == 2 else r.n_regionkey] for r in t["nation"].orderBy("n_nationkey").collect()]
    put(t.spark, path, workbook({"other": [["x"], [1]], "nations": [["a title"], ["key", "name"], *rows]}))
    return readers.read(t.spark, Source("excel", path, {"sheet_name": "nations", "header_row": 2}))


# --- services ---


class Service:
    """Rows of a table as JSON pages, by token or by offset; every third answer is an error that passes."""

    def __init__(self, rows: list[dict], size: int):
        self.rows, self.size, self.asked = rows, size, 0

    def page(self, at: int) -> list[dict]:
        return self.rows[at : at + self.size]

    def by_token(self, token) -> tuple[int, dict]:
        self.asked += 1
        if self.asked % 3 == 0:
            return 503, {}
        at = int(token or 0)
        return 200, {"data": {"items": self.page(at)}, "next": str(at + self.size) if at + self.size < len(self.rows) else None}

    def by_offset(self, at) -> tuple[int, list]:
        return 200, self.page(at)


def _nations(t) -> list[dict]:
    return [r.asDict() for r in t["nation"].orderBy("n_nationkey").collect()]


@query("rest_pages", "SELECT CAST(n_nationkey // 4 AS INTEGER) AS page, n_nationkey, n_name FROM nation")
def _(t):
    rows = readers.pages(t.spark, Service(_nations(t), 4).by_token, "data.items", rows_each=7, sleep=lambda _: None)
    parsed = F.from_json("payload", "n_nationkey int, n_name string")
    return rows.select("page", parsed.alias("x")).select("page", "x.n_nationkey", "x.n_name")


@query("rest_cursor_kept", "SELECT CASE WHEN n_nationkey < 12 THEN 1 ELSE 2 END AS run, n_nationkey FROM nation")
def _(t):
    """The second run begins where the first one, which saw half of the rows, ended."""
    name, rows, out = table_name("batches"), _nations(t), None
    try:
        for run, seen in ((1, rows[:12]), (2, rows)):
            last = runs.last_snapshot(t.spark, name, "nations")
            save = lambda at, run=run: runs.log_batch(t.spark, name, f"b{run}", datetime(2024, 1, run), "nations", str(at), 1)
            got = readers.pages(t.spark, Service(seen, 5).by_offset, None, "offset", size=5, start=None if last is None else int(last), save=save)
            got = got.select(F.lit(run).alias("run"), F.get_json_object("payload", "$.n_nationkey").cast("int").alias("n_nationkey"))
            out = got if out is None else out.union(got)
    finally:
        t.spark.sql(f"drop table if exists {name}")
    return out


@declared(
    "rest_failures",
    "what string, outcome string",
    [
        ("endless service", "TooManyPages: more than 3 pages"),
        ("third attempt", "3 attempts, waits 2.0 4.0"),
        ("never well", "RuntimeError: status 500 after 3 attempts"),
        ("not found", "RuntimeError: status 404 after 1 attempts"),
        ("empty pages", "4 pages asked"),
    ],
)
def _(t):
    waits, answers = [], iter([429, 503, 200])
    asked = []

    def third():
        readers.fetched(lambda: (next(answers), {}), sleep=waits.append)
        return f"{len(waits) + 1} attempts, waits {' '.join(map(str, waits))}"

    def empty(token):
        asked.append(token)
        return 200, {"items": [], "next": "more"}

    readers.pages(t.spark, empty, "items")
    return [
        ("endless service", outcome(lambda: readers.pages(t.spark, lambda at: (200, {"items": [{"a": 1}], "next": "more"}), "items", most=3))),
        ("third attempt", outcome(third)),
        ("never well", outcome(lambda: readers.fetched(lambda: (500, {}), sleep=lambda _: None))),
        ("not found", outcome(lambda: readers.fetched(lambda: (404, {}), sleep=lambda _: None))),
        ("empty pages", f"{len(asked)} pages asked"),
    ]


@declared(
    "rest_records",
    "path string, found string",
    [("", "[{'id': 1}]"), ("data", "[{'id': 1}, {'id': 2}]"), ("data.items", "[{'id': 3}]"), ("none.there", "[]"), ("one", "[{'id': 4}]"), ("mixed", "[{'id': 5}]")],
)
def _(t):
    payloads = {"": [{"id": 1}], "data": {"data": [{"id": 1}, {"id": 2}]}, "data.items": {"data": {"items": [{"id": 3}]}}, "none.there": {"a": 1}, "one": {"one": {"id": 4}}, "mixed": {"mixed": [{"id": 5}, 6, "x"]}}
    return [(path, str(readers.records(p, path))) for path, p in payloads.items()]


@declared(
    "rest_batch_rules",
    "rules string, outcome string",
    [
        ("keys", "['b: 1 rows without it']"),
        ("strict keys", "ValueError: b: 1 rows without it"),
        ("drift", "['2 sets of keys, more than 1']"),
        ("empty pages", "['5 empty pages, more than 3']"),
        ("too few", "ValueError: 3 rows, not 4 to None"),
        ("too many", "ValueError: 3 rows, not None to 2"),
        ("fine", "[]"),
    ],
)
def _(t):
    df = t.spark.createDataFrame([(0, '{"a": 1, "b": null}'), (0, '{"b": 2, "a": 3}'), (2, '{"a": 5}')], "page int, payload string")
    cases = {
        "keys": (BatchRules(("a", "b")), None), "strict keys": (BatchRules(("b",), strict=True), None), "drift": (BatchRules(signatures=1), None),
        "empty pages": (BatchRules(), 7), "too few": (BatchRules(least=4), None), "too many": (BatchRules(most=2), None), "fine": (BatchRules(("a",), 1, 3), 3),
    }
    return [(name, outcome(lambda r=r, n=n: readers.check_pages(df, r, n))) for name, (r, n) in cases.items()]


# --- imports ---


@declared(
    "file_import_guess",
    "name string, type string, nullable boolean, keyed boolean",
    [
        ("customer_id", "INTEGER", False, True), ("day", "TIMESTAMP", True, False), ("amount", "DECIMAL", False, False), ("large", "BIGINT", False, False),
        ("mixed", "JSON", False, False), ("words", "STRING", False, False), ("flag", "BOOLEAN", False, False), ("region_key", "INTEGER", False, False),
    ],
)
def _(t):
    rows = [
        {"Customer ID": "1", "Day": "2024-01-01", "Amount": "10.50", "Large": 5_000_000_000, "Mixed": {"a": 1}, "Words": "1", "Flag": "true", "Region Key": 1},
        {"Customer ID": "2", "Day": "2024-01-02T10:00:00", "Amount": "7", "Large": 1, "Mixed": "text", "Words": "x", "Flag": False, "Region Key": 1},
        {"Customer ID": "3", "Day": "", "Amount": "7", "Large": 1, "Mixed": "text", "Words": "2024-01-01", "Flag": "false", "Region Key": 1},
    ]
    return [(n, g["type"], g["nullable"], g["key"]) for n, g in landing.guessed(rows).items()]


@declared("rest_import_paths", "name string, path string", [("id", "$.id"), ("address_city", "$.address.City"), ("address_geo", "$.address.geo"), ("tags", "$.tags")])
def _(t):
    schema = T.StructType.fromDDL("id int, address struct<City: string, geo: struct<lat: double>>, tags array<string>")
    return list(landing.flat_paths(schema).items())


@declared(
    "import_table",
    "name string, type string, role string, nullable boolean, comment string",
    [("k", "BIGINT", "key", False, "the key"), ("price", "DECIMAL(12,2)", "business", True, None), ("tags", "JSON", "business", True, None)],
)
def _(t):
    name = "q_import_table"
    t.spark.createDataFrame([], "k bigint comment 'the key', price decimal(12,2), tags array<string>").createOrReplaceTempView(name)
    return [(c.name, c.type, c.role, c.nullable, c.comment) for c in generation.import_table(t.spark, name, ("K",))]


@declared(
    "ingest_modes",
    "integrate boolean, own boolean, system boolean, mode string, outcome string",
    [
        (True, None, True, "native", "native"), (True, None, True, "external", "external"), (True, None, False, "native", "none"), (True, True, False, "native", "native"),
        (True, False, True, "native", "none"), (False, True, True, "native", "none"), (True, True, True, "none", "ValueError: a raw table is wanted, but nothing ingests it"),
    ],
)
def _(t):
    cases = [(True, None, True, "native"), (True, None, True, "external"), (True, None, False, "native"), (True, True, False, "native"), (True, False, True, "native"), (False, True, True, "native"), (True, True, True, "none")]
    return [(*c, outcome(lambda c=c: readers.ingest_mode(*c))) for c in cases]


@declared(
    "delta_cutoffs",
    "environment string, outcome string",
    [("dev", "1995-02-28 12:00:00"), ("prod", "1998-03-30 12:00:00"), ("test", "None"), ("dev, no increment", "None"), ("filter", "ValueError: the filter needs a cutoff, and no policy gives one"), ("leap", "2023-02-28 00:00:00")],
)
def _(t):
    plain = Source("parquet", "", where="a = 1")
    return [
        *[(e, str(readers.cutoff_of(_FILTERED, _POLICIES, e, NOW))) for e in ("dev", "prod", "test")],
        ("dev, no increment", str(readers.cutoff_of(plain, _POLICIES, "dev", NOW))),
        ("filter", outcome(lambda: CTX.fill(_FILTERED.increment, None))),
        ("leap", str(readers.cutoff(datetime(2024, 2, 29), 1, "year"))),
    ]


@declared(
    "reader_refusals",
    "source string, outcome string",
    [
        ("avro", "ValueError: no reader for avro"),
        ("json object", "ValueError: does not hold arrays of JSON objects"),
        ("jdbc without bounds", "ValueError: t: give partitionColumn, lowerBound, upperBound, numPartitions, or single=True for a table that one task can read"),
        ("two names for a sheet", "ValueError: a sheet has a name or an index, not both"),
        ("names that clash", "ValueError: column names clash once normalized: ['a b', 'A_B']"),
    ],
)
def _(t):
    path = scratch_path(t.spark, "object") + ".json"
    put(t.spark, path, b'{"a": 1}')
    read = lambda *a: (lambda: readers.read(t.spark, Source(*a)))
    return [
        ("avro", outcome(read("avro", "x"))),
        ("json object", outcome(read("json", path)).replace(f" {path}", "")),
        ("jdbc without bounds", outcome(read("jdbc", "t", {"url": "x"}))),
        ("two names for a sheet", outcome(read("excel", "x", {"sheet_name": "a", "sheet_index": 0}))),
        ("names that clash", outcome(lambda: readers.with_normal_names(t.spark.createDataFrame([(1, 2)], "`a b` int, `A_B` int")))),
    ]




@query("land_payload_of_rows", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS missing FROM customer")
def _(t):
    payload = landing.as_payload(t["customer"].select(F.col("c_custkey").alias("Cust ID"), F.col("c_name").alias("Name")))
    named = payload.select(F.regexp_replace("payload", '"Cust ID"', '"cust_id"').alias("payload"))
    return landing.landed(named, {"id": ("$.cust_id", "BIGINT"), "name": ("$.Name", "STRING"), "missing": ("$.x.y[0]", "FLOAT")}, CTX).select("id", "name", "missing")
