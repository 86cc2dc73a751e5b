import os
import subprocess
import sys
from pathlib import Path

import pytest

from quern.plans import catalog_ingest
from quern.plans.catalog_ingest import shared_database
from quern.sources import readers

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"

APART = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://" + {shared!r}).config("spark.sql.warehouse.dir", {shared!r} + "/w").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
got = __spark_entry__.queries()["read_jdbc_parts"](spark, {sf!r})
want = spark.read.parquet({sf!r} + "/supplier.parquet").where("s_nationkey < 20").select(*got.columns)
print("rows", got.rdd.getNumPartitions(), sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != [], flush=True)
spark.stop()
"""


def test_parts_read_by_executors(tmp_path):
    """Executors are JVMs of their own, which see no database in the driver's memory."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    done = subprocess.run([sys.executable, "-c", APART.format(repo=str(REPO), shared=str(tmp_path), sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x for x in done.stdout.splitlines() if x.startswith("rows")] == ["rows 4 True"], done.stderr[-3000:]


def test_shared_database_keeps_odd_values(spark):
    rows = [(1, ' a "q", \r\n x\t'), (2, None), (None, "ü😀\\"), (-5, ""), (2**40, "  "), (2, None), (7, "null"), (8, '"'), (9, ",,"), (10, "x" * 100_000)]
    df = spark.createDataFrame(rows, "k long, name string")
    url = shared_database(df, "odd")
    bounds = {"partitionColumn": "k", "lowerBound": "1", "upperBound": "9", "numPartitions": "3"}
    got = readers.read(spark, readers.Source("jdbc", "odd", {"url": url, **bounds}))
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_shared_database_without_rows(spark):
    df = spark.createDataFrame([], "k int, name string")
    got = readers.read(spark, readers.Source("jdbc", "odd", {"url": shared_database(df, "odd"), "single": True}))
    assert got.dtypes == df.dtypes and got.collect() == []


def test_shared_database_wants_a_mounted_folder(spark, monkeypatch):
    monkeypatch.setattr(catalog_ingest, "scratch_path", lambda spark, name: f"ftp://nowhere/{name}")
    with pytest.raises(ValueError, match="mounted"):
        shared_database(spark.range(1), "odd")
