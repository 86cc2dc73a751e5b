"""Scratch tables in the folder that the session shares with its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, where it names none, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local.append("file://" + folder)
    return _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


class ScratchTable:
    """Rows written part by part."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, name)
        self.add([])

    def add(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def scratch_table(spark: SparkSession, schema: str, name: str) -> ScratchTable:
    return ScratchTable(spark, schema, name)
