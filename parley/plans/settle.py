"""Intermediate results that many plans use: computed once, written to the shared folder, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that goes when the driver ends. Where that setting is missing, a temporary folder is taken in local mode,
    and elsewhere this is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='parley-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read back: later plans begin here, and a lost executor costs no more than a read."""
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, n: int, *keys: str) -> Iterator[DataFrame]:
    """``df`` as a table of ``n`` buckets by ``keys``, whose rows joins by them leave where they are. The table is known within the ``with`` only."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", new_folder(df.sparkSession, "bucketed")).saveAsTable(name)
    try:
        yield df.sparkSession.table(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE {name}")
