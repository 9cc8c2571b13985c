"""What the operators share: tables in the shared folder, and joins that one frequent key cannot slow down."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the rows of any table that ``attach`` broadcasts.
HEAVY_KEYS = 20_000
#: Workspaces that hold tables.
_OPEN: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one is set in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='parley-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of ``rows`` rows and about ``size`` bytes at most, so that a batch of long texts stays small on either side. This is a setting of the
    session, as Spark has none for a single query; smaller values that are set already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Workspace:
    """A folder of written tables below the shared folder. It goes when the driver's JVM ends, or earlier by ``clear``."""

    def __init__(self, spark: SparkSession, name: str, broadcasts: bool = True):
        """Without ``broadcasts``, tables are made by joins that broadcast nothing unless told to: the driver keeps what many joins broadcast."""
        self.spark, self.broadcasts = spark, broadcasts
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        _OPEN.append(self)
        bound_batches(spark)
        self._fs(self.path, lambda fs, p: fs.deleteOnExit(p))

    def _fs(self, path: str, act):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return act(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p)

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back: its lineage ends here, and a lost executor costs no more than a read."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        with nullcontext() if self.broadcasts else setting(self.spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, by: str) -> DataFrame:
        """Write ``df`` dealt into ``buckets`` by a hash of ``key``, sorted by it, and within folders of ``by``; Spark knows of both on reading."""
        table = f"parley_{self.path.rsplit('-', 1)[-1]}_{name}".replace("-", "_")
        df.write.mode("overwrite").format("parquet").partitionBy(by).bucketBy(buckets, key).sortBy(key).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if table := self.tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._fs(f"{self.path}/{name}", lambda fs, p: fs.delete(p, True))

    def clear(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        for name in list(self.tables):
            self.drop(name)
        self._fs(self.path, lambda fs, p: fs.delete(p, True))


def clear_workspaces(spark: SparkSession) -> None:
    """Delete the tables of all operators so far. Results that were not written before can no longer be read."""
    for space in [x for x in _OPEN if x.spark is spark]:
        space.clear()
        _OPEN.remove(space)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """While this lasts, a setting of the session is another."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sorted_buckets(spark: SparkSession):
    """While this lasts, a bucket that is one file is read as sorted as it was written."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def attach(left: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", n: str = "n", few: int = 1) -> DataFrame:
    """Join ``left`` (``total`` rows) with ``table``, which has one row per key and in ``n`` the rows that ``left`` has of it.

    Keys with at least ``total / HEAVY_KEYS`` rows are joined by a broadcast: there are ``HEAVY_KEYS`` of them at most,
    whatever the data. All others have few rows each, so a shuffle deals them evenly. The two parts are told apart by a hash
    of the key, of which the heavy ones are listed in the plan; keys of fewer than ``few`` rows never are. ``how`` is inner or left_semi.
    """
    least = max(1, total // HEAVY_KEYS)
    plain = table.drop(n)
    if least == 1:
        return left.join(F.broadcast(plain), keys, how)
    least = max(least, few)
    code = "xxhash64(" + ", ".join(f"CAST(`{k}` AS {table.schema[k].dataType.simpleString()})" for k in keys) + ")"
    heavy = [str(r[0]) for r in table.filter(F.col(n) >= least).select(F.expr(code)).distinct().collect()]
    if not heavy:
        return left.join(plain, keys, how)
    is_heavy = F.expr(f"{code} IN ({', '.join(f'{h}L' for h in heavy)})")
    return left.filter(is_heavy).join(F.broadcast(plain.filter(is_heavy)), keys, how).unionByName(left.filter(~is_heavy).join(plain.filter(~is_heavy), keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def others(df: DataFrame, *added: str, drop: bool = True) -> list[str]:
    """The columns of ``df`` but for those that have a name which an operator adds."""
    return [c for c in df.columns if not (drop and c.lower() in added)]


def spread_join(left: DataFrame, table: DataFrame, key: str, spread: str, n_left: int, share: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """Join ``left`` (``n_left`` rows) with ``table`` (one row per ``key``, of any width), many rows of ``left`` per key or not. ``counted`` has as many
    rows per key as ``left``, and is ``left`` if not given.

    A key with more than ``share`` rows (or more, so that there are ``HEAVY_KEYS`` such keys at most) is dealt over one task per ``share`` rows, by a
    hash of ``spread``, and its row of ``table`` is copied to each.
    """
    share = max(share, n_left // HEAVY_KEYS)
    heavy = (left if counted is None else counted).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_copies")).filter("_copies > 1").collect() if n_left > share else []
    if not heavy:
        return left.join(table, key)
    many = F.broadcast(left.sparkSession.createDataFrame(heavy, f"`{key}` {left.schema[key].dataType.simpleString()}, _copies int"))
    own = table.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    dealt = left.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    return dealt.join(own, [key, "_salt"]).drop("_salt")


def spread_left(left: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, space: Workspace) -> DataFrame:
    """``left`` with the columns of ``table`` (one row per ``key``), or nulls. ``counts`` (key, n) tells how many rows of ``left`` a key of
    ``table`` has, ``total`` in all.

    Keys of many rows, of which there are ``HEAVY_KEYS`` at most, are dealt over several tasks, and their row of ``table`` is copied to each.
    """
    share = max(1000, total // HEAVY_KEYS)
    copies, salt = free_name(left, "_copies"), free_name(left, "_salt")
    heavy = space.table(counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias(copies)), f"heavy-{uuid.uuid4().hex[:8]}")
    if heavy.isEmpty():
        return left.join(table, key, "left")
    one = F.coalesce(copies, F.lit(1))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn(salt, F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop(copies)
    copied = table.join(F.broadcast(heavy), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1))).drop(copies)
    return dealt.join(copied, [key, salt], "left").drop(salt)
