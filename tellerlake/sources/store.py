"""Stored customer tables: built once, read by every analysis.

The customer table is written once as a Parquet table bucketed by customer and
the four relational tables are projections of it. A columnar scan of a projection
reads only its own columns, so nothing is stored twice, and since both sides of a
``Customer_ID`` join share one bucketing, such joins need no exchange.

Files go below the folder named by ``spark.checkpoint.dir``, which every executor
can reach, so a lost executor never loses a stored table.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, TABLE_COLUMNS, require

_scratch: dict[str, str] = {}
_kept: dict[tuple, object] = {}
_PREFIX = "tellerlake_customers_"
_SOURCES = ("customer", "nation", "orders", "lineitem")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for stored tables: the session's, or a temporary one in local tests."""
    shared = (spark.conf.get("spark.checkpoint.dir", None)
              or spark.sparkContext.getCheckpointDir())
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = shared or tempfile.mkdtemp(prefix="tellerlake-")
        _scratch[app] = f"{base.rstrip('/')}/tellerlake-{app}"
    return _scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`work_dir` that nothing has used yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends its lineage there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        fs, where = _fs(df.sparkSession, file)
        fs.delete(where.getParent(), True)


def checkpointed(rdd: RDD) -> str:
    """Store the rows of a kept RDD in the shared folder, partition by partition, and end its lineage there: the folder."""
    context = rdd.context
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{work_dir(SparkSession.active())}/checkpoints")
    rdd.checkpoint()
    rdd.foreachPartition(lambda rows: None)
    return rdd.getCheckpointFile()


def drop_checkpoint(spark: SparkSession, path: str) -> None:
    """Delete what :func:`checkpointed` wrote, once nothing follows from it any more."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def buckets(spark: SparkSession, source_bytes: int) -> int:
    """Bucket count: ``spark.tellerlake.buckets`` if set, else by the size of the sources.

    One bucket per 4 GB of source rows keeps a bucket of the far smaller customer
    table near 100 MB; small inputs still get a bucket per core, if worth a task.
    """
    fixed = spark.conf.get("spark.tellerlake.buckets", None)
    if fixed:
        return int(fixed)
    tasks = min(spark.sparkContext.defaultParallelism, 1 + source_bytes // 4_000_000)
    return max(tasks, 1 + source_bytes // 4_000_000_000)


def store_customers(df: DataFrame, table: str, path: str, n: int) -> DataFrame:
    """Write a customer table in ``n`` buckets by customer, sorted, one file per bucket."""
    require(df, [KEY])
    (df.repartition(n, KEY).write.mode("overwrite").format("parquet")
     .bucketBy(n, KEY).sortBy(KEY).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, bytes, newest and summed times of each source, folders below included.

    A stored table is only good for the same state. A source without any byte fails.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in _SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        found, count, size, newest, times = path.getFileSystem(conf).listFiles(path, True), 0, 0, 0, 0
        while found.hasNext():
            file = found.next()
            if not file.getPath().getName().startswith(("_", ".")):
                count, size = count + 1, size + file.getLen()
                newest = max(newest, file.getModificationTime())
                times += file.getModificationTime()
        if not size:
            raise ValueError(f"{sf_dir}: {name} holds no data")
        state.append((count, size, newest, times))
    return tuple(state)


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """``make()``, remembered for this application and the present state of the sources."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), source_state(spark, sf_dir), name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def customers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table of one star schema: built on first use, and again when it changed."""
    from .star import customer_table

    def build() -> str:
        app = spark.sparkContext.applicationId
        tag = hashlib.md5(f"{app}|{sf_dir}".encode()).hexdigest()[:10] + uuid.uuid4().hex[:6]
        table = f"{_PREFIX}{tag}"
        size = sum(s[1] for s in source_state(spark, sf_dir))
        store_customers(customer_table(spark, sf_dir), table, f"{work_dir(spark)}/{table}",
                        buckets(spark, size))
        return table

    return spark.table(once(spark, sf_dir, "customers", build))


def release(spark: SparkSession) -> None:
    """Forget and drop all that this application stored, and delete its own work folder."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _kept if k[0] == app]:
        kept = _kept.pop(key)
        if isinstance(kept, str) and kept.startswith(_PREFIX):
            spark.sql(f"DROP TABLE IF EXISTS {kept}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The four relational tables as projections of a customer table.

    Columns the table lacks are skipped; the transaction date becomes text.
    """
    tables = {}
    for name, wanted in TABLE_COLUMNS.items():
        cols = [
            F.col(c).cast("string").alias(c) if c == "Last_Transaction_Date" else F.col(c)
            for c in wanted if c in df.columns
        ]
        tables[name] = df.select(*cols)
    return tables


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables available to SQL text, replacing earlier views of the same name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


_POINTER = "current"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the version pointers below ``path``, oldest first."""
    fs, where = _fs(spark, f"{path}/{_POINTER}")
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if not s.getPath().getName().startswith((".", "_")))


def build_tables(df: DataFrame, path: str) -> dict[str, DataFrame]:
    """Write the four tables as Parquet below ``path``, all of them replaced at once.

    They go to a folder of their own. Only when all four are written, an empty file named after
    the folder, numbered on from the one before, makes it the current one: creating a file is
    one step in every file system, so a reader finds four old or four new tables. A run that was
    lost leaves a folder that nothing names. The version before the current one is kept for
    readers that are under way, older ones are deleted.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    old = _versions(spark, path)
    number = int(old[-1].split("-")[0]) + 1 if old else 1
    version = f"{number:09d}-{uuid.uuid4().hex[:12]}"
    for name, part in split_tables(df).items():
        part.write.parquet(f"{path}/{version}/{name}")
    fs, where = _fs(spark, f"{path}/{_POINTER}/{version}")
    fs.create(where, False).close()
    for gone in old[:-1]:
        for rest in (f"{path}/{_POINTER}/{gone}", f"{path}/{gone}"):  # the name first, then what it names
            _fs(spark, rest)[0].delete(_fs(spark, rest)[1], True)
    return open_tables(spark, path)


def open_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Open the tables :func:`build_tables` wrote last and register them as views."""
    path = path.rstrip("/")
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"{path}: no tables were built here")
    tables = {n: spark.read.parquet(f"{path}/{found[-1]}/{n}") for n in TABLE_COLUMNS}
    register(tables)
    return tables
