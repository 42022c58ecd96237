"""Session defaults, table loading and shared-storage intermediates."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(name: str = "voxlake", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the parquet tables (all of them by default)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else what the context already uses.

    Only where neither is set (tests on one machine) is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of one batch between the JVM and Python where rows hold whole texts; Spark's own default is ten times that.
TEXT_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Keeps batches of whole texts small, unless the session has its own limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_BATCH))


_STASHES: list[str] = []


def drop_stashes(spark: SparkSession) -> None:
    """Deletes what stash() has written so far in this process; results that still read it are lost, so call it between jobs."""
    jvm = spark.sparkContext._jvm
    while _STASHES:
        path = jvm.org.apache.hadoop.fs.Path(_STASHES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_part(df: DataFrame, part: str | None = None) -> None:
    """Deletes the folders part (column=value) of a table that stash() has written by that column, or the whole of one written plainly; the caller reads them no more."""
    spark = df.sparkSession
    files = df.inputFiles()
    for folder in {f[: f.index(part) + len(part)] for f in files if f"/{part}/" in f} if part else {f.rpartition("/")[0] for f in files}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM collect plans that are done, on which Spark deletes their shuffle files; it does so by itself every half hour only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stash(df: DataFrame, label: str, compression: str | None = None, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the written table: lineage ends here, so a lost executor costs
    a re-read, and values such as row marks are fixed for every later use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STASHES.append(path)
    df.write.parquet(path, compression=compression, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
