"""Session helpers: a local builder for tests and benchmarks, worker import paths, and paths for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str | int = "*", shuffle: int = 8, name: str = "millrace") -> SparkSession:
    """A session for one machine. On a cluster the caller brings their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def workers_can_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it.

    A cluster that installs the package (or gets it by ``--py-files``) is not affected:
    the folder is only one more place to look in.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Bytes of an Arrow batch between the JVM and a Python worker: with long rows, the default number of rows would be far more.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """What queries with Python workers need: the import path, and Arrow batches of bounded size unless the caller has set one."""
    workers_can_import(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing (a single machine, as in tests) a temporary folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or _own_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and kept as Parquet in the shared folder: survives lost executors, and goes with discard or when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of stored tables that nothing reads any more, such as those of a round that is over."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def in_tasks(df: DataFrame, tasks: int) -> DataFrame:
    """A stored table read by so many tasks at most, whatever the number of its files: for small tables that many jobs read."""
    out = df.coalesce(max(1, tasks))
    out._stored_at = df._stored_at
    return out


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Ask the file system of an existing path to remove it when the application closes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"
