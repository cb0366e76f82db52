"""Cutting lineage with tables written to the folder that all executors share.

A written table lives as long as a plan can reach it. The driver holds a weak
reference to what every plan over the table shares (its file index), and deletes
tables whose reference is cleared whenever another one is written, or on `sweep`;
the rest goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Paths of written tables, and the weak reference to the file index of each.
_owned: dict[str, object] = {}
#: Folders of this machine made for sessions without a setting.
_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent, a local master gets a folder of this machine
    (tests); any other master is refused, as its executors would each write to
    their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/quillvec-{uuid.uuid4().hex}"
        _made.add(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The columns are compressed, which a checkpoint of rows isn't, and the
    written table survives the loss of any executor. It is deleted once no plan
    reaches it.
    """
    sweep()
    path = write_cut(df, label)
    return own(read_cut(df.sparkSession, path, df), path)


#: Lets a query remove its shuffle files when it ends, where the session knows the setting.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def free_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    with contextlib.suppress(AnalysisException):
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def write_cut(df: DataFrame, label: str) -> str:
    """The path to which `df` was written. The shuffle files behind it go at once: nothing reads them again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with free_shuffles(spark):
        df.write.parquet(path)
    return path


def read_cut(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def own(df: DataFrame, path: str) -> DataFrame:
    """`df`, which reads `path` and nothing else, with the files of `path` bound to the life of its plans."""
    spark = df.sparkSession
    index = df._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _owned[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return df


def sweep(collect: bool = False) -> None:
    """Delete the tables that no plan reaches any more; with `collect` look for unreachable plans first."""
    if collect and _owned:
        gc.collect()
        SparkContext._jvm.java.lang.System.gc()
    for path, index in list(_owned.items()):
        if index.refersTo(None):
            del _owned[path]
            _delete(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a table written by `write_cut` that no plan reads any more."""
    _delete(path)


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _leave() -> None:
    for path in _owned:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(path)
    for folder in _made:
        shutil.rmtree(Path(folder.removeprefix("file://")), ignore_errors=True)
