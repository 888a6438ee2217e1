"""Helpers shared by the operators: tables, checkpoints, inline bindings and sizes."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id, behind all others.
LAST = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where that is unset and the master is local, else an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def trim_native(spark: SparkSession) -> str | None:
    """Gives the system back what the driver's native allocator keeps of freed memory (what the compilers and codecs have used), which is no part of the heap;
    what the JVM says to it, None where it has no such command."""
    jvm = spark.sparkContext._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # the server's class is not exported, so that it is called by the method of its interface
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return invoke.invoke(server, arguments)
    except Py4JError:
        return None


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files that nothing refers to any more, rather than when the driver's heap happens to be full."""
    for wait in (0.2, 0):  # the listeners of the last job hold it a moment longer
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
    trim_native(spark)


def checkpoint(df: DataFrame, large: bool = True) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the folder that all executors share; if it is ``large``, the shuffles that made it are
    released, unless the caller keeps ``df`` itself."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    if large and sys.getrefcount(df) <= 2:
        context._gateway.detach(df._jdf)  # at once; Python's own finalisers wait for up to a second
        release(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder below ``shared_folder``, and read again. ``discard`` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it.

    A lambda variable is never inlined, so this also keeps a value out of the loops of inner lambdas.
    """
    return F.transform(F.array(value), body)[0]


def places_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(d, t): what tells a row apart: its id, ``LAST`` for none, and a hash of its text, as ids may be null or repeated."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text, as an array; none for null. (``\\z``, as ``$`` also stands before a last U+0085, U+2028 or U+2029, which are no white space here.)"""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}\\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
