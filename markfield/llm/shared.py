"""Helpers the operators share: lineage cuts in the cluster's shared folder, expression idioms, table reads."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of numbers up to which Spark may broadcast it.
BROADCAST = 100_000
#: The white space that separates words in the contracts of operators 4 and 6.
SPACE = r"[\x20\x09-\x0D]"
#: Seconds between two returns of the driver's freed memory (each takes about a tenth of one), and when the last was.
TRIM_S, _trimmed = 5, [float("-inf")]
#: In each thread: for each settled call that goes on, innermost last, the folders of the tables it has cut so far.
_calls = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.  Where that is unset and everything runs in one process
    (tests), a temporary one; a cluster without it is an error, as each executor would write to its own disk."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="markfield-")
        atexit.register(shutil.rmtree, found, True)
        sc._conf.set("spark.checkpoint.dir", found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and return the written table: lineage ends there, so an executor
    that is lost later costs no recomputation, and what reads it twice does not compute it twice.  The driver's file
    system deletes the table when the driver ends, or the settled call that it is made in does before.  files: at most so many, for tables that are small beside the corpus
    (each file costs a round of the file system)."""
    spark = df.sparkSession
    path = new_folder(spark)
    out = (df if files is None else df.coalesce(files)).write
    out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # the write's return says so
    delete_at_exit(spark, path)
    if calls := getattr(_calls, "open", None):
        calls[-1].append(path)
    if time.monotonic() - _trimmed[0] >= TRIM_S:
        spark._jvm.System.gc()  # Spark deletes shuffle files once the collector has found their plans unused
        give_back_driver(spark)
        _trimmed[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def settled(files: int | None = None) -> Callable:
    """Decorates a function that returns a DataFrame: the result is cut (files: as there), and the tables that were cut on
    the way to it, which nothing reads any more, are deleted at once.  The function must not give tables that it has cut
    to anything but its result."""

    def decorate(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args, **named) -> DataFrame:
            calls = _calls.open = getattr(_calls, "open", [])
            calls.append([])
            keep = 0  # of a call that fails, all is left to the outer one
            try:
                out = cut(f(*args, **named), files)
                keep = len(calls[-1]) - 1
                for path in calls[-1][:keep]:
                    _delete(out.sparkSession, path)
                return out
            finally:
                rest = calls.pop()[keep:]
                if calls:
                    calls[-1] += rest

        return run

    return decorate


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/markfield-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at, True)
    files.cancelDeleteOnExit(at)


def dealt(df: DataFrame, n: int) -> DataFrame:
    """df for joins that n rows, or about as many, go into: beyond BROADCAST rows both sides are dealt out, as Spark goes by the
    size of files and would build tables of millions of numbers on the driver."""
    return df.hint("merge") if n > BROADCAST else df


def importable(spark: SparkSession) -> None:
    """Let Python workers that are started from now on import this package from where the driver has it (where it is
    shipped or installed, this changes nothing)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system (where the C library can), as workers are kept and stand
    beside an executor's JVM while they have nothing to do."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def give_back_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM, by its own command (System.trim_native_heap; a JVM without it is left as it is).  Its
    compiler and its hundreds of threads free native memory that the C library otherwise holds beside the heap; in long
    chains of queries that grows to several hundred MB.  The call goes by the interface's method, as the server's class is
    not open to reflection."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    try:
        of = jvm.java.lang.Class.forName
        types, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = of(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by Spark's reader only (the folder may be in a store that only Spark opens)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row.  Catalyst inlines a projected column into lambdas that capture
    it, which evaluates it once an element; a lambda variable is bound once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
