"""Session settings and the shared folder for tables that must outlive an executor."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import suppress
from weakref import WeakKeyDictionary

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewheel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have hundreds of expressions; a stack trace for each one doubles planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidewheel-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths that this application took in the shared folder, by its id.
_TAKEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nobody has used yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _TAKEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove all intermediate tables that this application wrote, once no DataFrame over them is in use; how many there were."""
    paths = _TAKEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def _at(spark: SparkSession, path: str):
    """A path's file system, as the executors see it, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    files, at = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of ``text`` under ``path``, which is there whole or not at all."""
    files, at = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = files.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(part, at):
        raise OSError(f"{path} could not be put in place")


#: Tables after which the driver lets go of what is behind them.
TABLES = 4
#: Share of the driver's heap that may stay free, in per cent, when garbage has been collected; the JVM itself holds 70.
FREE_HEAP = 40


def settle(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and shuffle files that nobody holds any more, and give free memory back to the system.

    Spark removes them when the driver's garbage is collected, which by itself happens late: a run of many small jobs fills
    the driver and the executors' disks before. The driver's limit counts what is taken, not what is used, and
    planning takes more outside the heap than its live objects do inside.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(Py4JError):  # a JVM without these options and commands does without
        _hold_heap(spark)
    spark._jvm.System.gc()
    with suppress(Py4JError):
        _trim(spark)


def _hold_heap(spark: SparkSession) -> None:
    """Have a collection give back all but ``FREE_HEAP`` per cent of the driver's heap."""
    kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    options = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
    for name, most in (("MinHeapFreeRatio", FREE_HEAP // 2), ("MaxHeapFreeRatio", FREE_HEAP)):  # the first is never above the second
        if int(options.getVMOption(name).getValue()) > most:
            options.setVMOption(name, str(most))


def _trim(spark: SparkSession) -> None:
    """Give back what the C library keeps of memory that the driver's JVM freed (``jcmd System.trim_native_heap``)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    # By the interface's method, as the server's own class is not open to calls.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage on storage that survives lost executors, so several
    consumers can read an expensive result without recomputing it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if len(_TAKEN[df.sparkSession.sparkContext.applicationId]) % TABLES == 0:
        settle(df.sparkSession)
    return _stored(df, [path])


#: Where the tables are that ``materialize`` and ``together`` returned.
_PATHS: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()


def _stored(like: DataFrame, paths: list[str]) -> DataFrame:
    table = like.sparkSession.read.schema(like.schema).parquet(*paths)
    _PATHS[table] = paths
    return table


def together(tables: list[DataFrame]) -> DataFrame:
    """All rows of stored tables of one schema, as one."""
    return _stored(tables[0], [path for table in tables for path in _PATHS[table]])


def forget(*tables: DataFrame) -> None:
    """Remove stored tables from the shared folder, once no DataFrame over them is in use."""
    for table in tables:
        for path in _PATHS.pop(table, []):
            remove(table.sparkSession, path)
