"""Session helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Of the driver's heap, the percentage that may stand free after a full collection; the JVM's own default is 70.
FREE_HEAP = 50


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per Spark application.

    Texts go to the workers in batches of at most 1,000 rows and about 4 MB,
    which bounds their memory.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    sc = spark.sparkContext
    if not getattr(sc, "_inkmeter_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="inkmeter-")
        atexit.register(shutil.rmtree, folder, True)  # the driver serves the package from here
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "inkmeter"), "zip", os.path.dirname(root), os.path.basename(root)))
        sc._inkmeter_shipped = True
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine, with the settings that the queries expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("inkmeter")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) is a folder made where
    the session names none; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkmeter-"))
    return sc._jsc.sc().getCheckpointDir().get()


def give_back() -> None:
    """Hand this Python process's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def hand_back(spark: SparkSession) -> None:
    """Hand the driver's unused memory back to the system, Python's and the JVM's.

    Compiling plans and code takes native memory for moments; glibc keeps what
    each of its many arenas once held, and the heap keeps most of what it once
    grew to, so that a long job's driver only grows. A JVM that cannot do a
    part of this goes on as it is.
    """
    give_back()
    sc = spark.sparkContext
    try:
        if not getattr(sc, "_inkmeter_heap", False):
            sc._inkmeter_heap = True
            _bound_free_heap(sc._jvm)
    except Py4JError:
        pass
    sc._jvm.System.gc()
    try:
        _trim(sc)
    except Py4JError:
        pass


def _bound_free_heap(jvm) -> None:
    """Let full collections shrink the heap to what ``FREE_HEAP`` allows, unless somebody chose a ratio."""
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    option = bean.getVMOption("MaxHeapFreeRatio")
    if option.getOrigin().toString() == "DEFAULT" and int(bean.getVMOption("MinHeapFreeRatio").getValue()) < FREE_HEAP < int(option.getValue()):
        bean.setVMOption("MaxHeapFreeRatio", str(FREE_HEAP))


def _trim(sc) -> None:
    """The JVM's own ``System.trim_native_heap``, which calls malloc_trim (Linux, Java 17.0.9 and later)."""
    jvm, new = sc._jvm, sc._gateway.new_array
    kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # By reflection, for the server's own class is not open to py4j.
    jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark removes the shuffle files of finished steps when the driver's garbage
    is collected; a long job asks for that here, so that disk use follows the
    largest step and not the sum of all. The driver's unused memory goes back too.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    hand_back(df.sparkSession)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files give fewer splits.

    Large tables have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
