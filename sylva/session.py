"""Session helpers: a default session, the shared folder, shipping the package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "sylva", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a fresh local folder serves a local master; on a cluster that is an error, as no other machine sees it.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sylva-shared-")
        sc.setCheckpointDir(path)
    return path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder in the shared one that nothing else has."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back(spark: SparkSession) -> str:
    """Return to the machine what the driver's Python and JVM have freed and their C library still holds; what the JVM says.

    Compiling, planning and training leave 50 to 160 MB there. Where the library or the JVM has no such command, all stays.
    """
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values).strip()
    except Py4JError:
        return ""


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... in the order of some columns.

    Ranges of rows are sorted apart, and only their sizes meet in one place; rows that are equal in `order` stand in any
    order among themselves.
    """
    keys = [f"_{k}" for k in range(len(order))]
    wrapped = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = cut(wrapped.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.spark_partition_id().alias("part"), place.alias("at")))
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("row.*", (F.col("before") + F.col("at")).alias(name))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sylva-ship-"), "sylva.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
