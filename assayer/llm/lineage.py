"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to a Python worker at once. Texts are long, and a worker holds a batch whole.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: The JVM's command, where its version has it.
_TRIM = "systemTrimNativeHeap"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where they aren't smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = spark.conf.get(key)
        except Exception:  # a version of Spark without this setting
            continue
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``: a lost executor costs no earlier step."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, one is made on a local master (tests); on a
    cluster that is an error, as executors share no folder that could be guessed."""
    small_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def tasks(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that only unreachable plans still hold, and gives the memory that the driver's
    native allocator keeps after compiling plans back to the system."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    if _server(spark, "isRegistered", commands):
        if any(o.getName() == _TRIM for o in _server(spark, "getMBeanInfo", commands).getOperations()):
            _server(spark, "invoke", commands, _TRIM, None, None)


def shrink(spark: SparkSession) -> None:
    """Lets the executors' heaps go back to what is live in them: a heap that one stage has enlarged stays so beside the
    workers of the next, whatever that needs. One short task a core, so idle executors all get one; on a local master
    there is no other JVM than the driver's."""
    context = spark.sparkContext
    if context._jsc.sc().isLocal():
        return
    n = context.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def _server(spark: SparkSession, name: str, *args):
    """A method of the JVM's management server, by its public interface: the class behind it isn't open to callers."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    method = next(m for m in kind.getMethods() if m.getName() == name)
    values = gateway.new_array(jvm.java.lang.Object, len(args))
    for k, value in enumerate(args):
        values[k] = value
    return method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
