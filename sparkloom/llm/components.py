"""Connected components by alternating large-star and small-star steps, with every table in the cluster."""

from __future__ import annotations

import ctypes
import gc
import os

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, so that its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of the user's only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or os.path.join("/tmp", "checkpoints", f"sparkloom-{os.getuid()}")


def tidy(spark: SparkSession) -> None:
    """Shuffle files and superseded checkpoints go when the driver collects its garbage; long chains of steps ask for it.

    Free memory of the driver's Python and the native memory that its JVM has freed go back to the system, too.
    """
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """What the driver's JVM says about native memory given back: compiling many plans leaves hundreds of MB free in its C heap.

    Empty where the JVM has no such command.
    """
    sc = spark.sparkContext
    management = sc._jvm.java.lang.management.ManagementFactory
    try:
        # The server's own class is not accessible, its interface is.
        invoke = next(m for m in sc._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
        given[0], given[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(management.getPlatformMBeanServer(), given))
    except Py4JError:
        return ""


def shrink_executors(spark: SparkSession) -> None:
    """Every executor collects its garbage whole, so that the heap which it grew for earlier steps goes back to the system.

    There is a task for each core; free executors get theirs by turns, so each has one at least.
    """
    n = spark.sparkContext.defaultParallelism
    collected = spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("none"))
    collected.write.format("noop").mode("overwrite").save()


def trimmed(run):
    """`run` over Arrow batches; at the end of a task the worker's free memory goes back to the system.

    Idle workers stay beside the executor, so what they keep counts against it.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most systems has it
        if trim:
            trim(0)

    return wrapped


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node that is reachable.

    Nulls and self-links are ignored; an empty table gives an empty one. A step moves each link to the smallest
    neighbour; the rounds end when a round changes nothing, after about the logarithm of the longest path.
    """
    star = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    )
    sign = None
    for turn in range(max_rounds):
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        if not turn:
            continue  # the first round nearly always changes something
        new = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("the components did not settle")
    tidy(star.sparkSession)
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
