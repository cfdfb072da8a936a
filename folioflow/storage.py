"""Tables written between steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session has a temporary folder; on a cluster, whose
    executors do not see the driver's disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if folder is None:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_by_call.get() if set_by_call.isDefined() else None
    if folder is None:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder


def give_back(spark: SparkSession) -> str | None:
    """Collect the driver's garbage, and hand the native memory that its JVM has freed back to the system.

    Planning and compiling one query after the other leaves holes in the JVM's C heap. They
    count as memory of the process, beside the Java heap, until they are trimmed. Returns what
    the JVM says of it; a JVM without that command keeps its holes.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    lang = jvm.java.lang
    lang.System.gc()

    def array(kind, items):
        made = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            made[i] = x
        return made

    try:
        # By reflection on the interface, as the bean server's own class is closed to callers.
        named = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        call = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, [lang.Class.forName(x) for x in named]))
        beans = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, [beans, "systemTrimNativeHeap", array(lang.Object, []), array(lang.String, [])]))
    except Py4JError:
        return None


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    A lost executor costs no recomputation of what was written. The files go when the
    session's file systems close. Shuffle files behind ``df`` are of no use any more; a
    collection on the driver lets Spark's cleaner find their plans dead and delete them, so
    that a chain of steps does not pile them up on the executors' disks, nor what planning them
    took in the driver's memory.
    """
    spark = df.sparkSession
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = f"{shared_folder(spark)}/folioflow-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(at)
    give_back(spark)
    back = spark.read.schema(df.schema).parquet(at)
    back._folder = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing will read again."""
    folder = getattr(df, "_folder", None)
    if folder is not None:
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
