"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Only settings that change results or that every deployment wants; sizing
# (executors, memory, shuffle partitions) belongs to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sessions of one key are merged where their events are read, so a busy key sends few partial ones.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "flowsentry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session somebody else made."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session, else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and return it read back: fresh lineage, real size.

    A table is preferred to `checkpoint()`, whose result keeps the size estimate of
    the plan it replaces: in a loop of joins those estimates multiply until planning
    stalls, and they hide from the planner that a side is small enough to broadcast.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "flowsentry", spark.sparkContext.applicationId, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of parts that do not need each other, started at once.

    A part waits at the end of each of its steps for the last task; the steps of the
    others use the cores that are free by then.
    """
    own = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(own(part)) for part in parts]]


def discard(table: DataFrame) -> None:
    """Delete a table that `cut` wrote, once nothing that is still to run reads it."""
    spark = table.sparkSession
    files = table.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if f"/flowsentry/{spark.sparkContext.applicationId}/" in f"{folder}/":
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
