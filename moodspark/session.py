"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def unset_defaults(conf: SparkConf, extra: dict[str, str] | None = None) -> dict[str, str]:
    """The defaults whose key ``conf`` (what spark-submit and the defaults file gave) does not hold."""
    return {k: v for k, v in (DEFAULTS | (extra or {})).items() if not conf.contains(k)}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "moodspark", driver_memory: str | None = None) -> SparkSession:
    """A session in which only unset values are filled in.

    The master is set only if the caller passes one; on a cluster it comes
    from spark-submit, as do sizes.
    """
    extra = {}
    if shuffle_partitions:
        extra["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        extra["spark.driver.memory"] = driver_memory
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in unset_defaults(SparkConf(), extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a plain local session (one machine, as in tests) uses a
    folder beside its warehouse; anything else is an error, since only the
    setting can name storage that all executors share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) "
                               "before running jobs that write intermediate state")
        d = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(*sessions: SparkSession) -> Iterator[None]:
    """Within the block, the shuffle files of a job are deleted when it ends, not when the driver next collects garbage.

    For jobs that write a table: nothing reads their shuffles again.
    """
    before = [(s, s.conf.get(SHUFFLE_CLEANUP, None)) for s in sessions]
    try:
        for s in sessions:
            s.conf.set(SHUFFLE_CLEANUP, "true")
        yield
    finally:
        for s, old in reversed(before):
            if old is None:
                s.conf.unset(SHUFFLE_CLEANUP)
            else:
                s.conf.set(SHUFFLE_CLEANUP, old)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where one intermediate result feeds several branches of a plan: the
    branches read the files instead of recomputing the lineage, and a lost
    executor re-reads files instead of re-running the upstream stages. The
    schema is carried over, so reading back runs no inference job.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
