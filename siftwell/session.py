"""Session settings the jobs rely on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # user settings and similar attribute tables of this size are sent to all executors
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # stateful streams keep several kinds of state, which only this store can
    "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
    # plans here are built from many small column calls; recording each call site slows that down
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "siftwell", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; anything else is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams started in a session of other settings keep keyed state too."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def use_utc(spark: SparkSession) -> SparkSession:
    """Results depend on the session zone; pin it before building a plan."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: What tasks of long jobs hold at a time. Record batches of Spark's 64 MB are held several times over, by the
#: worker and by the executor outside its heap, which does not give back what larger buffers took. Text columns
#: are decoded in whole batches of rows. A join by sorting takes two pages of up to 64 MB in each task, however
#: few rows it has; partitions under the limit are hashed instead, which is decided by their sizes as written.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16MB",
}


def bound_batches(spark: SparkSession) -> SparkSession:
    """The settings of ``BOUNDS``: none of them changes a result."""
    for key, value in BOUNDS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A temporary folder is made only where everything runs on one machine (local tests). On a cluster
    executors would each write to their own disk and later reads would miss those files, so a missing
    setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where two consumers need one expensive result: the written table survives the loss of
    executors, and cuts lineage without keeping blocks on them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
