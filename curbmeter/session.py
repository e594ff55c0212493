"""Session set-up and the few questions operators ask of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PARTITION_BYTES = 128 << 20
# A side of a join is broadcast only under both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Estimates from here on are Spark's default for a size that it does not know.
UNKNOWN_BYTES = 1 << 60


def build_session(
    app_name: str = "curbmeter", master: str | None = None, input_bytes: int | None = None, **conf
) -> SparkSession:
    """A session with adaptive execution on and timestamps free of zone shifts.

    ``input_bytes``, the size of the largest table, sets the number of
    partitions that shuffles start from, one per 128 MB; adaptive execution
    merges those that turn out small. It splits skewed partitions of joins
    only, so a wide aggregation of a large table needs this number. Pass
    ``**conf`` (dots as ``__``) to override any setting.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if input_bytes is not None:
        partitions = max(200, -(-input_bytes // PARTITION_BYTES))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only when neither that nor
    a directory on the context is set, and all of Spark runs in one process
    (tests, a laptop), is one made locally.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="curbmeter-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages never go back to the input scan."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for ``df``; plans only, starts no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of ``df`` only when it has at most ``rows`` rows and ``size`` estimated bytes.

    Meant for stored tables, where a count is cheap. A larger table is returned
    as it is and Spark shuffles the join.
    """
    if df.count() > rows:
        return df
    # A checkpoint has no known size; its rows are narrow where this is used.
    known = estimated_bytes(df)
    return F.broadcast(df) if known <= size or known >= UNKNOWN_BYTES else df
