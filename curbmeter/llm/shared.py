"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

import curbmeter

from curbmeter.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: later stages, also those repeated after an executor was
    lost, start from files. The files' size tells Spark whether to broadcast.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# Rows and bytes that go to a Python worker at once; texts can be long.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Set up Python workers: bounded batches, and this package once per application, as by ``--py-files``.

    The archive is made on the driver, and Spark serves it to executors.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_curbmeter_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(curbmeter.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="curbmeter-"), "curbmeter.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("curbmeter", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._curbmeter_shipped = True
