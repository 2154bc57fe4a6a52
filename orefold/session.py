"""Shared scratch space and lineage cuts.

A cluster names its shared folder in ``spark.checkpoint.dir``. Intermediate tables go
there as Parquet: they survive the loss of executors, keep column pruning, and carry
the size statistics that adaptive execution uses to choose joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_CONFS = ("spark.checkpoint.dir", "orefold.scratch.dir")
"""Where the folder is looked up, in this order. The first is fixed when a session
starts; the second can be set at any time on a session without the first."""


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder within the shared one.

    No folder is made up: one that only this machine sees would lose rows on a cluster.
    """
    for conf in FOLDER_CONFS:
        root = spark.conf.get(conf, None)
        if root:
            break
    else:
        raise RuntimeError(
            "intermediate tables need a folder that the driver and all executors share: "
            f"set {' or '.join(FOLDER_CONFS)}"
        )
    application = spark.conf.get("spark.app.id", "session")
    return f"{root.rstrip('/')}/orefold/{application}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete the tables that this session has written to the shared folder.

    To be called when no DataFrame that reads them is needed any more.
    """
    remove_folder(spark, shared_dir(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folder.getFileSystem(hadoop).delete(folder, True)
