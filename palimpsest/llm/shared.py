"""The folder that all executors share, and frames cut off from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a local session without one, a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def kept(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read from there: a lost executor costs none of the work before.

    The session removes such files if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
