"""The folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary one, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantrail-"))
    return context.getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _last(spark: SparkSession, folder: str) -> None:
    """Deletes the folder of this application, if the driver's JVM still lives."""
    try:
        delete(spark, folder)
    except Exception:  # noqa: BLE001  whatever a dying gateway raises, the program ends
        return


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; the end of the driver's program deletes it."""
    folder = f"{shared_folder(spark)}/quantrail-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(_last, spark, folder)
    return folder


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: later steps don't compute it again, nor does the loss of an executor.

    The table stays until discard() or the end of the driver's program deletes it.
    """
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes cut tables whose last reader is written."""
    for df in tables:
        delete(df.sparkSession, df._cut_path)
