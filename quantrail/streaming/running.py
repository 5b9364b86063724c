"""Statistics of streams: windows with watermarks, and running totals that say when a mean is known well enough."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})  # event times need a zone


def windowed_statistics(stream: DataFrame, time: str, value: str, by: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, key, n, mean, sd, least, most; rows later than the watermark are dropped, as state must end."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    out = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(by))
    out = out.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))
    return out.select(F.col("w.start").alias("start"), by, "n", "mean", "sd", "least", "most")


def precision(stream: DataFrame, value: str, by: str, relative: float = 0.05, z: float = 1.959964) -> DataFrame:
    """key, n, mean, half, enough: whether the mean's interval is within a share of it. State is three sums for each key."""
    x = F.col(value)
    s = stream.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    half = z * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return s.select(by, "n", "mean", half.alias("half"), F.coalesce((F.col("n") >= 500) & (half <= relative * F.abs("mean")), F.lit(False)).alias("enough"))


def drained(result: DataFrame, folder: str) -> DataFrame:
    """The complete result of a streaming aggregation after all that its source holds now; batches are written to the folder."""
    spark, path = result.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")
    result.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/rows")
