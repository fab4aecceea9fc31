"""Iteration logs as a stream: parsed rows, windowed counts and running best per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_SCHEMA = "row_id long, problem_id string, iteration string, ts timestamp, action_name string, passed boolean, iverilog_pass boolean, gen_in_tok long, gen_out_tok long"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines that arrive in a folder; the mixed iteration column stays text, its number beside it."""
    raw = spark.readStream.schema(schema).json(folder)
    return raw.withColumn("iteration_no", F.col("iteration").try_cast("int"))


def windowed_actions(rows: DataFrame, late: str | None = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Actions per window of event time; rows later than the watermark are left out.  ``late`` is None for rows that have a watermark."""
    marked = rows.withWatermark("ts", late) if late else rows
    return marked.groupBy(F.window("ts", size), "action_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def once_only(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Each row once, redelivered ones within the watermark dropped."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row_id"])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream of its files, whether it is one file or a folder of them."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def settle(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over what is there; its whole result replaces the table at ``path`` after each batch."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its rows as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
