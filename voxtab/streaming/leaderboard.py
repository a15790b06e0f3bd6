"""A leaderboard kept by a stream of metric rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.plans.lineage import shared_dir


def board(rows: DataFrame) -> DataFrame:
    """(tag, n, total, top): rows, sum and largest value of each tag; streams and tables alike."""
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))


def stream_leaderboard(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """The board after all Parquet files of a folder, or the file (event_type, value), have streamed by, a few files a batch.

    State is one row per tag. Each batch's whole board replaces the one before, in
    the shared folder, where the stream keeps its checkpoint too.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    reader, (folder, _, name) = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_a_batch), path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # a file: a stream watches its folder
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = reader.parquet(path).select(F.col("event_type").alias("tag"), "value")
    write = board(rows).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state")
    write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/board")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/board")
