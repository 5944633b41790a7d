"""Intake as structured streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import shared_dir


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a new file is a new batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote.

    The checkpoint and the output lie in the shared folder, so a lost executor or a
    restart goes on where the last batch ended.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/folioforge/stream-{label}-{uuid.uuid4().hex}"
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        schema = stream.schema

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        run = stream.writeStream.foreachBatch(put)
    run = run.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else schema).parquet(f"{at}/out")


def first_of_each(docs: DataFrame) -> DataFrame:
    """Documents by content, each once: replays and copies are dropped by the state of hashes seen."""
    return docs.withColumn("sha", F.sha2("text", 256)).dropDuplicates(["sha"])


def timed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events with a proper time (the tables' has no zone) and a watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def sessions(events: DataFrame, idle: str = "8 hours") -> DataFrame:
    """Sessions per user that end after ``idle``: ``user_id, began, ended, n``."""
    return events.groupBy("user_id", F.session_window("at", idle).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def rejected(docs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused documents; the refused carry a reason, for a sink of their own."""
    reason = F.when(F.col("text").isNull() | (F.length(F.trim("text")) == 0), "empty").when(F.length("text") > longest, "too long")
    marked = docs.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
