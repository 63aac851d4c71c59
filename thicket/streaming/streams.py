"""Structured Streaming: followed files, windowed counts, debounced bursts and derived tables kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import words
from thicket.session import shared_dir


def parquet_stream(spark: SparkSession, folder: str, name: str, files_a_batch: int = 100) -> DataFrame:
    """A table's files as a stream, so many in a batch; new files in its folder are picked up. A table of one file is found by its name."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else f"{folder}/{name}*.parquet")


def _is_dir(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def followed_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines of a text stream that match a pattern, whatever their case."""
    return lines.filter(F.col("value").rlike("(?i)" + pattern))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n, total) by tumbling windows; events later than `late` behind the newest are left out."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def bursts(events: DataFrame, time: str, key: str, quiet: str, late: str) -> DataFrame:
    """(key, start, stop, n): runs of a key's events with no gap of `quiet` between them, given out once quiet has passed."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.session_window("_t", quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and what it wrote to the shared folder; `complete` keeps the last result only."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/thicket-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a loss replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return found.select(*stream.columns)


def keep_postings(documents: DataFrame, folder: str) -> Callable[[], DataFrame]:
    """Keep (doc_id, term, tf) of a stream of documents in `folder`, a partition for each batch; the last batch with a document counts. Returns a reader."""

    def write(batch: DataFrame, number: int) -> None:
        terms = batch.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        terms.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")

    documents.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    def read() -> DataFrame:
        whole = documents.sparkSession.read.schema("doc_id long, term string, tf long, batch int").parquet(f"{folder}/postings")
        last = whole.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return whole.join(last, ["doc_id", "batch"]).select("doc_id", "term", "tf")

    return read
