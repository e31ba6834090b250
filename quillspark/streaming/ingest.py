"""Streams: incremental ingest of text with duplicates left out, event-time windows, job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """(source_file, line) of new .txt files of a folder."""
    s = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.txt").text(path)
    return s.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("line"))


def accepted(lines: DataFrame, slug: str) -> DataFrame:
    """(identifier, cleaned, concept): lines cleaned, rejected ones and those seen before in the stream left out. The ids
    seen are the stream's state."""
    b = lines.withColumn("line", T.normalise_line(F.col("line"))).where("line <> ''")
    b = b.withColumn("identifier", F.concat(F.lit(f"{slug}_"), F.substring(F.sha1("line"), 1, 16))).dropDuplicates(["identifier"])
    b = b.withColumn("cleaned", T.clean_positive(T.sanitise_braces(F.col("line"))))
    return b.where(T.reject_reason(F.col("cleaned")).isNull()).select("identifier", "cleaned", T.concept(F.col("cleaned")).alias("concept"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, slug: str) -> None:
    """Takes what is new in source and appends it to the parquet table target, leaving out what target holds. A batch that
    is repeated after a failure finds its rows stored and adds none twice."""

    def store(batch: DataFrame, _: int) -> None:
        try:
            stored = batch.sparkSession.read.parquet(target).select("identifier")
            batch = batch.join(stored, "identifier", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("append").parquet(target)

    q = accepted(read_lines(spark, source), slug).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in event-time windows, for a stream or a table; events later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of a user's events no further apart than the gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
