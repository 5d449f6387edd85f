"""Incremental consolidation of arriving files, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.operators.dedup import exact_dedup, question_hash
from qaloom.operators.quality import is_quality_record
from qaloom.sources.readers import QA_RECORD


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder is there, on whatever file system its address names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def consolidate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: T.StructType = QA_RECORD, files_at_once: int = 1000):
    """Start a stream that reads new JSON-line files of `folder`, keeps records of quality whose question is new, and appends them to `out`.

    The checkpoint knows which files were read. A batch meets the questions kept before by an anti join on their hash,
    which reads one column of `out`; records of a batch are in the order of file and id.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").json(folder)

    def add(batch: DataFrame, _: int) -> None:
        good = batch.where(is_quality_record(F.col("question"), F.col("answer"))).withColumn("question_hash", question_hash(F.col("question")))
        fresh = exact_dedup(good, F.col("question_hash"), [F.col("file_name"), F.col("id")])
        if _exists(batch.sparkSession, out):
            before = batch.sparkSession.read.schema("question_hash string").parquet(out)
            fresh = fresh.join(before, "question_hash", "left_anti")
        fresh.write.mode("append").parquet(out)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and key, for a stream or a table; of a stream, those later than `late` don't count."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
