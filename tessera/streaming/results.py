"""Recorded result lines as a stream: boxes of each new file, written once.

The archive join of ``tessera.sources.incremental`` stays the source of truth for what to process; a
stream only spares listing files that were read already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.ocr import text_boxes


def lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the files that appear in a folder, with the file's name as image_id."""
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.withColumn("image_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Text boxes of the stream; stateless, so late files need no watermark."""
    return text_boxes(lines(spark, folder)).drop("value")


def write_boxes(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop. Parquet's own commit log and the checkpoint make each file
    count once, also after a restart."""
    writer = boxes(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
