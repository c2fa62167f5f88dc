"""The same conversions over a folder that grows, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EncodeOptions
from ..plans.convert import convert
from ..sources.files import decode_images
from ..sources.sinks import write_files


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Image files (PNG, BMP, TGA, GIF, PSD, PIC, HDR, PNM) as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return decode_images(spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", "content"))


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, options: EncodeOptions, *, available_now: bool = True) -> StreamingQuery:
    """Convert arriving images to files in ``target``; a file written again after a failure is the same file."""

    def batch(images: DataFrame, _: int) -> None:
        write_files(convert(images, options), target).write.format("noop").mode("overwrite").save()

    writer = image_stream(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
