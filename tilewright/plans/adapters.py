"""Ordinary tables seen as pixels, vectors, tiles and byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """One pixel a line: image by ship mode of flags, place by key, channels from keys, alpha from the line number."""
    li = table(spark, folder, "lineitem")
    alpha = F.when(F.col("l_linenumber") % 8 == 7, 0).when(F.col("l_linenumber") % 8 == 6, 100).otherwise(255)
    rgba = color.pack((F.col("l_orderkey") % 256).cast("int"), (F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") % 256).cast("int"), alpha)
    return li.select((F.col("l_orderkey") % 4).alias("image_id"), F.lit(0).alias("layer"), F.floor(F.col("l_orderkey") / 4).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("x"), rgba.alias("rgba"))


def event_pixels(spark: SparkSession, folder: str, side: int = 64) -> DataFrame:
    """Square images filled row by row by event number; smooth in two channels, noisy in one."""
    ev = table(spark, folder, "events")
    area = side * side
    at = F.pmod("event_id", F.lit(area))
    y, x = F.floor(at / side).cast("int"), F.pmod(at, F.lit(side)).cast("int")
    r, g, b = F.pmod(x * 4 + F.pmod("user_id", F.lit(8)), F.lit(256)), F.pmod(y * 4, F.lit(256)), F.pmod(F.floor(F.col("user_id") / 16) * 16, F.lit(256))
    alpha = F.when(F.pmod("event_id", F.lit(97)) == 0, 0).otherwise(255)
    return ev.select(F.floor(F.col("event_id") / area).cast("long").alias("image_id"), F.lit(0).alias("layer"), y.alias("y"), x.alias("x"), color.pack(r.cast("int"), g.cast("int"), b.cast("int"), alpha).alias("rgba"))


def part_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse images of few colours, 16 pixels wide, by part number: tiles of them repeat and mirror."""
    p = table(spark, folder, "part")
    at = F.pmod("p_partkey", F.lit(1024))
    y, x = F.floor(at / 16).cast("int"), F.pmod(at, F.lit(16)).cast("int")
    shade = F.pmod(F.floor(x / 4) + F.floor(y / 4) * 2, F.lit(3)) * 100
    return p.select(F.floor(F.col("p_partkey") / 1024).cast("long").alias("image_id"), F.lit(0).alias("layer"), y.alias("y"), x.alias("x"), color.pack(shade.cast("int"), F.lit(40), F.lit(200), 255).alias("rgba"))


def document_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """UTF-8 bytes of documents: image_id, data."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("image_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
