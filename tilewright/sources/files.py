"""Readers: image files, raw words and characters, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "image_id bigint, name string, width int, height int, px binary"


def decode_images(files: DataFrame) -> DataFrame:
    """Images (see IMAGES) of rows with path and content; image_id is a hash of the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .decoders import decode

        for rows in batches:
            out = []
            for r in rows.itertuples():
                px = decode(bytes(r.content), r.path)
                out.append((r.image_id, r.path, px.shape[1], px.shape[0], px.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "name", "width", "height", "px"])

    return files.select(F.xxhash64("path").alias("image_id"), "path", "content").mapInPandas(run, IMAGES)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """All image files under ``path``.  JPEG goes through Spark's own image source, everything else is decoded here.

    A file that cannot be decoded is an error, of either kind.
    """
    files = spark.read.format("binaryFile").load(path).where(~F.lower("path").rlike(r"\.jpe?g$"))
    others = decode_images(files.select("path", "content"))
    jpeg = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(path).select("image.*").where(F.lower("origin").rlike(r"\.jpe?g$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.height < 1:
                    raise ValueError(f"{r.origin}: not a JPEG that can be decoded")
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.uint32)
                b, g, red = (v[..., k % r.nChannels] for k in range(3)) if r.nChannels >= 3 else (v[..., 0],) * 3
                px = red | g << 8 | b << 16 | np.uint32(255) << np.uint32(24)
                out.append((r.image_id, r.origin, r.width, r.height, px.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "name", "width", "height", "px"])

    return others.unionByName(jpeg.withColumn("image_id", F.xxhash64("origin")).mapInPandas(run, IMAGES))


def read_words(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Little-endian words of raw files: path, i, value."""
    hexes = F.regexp_extract_all(F.hex("content"), F.lit("[0-9A-F]{%d}" % (2 * width)), F.lit(0))
    words = spark.read.format("binaryFile").load(path).select("path", F.posexplode(hexes).alias("i", "h"))
    swapped = F.concat(*[F.substring("h", 2 * k + 1, 2) for k in reversed(range(width))])
    return words.select("path", "i", F.conv(swapped, 16, 10).cast("long").alias("value"))


def pad_chars(data: str, bits: int):
    """Raw character data grown with zeros to whole 8x8 characters."""
    size = 8 * bits
    return F.expr(f"rpad({data}, cast(ceil(octet_length({data}) / {size}) * {size} as int), x'00')")


def pixels_of(images: DataFrame, layer: int = 0) -> DataFrame:
    """Images as pixels: image_id, layer, y, x, rgba."""
    words = F.regexp_extract_all(F.hex("px"), F.lit("[0-9A-F]{8}"), F.lit(0))
    long = images.select("image_id", "width", F.posexplode(words).alias("i", "h"))
    swapped = F.concat(*[F.substring("h", k, 2) for k in (7, 5, 3, 1)])
    value = F.conv(swapped, 16, 10).cast("long")
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")
    return long.select("image_id", F.lit(layer).alias("layer"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.pmod("i", "width").cast("int").alias("x"), signed.alias("rgba"))


def whole_frames(pixels: DataFrame) -> DataFrame:
    """``pixels`` (image_id, y, x, rgba) with transparent black where the rectangle from (0, 0) lacks one.

    Only images that lack pixels get a frame, so for all others this is a count of their rows.
    """
    px = pixels.select("image_id", "y", "x", "rgba")
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("*").alias("n")).where("n < w * h")
    rows = sizes.select("image_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w")
    frame = rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return px.unionByName(frame.join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti").withColumn("rgba", F.lit(0)))


def images_of(pixels: DataFrame) -> DataFrame:
    """Pixels as images: image_id, width, height, px.  Absent pixels are transparent black."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "rgba")))
    le = lambda c: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0") for k in range(4)])
    out = whole_frames(pixels).groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), ordered.alias("p"))
    return out.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("p", lambda s: le(s["rgba"])), "")).alias("px"))
