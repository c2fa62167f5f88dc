"""Image geometry, compositing, masks and scaling as relational plans over ``pixels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color


def flip(pixels: DataFrame, width: Column | str, height: Column | str, x: bool = False, y: bool = False) -> DataFrame:
    w, h = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    out = pixels.withColumn("x", (w - 1 - F.col("x")).cast("int")) if x else pixels
    return out.withColumn("y", (h - 1 - F.col("y")).cast("int")) if y else out


def swap_red_blue(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("rgba", color.swap_red_blue("rgba"))


def grid(images: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Every (image_id, y, x) of a width by height frame for each image."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0), h - 1)).alias("y"), w.alias("__w"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)).alias("x"))


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle from (x0, y0), which may reach beyond the image: there pixels are 0."""
    frame = grid(pixels.select("image_id").distinct(), width, height)
    inside = pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    moved = inside.select("image_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "rgba")
    return frame.join(moved, ["image_id", "y", "x"], "left").withColumn("rgba", F.coalesce("rgba", F.lit(0)))


def pad_clamped(pixels: DataFrame, sizes: DataFrame, out_width: Column, out_height: Column) -> DataFrame:
    """Images (sizes: image_id, width, height) grown to a larger frame by repeating their last column and row."""
    frame = sizes.select("image_id", "width", "height", out_width.alias("ow"), out_height.alias("oh"))
    right = pixels.join(frame, "image_id")
    wide = right.withColumn("x", F.explode(F.when(F.col("x") == F.col("width") - 1, F.sequence("x", F.col("ow") - 1)).otherwise(F.array("x"))))
    tall = wide.withColumn("y", F.explode(F.when(F.col("y") == F.col("height") - 1, F.sequence("y", F.col("oh") - 1)).otherwise(F.array("y"))))
    return tall.drop("width", "height", "ow", "oh")


def composite(back: DataFrame, front: DataFrame) -> DataFrame:
    """``front`` over ``back`` where both have a pixel, in whole-number arithmetic."""
    b = back.select("image_id", "y", "x", F.col("rgba").alias("bg"))
    both = front.select("image_id", "y", "x", F.col("rgba").alias("fg")).join(b, ["image_id", "y", "x"])
    af, ab = color.channel("fg", 3), color.channel("bg", 3)
    wf, wb = af * 255, (F.lit(255) - af) * ab
    total = wf + wb
    safe = F.when(total > 0, total).otherwise(F.lit(1))
    mixed = color.pack(*(F.floor((color.channel("fg", k) * wf + color.channel("bg", k) * wb) / safe).cast("int") for k in range(3)), F.floor(total / 255).cast("int"))
    return both.select("image_id", "y", "x", F.when(af == 255, F.col("fg")).when(af == 0, F.col("bg")).otherwise(mixed).alias("rgba"))


def alpha_mask(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    """One bit a pixel, set where alpha is under the threshold, first pixel in the high bit: image_id, y, byte_no, byte."""
    bit = (color.channel("rgba", 3) < threshold).cast("int")
    place = F.call_function("shiftleft", bit, F.lit(7) - F.pmod("x", F.lit(8)).cast("int"))
    return pixels.groupBy("image_id", "y", F.floor(F.col("x") / 8).cast("int").alias("byte_no")).agg(F.bit_or(place).cast("int").alias("byte"))


def color_mask(pixels: DataFrame) -> DataFrame:
    """Blue, green, red and a zero byte for each pixel, as one integer from the low byte on."""
    return pixels.withColumn("bgr0", color.pack(color.channel("rgba", 2), color.channel("rgba", 1), color.channel("rgba", 0), F.lit(0)))


def _cells(at: str, source: Column, target: int) -> Column:
    """Target cells that source cell ``at`` overlaps."""
    first = F.floor(F.col(at) * target / source).cast("int")
    last = F.least(F.ceil((F.col(at) + 1) * target / source).cast("int") - 1, F.lit(target - 1))
    return F.sequence(first, last)


def _overlap(at: str, cell: str, source: Column, target: int) -> Column:
    """Length shared by source cell ``at`` and target cell ``cell``, in units of 1/target of a source cell."""
    low = F.greatest(F.col(at) * target, F.col(cell) * source)
    high = F.least((F.col(at) + 1) * target, (F.col(cell) + 1) * source)
    return (high - low).cast("long")


def scale(pixels: DataFrame, sizes: DataFrame, width: int, height: int) -> DataFrame:
    """Area-weighted means of colours, weighed by alpha, in a width by height frame.

    Each source pixel is sent to the target cells it overlaps, with whole-number areas, so the
    range join is an explode of a few rows and one aggregation, whose sums are exact.
    """
    w, h = F.col("width"), F.col("height")
    p = pixels.join(sizes.select("image_id", "width", "height"), "image_id")
    p = p.withColumn("tx", F.explode(_cells("x", w, width))).withColumn("ty", F.explode(_cells("y", h, height)))
    area = _overlap("x", "tx", w, width) * _overlap("y", "ty", h, height)
    a = color.channel("rgba", 3).cast("long")
    sums = p.withColumn("area", area).where("area > 0").groupBy("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "width", "height").agg(
        *[F.sum(color.channel("rgba", k).cast("long") * a * F.col("area")).alias(f"s{k}") for k in range(3)], F.sum(a * F.col("area")).alias("sa")
    )
    # a whole-number form of floor(mean + 1/2)
    mean = lambda s, n: F.expr(f"(2 * {s} + {n}) div (2 * {n})").cast("int")
    packed = color.pack(*(mean(f"s{k}", "sa") for k in range(3)), mean("sa", "(width * height)"))
    return sums.select("image_id", "y", "x", F.when(F.col("sa") > 0, packed).otherwise(F.lit(0)).alias("rgba"))


def scale_into(pixels: DataFrame, width: int, height: int, out_width: int, out_height: int, mode: str = "fill") -> DataFrame:
    """Scale images of one size: "fill" stretches; "fit" and "cover" keep proportions, centred, with 0 around or cut off."""
    ids = pixels.select("image_id").distinct()
    sizes = ids.withColumn("width", F.lit(width)).withColumn("height", F.lit(height))
    if mode == "fill":
        return scale(pixels, sizes, out_width, out_height)
    if mode not in ("fit", "cover"):
        raise ValueError(f"unknown mode {mode}")
    by_width, by_height = (out_width, height * out_width // width), (width * out_height // height, out_height)
    w, h = (by_width if (by_width[0] > by_height[0]) == (mode == "cover") else by_height)
    w, h = max(w, 1), max(h, 1)
    scaled = scale(pixels, sizes, w, h)
    # C-like truncation towards zero of half the difference
    return crop(scaled, int((w - out_width) / 2), int((h - out_height) / 2), out_width, out_height)
