"""Weighted histograms, stencils, moments and counts over ``pixels`` tables.

``pixels`` has image_id, layer, y, x, rgba.  Everything here is relational: aggregations
combine on the map side, and a stencil costs one shuffle by image.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALPHA_NONE, ALPHA_PALETTE, ALPHA_PIXEL, ALPHA_RESERVE, Reduction
from ..functions import color

IMAGE = ("image_id", "layer")


def histogram(pixels: DataFrame, keys: tuple[str, ...] = ("image_id",), weight: str | Column | None = None) -> DataFrame:
    """Weight of each distinct rgba within ``keys``; a pixel weighs 1 unless ``weight`` is given."""
    total = F.count("*").cast("double") if weight is None else F.sum(weight)
    return pixels.groupBy(*keys, "rgba").agg(total.alias("weight"))


def neighbours(pixels: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` of the left, right, upper and lower pixel as {name}_l, _r, _u, _d; a missing one is the pixel's own.

    Both windows are satisfied by one distribution by image, so this shuffles once.
    """
    dealt = pixels.withColumn(name, value).repartition(*IMAGE)
    row = Window.partitionBy(*IMAGE, "y").orderBy("x")
    col = Window.partitionBy(*IMAGE, "x").orderBy("y")
    at = F.col(name)

    def beside(w, order: str, step: int) -> Column:
        near = (F.lag if step < 0 else F.lead)(F.struct(order, name), 1).over(w)
        return F.when(near[order] == F.col(order) + step, near[name]).otherwise(at)

    return dealt.withColumns({f"{name}_l": beside(row, "x", -1), f"{name}_r": beside(row, "x", 1)}).withColumns({f"{name}_u": beside(col, "y", -1), f"{name}_d": beside(col, "y", 1)})


def pixel_weights(pixels: DataFrame, reduction: Reduction = Reduction()) -> DataFrame:
    """``pixels`` with a weight that grows with contrast to the four neighbours, and with rgba as the alpha mode sees it.

    Modes "none" and "reserve" drop pixels under the alpha threshold and make the rest opaque;
    "pixel" scales the weight by alpha; "palette" keeps alpha.
    """
    near = neighbours(pixels, color.yiq("rgba")["y"], "__y")
    mean = F.lit(0.25) * (F.col("__y_l") + F.col("__y_r") + F.col("__y_u") + F.col("__y_d"))
    weight = F.greatest(F.lit(16.0) - F.abs(F.lit(16.0) - F.abs(F.col("__y") - mean)) / 8.0, F.lit(1.0))
    alpha, solid = color.channel("rgba", 3), F.col("rgba").bitwiseOR(F.lit(-16777216))
    out = near.withColumn("weight", weight).drop("__y", "__y_l", "__y_r", "__y_u", "__y_d")
    if reduction.alpha_mode in (ALPHA_NONE, ALPHA_RESERVE):
        return out.where(alpha >= reduction.alpha_threshold).withColumn("rgba", solid)
    if reduction.alpha_mode == ALPHA_PIXEL:
        return out.where(alpha > 0).withColumn("weight", F.col("weight") * alpha / 255.0).withColumn("rgba", solid)
    assert reduction.alpha_mode == ALPHA_PALETTE
    return out


def weighted_histogram(pixels: DataFrame, reduction: Reduction = Reduction(), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return histogram(pixel_weights(pixels, reduction), keys, "weight")


def layered_histogram(pixels: DataFrame, reduction: Reduction = Reduction()) -> DataFrame:
    """(image_id, colors array over layers, weight): each place's colours in all layers are one point.

    A place weighs the sum of its layers' weights and is left out only when all are transparent.
    """
    solid = pixel_weights(pixels, reduction).select("image_id", "y", "x", "layer", "rgba", "weight")
    layers = pixels.groupBy("image_id").agg((F.max("layer") + 1).alias("n"))
    points = solid.groupBy("image_id", "y", "x").agg(F.map_from_entries(F.collect_list(F.struct("layer", "rgba"))).alias("m"), F.sum("weight").alias("weight"))
    full = points.join(layers, "image_id").select("image_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.col("m")[k], F.lit(0))).alias("colors"), "weight")
    return full.groupBy("image_id", "colors").agg(F.sum("weight").alias("weight"))


def top_colors(hist: DataFrame, n: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The ``n`` heaviest colours by group; ties go to the smaller rgba.  idx counts from 0."""
    by = Window.partitionBy(*keys).orderBy(F.desc("weight"), "rgba")
    # the filter is on the rank itself, so that each task keeps only its own n before the exchange
    return hist.withColumn("idx", F.row_number().over(by)).where(F.col("idx") <= n).withColumn("idx", F.col("idx") - 1)


def background_moments(pixels: DataFrame) -> DataFrame:
    """Means and mean squares of y, i, q over all pixels: what a Reduction assumes of backgrounds."""
    c = pixels.select(color.yiq("rgba").alias("c"))
    return c.agg(*[F.avg(F.col("c")[n]).alias(f"mean_{n}") for n in "yiq"], *[F.avg(F.col("c")[n] * F.col("c")[n]).alias(f"square_{n}") for n in "yiq"])


def covariance(hist: DataFrame, reduction: Reduction = Reduction(), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Total weight, weighted means and covariances of the scaled y, i, q, a by group (one row each).

    The principal axis is the top eigenvector of this 4 by 4 matrix: see ``principal_axis``.
    """
    scale = dict(zip("yiq", reduction.weights, strict=True)) | {"a": reduction.alpha_square**0.5}
    c = hist.select(*keys, "weight", color.yiq("rgba").alias("c"))
    v = {n: F.col("c")[n] * F.lit(s) for n, s in scale.items()}
    pairs = [(a, b) for k, a in enumerate("yiqa") for b in "yiqa"[k:]]
    sums = c.groupBy(*keys).agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * v[n]).alias(f"s_{n}") for n in "yiqa"], *[F.sum(F.col("weight") * v[a] * v[b]).alias(f"p_{a}{b}") for a, b in pairs])
    mean = {n: F.col(f"s_{n}") / F.col("w") for n in "yiqa"}
    return sums.select(*keys, F.col("w").alias("weight"), *[mean[n].alias(f"mean_{n}") for n in "yiqa"], *[(F.col(f"p_{a}{b}") / F.col("w") - mean[a] * mean[b]).alias(f"cov_{a}{b}") for a, b in pairs])


def principal_axis(row) -> list[float]:
    """Top eigenvector of a ``covariance`` row, its first nonzero component positive."""
    import numpy as np

    names = "yiqa"
    m = np.array([[row[f"cov_{min(a, b, key=names.index)}{max(a, b, key=names.index)}"] for b in names] for a in names])
    axis = np.linalg.eigh(m)[1][:, -1]
    lead = axis[np.argmax(np.abs(axis) > 1e-12)]
    return (axis if lead >= 0 else -axis).tolist()


def placed(rows: DataFrame, keys: tuple[str, ...], coarse: Column, order: tuple[str | Column, ...], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 within ``keys`` in the order (coarse, *order).

    Only the counts of ``coarse`` are put in order by group; rows are sorted within one value of
    it, so that a large group is many tasks.
    """
    at = rows.withColumn("__k", coarse)
    before = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy(*keys, "__k").agg(F.count("*").alias("__n"))
    starts = _renamed(counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), (*keys, "__k"))
    near = Window.partitionBy(*keys, "__k").orderBy(*order)
    out = at.join(starts, _same((*keys, "__k"))).withColumn(name, F.row_number().over(near) - 1 + F.col("__start"))
    return out.drop("__k", "__start", *[f"__of_{k}" for k in (*keys, "__k")])


def _renamed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__of_{k}" for k in keys})


def _same(keys: tuple[str, ...]) -> Column:
    """Equality with the ``_renamed`` keys, nulls being equal."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])


def split_table(scored: DataFrame, keys: tuple[str, ...], score: str = "score", weight: str = "weight", value: tuple[str, ...] = ("y", "i", "q", "a"), step: float = 1.0) -> DataFrame:
    """Running sums along ``score`` and the within-cluster squares left by cutting after each row (wss).

    The best cut of a group is its least wss; the last row, which leaves nothing to the right,
    has none.  Sums are first taken over stretches of ``step`` of the score, and rows are put in
    order within a stretch only.
    """
    w, at = F.col(weight), scored.withColumn("__k", F.floor(F.col(score) / step))
    terms = {"w": w, "sq": sum((w * F.col(v) * F.col(v) for v in value), F.lit(0.0))} | {v: w * F.col(v) for v in value}
    parts = at.groupBy(*keys, "__k").agg(*[F.sum(e).alias(f"__p_{n}") for n, e in terms.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "__k", *[F.coalesce(F.sum(f"__p_{n}").over(before), F.lit(0.0)).alias(f"__s_{n}") for n in terms if n != "sq"], *[F.sum(f"__p_{n}").over(whole).alias(f"__t_{n}") for n in terms])
    by = Window.partitionBy(*keys, "__k").orderBy(score, *value).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(_renamed(starts, (*keys, "__k")), _same((*keys, "__k")))
    out = out.select(*scored.columns, *[(F.sum(e).over(by) + F.col(f"__s_{n}")).alias("w_l" if n == "w" else f"s_{n}") for n, e in terms.items() if n != "sq"], *[f"__t_{n}" for n in terms])
    rest = F.col("__t_w") - F.col("w_l")
    left = sum((F.col(f"s_{v}") * F.col(f"s_{v}") for v in value), F.lit(0.0))
    right = sum(((F.col(f"__t_{v}") - F.col(f"s_{v}")) * (F.col(f"__t_{v}") - F.col(f"s_{v}")) for v in value), F.lit(0.0))
    wss = F.when(rest > 0, F.col("__t_sq") - left / F.col("w_l") - right / rest)
    return out.withColumn("wss", wss).select(*scored.columns, "w_l", *[f"s_{v}" for v in value], "wss")


def count_colors(pixels: DataFrame, keys: tuple[str, ...] = ("image_id",), *, ignore_alpha: bool = False, binary_alpha: bool = False, count_transparent: bool = True, keep_transparent_color: bool = False) -> DataFrame:
    """Exact number of distinct colours by group; transparent ones are one colour unless kept apart."""
    c = F.col("rgba")
    if ignore_alpha:
        c = c.bitwiseOR(F.lit(-16777216))
    if binary_alpha:
        c = F.when(color.channel(c, 3) < 128, c.bitwiseAND(F.lit(0xFFFFFF))).otherwise(c.bitwiseOR(F.lit(-16777216)))
    if not keep_transparent_color:
        c = color.zero_transparent(c)
    seen = pixels.withColumn("__c", c)
    if not count_transparent:
        seen = seen.where(color.channel("__c", 3) != 0)
    return seen.groupBy(*keys).agg(F.count_distinct("__c").alias("colors"))


def image_facts(pixels: DataFrame) -> DataFrame:
    """Per image: area, colours, opaque_colors, translucent, has_transparent (a pixel under half alpha)."""
    seen = pixels.select("image_id", "rgba", color.zero_transparent("rgba").alias("c"), color.channel("rgba", 3).alias("a"))
    return seen.groupBy("image_id").agg(
        F.count("*").alias("area"),
        F.count_distinct("c").alias("colors"),
        F.count_distinct(F.when(F.col("a") != 0, F.col("rgba").bitwiseOR(F.lit(-16777216)))).alias("opaque_colors"),
        F.bool_or(F.col("a").between(5, 250)).alias("translucent"),
        F.bool_or(F.col("a") < 128).alias("has_transparent"),
    )


def average_lightness(hist: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Sum of y over sum of alpha by group, which orders palettes by lightness."""
    c = color.yiq("rgba")
    return hist.groupBy(*keys).agg((F.sum(c["y"]) / F.sum(c["a"])).alias("lightness"))


def symbol_counts(blobs: DataFrame, data: str = "data", *, bits: int = 8, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """How often each byte or (low first) half byte occurs."""
    hexes = blobs.select(*keys, F.explode(F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]" if bits == 4 else "[0-9A-F]{2}"), F.lit(0))).alias("h"))
    return hexes.groupBy(*keys, F.conv("h", 16, 10).cast("int").alias("symbol")).count()


def run_lengths(values: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Maximal runs of equal neighbours: keys, run (from 0), value, start, length."""
    by = Window.partitionBy(*keys).orderBy(order)
    fresh = values.withColumn("__new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1)))
    first = F.row_number().over(by) == 1
    runs = fresh.withColumn("__new", F.when(first, 0).otherwise(F.col("__new"))).withColumn("run", F.sum("__new").over(by))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.min(order).alias("start"), F.count("*").alias("length"))
