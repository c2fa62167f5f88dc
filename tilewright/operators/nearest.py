"""Nearest palette entries: an arg-min join against a palette of at most 256 colours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALPHA_RESERVE, MAX_COLORS, Reduction
from ..functions import color


def yiq_array(rgba: np.ndarray) -> np.ndarray:
    """Rows of premultiplied y, i, q, a, to the last bit as ``color.yiq``: a matrix product may fuse or reorder its sums."""
    v = np.asarray(rgba).astype(np.int64)
    r, g, b = (((v >> s) & 255).astype(float) for s in (0, 8, 16))
    a = ((v >> 24) & 255) / 255.0
    return np.stack([a * (m[0] * r + m[1] * g + m[2] * b) for m in color.TO_YIQ] + [a], axis=-1)


def rgba_array(c: np.ndarray) -> np.ndarray:
    """The inverse, rounded, as signed 32-bit integers."""
    a = c[..., 3:]
    plain = np.where(a > 0, c[..., :3] / np.where(a > 0, a, 1), 0)
    rgb = np.floor(np.clip(plain @ np.array(color.TO_RGB).T, 0, 255) + 0.5).astype(np.int64)
    alpha = np.floor(np.clip(a[..., 0] * 255, 0, 255) + 0.5).astype(np.int64)
    return (rgb[..., 0] | rgb[..., 1] << 8 | rgb[..., 2] << 16 | alpha << 24).astype(np.uint32).view(np.int32)


def differences(points: np.ndarray, palette: np.ndarray, reduction: Reduction) -> np.ndarray:
    """(points, palette) matrix of distances; both have a last axis of four channels, before it perhaps layers.

    Sums run in the order of ``color.distance``, so that distances agree with it to the last bit.
    """
    y, i, q, a = (points[:, None, ..., k] - palette[None, ..., k] for k in range(4))
    wy, wi, wq = reduction.squares
    xy, xi, xq = reduction.interaction
    out = wy * y * y + wi * i * i + wq * q * q
    if a.any():
        out += reduction.alpha_square * a * a - a * (xy * y + xi * i + xq * q)
    return out.sum(axis=-1) if out.ndim == 3 else out


def nearest_entries(points: np.ndarray, palette: np.ndarray, reduction: Reduction) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry of each point; the lowest index among equals."""
    index, least = np.zeros(len(points), np.int64), np.zeros(len(points))
    for at in range(0, len(points), 4096):
        d = differences(points[at : at + 4096], palette, reduction)
        index[at : at + 4096] = d.argmin(axis=1)
        least[at : at + 4096] = d.min(axis=1)
    return index, least


def _checked(palette: Sequence[int]) -> list[int]:
    if not 0 < len(palette) <= MAX_COLORS:
        raise ValueError(f"a palette has 1 to {MAX_COLORS} colours")
    return [int(np.int64(c).astype(np.uint32).view(np.int32)) for c in palette]


def nearest(rgba: str | Column, palette: Sequence[int], reduction: Reduction = Reduction()) -> Column:
    """struct(idx, d) of the nearest palette entry, by vectorised distances in Arrow batches.

    The palette travels in the function's closure, which its size limit keeps small.  In mode
    "reserve", pixels under the alpha threshold get entry 0 and all others one from 1 on.
    """
    colors = yiq_array(np.array(_checked(palette)))
    reserve, threshold = reduction.alpha_mode == ALPHA_RESERVE, reduction.alpha_threshold

    @F.pandas_udf("idx int, d double")
    def find(values: pd.Series) -> pd.DataFrame:
        v = values.to_numpy()
        distinct, back = np.unique(v, return_inverse=True)
        index, d = nearest_entries(yiq_array(distinct), colors[1:] if reserve else colors, reduction)
        if reserve:
            clear = ((distinct.astype(np.int64) >> 24) & 255) < threshold
            index, d = np.where(clear, 0, index + 1), np.where(clear, 0.0, d)
        return pd.DataFrame({"idx": index[back].astype("int32"), "d": d[back]})

    return find(rgba)


def nearest_expr(rgba: str | Column, palette: Sequence[int], reduction: Reduction = Reduction()) -> Column:
    """The same as one built-in expression: the least struct(d, idx) over a literal palette."""
    point = color.yiq(rgba)
    found = [F.struct(color.distance(point, F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("yiqa", c, strict=True))), reduction).alias("d"), F.lit(k).alias("idx")) for k, c in enumerate(yiq_array(np.array(_checked(palette))))]
    return F.array_min(F.array(*found))


def nearest_join(pixels: DataFrame, palettes: DataFrame, reduction: Reduction = Reduction(), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Each distinct colour of a group against its group's palette table (keys, idx, entry): keys, rgba, n, idx, d.

    Colours are counted first, so distances are computed per distinct colour, not per pixel.  The
    colours of a group, which grow with the data, are dealt out by a hash; its palette of at most
    256 entries goes to each of those parts and comes first there, so every task finds the
    entries of its colours by vectorised distances, in Arrow batches of any size.  Nothing is
    broadcast and no pair is ever a row.  Colours of a group without a palette are left out.
    """
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("rgba"), F.lit(tasks)).cast("int")
    seen = pixels.groupBy(*keys, "rgba").agg(F.count("*").alias("n"))
    colors = seen.select(*keys, part.alias("__part"), F.lit(256).alias("idx"), "rgba", "n")
    entries = palettes.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("__part"), F.col("idx").cast("int"), F.col("entry").cast("int").alias("rgba"), F.lit(0).cast("long").alias("n"))
    dealt = entries.unionByName(colors).repartition(tasks, *keys, "__part").sortWithinPartitions(*keys, "__part", "idx")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, palette, index = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            idx, rgba = (batch.column(width + k).to_numpy() for k in (1, 2))
            marks = batch.select(range(width + 1))
            # groups are adjacent: they start where any key changes
            codes = np.stack([pc.fill_null(pc.index_in(c, c.unique()), -1).to_numpy(zero_copy_only=False) for c in marks.columns])
            starts = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)])) if batch.num_rows else []
            best, least, found = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(c[int(s)].as_py() for c in marks.columns)
                if here != group:
                    group, palette, index = here, np.zeros(0, np.int64), np.zeros(0, np.int64)
                first = s + int(np.searchsorted(idx[s:e], 256))
                if first > s:
                    palette, index = np.concatenate([palette, rgba[s:first]]), np.concatenate([index, idx[s:first]])
                if first < e and len(palette):
                    k, d = nearest_entries(yiq_array(rgba[first:e]), yiq_array(palette), reduction)
                    best[first:e], least[first:e], found[first:e] = index[k], d, True
            columns = [*batch.columns[:width], *batch.columns[width + 2 :], pa.array(best), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "rgba", "n", "idx", "d"]).filter(pa.array(found))

    types = {f.name: f.dataType.simpleString() for f in seen.schema}
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rgba int, n bigint, idx int, d double")


def palette_error(nearest_rows: DataFrame, keys: tuple[str, ...] = ("image_id",), limit: float | None = None, weight: str = "n") -> DataFrame:
    """Weighted sum of distances by group, at most ``limit``."""
    total = F.sum(F.col(weight) * F.col("d"))
    return nearest_rows.groupBy(*keys).agg((F.least(total, F.lit(limit)) if limit else total).alias("error"))


def lookup(indices: DataFrame, palette: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``indices`` (keys, idx, ...) with the palette's entry; an index beyond the palette gives 0."""
    return indices.join(palette.select(*keys, "idx", "entry"), [*keys, "idx"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))


def best_palettes(tiles: DataFrame, palettes: DataFrame, reduction: Reduction = Reduction()) -> DataFrame:
    """Each tile's palette of least error: image_id, tile_no, palette, error.

    ``tiles``: image_id, tile_no, rgba, n (colour counts); ``palettes``: image_id, palette, idx,
    entry, at most 16 of them an image.  Ties go to the lower palette number.
    """
    pairs = tiles.join(palettes, "image_id").select("image_id", "tile_no", "palette", "rgba", "n", color.distance(color.yiq("rgba"), color.yiq("entry"), reduction).alias("d"))
    least = pairs.groupBy("image_id", "tile_no", "palette", "rgba", "n").agg(F.min("d").alias("d"))
    errors = least.groupBy("image_id", "tile_no", "palette").agg(F.sum(F.col("n") * F.col("d")).alias("error"))
    best = errors.groupBy("image_id", "tile_no").agg(F.min(F.struct("error", "palette")).alias("s"))
    return best.select("image_id", "tile_no", F.col("s.palette").alias("palette"), F.col("s.error").alias("error"))
