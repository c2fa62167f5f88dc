"""Bit packing, 8x8 tiles, their symmetries, merging and screens."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALPHA_NONE, ALPHA_RESERVE, Reduction
from ..functions import color
from ..functions.texture import screen_entry
from .dither import index_image
from .histogram import placed
from .nearest import differences, nearest_entries, yiq_array

SIDE = 8
#: Index masks of the symmetries none, X, Y, XY on a row-major 8x8 tile.
FLIPS = (0, 7, 56, 63)
#: Pairs held between two merging passes.
BATCH = 64


def pack_indices(indices: DataFrame, keys: tuple[str, ...], order: str, value: str, bits: int) -> DataFrame:
    """Indices packed into bytes, first pixel in the low bits: keys, byte_no, byte."""
    per = 8 // bits
    at = F.pmod(order, F.lit(per)).cast("int")
    piece = F.call_function("shiftleft", F.col(value).bitwiseAND(F.lit((1 << bits) - 1)), at * bits)
    return indices.groupBy(*keys, F.floor(F.col(order) / per).cast("long").alias("byte_no")).agg(F.bit_or(piece).cast("int").alias("byte"))


def unpack_indices(packed: DataFrame, keys: tuple[str, ...], bits: int) -> DataFrame:
    """The inverse: keys, i, value."""
    per = 8 // bits
    parts = F.array(*[F.shiftright("byte", k * bits).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(per)])
    return packed.select(*keys, "byte_no", F.posexplode(parts).alias("k", "value")).select(*keys, (F.col("byte_no") * per + F.col("k")).alias("i"), "value")


def packed_blob(packed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bytes of each group as one binary; groups are as large as an image."""
    pairs = F.array_sort(F.collect_list(F.struct("byte_no", "byte")))
    return packed.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(pairs, lambda p: F.lpad(F.hex(p["byte"].cast("long")), 2, "0")), "")).alias("data"))


def split_tiles(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """(image_id, tile_y, tile_x, px array in row order) of every tile; absent pixels are transparent black.

    Of several pixels at one place the least rgba counts.
    """
    ty, tx = (F.floor(F.col(c) / side).cast("int") for c in ("y", "x"))
    at = (F.pmod("y", F.lit(side)) * side + F.pmod("x", F.lit(side))).alias("k")
    tiles = pixels.groupBy("image_id", ty.alias("tile_y"), tx.alias("tile_x")).agg(F.array_sort(F.collect_list(F.struct(at, "rgba"))).alias("p"))
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    filled = F.transform(places, lambda k: F.coalesce(F.get(F.filter("p", lambda s: s["k"] == k), F.lit(0))["rgba"], F.lit(0)))
    return tiles.select("image_id", "tile_y", "tile_x", F.when(F.col("p.k") == places, F.col("p.rgba")).otherwise(filled).alias("px"))


def flipped(px: str | Column, flip: int) -> Column:
    """A tile mirrored by one of the four symmetries."""
    px = F.col(px) if isinstance(px, str) else px
    return px if not FLIPS[flip] else F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.element_at(px, k.bitwiseXOR(F.lit(FLIPS[flip])) + 1))


def canonical(px: str | Column, flips: bool = True) -> Column:
    """struct(px, flip): the least of the tile's mirror images and the first symmetry that gives it."""
    return F.array_min(F.array(*[F.struct(flipped(px, k).alias("px"), F.lit(k).alias("flip")) for k in range(4 if flips else 1)]))


def dedup_tiles(tiles: DataFrame, order: tuple[str, ...] = ("tile_y", "tile_x"), flips: bool = True) -> DataFrame:
    """``tiles`` with master (tile number in ``order`` of the first equal tile), flip from it, and represents.

    Equality is on the canonical form.  Tiles are numbered by counts of their rows, and masters
    come from an aggregation by form, which combines equal tiles (blank ones, say) before the
    shuffle, joined back.
    """
    formed = tiles.withColumn("__c", canonical("px", flips)).withColumn("__form", F.col("__c.px")).withColumn("__turn", F.col("__c.flip")).drop("__c")
    numbered = placed(formed, ("image_id",), F.col(order[0]), order, "tile_no").withColumn("tile_no", F.col("tile_no").cast("int"))
    first = F.min(F.col("tile_no").cast("long") * 4 + F.col("__turn")).alias("__first")
    masters = numbered.groupBy(F.col("image_id").alias("__image"), F.col("__form").alias("__of")).agg(first, F.count("*").alias("represents"))
    out = numbered.join(masters, F.col("image_id").eqNullSafe(F.col("__image")) & (F.col("__form") == F.col("__of")))
    master, turn = F.floor(F.col("__first") / 4).cast("int"), F.col("__first").bitwiseAND(F.lit(3)).cast("int")
    return out.withColumn("master", master).withColumn("flip", F.col("__turn").bitwiseXOR(turn)).drop("__form", "__turn", "__image", "__of", "__first")


def tile_difference(a: Column, b: Column, reduction: Reduction = Reduction()) -> Column:
    """Sum of pixel distances of two tiles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: color.distance(color.yiq(x), color.yiq(y), reduction)), F.lit(0.0), lambda s, d: s + d)


def tile_pairs(tiles: DataFrame, reduction: Reduction = Reduction(), flips: bool = True) -> DataFrame:
    """Every pair of an image's distinct tiles, a < b: image_id, a, b, d, flip (first among equals).

    All pairs of an image are the operator's result; pass masters only, and images of at most
    a few thousand tiles.
    """
    a = tiles.select("image_id", F.col("tile_no").alias("a"), F.col("px").alias("pa"))
    b = tiles.select("image_id", F.col("tile_no").alias("b"), F.col("px").alias("pb"))
    options = F.array(*[F.struct(tile_difference(F.col("pa"), flipped("pb", k), reduction).alias("d"), F.lit(k).alias("flip")) for k in range(4 if flips else 1)])
    return a.join(b, (a["image_id"] == b["image_id"]) & (F.col("a") < F.col("b"))).select(a["image_id"], "a", "b", F.array_min(options).alias("s")).select("image_id", "a", "b", F.col("s.d").alias("d"), F.col("s.flip").alias("flip"))


def mean_tiles(members: DataFrame) -> DataFrame:
    """Average pixel of each master's members, after turning them by their flip: image_id, master, k, y, i, q, a."""
    turned = F.element_at(F.array(*[flipped("px", k) for k in range(4)]), F.col("flip") + 1)
    px = members.select("image_id", "master", F.posexplode(turned).alias("k", "rgba")).withColumn("c", color.yiq("rgba"))
    return px.groupBy("image_id", "master", "k").agg(*[F.avg(F.col("c")[n]).alias(n) for n in "yiqa"])


def merge_tiles(px: np.ndarray, limit: int, reduction: Reduction, flips: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(master, flip, mean pixels) after merging tiles until at most ``limit`` masters are left.

    Each pass takes the BATCH cheapest pairs, a pair's difference being weighed by the square of
    how many tiles it would stand for, and merges those whose tiles no earlier pair of the pass
    has touched.  Distances between unmerged tiles are computed once; masters keep the pixels of
    their first tile until the end.
    """
    n = len(px)
    points = yiq_array(px)
    master, flip, size = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
    count = len(FLIPS) if flips else 1
    least, turn = np.full((n, n), np.inf), np.zeros((n, n), np.int64)
    w = np.array(reduction.squares)
    for f in range(count):
        other = points[:, np.arange(64) ^ FLIPS[f]]
        for i in range(n):
            d = points[i][None] - other[i + 1 :]
            v = ((d[..., :3] ** 2) @ w + reduction.alpha_square * d[..., 3] ** 2 - d[..., 3] * (d[..., :3] @ np.array(reduction.interaction))).sum(axis=1)
            better = v < least[i, i + 1 :]
            least[i, i + 1 :][better] = v[better]
            turn[i, i + 1 :][better] = f
    alive = np.ones(n, bool)

    def join(a: int, b: int) -> None:
        mine = master == b
        master[mine], flip[mine] = a, flip[mine] ^ turn[a, b]
        size[a] += size[b]
        alive[b] = False
        least[b, :] = least[:, b] = np.inf

    for a, b in np.argwhere(least == 0):
        if alive[a] and alive[b]:
            join(int(a), int(b))
    while alive.sum() > limit:
        cost = least * (size[:, None] + size[None, :]).astype(float) ** 2
        flat = np.argsort(cost, axis=None, kind="stable")[: BATCH]
        touched: set[int] = set()
        for k in flat:
            a, b = divmod(int(k), n)
            if alive.sum() <= limit or not np.isfinite(cost[a, b]):
                break
            if a in touched or b in touched:
                continue
            join(a, b)
            touched |= {a, b}
    mean = np.zeros_like(points)
    for m in np.flatnonzero(alive):
        mine = np.flatnonzero(master == m)
        mean[m] = np.mean([points[t][np.arange(64) ^ FLIPS[flip[t]]] for t in mine], axis=0)
    return master, flip, mean


def reduce_tiles(tiles: DataFrame, limit: int, reduction: Reduction = Reduction(), flips: bool = True) -> DataFrame:
    """Tiles (image_id, tile_no, px) merged to at most ``limit`` masters an image: image_id, tile_no, master, flip, char_no, px.

    Exact copies should have been dropped before.  An image is one task: its merges depend on
    each other.
    """
    from .nearest import rgba_array

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile_no")
        px = np.array(rows["px"].tolist())
        master, flip, mean = merge_tiles(px, limit, reduction, flips)
        number = {m: k for k, m in enumerate(np.unique(master))}
        numbers = rows["tile_no"].to_numpy()
        return pd.DataFrame({"image_id": key[0], "tile_no": numbers, "master": numbers[master], "flip": flip.astype("int32"), "char_no": [number[m] for m in master], "px": [rgba_array(mean[m]).tolist() for m in master]})

    return tiles.groupBy("image_id").applyInPandas(run, "image_id bigint, tile_no int, master int, flip int, char_no int, px array<int>")


def panel_order(screen: DataFrame, tiles_x: Column | str, tiles_y: Column | str) -> DataFrame:
    """Entries (image_id, ty, tx, entry) with their place ``pos`` in 32x32 panels, row by row; edge panels are packed.

    The place is arithmetic, so no sort or window is needed.
    """
    w, h = (F.col(c) if isinstance(c, str) else c for c in (tiles_x, tiles_y))
    py, px = (F.floor(F.col(c) / 32).cast("int") for c in ("ty", "tx"))
    ph, pw = F.least(h - py * 32, F.lit(32)), F.least(w - px * 32, F.lit(32))
    before = py * 32 * w + px * 32 * ph
    return screen.withColumn("pos", before + F.pmod("ty", F.lit(32)) * pw + F.pmod("tx", F.lit(32)))


def affine_entries(screen: DataFrame) -> DataFrame:
    """Entries cut to their low eight bits."""
    return screen.withColumn("entry", F.col("entry").bitwiseAND(F.lit(255)))


def assemble_screen(tiles: DataFrame, chars: list[list[int]], palettes: list[list[int]], reduction: Reduction = Reduction(), transparent0: bool = True) -> DataFrame:
    """Each tile's best existing character, palette and flip: image_id, tile_no, char, palette, flip, error, entry.

    ``chars`` (64 indices each) and ``palettes`` are given and small (1024 by 64, 16 by 256 at most),
    so they travel with the function; tiles stream by in Arrow batches.  Index 0 matches
    anything while ``transparent0`` holds.  Errors are taken to thousandths, so that sums
    in another order tie alike; ties go to the lower character, palette, flip.
    """
    if len(chars) > 1024 or len(palettes) > 16:
        raise ValueError("too many characters or palettes")
    ch = np.array(chars, np.int64).reshape(-1, 64)
    colors = [yiq_array(np.array(p, np.int64)) for p in palettes]

    @F.pandas_udf("char int, palette int, flip int, error double")
    def best(tiles_px: pd.Series) -> pd.DataFrame:
        out = []
        for px in tiles_px:
            points = yiq_array(np.array(px))
            found = (np.inf, 0, 0, 0)
            for p, pal in enumerate(colors):
                d = differences(points, pal, reduction)
                if transparent0:
                    d[:, 0] = 0.0
                for f, m in enumerate(FLIPS):
                    index = ch[:, np.arange(64) ^ m]
                    errors = np.floor(d[np.arange(64)[None], np.minimum(index, len(pal) - 1)].sum(axis=1) * 1000 + 0.5) / 1000
                    k = int(errors.argmin())
                    found = min(found, (float(errors[k]), k, p, f))
            out.append((found[1], found[2], found[3], found[0]))
        return pd.DataFrame(out, columns=["char", "palette", "flip", "error"]).astype({"char": "int32", "palette": "int32", "flip": "int32"})

    out = tiles.withColumn("s", best("px")).select("image_id", "tile_no", "s.char", "s.palette", "s.flip", "s.error")
    return out.withColumn("entry", screen_entry("char", "flip", "palette"))


def index_tiles(px: np.ndarray, palette: np.ndarray, reduction: Reduction, opaque0: bool = False, amount: float = 0.0) -> np.ndarray:
    """Nearest indices of a tile's pixels; without ``opaque0``, index 0 is for transparent pixels only.

    With ``amount``, that share of the error is diffused within the tile.
    """
    if amount > 0 and len(palette) > (0 if opaque0 else 1):
        mode = replace(reduction, alpha_mode=ALPHA_NONE if opaque0 else ALPHA_RESERVE)
        solid = palette | np.int32(-16777216)
        return index_image(px.reshape(SIDE, SIDE), solid, mode, amount).ravel()
    points = yiq_array(px)
    if opaque0:
        return nearest_entries(points, yiq_array(palette), reduction)[0]
    clear = ((px.astype(np.int64) >> 24) & 255) < 128
    if len(palette) < 2:
        return np.zeros(len(px), np.int64)
    return np.where(clear, 0, nearest_entries(points, yiq_array(palette[1:]), reduction)[0] + 1)


def overlay(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Existing rows with the generated ones written over them."""
    n, o = new.withColumnRenamed(value, "__new"), old.withColumnRenamed(value, "__old")
    return n.join(o, keys, "full_outer").select(*keys, F.coalesce("__new", "__old").alias(value))
