"""Texture encoding by format, and decoding of every format as the round-trip check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import ALPHA_NONE, ALPHA_PALETTE, ALPHA_RESERVE, Reduction
from ..functions.texture import FORMATS, INDEX_COLORS, TEXEL_BITS
from .blocks4 import decode_blocks, encode_blocks
from .dither import _diffused, blurred, index_image, index_layers
from .nearest import differences, rgba_array, yiq_array
from .palette import create_palette, snap15_array

OUT = "image_id bigint, fmt int, width int, height int, param int, texel binary, pidx binary, palette binary"


def next_side(n: int) -> int:
    return max(8, 1 << (n - 1).bit_length())


def pad_image(rgba: np.ndarray) -> np.ndarray:
    """Grown to power-of-two sides by repeating the last row and column."""
    h, w = rgba.shape
    return np.pad(rgba, ((0, next_side(h) - h), (0, next_side(w) - w)), mode="edge")


def colors15(rgba: np.ndarray) -> np.ndarray:
    """Little-endian 15-bit words of colours."""
    v = np.asarray(rgba).astype(np.int64)
    five = [(((v >> s) & 255) * 62 + 255) // 510 for s in (0, 8, 16)]
    return (five[0] | five[1] << 5 | five[2] << 10).astype("<u2")


def colors24(words: np.ndarray) -> np.ndarray:
    """Colours of 15-bit words, alpha 0."""
    v = np.asarray(words).astype(np.int64)
    eight = [(((v >> s) & 31) * 510 + 31) // 62 for s in (0, 5, 10)]
    return eight[0] | eight[1] << 8 | eight[2] << 16


def pack_bits(indices: np.ndarray, bits: int) -> bytes:
    """Indices in bytes, first pixel lowest."""
    per = 8 // bits
    flat = np.zeros(-(-indices.size // per) * per, np.uint8)
    flat[: indices.size] = indices.ravel()
    return (flat.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * bits)).sum(axis=1).astype(np.uint8).tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    per = 8 // bits
    raw = np.frombuffer(data, np.uint8)
    return ((raw[:, None] >> (np.arange(per) * bits)) & ((1 << bits) - 1)).ravel()


def histogram_of(rgba: np.ndarray, reduction: Reduction) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours with the weight of their contrast to neighbours, as operators.histogram has it."""
    y = yiq_array(rgba)[..., 0]
    p = np.pad(y, 1, mode="edge")
    mean = 0.25 * (p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1])
    weight = np.maximum(16 - np.abs(16 - np.abs(y - mean)) / 8, 1)
    alpha = (rgba.astype(np.int64) >> 24) & 255
    use = np.ones(rgba.shape, bool)
    if reduction.alpha_mode in (ALPHA_NONE, ALPHA_RESERVE):
        use = alpha >= reduction.alpha_threshold
    elif reduction.alpha_mode != ALPHA_PALETTE:
        use, weight = alpha > 0, weight * alpha / 255
    colors = rgba[use] | (0 if reduction.alpha_mode == ALPHA_PALETTE else np.int32(-16777216))
    distinct, back = np.unique(colors, return_inverse=True)
    return distinct, np.bincount(back, weight[use], minlength=len(distinct))


def palette_for(rgba: np.ndarray, n: int, reduction: Reduction) -> np.ndarray:
    colors, weight = histogram_of(rgba, reduction)
    return create_palette(yiq_array(colors[:, None]), weight, n, reduction)[:, 0] if len(colors) else np.zeros(0, np.int32)


def nearest15(rgba: np.ndarray, reduction: Reduction) -> np.ndarray:
    """Nearest of all 15-bit colours.

    The rounded colour of each channel is near, but distance weighs channels unequally, so each
    distinct colour is compared with all neighbours one step around it.
    """
    distinct, back = np.unique(rgba & 0xFFFFFF, return_inverse=True)
    base = colors15(distinct).astype(np.int64)
    around = np.array([(r, g, b) for r in (-1, 0, 1) for g in (-1, 0, 1) for b in (-1, 0, 1)])
    parts = np.stack([(base >> s) & 31 for s in (0, 5, 10)], axis=1)[:, None] + around[None]
    parts = np.clip(parts, 0, 31)
    words = parts[..., 0] | parts[..., 1] << 5 | parts[..., 2] << 10
    points = yiq_array(distinct | np.int64(0xFF000000))
    d = np.array([differences(points[i][None], yiq_array(colors24(words[i]) | 0xFF000000), reduction)[0] for i in range(len(distinct))])
    best = d == d.min(axis=1, keepdims=True)
    return np.where(best, words, 1 << 16).min(axis=1)[back].reshape(rgba.shape)


def diffused15(rgba: np.ndarray, reduction: Reduction, amount: float) -> np.ndarray:
    """15-bit words of all visible pixels with error diffusion; ``amount`` is its share.

    The nearest word of a diffused colour is sought from the rounded one, a step at a time in all
    channels, until no neighbour is nearer.
    """
    every = yiq_array(colors24(np.arange(1 << 15)) | 0xFF000000)
    around = np.array([(r, g, b) for r in (-1, 0, 1) for g in (-1, 0, 1) for b in (-1, 0, 1)])
    solid = rgba | np.int32(-16777216)
    points, plain = yiq_array(solid), nearest15(solid, reduction)
    mean = blurred(points)
    gap = mean - every[nearest15(rgba_array(mean), reduction)]
    off = (gap[..., :3] ** 2) @ np.array(reduction.squares)

    def find(wanted: np.ndarray) -> int:
        at = int(colors15(rgba_array(wanted[0]))[0])
        while True:
            parts = np.clip(np.array([at & 31, at >> 5 & 31, at >> 10]) + around, 0, 31)
            words = np.unique(parts[:, 0] | parts[:, 1] << 5 | parts[:, 2] << 10)
            d = differences(wanted[0], every[words], reduction)[0]
            if d.min() >= d[words == at][0]:
                return at
            at = int(words[d.argmin()])

    clear = ((rgba.astype(np.int64) >> 24) & 255) < 128
    return _diffused(points[:, :, None], mean[:, :, None], plain, off, find, lambda k: every[k][None], clear, reduction, amount)


def param_of(width: int, height: int, fmt: int, transparent0: bool) -> int:
    return fmt << 26 | (width.bit_length() - 4) << 20 | (height.bit_length() - 4) << 23 | transparent0 << 29


def encode_image(rgba: np.ndarray, fmt: int, reduction: Reduction, *, n_colors: int | None = None, transparent0: bool = False, diffuse: float = 0.0, dither_alpha: bool = False, fixed: np.ndarray | None = None, threshold: int = 0) -> tuple[int, bytes, bytes, bytes]:
    """(param, texel, pidx, palette) of one image, padded to power-of-two sides."""
    px = pad_image(rgba)
    h, w = px.shape
    alpha = (px.astype(np.int64) >> 24) & 255
    param = param_of(w, h, fmt, transparent0)
    if fmt == FORMATS["direct"]:
        words = (diffused15(px, reduction, diffuse) if diffuse > 0 else nearest15(px, reduction)) | np.where(alpha >= 128, 0x8000, 0)
        return param, np.where(alpha >= 128, words, 0).astype("<u2").tobytes(), b"", b""
    if fmt == FORMATS["tex4x4"]:
        texel, pidx, colors = encode_blocks(px, reduction, n_colors or 256, threshold)
        return param, texel, pidx, colors.tobytes()
    limit = INDEX_COLORS[fmt]
    n = min(n_colors or limit, limit)
    if fmt in (FORMATS["a3i5"], FORMATS["a5i3"]):
        levels, shift = (7, 5) if fmt == FORMATS["a3i5"] else (31, 3)
        colors = fixed if fixed is not None else palette_for(px, n, reduction)
        solid = px | np.int32(-16777216)
        index = index_image(solid, colors, reduction, diffuse) if len(colors) else np.zeros(px.shape, np.int64)
        level = (alpha * 2 * levels + 255) // 510
        if dither_alpha:
            level = _dithered_levels(alpha, levels)
        return param, (index | level << shift).astype(np.uint8).tobytes(), b"", colors15(colors).tobytes()
    mode = Reduction(reduction.balance, reduction.color_balance, reduction.enhance, ALPHA_RESERVE if transparent0 else ALPHA_NONE)
    if fixed is not None:
        colors = fixed
    else:
        colors = palette_for(px, n - transparent0, mode)
        if transparent0:
            colors = np.concatenate([np.zeros(1, np.int32), colors])
    shown = px if transparent0 else px | np.int32(-16777216)
    index = index_image(shown, colors | np.int32(-16777216) if not transparent0 else np.concatenate([colors[:1], colors[1:] | np.int32(-16777216)]), mode, diffuse) if len(colors) else np.zeros(px.shape, np.int64)
    return param, pack_bits(index, TEXEL_BITS[fmt]), b"", colors15(colors).tobytes()


def _dithered_levels(alpha: np.ndarray, levels: int) -> np.ndarray:
    """Alpha levels with the rounding error passed on along rows that alternate direction."""
    h, w = alpha.shape
    error = np.zeros((h + 1, w + 2))
    out = np.zeros((h, w), np.int64)
    for r in range(h):
        step = 1 if r % 2 == 0 else -1
        for c in range(w)[::step]:
            a = alpha[r, c]
            if a in (0, 255):
                out[r, c] = 0 if a == 0 else levels
                continue
            wanted = min(max(a + error[r, c + 1], 0), 255)
            out[r, c] = int((int(wanted) * 2 * levels + 255) // 510)
            left = wanted - out[r, c] * 255 / levels
            for share, (dr, dc) in zip((7, 3, 5, 1), ((0, step), (1, -step), (1, 0), (1, step)), strict=True):
                error[r + dr, c + 1 + dc] += left * share / 16
    return out


def decode_image(param: int, texel: bytes, pidx: bytes, palette: bytes, height: int | None = None) -> np.ndarray:
    """The rgba image that a texture shows."""
    fmt, w, h, clear0 = param >> 26 & 7, 8 << (param >> 20 & 7), height or 8 << (param >> 23 & 7), param >> 29 & 1
    colors = np.concatenate([colors24(np.frombuffer(palette, "<u2")), np.zeros(1, np.int64)])
    entry = lambda i: colors[np.minimum(i, len(colors) - 1)]
    if fmt == FORMATS["direct"]:
        words = np.frombuffer(texel, "<u2")[: w * h].astype(np.int64)
        out = colors24(words) | np.where(words & 0x8000, 0xFF000000, 0)
    elif fmt == FORMATS["tex4x4"]:
        return decode_blocks(np.frombuffer(texel, "<u4"), np.frombuffer(pidx, "<u2"), np.frombuffer(palette, "<u2"), w, h)
    elif fmt in (FORMATS["a3i5"], FORMATS["a5i3"]):
        raw = np.frombuffer(texel, np.uint8)[: w * h].astype(np.int64)
        bits = 5 if fmt == FORMATS["a3i5"] else 3
        level = raw >> bits
        five = level << 2 | level >> 1 if bits == 5 else level
        out = entry(raw & ((1 << bits) - 1)) | ((five * 510 + 31) // 62) << 24
    else:
        index = unpack_bits(texel, TEXEL_BITS[fmt])[: w * h].astype(np.int64)
        out = np.where((index == 0) & bool(clear0), 0, entry(index) | 0xFF000000)
    return out.astype(np.uint32).view(np.int32).reshape(h, w)


def trim(param: int, texel: bytes, pidx: bytes, height: int) -> tuple[bytes, bytes, int]:
    """Texel and index data without the rows that only pad; whole rows of blocks for 4x4."""
    fmt, w = param >> 26 & 7, 8 << (param >> 20 & 7)
    if fmt == FORMATS["tex4x4"]:
        rows = (height + 3) & ~3
        return texel[: w * rows // 4], pidx[: w * rows // 8], rows
    return texel[: w * TEXEL_BITS[fmt] // 8 * height], pidx, height


def encode_textures(images: DataFrame, fmt: str | None = None, reduction: Reduction = Reduction(), **options) -> DataFrame:
    """Textures of ``images`` (image_id, width, height, px binary): one row each, see OUT.

    ``fmt`` is a format's name, or None for a column ``fmt`` (name) in ``images``.  Images are
    independent and stream through Arrow batches.
    """
    if fmt is not None and fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                rgba = np.frombuffer(r.px, "<i4").reshape(r.height, r.width)
                kind = FORMATS[fmt or r.fmt]
                param, texel, pidx, palette = encode_image(rgba, kind, reduction, **options)
                out.append((r.image_id, kind, r.width, r.height, param, texel, pidx, palette))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return images.mapInPandas(run, OUT)


def decode_textures(textures: DataFrame) -> DataFrame:
    """Rows of OUT back to images, at their own size: image_id, width, height, px."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                px = decode_image(r.param, r.texel, r.pidx, r.palette)[: r.height, : r.width]
                out.append((r.image_id, r.width, r.height, np.ascontiguousarray(px).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "px"])

    return textures.mapInPandas(run, "image_id bigint, width int, height int, px binary")


def encode_layers(layers: list[np.ndarray], n: int, reduction: Reduction, fmt: int, diffuse: float = 0.0) -> tuple[bytes, list[bytes]]:
    """One index image for several images and a palette for each: (texel, palettes).

    A place's colours in all images are one point; places transparent in every image take no
    part.  Entries alike in all palettes come first.
    """
    from .palette import sort_palette

    px = np.stack([pad_image(x) for x in layers], axis=-1)
    solid = px | np.int32(-16777216)
    flat, back = np.unique(solid.reshape(-1, len(layers)), axis=0, return_inverse=True)
    weight = np.bincount(back.ravel(), minlength=len(flat)).astype(float)
    made = create_palette(yiq_array(flat), weight, n, reduction)
    made = sort_palette(made, reduction, same_first=True)
    index = index_layers(solid, made, reduction, diffuse)
    return pack_bits(index, TEXEL_BITS[fmt]), [colors15(made[:, k]).tobytes() for k in range(len(layers))]


__all__ = ["encode_textures", "decode_textures", "encode_image", "decode_image", "encode_layers", "trim", "snap15_array"]
