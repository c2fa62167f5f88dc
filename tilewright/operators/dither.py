"""Indexing of whole images with error diffusion, which is sequential within an image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import ALPHA_PALETTE, ALPHA_PIXEL, ALPHA_RESERVE, Reduction
from ..functions.color import DIFFUSE_CURVE
from .nearest import differences, nearest_entries, yiq_array

# Shares of the error for the pixels ahead, behind-below, below, ahead-below, in sixteenths.
SHARES = (7, 3, 5, 1)
# Weights of the neighbourhood's near and far pixels.
NEAR, FAR = 0.1875, 0.125
# A pixel passes its error on if, in units of the squared weight of y, its surroundings are less than
# the first from it and the nearest entry is more than the second from its surroundings.
CALM, OFF = 110.0, 2.0


def _curve(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    for k, name in enumerate("yiqy"):
        power, factor = DIFFUSE_CURVE[name]
        x = v[k] * 511 if k == 3 else v[k]
        size = abs(x)
        bent = size if size <= 8 else 8 + (size - 8) ** power * factor
        out[k] = np.copysign(bent, x) / (511 if k == 3 else 1)
    return out


def blurred(points: np.ndarray) -> np.ndarray:
    """Neighbourhood means that decide where to diffuse: three sixteenths each of the pixel, its left, right and upper neighbours, an eighth of both upper corners."""
    p = np.pad(points, ((1, 0), (1, 1), (0, 0)), mode="edge")
    mid, up = p[1:], p[:-1]
    return NEAR * (mid[:, 1:-1] + mid[:, :-2] + mid[:, 2:] + up[:, 1:-1]) + FAR * (up[:, :-2] + up[:, 2:])


def index_image(rgba: np.ndarray, palette: np.ndarray, reduction: Reduction, amount: float = 0.0) -> np.ndarray:
    """Palette indices of a (height, width) image; ``amount`` is the diffused share of the error.

    Rows run in turns left and right.  Where a pixel is much like its neighbourhood's mean and
    the nearest entry is not so near to that mean, the mean plus the error gathered there, scaled
    by ``amount`` and then bent by the tapering curve, is matched instead of the pixel, and what
    the entry leaves is passed on; elsewhere errors end, so edges are crisp.  Without diffusion
    each pixel gets its nearest entry.
    """
    points = yiq_array(rgba)
    h, w = rgba.shape
    alpha = (rgba.astype(np.int64) >> 24) & 255
    clear = (alpha < reduction.alpha_threshold) if reduction.alpha_mode == ALPHA_RESERVE else np.zeros_like(alpha, bool)
    first = 1 if reduction.alpha_mode == ALPHA_RESERVE and len(palette) > 1 else 0
    if reduction.alpha_mode != ALPHA_PALETTE:
        # opaque where visible
        solid = np.where(points[..., 3:] > 0, points[..., :3] / np.where(points[..., 3:] > 0, points[..., 3:], 1), points[..., :3])
        points = np.concatenate([solid, np.where(points[..., 3:] > 0, 1.0, 0.0) if reduction.alpha_mode != ALPHA_PIXEL else np.ones_like(points[..., 3:])], axis=-1)
    colors = yiq_array(palette)[first:]
    if amount <= 0:
        flat, back = np.unique(points.reshape(-1, 4), axis=0, return_inverse=True)
        found = nearest_entries(flat, colors, reduction)[0][back.ravel()].reshape(h, w) + first
        return np.where(clear, 0, found)
    mean = blurred(points)
    flat = lambda p: nearest_entries(p.reshape(-1, 4), colors, reduction)
    plain, off = flat(points)[0].reshape(h, w), flat(mean)[1].reshape(h, w)
    find = lambda wanted: int(differences(wanted, colors[:, None], reduction)[0].argmin())
    out = _diffused(points[:, :, None], mean[:, :, None], plain, off, find, lambda k: colors[k][None], clear, reduction, amount, reduction.alpha_mode == ALPHA_PALETTE)
    return np.where(clear, 0, out + first)


def _diffused(points: np.ndarray, mean: np.ndarray, plain: np.ndarray, off: np.ndarray, find, color_of, clear: np.ndarray, reduction: Reduction, amount: float, keep_alpha: bool = False) -> np.ndarray:
    """Entries of (height, width, layers) points with diffusion.

    ``mean`` are the points' neighbourhoods, ``plain`` each place's nearest entry and ``off`` how far
    the nearest entry is from the place's mean; ``find`` gives the entry of (1, layers) points and
    ``color_of`` an entry's points.  Without ``keep_alpha`` alpha takes no part: errors are scaled
    by the place's alpha and colours compared at the entry's.  ``clear`` places take no part.
    """
    h, w, layers = points.shape[:3]
    y2 = reduction.squares[0]
    gap = points - mean
    centre = (gap[..., :3] ** 2) @ np.array(reduction.squares) + reduction.alpha_square * gap[..., 3] ** 2 - gap[..., 3] * (gap[..., :3] @ np.array(reduction.interaction))
    smooth = (centre.mean(axis=2) < CALM * y2) & (off > OFF * y2)
    error = np.zeros((h + 1, w + 2, layers, 4))
    out = np.zeros((h, w), np.int64)
    for r in range(h):
        step = 1 if r % 2 == 0 else -1
        for c in range(w)[::step]:
            if clear[r, c]:
                continue
            if not smooth[r, c]:
                out[r, c] = plain[r, c]
                continue
            wanted = np.stack([_moved(m, _curve(e * amount), keep_alpha) for m, e in zip(mean[r, c], error[r, c + 1], strict=True)])
            k = out[r, c] = find(wanted[None])
            chosen = color_of(k)
            if keep_alpha:
                left = wanted - chosen
            else:
                alpha = wanted[:, 3:]
                left = np.where(alpha > 0, wanted * chosen[:, 3:] / np.where(alpha > 0, alpha, 1.0) - chosen, 0.0)
                left[:, 3] = 0.0
            for share, (dr, dc) in zip(SHARES, ((0, step), (1, -step), (1, 0), (1, step)), strict=True):
                error[r + dr, c + 1 + dc] += left * share / 16
    return out


def _moved(color: np.ndarray, by: np.ndarray, keep_alpha: bool) -> np.ndarray:
    """A premultiplied colour moved by an error and brought back into range."""
    color = color.copy()
    if keep_alpha:
        color += by
    else:
        if color[3] != 0:
            color[:3] *= 1.0 + by[3] / color[3]
        color[:3] += by[:3] * (color[3] + by[3])
    if color[3] < 0:
        return np.zeros(4)
    if color[0] < 0:
        color[:3] = 0.0
    elif color[0] > 511.0 * color[3]:
        color[:3] = (511.0 * color[3], 0.0, 0.0)
    if color[3] > 1:
        color = color / color[3]
    return color


def index_layers(px: np.ndarray, palettes: np.ndarray, reduction: Reduction, amount: float = 0.0) -> np.ndarray:
    """Indices of opaque (height, width, layers) colours in (entries, layers) palettes; errors pass on in all layers at once."""
    points, colors = yiq_array(px), yiq_array(palettes)
    h, w, layers = px.shape
    flat, back = np.unique(px.reshape(-1, layers), axis=0, return_inverse=True)
    d = differences(yiq_array(flat), colors, reduction)
    plain = d.argmin(axis=1)[back.ravel()].reshape(h, w)
    if amount <= 0:
        return plain
    mean = np.stack([blurred(points[:, :, k]) for k in range(layers)], axis=2)
    off = np.concatenate([differences(rows, colors, reduction).min(axis=1) for rows in np.array_split(mean.reshape(-1, layers, 4), -(-h * w // 4096))]).reshape(h, w)
    find = lambda wanted: int(differences(wanted, colors, reduction)[0].argmin())
    return _diffused(points, mean, plain, off, find, lambda k: colors[k], np.zeros((h, w), bool), reduction, amount)


def index_images(images: DataFrame, palettes: DataFrame, reduction: Reduction = Reduction(), amount: float = 0.0) -> DataFrame:
    """``images`` (image_id, width, height, px binary of little-endian rgba) to (image_id, width, height, indices binary of uint16).

    Each image meets its own palette (image_id, idx, entry) in one task; images are independent.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        palette = right.sort_values("idx")["entry"].to_numpy()
        rows = []
        for r in left.itertuples():
            rgba = np.frombuffer(r.px, "<i4").reshape(r.height, r.width)
            found = index_image(rgba, palette, reduction, amount) if len(palette) else np.zeros(rgba.shape, np.int64)
            rows.append((r.image_id, r.width, r.height, found.astype("<u2").tobytes()))
        return pd.DataFrame(rows, columns=["image_id", "width", "height", "indices"])

    return images.groupBy("image_id").cogroup(palettes.groupBy("image_id")).applyInPandas(run, "image_id bigint, width int, height int, indices binary")
