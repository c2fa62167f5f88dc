"""Palette creation: divisive clustering along principal axes, then capacity-bounded Lloyd rounds.

The kernel works on one group's histogram, which is small after aggregation; groups run in
parallel with ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALPHA_PALETTE, ALPHA_RESERVE, MAX_COLORS, Reduction
from .histogram import layered_histogram, weighted_histogram
from .nearest import differences, nearest_entries, rgba_array, yiq_array


def snap15_array(rgba: np.ndarray) -> np.ndarray:
    v = np.asarray(rgba).astype(np.int64) & 0xFFFFFFFF
    five = [(((v >> s) & 255) * 62 + 255) // 510 for s in (0, 8, 16)]
    eight = [(x * 510 + 31) // 62 for x in five]
    return (eight[0] | eight[1] << 8 | eight[2] << 16 | (v & 0xFF000000)).astype(np.uint32).view(np.int32)


def masked(points: np.ndarray, reduction: Reduction) -> np.ndarray:
    """Points as the colours a palette can hold (rgba, by layer)."""
    rgba = rgba_array(points)
    return snap15_array(rgba) if reduction.mask15 else rgba


class Node:
    """A run of histogram entries, its mean, and what its best cut would gain."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, reduction: Reduction) -> None:
        self.points, self.weight = points, weight
        self.total = float(weight.sum())
        self.mean = (weight[:, None, None] * points).sum(axis=0) / self.total
        self.gain, self.cut = -1.0, None
        if len(points) < 2:
            return
        scale = np.array([*reduction.weights, reduction.alpha_square**0.5])
        flat = (points * scale).reshape(len(points), -1)
        centred = flat - np.average(flat, axis=0, weights=weight)
        cov = (centred * weight[:, None]).T @ centred / self.total
        axis = np.linalg.eigh(cov)[1][:, -1]
        if reduction.alpha_mode == ALPHA_PALETTE:
            alphas = np.arange(3, cov.shape[0], 4)
            strongest = alphas[np.argmax(cov[alphas, alphas])]
            if cov[strongest, strongest] > np.trace(cov) - cov[strongest, strongest]:
                axis = np.eye(cov.shape[0])[strongest]
        score = flat @ axis
        if score.max() - score.min() <= 1e-9 * max(1.0, np.abs(score).max()):
            return
        order = np.lexsort((*flat.T[::-1], score))
        flat, w = flat[order], weight[order]
        sums, ws = np.cumsum(flat * w[:, None], axis=0), np.cumsum(w)
        left, right = sums[:-1], sums[-1] - sums[:-1]
        wl, wr = ws[:-1], ws[-1] - ws[:-1]
        squares = float((w[:, None] * flat**2).sum())
        wss = squares - (left**2).sum(axis=1) / wl - (right**2).sum(axis=1) / wr
        means = (np.cumsum((w[:, None, None] * points[order]), axis=0))
        ml, mr = means[:-1] / wl[:, None, None], (means[-1] - means[:-1]) / wr[:, None, None]
        differ = (masked(ml, reduction) != masked(mr, reduction)).any(axis=1)
        if not differ.any():
            return
        wss = np.where(differ, wss, np.inf)
        best = int(wss.argmin())
        self.gain = squares - float((sums[-1] ** 2).sum()) / self.total - float(wss[best])
        if not reduction.enhance:
            self.gain *= self.total**-0.5
        self.cut = order[: best + 1], order[best + 1 :]

    def split(self, reduction: Reduction) -> tuple[Node, Node]:
        return tuple(Node(self.points[part], self.weight[part], reduction) for part in self.cut)


def _unique_colors(nodes: list[Node], reduction: Reduction) -> np.ndarray:
    """Means as palette colours; nodes that share one count as one."""
    merged: dict[bytes, list] = {}
    for n in nodes:
        entry = merged.setdefault(masked(n.mean, reduction).tobytes(), [0.0, 0.0])
        entry[0] = entry[0] + n.mean * n.total
        entry[1] += n.total
    return np.array([yiq_array(masked(s / w, reduction)) for s, w in merged.values()])


def _assign(points: np.ndarray, weight: np.ndarray, centres: np.ndarray, reduction: Reduction) -> tuple[np.ndarray, np.ndarray]:
    return nearest_entries(points, centres, reduction)


def lloyd(points: np.ndarray, weight: np.ndarray, centres: np.ndarray, reduction: Reduction, pinned: int = 0) -> np.ndarray:
    """At most ``reduction.rounds`` rounds; each keeps only centres that lower its cluster's error.

    An empty cluster moves to the worst-placed colour; colours that end without a pixel are
    dropped; the first ``pinned`` centres stay where they are.
    """
    for _ in range(reduction.rounds):
        at, d = _assign(points, weight, centres, reduction)
        counts = np.bincount(at, weight, minlength=len(centres))
        new = centres.copy()
        lost = d * weight
        for k in range(pinned, len(centres)):
            mine = at == k
            if not counts[k]:
                worst = int(lost.argmax())
                if lost[worst] > 0:
                    new[k] = yiq_array(masked(points[worst], reduction))
                    lost[worst] = 0
                continue
            mean = (weight[mine, None, None] * points[mine]).sum(axis=0) / counts[k]
            moved = yiq_array(masked(mean, reduction))
            if (differences(points[mine], moved[None], reduction)[:, 0] * weight[mine]).sum() < (d * weight)[mine].sum():
                new[k] = moved
        if np.array_equal(new, centres):
            break
        before, after = (d * weight).sum(), (_assign(points, weight, new, reduction)[1] * weight).sum()
        if after >= before:
            break
        centres = new
    at, _ = _assign(points, weight, centres, reduction)
    used = np.bincount(at, minlength=len(centres)) > 0
    used[:pinned] = True
    return centres[used]


def create_palette(points: np.ndarray, weight: np.ndarray, n: int, reduction: Reduction) -> np.ndarray:
    """At most ``n`` colours (rgba, layers) for a histogram of (entries, layers, 4) points."""
    if not len(points) or n < 1:
        return np.zeros((0, points.shape[1]), np.int32)
    order = np.lexsort((*points.reshape(len(points), -1).T[::-1],))
    points, weight = points[order], weight[order]
    nodes = [Node(points, weight, reduction)]
    while len(nodes) < n:
        best = max(range(len(nodes)), key=lambda k: (nodes[k].gain, -k))
        if nodes[best].gain <= 0:
            break
        nodes[best : best + 1] = nodes[best].split(reduction)
    centres = _unique_colors(nodes, reduction)
    centres = lloyd(points, weight, centres, reduction)
    return sort_palette(np.unique(masked(centres, reduction), axis=0), reduction)


def sort_palette(rgba: np.ndarray, reduction: Reduction | None = None, *, same_first: bool = False) -> np.ndarray:
    """By alpha and lightness of the first layer, then by value; perhaps rows that are alike in all layers first."""
    first = rgba[:, 0].astype(np.int64) & 0xFFFFFFFF
    y = yiq_array(rgba[:, 0])[:, 0] if len(rgba) else np.zeros(0)
    differ = (rgba != rgba[:, :1]).any(axis=1) if same_first else np.zeros(len(rgba), bool)
    return rgba[np.lexsort((first, y, first >> 24, differ))]


def palettes_of(hist: DataFrame, n: int, reduction: Reduction = Reduction(), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Palettes of all groups of a histogram (keys, rgba or colors, weight): keys, layer, idx, entry.

    In mode "reserve", entry 0 is kept for transparency (0).
    """
    if not 1 <= n <= 0x8000:
        raise ValueError("palette size")
    layered = "colors" in hist.columns
    reserve = reduction.alpha_mode == ALPHA_RESERVE
    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rgba = np.array(rows["colors"].tolist()) if layered else rows["rgba"].to_numpy()[:, None]
        made = create_palette(yiq_array(rgba), rows["weight"].to_numpy(), n - reserve, reduction)
        if reserve:
            made = np.concatenate([np.zeros((1, rgba.shape[1]), np.int32), made])
        idx, layer = np.indices(made.shape)
        out = {k: v for k, v in zip(keys, key, strict=True)}
        return pd.DataFrame({**out, "layer": layer.ravel().astype("int32"), "idx": idx.ravel().astype("int32"), "entry": made.ravel()})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", layer int, idx int, entry int"
    return hist.groupBy(*keys).applyInPandas(run, schema)


def image_palettes(pixels: DataFrame, n: int, reduction: Reduction = Reduction()) -> DataFrame:
    """Histogram and palette of every image; several layers of an image make one layered palette."""
    layers = pixels.agg(F.max("layer")).first()[0] or 0
    hist = layered_histogram(pixels, reduction) if layers else weighted_histogram(pixels, reduction)
    return palettes_of(hist, n, reduction)


# -- several palettes an image --------------------------------------------------------------


def merge_palettes(tile_points: list[np.ndarray], tile_weights: list[np.ndarray], n_palettes: int, n: int, reduction: Reduction, shared0: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(palette number of each tile, palettes): tiles' own palettes are merged, nearest first, then refined.

    How badly one tile's colours fare in another's palette is no symmetric measure; the pair with
    the least such loss in either direction merges (the lowest numbers among equals), and the
    merged group gets a palette of its own.  Losses are kept in a matrix of live groups, and only
    a merged group's row and column are computed anew.  With ``shared0`` one of the ``n`` colours,
    the first, is the same in all palettes (see ``_share_first``).
    """
    t = len(tile_points)
    n -= shared0
    members = {k: [k] for k in range(t)}

    def palette_of(tiles: list[int]) -> np.ndarray:
        return create_palette(np.concatenate([tile_points[i] for i in tiles]), np.concatenate([tile_weights[i] for i in tiles]), n, reduction)

    def loss(tiles: list[int], palette: np.ndarray) -> float:
        if not len(palette):
            return 0.0
        return sum(float((nearest_entries(tile_points[i], yiq_array(palette), reduction)[1] * tile_weights[i]).sum()) for i in tiles if len(tile_points[i]))

    palettes = {k: palette_of([k]) for k in members}
    cost = np.full((t, t), np.inf)
    for a in members:
        for b in members:
            if a != b:
                cost[a, b] = loss(members[a], palettes[b])
    while len(members) > max(1, n_palettes):
        a, b = np.unravel_index(int(cost.argmin()), cost.shape)
        keep, drop = min(a, b), max(a, b)
        members[keep] += members.pop(drop)
        palettes[keep] = palette_of(members[keep])
        palettes.pop(drop)
        cost[drop, :] = cost[:, drop] = np.inf
        for k in members:
            if k != keep:
                cost[keep, k], cost[k, keep] = loss(members[keep], palettes[k]), loss(members[k], palettes[keep])
    found = [palettes[k] for k in sorted(members)]
    at = np.zeros(t, np.int64)
    for _ in range(reduction.rounds):
        costs = np.array([[loss([i], p) for p in found] for i in range(t)])
        new = costs.argmin(axis=1)
        for k in range(len(found)):
            mine = [i for i in range(t) if new[i] == k and len(tile_points[i])]
            if mine:
                found[k] = palette_of(mine)
        if (new == at).all():
            break
        at = new
    light = [float(yiq_array(p[:, 0])[:, 0].mean()) if len(p) else 0.0 for p in found]
    order = np.argsort(light, kind="stable")
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    at = np.array([[loss([i], found[k]) for k in order] for i in range(t)]).argmin(axis=1)
    made = [found[k] for k in order]
    return at, _share_first(tile_points, tile_weights, at, made, reduction) if shared0 else made


def _share_first(tile_points: list[np.ndarray], tile_weights: list[np.ndarray], at: np.ndarray, palettes: list[np.ndarray], reduction: Reduction) -> list[np.ndarray]:
    """The palettes with one more colour before all others: that with the most error to save over all tiles.

    Only error beyond that of the nearest colour that a palette can hold counts, summed by that
    colour; the lowest of equals is taken.  The other colours then adapt by Lloyd rounds around it.
    """
    lost: dict[int, float] = {}
    for points, weight, k in zip(tile_points, tile_weights, at, strict=True):
        if not len(points):
            continue
        ideal = masked(points, reduction)
        apart = differences(points, yiq_array(ideal), reduction).diagonal()
        drawn = nearest_entries(points, yiq_array(palettes[k]), reduction)[1] if len(palettes[k]) else np.full(len(points), np.inf)
        for c, d in zip(ideal[:, 0].tolist(), np.maximum(drawn - apart, 0) * weight, strict=True):
            lost[c] = lost.get(c, 0.0) + float(d)
    first = np.array([[min(lost, key=lambda c: (-lost[c], c)) if lost else 0]], np.int32) | np.int32(-16777216)
    out = []
    for k, own in enumerate(palettes):
        mine = [i for i in range(len(tile_points)) if at[i] == k and len(tile_points[i])]
        if mine and len(own):
            points, weight = np.concatenate([tile_points[i] for i in mine]), np.concatenate([tile_weights[i] for i in mine])
            centres = lloyd(points, weight, yiq_array(np.concatenate([first, own])), reduction, pinned=1)
            own = sort_palette(np.unique(masked(centres[1:], reduction), axis=0), reduction)
        out.append(np.concatenate([first, own]))
    return out


def tile_palettes(tile_hist: DataFrame, n_palettes: int, n: int, reduction: Reduction = Reduction(), shared0: bool = False) -> DataFrame:
    """Several palettes an image from its tiles' histograms (image_id, tile_no, rgba, weight).

    One row per tile and palette entry kind: kind "tile" has (tile_no, palette), kind "entry"
    (palette, idx, entry).  Images are independent, and an image holds at most some thousand
    tiles; distinct tiles should be passed once.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile_no", "rgba"])
        tiles = [(no, part) for no, part in rows.groupby("tile_no", sort=True)]
        points = [yiq_array(p["rgba"].to_numpy()[:, None]) for _, p in tiles]
        at, found = merge_palettes(points, [p["weight"].to_numpy() for _, p in tiles], n_palettes, n, reduction, shared0)
        a = pd.DataFrame({"kind": "tile", "tile_no": [no for no, _ in tiles], "palette": at, "idx": None, "entry": None})
        b = pd.DataFrame([("entry", None, p, i, int(c)) for p, colors in enumerate(found) for i, c in enumerate(colors[:, 0])], columns=a.columns)
        out = pd.concat([a.astype(object), b.astype(object)])
        out.insert(0, "image_id", key[0])
        return out

    return tile_hist.groupBy("image_id").applyInPandas(run, "image_id bigint, kind string, tile_no int, palette int, idx int, entry int")


def check_size(n: int) -> None:
    if not 1 <= n <= MAX_COLORS:
        raise ValueError(f"1 to {MAX_COLORS} colours")
