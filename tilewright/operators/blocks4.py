"""4x4 block textures: a palette model for each block, a shared palette, and its refinement."""

from __future__ import annotations

import numpy as np

from ..config import Reduction
from .nearest import differences, nearest_entries, yiq_array
from .palette import create_palette, snap15_array

# Mode bits of a block's palette index.
OPAQUE, INTERPOLATE, ADDRESS = 0x8000, 0x4000, 0x3FFF
# A block is drawn from two endpoints if its mean squared error stays within the first; rounds of
# refinement of the palettes, and most steps that an endpoint climbs.
ENDPOINT_MSE = 53.0
REFINEMENTS, CLIMBS = 4, 10


def _words(rgba: np.ndarray) -> np.ndarray:
    v = np.asarray(rgba).astype(np.int64)
    five = [(((v >> s) & 255) * 62 + 255) // 510 for s in (0, 8, 16)]
    return five[0] | five[1] << 5 | five[2] << 10


def _colors(words: np.ndarray) -> np.ndarray:
    w = np.asarray(words).astype(np.int64)
    eight = [(((w >> s) & 31) * 510 + 31) // 62 for s in (0, 5, 10)]
    return eight[0] | eight[1] << 8 | eight[2] << 16 | 0xFF000000


def _blend(c1: np.ndarray, c2: np.ndarray, eighths: int) -> np.ndarray:
    out = np.zeros_like(c1) | 0xFF000000
    for s in (0, 8, 16):
        v = (((c1 >> s) & 255) * (8 - eighths) + ((c2 >> s) & 255) * eighths + 4) // 8
        out = out | ((((v * 126 + 255) // 510) * 510 + 63) // 126) << s
    return out


def expand(words: np.ndarray, mode: int) -> np.ndarray:
    """The colours (..., 4) that a block in ``mode`` sees at the start of (..., 4) palette words; 0 where transparent."""
    c = _colors(words)
    out = np.zeros_like(c)
    out[..., 0], out[..., 1] = c[..., 0], c[..., 1]
    if mode & INTERPOLATE:
        if mode & OPAQUE:
            out[..., 2], out[..., 3] = _blend(c[..., 0], c[..., 1], 3), _blend(c[..., 0], c[..., 1], 5)
        else:
            out[..., 2] = _blend(c[..., 0], c[..., 1], 4)
    else:
        out[..., 2] = c[..., 2]
        if mode & OPAQUE:
            out[..., 3] = c[..., 3]
    return out


def usable(mode: int) -> int:
    """Colours of a mode that a visible pixel may take."""
    return 4 if mode & OPAQUE else 3


def size_of(mode: int) -> int:
    """Palette words that a mode takes."""
    return 2 if mode & INTERPOLATE else 4


def decode_blocks(texel: np.ndarray, pidx: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image of 4x4 texel words and palette indices; words beyond the palette are black."""
    bw, bh = width // 4, height // 4
    n = bw * bh
    words = np.concatenate([palette.astype(np.int64), np.zeros(0x8004, np.int64)])
    at = (pidx[:n].astype(np.int64) & ADDRESS) << 1
    own = words[at[:, None] + np.arange(4)]
    out = np.zeros((n, 16), np.int64)
    index = (texel[:n, None].astype(np.int64) >> (2 * np.arange(16))) & 3
    for mode in (0, OPAQUE, INTERPOLATE, OPAQUE | INTERPOLATE):
        mine = (pidx[:n] & (OPAQUE | INTERPOLATE)) == mode
        if mine.any():
            out[mine] = np.take_along_axis(expand(own[mine], mode), index[mine], axis=1)
    grid = out.reshape(bh, bw, 4, 4).transpose(0, 2, 1, 3).reshape(bh * 4, bw * 4)
    return grid.astype(np.uint32).view(np.int32)


# -- a block's own model --------------------------------------------------------------------


def endpoints(points: np.ndarray, weight: np.ndarray, colors: np.ndarray, mode: int, reduction: Reduction) -> tuple[np.ndarray, float]:
    """Two palette words whose blends fit a block best, and their error.

    The start is the ends of the principal axis; then steps of one in green, red and blue of
    either end are kept while they help, within the channel's range.
    """

    def error(words: np.ndarray) -> float:
        shown = expand(np.array([words[0], words[1], 0, 0]), mode)[: usable(mode)]
        return float((nearest_entries(points, yiq_array(shown), reduction)[1] * weight).sum())

    scale = np.array([*reduction.weights, reduction.alpha_square**0.5])
    flat = points * scale
    centred = flat - np.average(flat, axis=0, weights=weight)
    axis = np.linalg.eigh((centred * weight[:, None]).T @ centred)[1][:, -1]
    score = flat @ axis
    words = np.array([_words(colors[score.argmin()]), _words(colors[score.argmax()])])
    best = error(words)
    for _ in range(CLIMBS):
        moved = False
        for shift in (5, 0, 10):
            for end in (0, 1):
                for step in (1, -1):
                    level = (words[end] >> shift) & 31
                    if 0 <= level + step <= 31:
                        trial = words.copy()
                        trial[end] += step << shift
                        e = error(trial)
                        if e < best:
                            words, best, moved = trial, e, True
                            break
        if not moved:
            break
    light = yiq_array(_colors(words))[:, 0]
    return (words if light[0] <= light[1] else words[::-1]), best


def model(block: np.ndarray, reduction: Reduction) -> tuple[int, np.ndarray]:
    """(mode, palette words) that suit one block of 16 pixels."""
    alpha = (block.astype(np.int64) >> 24) & 255
    seen = block[alpha >= 128] | np.int32(-16777216)
    opaque = OPAQUE if len(seen) == 16 else 0
    if not len(seen):
        return INTERPOLATE, np.zeros(2, np.int64)
    colors, count = np.unique(seen, return_counts=True)
    snapped = np.unique(snap15_array(colors))
    if len(snapped) <= 2:
        words = _words(snapped[[0, -1]])
        light = yiq_array(_colors(words))[:, 0]
        return opaque | INTERPOLATE, words if light[0] <= light[1] else words[::-1]
    points, weight = yiq_array(colors), count.astype(float)
    words, error = endpoints(points, weight, colors, opaque | INTERPOLATE, reduction)
    if error / (weight.sum() * sum(reduction.squares)) <= ENDPOINT_MSE:
        return opaque | INTERPOLATE, words
    n = 4 if opaque else 3
    made = create_palette(points[:, None], weight, n, reduction)[:, 0]
    words = np.zeros(4, np.int64)
    words[: len(made)] = _words(made)
    return opaque, words


# -- the shared palette ---------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray, reduction: Reduction) -> float:
    return float(differences(yiq_array(_colors(a)), yiq_array(_colors(b)), reduction).diagonal().sum())


def shared_palette(models: list[tuple[int, np.ndarray]], uses: np.ndarray, limit: int, threshold: int, reduction: Reduction) -> np.ndarray:
    """Palettes of all blocks in at most ``limit`` words: equal ones once, nearest of one size merged as needed.

    Pairs nearer than ``threshold`` merge even when there is room.  Merging keeps the mean weighed
    by uses.
    """
    groups: dict[tuple[int, bytes], float] = {}
    for (mode, words), n in zip(models, uses, strict=True):
        key = (size_of(mode), words.tobytes())
        groups[key] = groups.get(key, 0.0) + float(n)
    items = [[size, np.frombuffer(w, np.int64).copy(), n] for (size, w), n in groups.items()]
    bound = threshold * threshold * sum(reduction.squares)
    while True:
        total = sum(x[0] for x in items)
        if total <= limit and not threshold:
            break
        best = None
        for size in (4, 2):
            mine = [k for k, x in enumerate(items) if x[0] == size]
            if len(mine) < 2:
                continue
            points = yiq_array(_colors(np.array([items[k][1] for k in mine])))
            use = np.array([items[k][2] for k in mine])
            d = np.zeros((len(mine), len(mine)))
            diff = points[:, None] - points[None]
            d = ((diff[..., :3] ** 2) @ np.array(reduction.squares)).sum(axis=-1) / size
            cost = d * (use[:, None] * use[None, :] / (use[:, None] + use[None, :])) / size
            np.fill_diagonal(cost, np.inf)
            i, j = divmod(int(cost.argmin()), len(mine))
            found = (float(cost[i, j]), float(d[i, j]), mine[min(i, j)], mine[max(i, j)])
            best = found if best is None or found < best else best
        if best is None or (total <= limit and best[1] > bound):
            break
        _, _, a, b = best
        x, y = items[a], items[b]
        mean = (yiq_array(_colors(x[1])) * x[2] + yiq_array(_colors(y[1])) * y[2]) / (x[2] + y[2])
        from .nearest import rgba_array

        items[a] = [x[0], _words(rgba_array(mean)), x[2] + y[2]]
        del items[b]
    items.sort(key=lambda x: (-x[0], -x[2]))
    words = np.concatenate([x[1] for x in items]) if items else np.zeros(2, np.int64)
    return words[: limit & ~1]


def assign(blocks: np.ndarray, palette: np.ndarray, reduction: Reduction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (palette index, texel word, error) of each block over all addresses and modes open to it."""
    padded = np.concatenate([palette, np.zeros(4, np.int64)])
    addresses = np.arange(0, max(len(palette) - 1, 1), 2)
    own = padded[addresses[:, None] + np.arange(4)]
    alpha = (blocks.astype(np.int64) >> 24) & 255
    clear = alpha < 128
    pidx, texel, error = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64), np.full(len(blocks), np.inf)
    for opaque in (OPAQUE, 0):
        mine = np.flatnonzero(~clear.any(axis=1) if opaque else clear.any(axis=1))
        for mode in (opaque | INTERPOLATE, opaque):
            room = len(palette) - addresses >= size_of(mode)
            if not room.any() or not len(mine):
                continue
            shown = expand(own[room], mode)[:, : usable(mode)]
            colors = yiq_array(shown.reshape(-1))
            for k in mine:
                d = differences(yiq_array(blocks[k] | np.int32(-16777216)), colors, reduction).reshape(16, -1, usable(mode))
                d[clear[k]] = 0
                sums = d.min(axis=2).sum(axis=0)
                a = int(sums.argmin())
                if sums[a] < error[k]:
                    index = np.where(clear[k], 3, d[:, a].argmin(axis=1))
                    error[k], pidx[k], texel[k] = sums[a], mode | addresses[room][a] >> 1, int((index << (2 * np.arange(16))).sum())
    return pidx, texel, error


def _narrowed(pair: tuple[int, int]) -> list[int]:
    """Two words as near to each other as may be with the same halfway blend."""
    ends = [((pair[0] >> s) & 31, (pair[1] >> s) & 31) for s in (0, 5, 10)]
    near = [sum((sum(e) + up) // 2 << s for e, s in zip(ends, (0, 5, 10), strict=True)) for up in (1, 0)]
    blends = _blend(_colors(np.array([near[0], pair[0]])), _colors(np.array([near[1], pair[1]])), 4)
    return near if blends[0] == blends[1] else list(pair)


def compacted(pidx: np.ndarray, texel: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """A palette in which every block finds the colours that it draws, in as few words as a greedy layout needs; -1 for words left free.

    Pairs that blends are drawn from come first, once each; a pair of which only the halfway
    blend is drawn shares any pair with that blend, else its ends move together.  Then, larger
    sets first, the colours that blocks draw directly go where a block may see them (four words
    from an even place, three where index 3 is transparent), with the fewest new pairs, then the
    fewest new words.
    """
    padded = np.concatenate([palette, np.zeros(4, np.int64)])
    blends, halves, plain = set(), set(), set()
    for p, t in set(zip(pidx.tolist(), texel.tolist(), strict=True)):
        at = (p & ADDRESS) << 1
        own = padded[at : at + 4].tolist()
        seen = {(t >> (2 * k)) & 3 for k in range(16)} - (set() if p & OPAQUE else {3})
        if p & INTERPOLATE and max(seen, default=0) > 1:
            (blends if p & OPAQUE or seen != {2} else halves).add((min(own[:2]), max(own[:2])))
        elif seen:
            plain.add((usable(p), tuple(sorted({own[k] for k in seen}))))
    words = [w for pair in sorted(blends) for w in pair]

    def half(pairs: np.ndarray) -> np.ndarray:
        return _blend(_colors(pairs[:, 0]), _colors(pairs[:, 1]), 4)

    for pair in sorted(halves - blends):
        if not words or half(np.array([pair]))[0] not in half(np.array(words).reshape(-1, 2)):
            words += _narrowed(pair)
    for room, colors in sorted(plain, key=lambda x: (-len(x[1]), x)):
        n = len(words) // 2
        ahead = np.array(words + [-1] * 6)
        seen = ahead[2 * np.arange(n + 1)[:, None] + np.arange(room)]
        missing = len(colors) - (seen[:, :, None] == np.array(colors)).any(axis=1).sum(axis=1)
        free = (seen < 0).sum(axis=1)
        inside = free.copy()
        inside[n:] = 0
        if n:
            inside[n - 1] = (seen[n - 1, :2] < 0).sum()
        cost = np.where(missing <= free, (np.maximum(missing - inside, 0) + 1) // 2 * 8 + missing, 1 << 30)
        start = 2 * int(cost.argmin())
        for w in colors:
            if w not in ahead[start : start + room]:
                ahead[start + int(np.flatnonzero(ahead[start : start + room] < 0)[0])] = w
        last = max(len(words), 1 + int(np.flatnonzero(ahead >= 0).max()))
        words = ahead[: last + last % 2].tolist()
    return np.array(words, np.int64)


def encode_blocks(px: np.ndarray, reduction: Reduction, limit: int, threshold: int = 0) -> tuple[bytes, bytes, np.ndarray]:
    """(texel, palette indices, palette words) of an image with sides that are multiples of 4.

    Equal blocks are modelled once.  Each refinement lays out anew the colours that blocks draw,
    spends the room on own palettes of the worst blocks (single colours first in words left
    free), and assigns all blocks anew; a round that raises the total error or changes nothing
    ends it.
    """
    h, w = px.shape
    grid = px.reshape(h // 4, 4, w // 4, 4).transpose(0, 2, 1, 3).reshape(-1, 16)
    alpha = (grid.astype(np.int64) >> 24) & 255
    grid = np.where(alpha < 128, 0, grid).astype(np.int32)
    blocks, back, uses = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
    models = [model(b, reduction) for b in blocks]
    palette = shared_palette(models, uses, limit, threshold, reduction)
    pidx, texel, error = assign(blocks, palette, reduction)
    for _ in range(REFINEMENTS):
        trial = compacted(pidx, texel, palette)
        if len(trial) > len(palette):
            trial = palette.copy()
        for k in np.argsort(-(error * uses), kind="stable"):
            words = models[k][1]
            free = np.flatnonzero(trial < 0)
            if error[k] <= 0 or (not len(free) and len(trial) + 2 > limit):
                break
            if len(free) and (words == words[0]).all():
                trial[free[0]] = words[0]
            elif len(trial) + len(words) <= limit:
                trial = np.concatenate([trial, words])
        if not len(trial):
            break
        trial = np.where(trial < 0, trial.reshape(-1, 2)[:, ::-1].ravel(), trial)
        new = assign(blocks, trial, reduction)
        if (new[2] * uses).sum() > (error * uses).sum() or (len(trial) == len(palette) and (trial == palette).all()):
            break
        palette, (pidx, texel, error) = trial, new
    back = back.ravel()
    return texel[back].astype("<u4").tobytes(), pidx[back].astype("<u2").tobytes(), palette.astype("<u2")
