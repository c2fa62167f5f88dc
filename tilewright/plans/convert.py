"""Whole conversions: images to textures or tiled backgrounds, as files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EncodeOptions
from ..functions.texture import FORMATS
from ..operators import codecs as cx
from ..operators import tiles as tl
from ..operators.nearest import nearest_entries, rgba_array, yiq_array
from ..operators.palette import create_palette, merge_palettes
from ..operators.texture import colors15, colors24, decode_image, encode_image, encode_layers, histogram_of, pack_bits, trim
from ..sources import sinks

FILES = "image_id bigint, name string, data binary"


#: Most bytes of a palette or character file that is sent along with a conversion.
SIDECAR_BYTES = 1 << 20


def _content(file: str | bytes) -> bytes:
    if isinstance(file, bytes):
        return file
    with open(file, "rb") as f:
        return f.read()


def with_contents(spark: SparkSession, o: EncodeOptions) -> EncodeOptions:
    """The same options with the bytes of the files they name, read once through Spark, so that tasks open none."""

    def read(path: str) -> bytes:
        found = spark.read.format("binaryFile").load(path).where(F.col("length") <= SIDECAR_BYTES).select("content").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{path}: not one file of at most {SIDECAR_BYTES} bytes")
        return bytes(found[0].content)

    named = {k: getattr(o, k) for k in ("existing_palette", "existing_chars", "fixed_palette")}
    return replace(o, **{k: read(v) for k, v in named.items() if isinstance(v, str)})


def prepare(px: np.ndarray, key: int | None) -> np.ndarray:
    """The key colour and all transparent pixels become transparent black."""
    out = px.copy()
    if key is not None:
        out[(out & 0xFFFFFF) == (key & 0xFFFFFF)] = 0
    out[((out.astype(np.int64) >> 24) & 255) == 0] = 0
    return out


def guess_format(px: np.ndarray) -> str:
    """As functions.texture.choose_format, for one image at hand."""
    alpha = (px.astype(np.int64) >> 24) & 255
    if ((alpha >= 5) & (alpha <= 250)).any():
        return "a5i3" if len(np.unique(px[alpha != 0] | np.int32(-16777216))) < 16 else "a3i5"
    colors = len(np.unique(np.where(alpha == 0, 0, px)))
    if colors <= 4:
        return "palette4"
    if px.size <= 1024 * 512:
        return "tex4x4"
    return "palette16" if colors <= 32 else "palette256"


def block_colors(area: int) -> int:
    n = int(8 * area**0.5) if area <= 128 * 128 else int(256 * (np.log2(area) - 10) + 1e-6)
    return (n + 15) // 16 * 16


def _emit(o: EncodeOptions, base: str, parts: list[tuple[str, bytes, int]]) -> list[tuple[str, bytes]]:
    """Parts (suffix, data, unit) as raw files or as one C source with its header."""
    squeezed = [(s, cx.smallest(d, o.codecs, o.vram_safe), u) for s, d, u in parts]
    if o.output == "c":
        made = [sinks.c_array(base + s, d, u, bool(o.codecs)) for s, d, u in squeezed]
        head = sinks.banner()
        return [(f"{base}.c", (head + "#include <stdint.h>\n\n" + "\n".join(m[0] for m in made)).encode()), (f"{base}.h", (head + "#pragma once\n\n#include <stdint.h>\n\n" + "".join(m[1] for m in made)).encode())]
    return [(f"{base}{s}.bin", d) for s, d, _ in squeezed]


def texture_files(px: np.ndarray, base: str, o: EncodeOptions) -> list[tuple[str, bytes]]:
    """Files of one texture."""
    px = prepare(px, o.alpha_key)
    fmt = FORMATS[o.texture_format or guess_format(px)]
    alpha = (px.astype(np.int64) >> 24) & 255
    clear0 = o.color0_transparent if o.color0_transparent is not None else bool((alpha < 128).any())
    clear0 = clear0 and fmt in (2, 3, 4)
    n = o.max_colors
    if fmt == 5 and n is None:
        n = 0x8000 if not o.merge_chars else block_colors(px.size)
    fixed = None
    if o.fixed_palette:
        fixed = (colors24(np.frombuffer(_content(o.fixed_palette), "<u2")) | 0xFF000000).astype(np.uint32).view(np.int32)
    param, texel, pidx, palette = encode_image(px, fmt, o.reduction, n_colors=n, transparent0=clear0, diffuse=o.diffuse, dither_alpha=o.dither_alpha, fixed=fixed, threshold=o.merge_threshold)
    height = 8 << (param >> 23 & 7)
    if o.trim and px.shape[0] != height:
        texel, pidx, height = trim(param, texel, pidx, px.shape[0])
    if o.output == "grf":
        return [(f"{base}.grf", sinks.grf_texture(fmt, 8 << (param >> 20 & 7), height, texel, pidx, palette, clear0, o.codecs, o.vram_safe))]
    if o.output == "tga":
        return [(f"{base}.tga", sinks.nns_tga(decode_image(param, texel, pidx, palette, height), fmt, texel, pidx, palette, f"{base}_pl", clear0))]
    parts = [("_tex", texel, 2 if fmt == 7 else 1)] + ([("_idx", pidx, 2)] if pidx else [])
    if palette and (fixed is None or o.output_fixed_palette):
        parts.append(("_pal", palette, 2))
    return _emit(o, base, parts)


def layered_files(layers: list[np.ndarray], base: str, names: list[str], o: EncodeOptions) -> list[tuple[str, bytes]]:
    """One index image and a palette for each of several images of one size."""
    if len({x.shape for x in layers}) > 1:
        raise ValueError("images differ in size")
    fmt = FORMATS[o.texture_format or "palette256"]
    if fmt not in (2, 3, 4):
        raise ValueError("palette swaps need an indexed format")
    n = min(o.max_colors or 256, {2: 4, 3: 16, 4: 256}[fmt])
    texel, palettes = encode_layers([prepare(x, o.alpha_key) for x in layers], n, o.reduction, fmt, o.diffuse)
    return _emit(o, base, [("_tex", texel, 1)]) + [f for name, p in zip(names, palettes, strict=True) for f in _emit(replace(o, output="bin"), f"{base}_{name}", [("_pal", p, 2)])]


def background(px: np.ndarray, o: EncodeOptions) -> dict[str, object]:
    """Palette words (16 rows), character indices, and screen entries of one image cut into 8x8 tiles."""
    px = prepare(px, o.alpha_key)
    h, w = px.shape[0] // 8, px.shape[1] // 8
    tiles = px[: h * 8, : w * 8].reshape(h, 8, w, 8).transpose(0, 2, 1, 3).reshape(-1, 64)
    alpha = (tiles.astype(np.int64) >> 24) & 255
    tiles = np.where(alpha < 128, 0, tiles | np.int32(-16777216)).astype(np.int32)
    red = o.reduction
    own = o.max_colors - (0 if o.color0_opaque else 1)
    per = 16 if o.bg_type == "text4" else 256
    if o.palettes == 1:
        colors, weight = histogram_of(px, red)
        made = [create_palette(yiq_array(colors[:, None]), weight, own, red)[:, 0] if len(colors) else np.zeros(0, np.int32)]
        at = np.zeros(len(tiles), np.int64)
    else:
        hists = [np.unique(t[t != 0], return_counts=True) for t in tiles]
        at, found = merge_palettes([yiq_array(c[:, None]) for c, _ in hists], [n.astype(float) for _, n in hists], o.palettes, own, red, o.color0_opaque)
        made = [p[:, 0] for p in found]
    palettes = [np.concatenate([np.zeros(0 if o.color0_opaque else 1, np.int32), p]) for p in made]
    flips = o.bg_type not in ("affine", "bitmap")
    distinct, back = np.unique(tiles, axis=0, return_inverse=True)
    back = back.ravel()
    first = np.unique(back, return_index=True)[1]
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct, back = distinct[order], rank[back]
    if o.merge_chars and o.bg_type != "bitmap":
        master, flip, mean = tl.merge_tiles(distinct, o.max_chars, red, flips)
    else:
        master, flip, mean = np.arange(len(distinct)), np.zeros(len(distinct), np.int64), yiq_array(distinct)
    kept = np.unique(master)
    number = {m: k for k, m in enumerate(kept)}
    merged = len(kept) < len(distinct)
    chars, pal_of = [], {}
    for m in kept:
        shown = rgba_array(mean[m]) if merged else distinct[m]
        shown = np.where(((shown.astype(np.int64) >> 24) & 255) < 128, 0, shown).astype(np.int32)
        users = np.unique(at[np.isin(back, np.flatnonzero(master == m))])
        costs = [(float(nearest_entries(yiq_array(shown[shown != 0]), yiq_array(made[p]), red)[1].sum()) if len(made[p]) and (shown != 0).any() else 0.0, p) for p in users]
        pal_of[m] = min(costs)[1]
        alone = np.count_nonzero(master == m) == 1  # averages of merged tiles are not diffused
        index = tl.index_tiles(shown, palettes[pal_of[m]], red, o.color0_opaque, o.diffuse if alone else 0.0)
        chars.append(np.where(index > 0, index + o.palette_offset, 0) if not o.color0_opaque else index + o.palette_offset)
    char_base = o.char_base or 0
    entries = np.array([((number[master[t]] + char_base) & 0x3FF) | flip[t] << 10 | ((pal_of[master[t]] + o.palette_base) & 15) << 12 for t in back], np.int64)
    words = np.zeros((16, per), "<u2")
    for p, colors in enumerate(palettes):
        words[p + o.palette_base, o.palette_offset : o.palette_offset + len(colors)] = colors15(colors)
    indices = np.array(chars, np.uint8).reshape(-1, 64)
    return {"palette": words, "chars": indices, "screen": entries.reshape(h, w), "merged": merged, "width": w, "height": h}


def screen_bytes(entries: np.ndarray, kind: str) -> bytes:
    """Panels of 32x32 entries for text screens, low bytes for affine ones, plain order for extended ones."""
    h, w = entries.shape
    if kind in ("text4", "text8"):
        parts = [entries[y : y + 32, x : x + 32].ravel() for y in range(0, h, 32) for x in range(0, w, 32)]
        return np.concatenate(parts).astype("<u2").tobytes()
    if kind == "affine":
        return (entries & 255).astype(np.uint8).tobytes()
    return entries.astype("<u2").tobytes()


def background_files(px: np.ndarray, base: str, o: EncodeOptions) -> list[tuple[str, bytes]]:
    """Files of one background."""
    depth = 4 if o.bg_type == "text4" else 8
    if o.screen_only:
        words = np.frombuffer(_content(o.existing_palette), "<u2")
        raw = _content(o.existing_chars)
        from ..operators.texture import unpack_bits

        raw += bytes(-len(raw) % (8 * depth))
        chars = unpack_bits(raw, depth) if depth < 8 else np.frombuffer(raw, np.uint8)
        per = 1 << depth
        rows = [(colors24(words[k : k + per]) | 0xFF000000).astype(np.uint32).view(np.int32) for k in range(0, len(words), per)]
        entries = screen_of(prepare(px, o.alpha_key), chars.reshape(-1, 64), rows, o)
        return _emit(o, base, [("_scr", screen_bytes(entries, o.bg_type), 1 if o.bg_type == "affine" else 2)])
    made = background(px, o)
    lo = o.palette_base if o.used_palettes_only else 0
    hi = o.palette_base + o.palettes if o.used_palettes_only else 16
    words = made["palette"][lo:hi] if o.bg_type in ("text4", "affine_ext") else made["palette"][:1]
    if o.existing_palette:
        old = np.frombuffer(_content(o.existing_palette), "<u2")[: words.size]
        flat = words.ravel().copy()
        flat[: len(old)] = np.where(flat[: len(old)] == 0, old, flat[: len(old)])
        words = flat
    palette = words.tobytes()
    w, h = made["width"], made["height"]
    if o.bg_type == "bitmap":
        grid = np.array([made["chars"][e & 0x3FF] if len(made["chars"]) <= 1024 else None for e in made["screen"].ravel()]).reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8) if len(made["chars"]) <= 1024 else tl_indices(px, made, o)
        if o.output == "bmp":
            return [(f"{base}.bmp", sinks.indexed_bmp(colors24(made["palette"][0]), grid))]
        return _emit(o, base, [("_bmp", grid.astype(np.uint8).tobytes(), 1), ("_pal", palette, 2)])
    data = pack_bits(made["chars"], depth)
    if o.existing_chars:
        old = _content(o.existing_chars)
        at = (o.char_base or 0) * 8 * depth
        data = old[:at].ljust(at, b"\0") + data + old[at + len(data) :]
    screen = screen_bytes(made["screen"], o.bg_type) if o.screen else None
    if o.output == "bmp":
        turned = np.array([made["chars"][(e & 0x3FF) - (o.char_base or 0)][np.arange(64) ^ tl.FLIPS[e >> 10 & 3]] for e in made["screen"].ravel()])
        grid = turned.reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)
        row = made["palette"][o.palette_base]
        return [(f"{base}.bmp", sinks.indexed_bmp(colors24(row), grid))]
    if o.output == "grf":
        return [(f"{base}.grf", sinks.grf_background(o.bg_type, depth, w * 8, h * 8, palette, data, screen, o.codecs, o.vram_safe))]
    if o.output == "nns":
        files = [(f"{base}.NCLR", sinks.nclr(palette, depth, o.bg_type, o.palette_base << depth, o.used_palettes_only)), (f"{base}.NCGR", sinks.ncgr(data, w, h, depth, merged=made["merged"]))]
        files += [(f"{base}.NSCR", sinks.nscr(screen, o.bg_type, w, h))] if screen is not None else []
        return [(n, cx.smallest(d, o.codecs, o.vram_safe)) for n, d in files]
    return _emit(o, base, [("_pal", palette, 2), ("_chr", data, 1)] + ([("_scr", screen, 1 if o.bg_type == "affine" else 2)] if screen is not None else []))


def tl_indices(px: np.ndarray, made: dict, o: EncodeOptions) -> np.ndarray:
    """Indices of a bitmap with more distinct tiles than a screen could name."""
    colors = (colors24(made["palette"][0]) | 0xFF000000).astype(np.uint32).view(np.int32)
    h, w = made["height"] * 8, made["width"] * 8
    if o.diffuse > 0:
        tiles = px[:h, :w].reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64)
        found = np.array([tl.index_tiles(t, colors[: o.max_colors], o.reduction, o.color0_opaque, o.diffuse) for t in tiles])
        return found.reshape(h // 8, w // 8, 8, 8).transpose(0, 2, 1, 3).reshape(h, w)
    return tl.index_tiles(px[:h, :w].ravel(), colors[: o.max_colors], o.reduction, o.color0_opaque).reshape(h, w)


def screen_of(px: np.ndarray, chars: np.ndarray, palettes: list[np.ndarray], o: EncodeOptions) -> np.ndarray:
    """Entries that show an image best with characters and palettes at hand."""
    from ..operators.nearest import differences

    h, w = px.shape[0] // 8, px.shape[1] // 8
    tiles = px[: h * 8, : w * 8].reshape(h, 8, w, 8).transpose(0, 2, 1, 3).reshape(-1, 64)
    out = []
    for t in tiles:
        best = (np.inf, 0, 0, 0)
        for p, colors in enumerate(palettes):
            d = differences(yiq_array(t), yiq_array(colors), o.reduction)
            d[:, 0] = d[:, 0] if o.color0_opaque else 0.0
            for f, m in enumerate(tl.FLIPS):
                sums = d[np.arange(64)[None], np.minimum(chars[:, np.arange(64) ^ m], len(colors) - 1)].sum(axis=1)
                k = int(sums.argmin())
                best = min(best, (float(sums[k]), k, p, f))
        out.append(best[1] & 0x3FF | best[3] << 10 | best[2] << 12)
    return np.array(out).reshape(h, w)


def convert(images: DataFrame, options: EncodeOptions) -> DataFrame:
    """Files (see FILES) of every image (image_id, name, width, height, px); images are independent of each other."""
    o = with_contents(images.sparkSession, options.checked())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                px = np.frombuffer(r.px, "<i4").reshape(r.height, r.width)
                base = o.base or r.name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                made = (texture_files if o.mode == "texture" else background_files)(px, base, o)
                out += [(r.image_id, n, d) for n, d in made]
            yield pd.DataFrame(out, columns=["image_id", "name", "data"])

    return images.select("image_id", "name", "width", "height", "px").mapInPandas(run, FILES)


def convert_layers(images: DataFrame, options: EncodeOptions, group: str = "set_id") -> DataFrame:
    """Palette-swap textures: each group's images share one index image; layers are ordered by name."""
    o = with_contents(images.sparkSession, options.checked())

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        layers = [np.frombuffer(r.px, "<i4").reshape(r.height, r.width) for r in rows.itertuples()]
        names = [n.rsplit("/", 1)[-1].rsplit(".", 1)[0] for n in rows["name"]]
        made = layered_files(layers, o.base or names[0], names, o)
        return pd.DataFrame([(int(key[0]), n, d) for n, d in made], columns=["image_id", "name", "data"])

    return images.groupBy(group).applyInPandas(run, FILES)


def run_files(spark: SparkSession, options: EncodeOptions, folder: str) -> DataFrame:
    """Read the inputs, convert them, write the files; returns what was written."""
    from ..sources.files import read_images

    images = None
    for path in options.inputs:
        one = read_images(spark, path)
        images = one if images is None else images.unionByName(one)
    if images is None:
        raise ValueError("no input")
    layered = options.mode == "texture" and len(options.inputs) > 1
    files = convert_layers(images.withColumn("set_id", F.lit(0)), options) if layered else convert(images, options)
    return sinks.write_files(files, folder)
