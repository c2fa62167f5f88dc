"""Texture formats: sizes, choices and bit fields as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import shift_left

# Format numbers, bits of a pixel, palette sizes.
FORMATS = {"a3i5": 1, "palette4": 2, "palette16": 3, "palette256": 4, "tex4x4": 5, "a5i3": 6, "direct": 7}
TEXEL_BITS = {1: 8, 2: 2, 3: 4, 4: 8, 5: 2, 6: 8, 7: 16}
VRAM_BITS = {**TEXEL_BITS, 5: 3}
INDEX_COLORS = {1: 32, 2: 4, 3: 16, 4: 256, 6: 8}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _of(table: dict[int, object], key, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(_c(key) == k, F.lit(v)).otherwise(out)
    return out


def format_name(fmt) -> Column:
    return _of({v: k for k, v in FORMATS.items()}, fmt, "")


def log2_floor(x) -> Column:
    """Place of the highest set bit; -1 for 0."""
    return (F.length(F.bin(_c(x).cast("long"))) - 1 - (_c(x) == 0).cast("int")).cast("int")


def valid_side(x) -> Column:
    return (F.bit_count(_c(x)) == 1) & _c(x).between(8, 1024)


def round_side(x) -> Column:
    """The next power of two, at least 8."""
    x = _c(x)
    return F.when(x < 8, F.lit(8)).otherwise(F.call_function("shiftleft", F.lit(1), log2_floor(x * 2 - 1)))


def texel_bytes(width, height, fmt) -> Column:
    return F.floor(_c(width) * _c(height) * _of(TEXEL_BITS, fmt, 0) / 8).cast("long")


def index_bytes(width, height, fmt) -> Column:
    return F.when(_c(fmt) == 5, F.floor(texel_bytes(width, height, fmt) / 2)).otherwise(F.lit(0)).cast("long")


def vram_bytes(width, height, fmt) -> Column:
    return F.floor(_c(width) * _c(height) * _of(VRAM_BITS, fmt, 0) / 8).cast("long")


def palette_bytes(colors) -> Column:
    return _c(colors) * 2


def image_param(width, height, fmt, transparent0) -> Column:
    """Format, sides and the colour-0 flag in one integer."""
    side = lambda x: log2_floor(x) - 3
    return shift_left(_c(fmt), 26).bitwiseOR(shift_left(side(width), 20)).bitwiseOR(shift_left(side(height), 23)).bitwiseOR(shift_left(_c(transparent0).cast("int"), 29))


def param_fields(param) -> Column:
    """struct(fmt, width, height, transparent0) of such an integer."""
    p = _c(param)
    bits = lambda at, n: F.shiftright(p, at).bitwiseAND(F.lit(n))
    return F.struct(
        bits(26, 7).alias("fmt"),
        F.call_function("shiftleft", F.lit(8), bits(20, 7)).alias("width"),
        F.call_function("shiftleft", F.lit(8), bits(23, 7)).alias("height"),
        bits(29, 1).alias("transparent0"),
    )


def choose_format(area, opaque_colors, colors, translucent) -> Column:
    """The format that suits an image, from its counts (opaque_colors: ignoring alpha, without transparent pixels)."""
    return (
        F.when(_c(translucent), F.when(_c(opaque_colors) < 16, F.lit("a5i3")).otherwise(F.lit("a3i5")))
        .when(_c(colors) <= 4, F.lit("palette4"))
        .when(_c(area) <= 1024 * 512, F.lit("tex4x4"))
        .when(_c(colors) <= 32, F.lit("palette16"))
        .otherwise(F.lit("palette256"))
    )


def block_palette_colors(area) -> Column:
    """Palette size for 4x4 blocks: 8 times the side up to 128 x 128, then 256 a doubling; a multiple of 16."""
    area = _c(area)
    raw = F.when(area <= 128 * 128, F.floor(F.sqrt(area.cast("double")) * 8)).otherwise(F.floor((F.log2(area.cast("double")) - 10) * 256 + 1e-6)).cast("int")
    return (F.floor((raw + 15) / 16) * 16).cast("int")


def screen_entry(char, flip, palette) -> Column:
    return _c(char).bitwiseAND(F.lit(0x3FF)).bitwiseOR(shift_left(_c(flip), 10)).bitwiseOR(shift_left(_c(palette), 12)).cast("int")


def screen_fields(entry) -> Column:
    e = _c(entry)
    return F.struct(e.bitwiseAND(F.lit(0x3FF)).alias("char"), F.shiftright(e, 10).bitwiseAND(F.lit(3)).alias("flip"), F.shiftright(e, 12).bitwiseAND(F.lit(15)).alias("palette"))


def block_index_fields(index) -> Column:
    """struct(opaque, interpolated, address) of a 4x4 block's 16-bit palette index."""
    i = _c(index)
    return F.struct((i.bitwiseAND(F.lit(0x8000)) != 0).alias("opaque"), (i.bitwiseAND(F.lit(0x4000)) != 0).alias("interpolated"), shift_left(i.bitwiseAND(F.lit(0x3FFF)), 1).alias("address"))
