"""Colours as Column expressions.

``rgba`` columns are integers with red in the low byte and alpha in the high one; 15-bit
colours are integers in 0..65535 with red in the low five bits and bit 15 for alpha.  All
bit conversions are closed forms, so they stay inside generated code without a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Reduction

# Rows give y, i, q from red, green, blue, and the inverse.
TO_YIQ = ((0.5146329, 1.2303905, 0.2588982), (-0.5885085, -0.3060195, 0.8945280), (0.7227111, -1.3898515, 0.6671403))
TO_RGB = ((0.4990215, -0.56700944, 0.5666126), (0.4990215, 0.07502532, -0.2942529), (0.4990215, 0.77053964, 0.2721091))
# Exponent and factor of the error curve beyond 8, by channel.
DIFFUSE_CURVE = {"y": (0.9, 0.94140625), "i": (0.85, 0.98828125), "q": (0.85, 0.89453125)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: int) -> Column:
    """Whole-number quotient."""
    return F.floor(a / F.lit(b)).cast("int")


def shift_left(x, n: int) -> Column:
    return F.call_function("shiftleft", _c(x), F.lit(n))


def channel(rgba, k: int) -> Column:
    """Channel 0..3: red, green, blue, alpha."""
    return F.shiftrightunsigned(_c(rgba), 8 * k).bitwiseAND(F.lit(255))


def pack(r, g, b, a=0) -> Column:
    """Four channels as one signed integer."""
    return _c(r).bitwiseOR(shift_left(_c(g), 8)).bitwiseOR(shift_left(_c(b), 16)).bitwiseOR(shift_left(_lit(a) if not isinstance(a, str) else _c(a), 24)).cast("int")


def to5(x) -> Column:
    return _div(_c(x) * 62 + 255, 510)


def to8(x) -> Column:
    return _div(_c(x) * 510 + 31, 62)


def snap6(x) -> Column:
    return _div(_div(_c(x) * 126 + 255, 510) * 510 + 63, 126)


def to15(rgba) -> Column:
    """24-bit to 15-bit colour."""
    r, g, b = (to5(channel(rgba, k)) for k in range(3))
    return r.bitwiseOR(shift_left(g, 5)).bitwiseOR(shift_left(b, 10)).cast("int")


def part15(c, k: int) -> Column:
    """Five-bit channel 0..2 of a 15-bit colour, or its alpha bit (3)."""
    return F.shiftrightunsigned(_c(c), 5 * k).bitwiseAND(F.lit(1 if k == 3 else 31))


def from15(c) -> Column:
    """15-bit to 24-bit colour, alpha 0."""
    return pack(*(to8(part15(c, k)) for k in range(3)))


def snap15(rgba) -> Column:
    """Nearest colour of the 15-bit gamut, alpha 0."""
    return from15(to15(rgba))


def snap18(rgba) -> Column:
    """Nearest colour of the 18-bit gamut, alpha 0."""
    return pack(*(snap6(channel(rgba, k)) for k in range(3)))


def interpolate15(c1, c2, amount: float) -> Column:
    """Truncating blend of two 15-bit colours."""
    parts = [F.floor(part15(c1, k) * F.lit(1.0 - amount) + part15(c2, k) * F.lit(float(amount))).cast("int") for k in range(3)]
    return parts[0].bitwiseOR(shift_left(parts[1], 5)).bitwiseOR(shift_left(parts[2], 10))


def swap_red_blue(rgba) -> Column:
    return pack(channel(rgba, 2), channel(rgba, 1), channel(rgba, 0), channel(rgba, 3))


def swap_red_blue15(c) -> Column:
    return _c(c).bitwiseAND(F.lit(0x83E0)).bitwiseOR(shift_left(part15(c, 0), 10)).bitwiseOR(part15(c, 2))


def yiq(rgba) -> Column:
    """struct(y, i, q, a), premultiplied by alpha in 0..1."""
    r, g, b = (channel(rgba, k).cast("double") for k in range(3))
    a = channel(rgba, 3) / F.lit(255.0)
    parts = [(a * (F.lit(m[0]) * r + F.lit(m[1]) * g + F.lit(m[2]) * b)).alias(n) for n, m in zip("yiq", TO_YIQ, strict=True)]
    return F.struct(*parts, a.alias("a"))


def luma(rgba) -> Column:
    """The y channel of a colour taken as opaque."""
    m = TO_YIQ[0]
    return F.lit(m[0]) * channel(rgba, 0) + F.lit(m[1]) * channel(rgba, 1) + F.lit(m[2]) * channel(rgba, 2)


def to_rgb(c) -> Column:
    """The nearest rgba of a premultiplied struct(y, i, q, a)."""
    c = _c(c)
    a = c["a"]
    y, i, q = (F.when(a > 0, c[n] / a).otherwise(F.lit(0.0)) for n in "yiq")
    whole = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
    return pack(*(whole(F.lit(m[0]) * y + F.lit(m[1]) * i + F.lit(m[2]) * q) for m in TO_RGB), whole(a * 255.0))


def distance(c1, c2, reduction: Reduction = Reduction()) -> Column:
    """Weighted squared difference of two struct(y, i, q, a) columns over the assumed backgrounds."""
    c1, c2 = _c(c1), _c(c2)
    d = {n: c1[n] - c2[n] for n in "yiqa"}
    plain = sum((F.lit(w) * d[n] * d[n] for n, w in zip("iq", reduction.squares[1:], strict=True)), F.lit(reduction.squares[0]) * d["y"] * d["y"])
    mixed = sum((F.lit(x) * d[n] for n, x in zip("iq", reduction.interaction[1:], strict=True)), F.lit(reduction.interaction[0]) * d["y"])
    return plain + F.when(d["a"] != 0, F.lit(reduction.alpha_square) * d["a"] * d["a"] - d["a"] * mixed).otherwise(F.lit(0.0))


def layered_distance(v1, v2, reduction: Reduction = Reduction()) -> Column:
    """Sum of distances over the layers of two arrays of struct(y, i, q, a)."""
    return F.aggregate(F.zip_with(v1, v2, lambda a, b: distance(a, b, reduction)), F.lit(0.0), lambda s, x: s + x)


def mask(rgba, to_gamut: bool = True) -> Column:
    """Colours that a palette may hold: the 15-bit gamut, or any; alpha stays."""
    return snap15(rgba).bitwiseOR(_c(rgba).bitwiseAND(F.lit(-16777216))) if to_gamut else _c(rgba)


def same_color(a, b) -> Column:
    return _c(a).eqNullSafe(_c(b))


def opaque(c) -> Column:
    """A premultiplied struct as if its alpha were 1; the fully transparent one stays."""
    c = _c(c)
    over = F.when(c["a"] != 0, c["a"]).otherwise(F.lit(1.0))
    return F.struct(*((c[n] / over).alias(n) for n in "yiq"), F.when(c["a"] != 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("a"))


def transparent() -> Column:
    return F.struct(*(F.lit(0.0).alias(n) for n in "yiqa"))


def black(c) -> Column:
    return F.struct(*(F.lit(0.0).alias(n) for n in "yiq"), _c(c)["a"].alias("a"))


def white(c) -> Column:
    a = _c(c)["a"]
    return F.struct((F.lit(511.0) * a).alias("y"), F.lit(0.0).alias("i"), F.lit(0.0).alias("q"), a.alias("a"))


def scale(c, by) -> Column:
    return F.struct(*((_c(c)[n] * _lit(by)).alias(n) for n in "yiqa"))


def subtract(c1, c2) -> Column:
    return F.struct(*((_c(c1)[n] - _c(c2)[n]).alias(n) for n in "yiqa"))


def diffuse_curve(x, name: str) -> Column:
    """Errors beyond 8 count less; odd.  Alpha uses the curve of y on a scale of 511."""
    if name == "a":
        return diffuse_curve(_c(x) * 511.0, "y") * F.lit(1.0 / 511.0)
    x, (power, factor) = _c(x), DIFFUSE_CURVE[name]
    size = F.abs(x)
    bent = F.when(size <= 8.0, size).otherwise(F.lit(8.0) + F.pow(F.greatest(size - 8.0, F.lit(0.0)), F.lit(power)) * F.lit(factor))
    return F.when(x < 0, -bent).otherwise(bent)


def blend18(c1, c2, eighths: int) -> Column:
    """(8 - eighths) of c1 and eighths of c2 in the 18-bit gamut, opaque."""
    parts = [_div(channel(c1, k) * (8 - eighths) + channel(c2, k) * eighths + 4, 8) for k in range(3)]
    return pack(*(snap6(p) for p in parts), 255)


def parse_hex(text) -> Column:
    """The last six hex digits of a string as red, green, blue; anything else in it is skipped."""
    digits = F.concat(F.lit("000000"), F.regexp_replace(_c(text), "[^0-9A-Fa-f]", ""))
    value = F.conv(F.right(digits, F.lit(6)), 16, 10).cast("int")
    return pack(F.shiftright(value, 16).bitwiseAND(F.lit(255)), F.shiftright(value, 8).bitwiseAND(F.lit(255)), value.bitwiseAND(F.lit(255)))


def apply_alpha_key(rgba, key: int) -> Column:
    """Pixels with the key's colour become transparent black."""
    return F.when(_c(rgba).bitwiseAND(F.lit(0xFFFFFF)) == F.lit(key & 0xFFFFFF), F.lit(0)).otherwise(_c(rgba))


def zero_transparent(rgba) -> Column:
    return F.when(channel(rgba, 3) == 0, F.lit(0)).otherwise(_c(rgba))


def threshold_alpha(rgba, threshold: int = 128) -> Column:
    """Alpha becomes 0 (with black) or 255."""
    return F.when(channel(rgba, 3) < threshold, F.lit(0)).otherwise(_c(rgba).bitwiseOR(F.lit(-16777216)))


def is_translucent(rgba) -> Column:
    return channel(rgba, 3).between(5, 250)


def alpha_level(a, levels: int) -> Column:
    """Alpha 0..255 in 0..levels."""
    return _div(_c(a) * 2 * levels + 255, 510)


def level_alpha(level, bits: int) -> Column:
    """3- or 5-bit alpha back to 0..255."""
    five = shift_left(_c(level), 2).bitwiseOR(F.shiftright(_c(level), 1)) if bits == 3 else _c(level)
    return to8(five)
