"""Exhaustive checks of the closed forms, and expressions against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import EncodeOptions, Reduction
from tilewright.functions import color, texture
from tilewright.operators import histogram, nearest
from tilewright.operators.palette import snap15_array


def values(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


def test_ramp(spark):
    d = spark.range(256)
    five = values(d, color.to5("id"))
    assert five == [(x * 62 + 255) // 510 for x in range(256)] and five[0] == 0 and five[-1] == 31
    eight = values(spark.range(32), color.to8("id"))
    assert [five[x] for x in eight] == list(range(32))
    six = values(d, color.snap6("id"))
    assert sorted(set(six)) == [(k * 510 + 63) // 126 for k in range(64)]


def test_15_bit_round_trip(spark):
    d = spark.range(1 << 15)
    assert values(d, color.to15(color.from15("id"))) == list(range(1 << 15))
    assert values(d, color.swap_red_blue15(color.swap_red_blue15("id"))) == list(range(1 << 15))


def test_yiq_inverse_and_numpy_twin(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(-(1 << 31), 1 << 31, 3000).astype(np.int32)
    px[:4] = [0, -1, 255 << 24 >> 0 if False else -16777216, 128]
    d = spark.createDataFrame([(k, int(v)) for k, v in enumerate(px)], "id long, rgba int")
    want = nearest.yiq_array(px)
    got = np.array([[c[n] for n in "yiqa"] for c in values(d, color.yiq("rgba"))])
    assert np.abs(got - want).max() < 1e-9
    back = values(d, color.to_rgb(color.yiq("rgba")))
    shown = np.where(((px.astype(np.int64) >> 24) & 255) == 0, 0, px)
    assert back == shown.tolist() == nearest.rgba_array(want).tolist()
    snapped = values(d, color.snap15("rgba"))
    assert snapped == (snap15_array(px) & 0xFFFFFF).tolist()


def test_distance(spark):
    red = Reduction(alpha_mode="palette")
    a, b = -1, 0x40102030
    d = spark.range(1).select(color.distance(color.yiq(F.lit(a)), color.yiq(F.lit(b)), red)).first()[0]
    assert abs(d - nearest.differences(nearest.yiq_array(np.array([a])), nearest.yiq_array(np.array([b])), red)[0, 0]) < 1e-6 * d
    same = spark.range(1).select(color.distance(color.yiq(F.lit(a)), color.yiq(F.lit(a)), red)).first()[0]
    assert same == 0


def test_hex_and_keys(spark):
    d = spark.createDataFrame([("#102030",), ("102030",), ("#1",), ("zz10-20-30",), ("99102030",)], "s string")
    assert [r[0] for r in d.select(color.parse_hex("s")).collect()] == [0x302010, 0x302010, 0x010000, 0x302010, 0x302010]
    k = spark.range(1).select(color.apply_alpha_key(F.lit(-1), 0xFFFFFF), color.apply_alpha_key(F.lit(-2), 0xFFFFFF)).first()
    assert tuple(k) == (0, -2)


def test_sizes(spark):
    d = spark.createDataFrame([(8, 16, f) for f in range(1, 8)], "w int, h int, f int")
    rows = d.select(texture.texel_bytes("w", "h", "f"), texture.index_bytes("w", "h", "f"), texture.vram_bytes("w", "h", "f"), texture.format_name("f"), texture.param_fields(texture.image_param("w", "h", "f", F.lit(1)))).collect()
    assert [r[0] for r in rows] == [128, 32, 64, 128, 32, 128, 256] and rows[4][1] == 16 and rows[4][2] == 48
    assert [r[3] for r in rows] == ["a3i5", "palette4", "palette16", "palette256", "tex4x4", "a5i3", "direct"]
    assert all(tuple(r[4]) == (f, 8, 16, 1) for f, r in enumerate(rows, 1))
    sides = spark.createDataFrame([(x,) for x in (1, 8, 9, 64, 1000, 1024)], "x int").select(texture.round_side("x"), texture.valid_side("x"), texture.log2_floor("x")).collect()
    assert [r[0] for r in sides] == [8, 8, 16, 64, 1024, 1024] and [r[1] for r in sides] == [False, True, False, True, False, True] and [r[2] for r in sides] == [0, 3, 3, 6, 9, 10]


def test_flat_image_weight(spark):
    px = [(0, 0, y, x, -12345) for y in range(8) for x in range(8)]
    h = histogram.weighted_histogram(spark.createDataFrame(px, "image_id long, layer int, y int, x int, rgba int")).collect()
    assert len(h) == 1 and h[0].weight == 64 * 14


def test_translucent_bounds(spark):
    px = [(a, 0, 0, 0, (a << 24) - (1 << 32 if a > 127 else 0)) for a in (0, 4, 5, 128, 250, 251, 255)]
    f = {r.image_id: (r.translucent, r.has_transparent) for r in histogram.image_facts(spark.createDataFrame(px, "image_id long, layer int, y int, x int, rgba int")).collect()}
    assert f == {0: (False, True), 4: (False, True), 5: (True, True), 128: (True, False), 250: (True, False), 251: (False, False), 255: (False, False)}


def test_options():
    assert EncodeOptions(bg_type="affine", palettes=4, max_chars=900).checked().max_chars == 256
    assert EncodeOptions(output="grf").checked().codecs == ("none",)
    assert EncodeOptions(bg_type="text4").checked().max_colors == 16
    for bad in (EncodeOptions(mode="texture", output="nns"), EncodeOptions(palettes=17), EncodeOptions(screen_only=True), EncodeOptions(bg_type="text4", palette_offset=4, max_colors=14), EncodeOptions(diffuse=2.0)):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(ValueError):
        Reduction(balance=40)
