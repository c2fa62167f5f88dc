"""Round trips and properties of codecs, palettes, tiles, textures and dithering."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.config import Reduction
from tilewright.operators import blocks4, codecs, dither, nearest, palette, texture, tiles

RED = Reduction()
RNG = np.random.default_rng(7)


def image(h, w, colors=6):
    table = (RNG.integers(0, 1 << 24, colors) | 0xFF000000).astype(np.uint32).view(np.int32)
    return table[RNG.integers(0, colors, (h, w))]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"a", b"abc", b"\0" * 40, b"xyzxyz"]), max_size=40).map(b"".join)), st.sampled_from(codecs.CODECS), st.booleans())
def test_codecs_round_trip(data, codec, safe):
    assert codecs.decode(codecs.encode(data, codec, safe)) == data


def test_codec_details():
    run = codecs.rle(b"\x41" * 200)
    assert run == bytes([0x30, 200, 0, 0]) + run[4:] and len(run) == 8
    text = b"abc" * 20
    packed = codecs.lz(text)
    assert packed[4] == 0b00011110 or packed[5:8] == b"abc"
    assert len(codecs.lzx(b"q" * 5000)) < len(codecs.lz(b"q" * 5000))
    for kind in (4, 8):
        assert codecs.decode(codecs.huffman(b"\0" * 16, kind)) == b"\0" * 16
    every = bytes(range(256)) * 3
    assert codecs.decode(codecs.huffman(every)) == every
    skewed = b"".join(bytes([k]) * min(1 << k, 3000) for k in range(14)) + bytes(range(256))
    assert codecs.decode(codecs.huffman(skewed)) == skewed
    assert codecs.smallest(text, ()) == text
    best = codecs.smallest(text, codecs.CODECS)
    assert all(len(best) <= len(codecs.encode(text, c)) for c in codecs.CODECS)
    unsafe = codecs.longest_matches(b"aaaaaaaa", 1, 18)
    assert unsafe[1] == (7, 1) and codecs.longest_matches(b"aaaaaaaa", 2, 18)[2][1] >= 2
    with pytest.raises(ValueError):
        codecs.decode(b"\x99\0\0\0")


def test_lz_parse_is_cheapest():
    """Against all parses of short strings."""

    def cheapest(data):
        matches = codecs.longest_matches(data, 1, 18)
        best = [0] * (len(data) + 1)
        for i in range(len(data) - 1, -1, -1):
            best[i] = min([best[i + 1] + 9] + [best[i + n] + 17 for n in range(3, matches[i][0] + 1)])
        return best[0]

    for _ in range(50):
        data = bytes(RNG.choice(list(b"ab"), RNG.integers(1, 40)).tolist())
        tokens = codecs.best_parse(codecs.longest_matches(data, 1, 18), False)
        assert sum(17 if far else 9 for _, far in tokens) == cheapest(data)


def test_palette_keeps_few_colors():
    px = palette.snap15_array(image(16, 16, 5))
    made = texture.palette_for(px, 8, RED)
    assert set(made.tolist()) == set(px.ravel().tolist())


def test_palette_error_falls_with_size():
    px = (RNG.integers(0, 1 << 24, (24, 24)) | 0xFF000000).astype(np.uint32).view(np.int32)
    colors, weight = texture.histogram_of(px, RED)
    points = nearest.yiq_array(colors)
    errors = [(nearest.nearest_entries(points, nearest.yiq_array(texture.palette_for(px, n, RED)), RED)[1] * weight).sum() for n in (2, 4, 8, 16, 32)]
    assert errors == sorted(errors, reverse=True)


def test_lloyd_never_raises_the_error():
    points = nearest.yiq_array((RNG.integers(0, 1 << 24, 300) | 0xFF000000).astype(np.int64))[:, None]
    weight = RNG.random(300) + 0.1
    start = points[:7].copy()
    end = palette.lloyd(points, weight, start, RED)
    err = lambda c: (nearest.nearest_entries(points, c, RED)[1] * weight).sum()
    assert err(end) <= err(start) + 1e-6


def test_order_of_rows_changes_nothing():
    points = nearest.yiq_array((RNG.integers(0, 1 << 24, 200) | 0xFF000000).astype(np.int64))[:, None]
    weight = RNG.integers(1, 9, 200).astype(float)
    p = RNG.permutation(200)
    assert (palette.create_palette(points, weight, 9, RED) == palette.create_palette(points[p], weight[p], 9, RED)).all()


def test_layers():
    a, b = image(16, 16, 4), image(16, 16, 3)
    texel, palettes = texture.encode_layers([palette.snap15_array(a), palette.snap15_array(b)], 16, RED, 3)
    for layer, words in zip((a, b), palettes, strict=True):
        index = texture.unpack_bits(texel, 4)[:256]
        shown = texture.colors24(np.frombuffer(words, "<u2"))[index].reshape(16, 16)
        assert (shown == (palette.snap15_array(layer) & 0xFFFFFF)).all()


def test_several_palettes():
    tiles_px = [image(8, 8, 3).ravel() for _ in range(6)]
    hists = [np.unique(palette.snap15_array(t), return_counts=True) for t in tiles_px * 2]
    at, found = palette.merge_palettes([nearest.yiq_array(c[:, None]) for c, _ in hists], [n.astype(float) for _, n in hists], 3, 16, RED)
    assert len(found) == 3 and (at[:6] == at[6:]).all()
    assert all(set(hists[k][0].tolist()) <= set(found[at[k]][:, 0].tolist()) for k in range(12))


def test_dither_without_diffusion_is_nearest():
    px, pal = image(12, 10, 30), image(1, 8, 8).ravel()
    got = dither.index_image(px, pal, RED)
    want = nearest.nearest_entries(nearest.yiq_array(px.ravel()), nearest.yiq_array(pal), RED)[0]
    assert (got.ravel() == want).all()
    clear = px.copy()
    clear[:3] = 0
    reserved = dither.index_image(clear, pal, Reduction(alpha_mode="reserve"))
    assert (reserved[:3] == 0).all() and (reserved[3:] > 0).all()


def test_dither_keeps_the_mean():
    grey = np.full((32, 32), 0, np.int64) | 100 | 100 << 8 | 100 << 16 | 0xFF000000
    px = grey.astype(np.uint32).view(np.int32)
    pal = np.array([0xFF505050, 0xFF808080], np.uint32).view(np.int32)
    plain, mixed = (dither.index_image(px, pal, RED, a) for a in (0.0, 1.0))
    assert len(np.unique(plain)) == 1 and 0.1 < mixed.mean() < 0.9


def test_dither_by_hand():
    """One row of three equal greys between two entries: the first is matched, what it leaves is bent and moves the next."""
    grey = np.array([[0xFF646464] * 3], np.uint32).view(np.int32)
    pal = np.array([0xFF505050, 0xFF808080], np.uint32).view(np.int32)
    points, (dark, light) = nearest.yiq_array(grey)[0], nearest.yiq_array(pal)
    want, error = [], 0.0
    for p in points:
        y = p[0] + dither._curve(np.array([error * 0.8, 0.0, 0.0, 0.0]))[0]
        k = int(abs(y - light[0]) < abs(y - dark[0]))
        want.append(k)
        error = (y - (dark, light)[k][0]) * 7 / 16
    assert dither.index_image(grey, pal, RED, 0.8)[0].tolist() == want
    # an edge: the neighbourhood is far from the pixel, so nothing is passed on and the pixel itself is matched
    edge = np.array([[0xFF000000] * 2 + [0xFFFFFFFF] * 2], np.uint32).view(np.int32)
    ends = np.array([0xFF101010, 0xFFF0F0F0], np.uint32).view(np.int32)
    assert dither.index_image(edge, ends, RED, 1.0)[0].tolist() == [0, 0, 1, 1]


def test_dither_matches_the_neighbourhood():
    """Where surroundings are calm it is their mean that is matched, even before any error has gathered."""
    px = np.array([[0xFF606060, 0xFF686868, 0xFF606060]], np.uint32).view(np.int32)
    pal = np.array([0xFF505050, 0xFF666666, 0xFF7C7C7C], np.uint32).view(np.int32)
    mean = dither.blurred(nearest.yiq_array(px))[0, 0]
    got = dither.index_image(px, pal, RED, 1e-9)[0, 0]
    assert got == nearest.nearest_entries(mean[None], nearest.yiq_array(pal), RED)[0][0]


def test_merge_tiles():
    base = image(8, 8, 3).ravel()
    flips = np.array([base[np.arange(64) ^ m] for m in tiles.FLIPS])
    master, flip, _ = tiles.merge_tiles(flips, 64, RED)
    assert (master == 0).all() and flip.tolist() == [0, 1, 2, 3]
    assert len(set(tiles.merge_tiles(flips, 64, RED, flips=False)[0].tolist())) == 4
    many = np.array([image(8, 8, 20).ravel() for _ in range(20)])
    assert len(set(tiles.merge_tiles(many, 5, RED)[0].tolist())) == 5


@pytest.mark.parametrize("fmt", [1, 2, 3, 4, 5, 6, 7])
@pytest.mark.parametrize("shape", [(16, 16), (6, 10)])
def test_textures_show_few_colors_exactly(fmt, shape):
    px = palette.snap15_array(image(*shape, 2 if fmt == 5 else 4))
    param, texel, pidx, pal = texture.encode_image(px, fmt, RED)
    shown = texture.decode_image(param, texel, pidx, pal)
    assert shown.shape == tuple(texture.next_side(n) for n in shape) and (shown[: shape[0], : shape[1]] == px).all()


def test_transparent_index():
    px = palette.snap15_array(image(8, 8, 3))
    px[0] = 0
    param, texel, pidx, pal = texture.encode_image(px, 3, RED, transparent0=True)
    assert param >> 29 == 1 and (texture.decode_image(param, texel, pidx, pal) == px).all()


def test_alpha_formats():
    px = (image(8, 8, 3).astype(np.int64) & 0xFFFFFF).reshape(8, 8) | (np.arange(64).reshape(8, 8) * 4) << 24
    px = px.astype(np.uint32).view(np.int32)
    for fmt, step in ((1, 37), (6, 9)):
        for dithered in (False, True):
            shown = texture.decode_image(*texture.encode_image(px, fmt, RED, dither_alpha=dithered))
            gap = np.abs(((shown.astype(np.int64) >> 24) & 255) - ((px.astype(np.int64) >> 24) & 255))
            assert gap.max() <= step * (2 if dithered else 1)


def test_layout_of_drawn_colors():
    """Single colours share pairs, blends keep theirs, halves share or narrow; nothing drawn changes."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        pal = rng.integers(0, 6, 24) * rng.integers(1, 5000)
        pidx = rng.integers(0, 11, 30) | rng.choice([0, 0x4000, 0x8000, 0xC000], 30)
        texel = np.array([sum(int(v) << 2 * k for k, v in enumerate(rng.choice(rng.integers(0, 4, 2), 16))) for _ in range(30)])
        texel |= np.where(pidx & 0x8000, 0, 3)  # blocks without transparency are drawn in opaque modes
        lean = blocks4.compacted(pidx, texel, pal)
        assert len(lean) % 2 == 0 and len(lean) <= 24
        flat = np.where(lean < 0, 0, lean)
        shown = blocks4.decode_blocks(texel, pidx, pal, 120, 4).reshape(4, 30, 4).transpose(1, 0, 2).reshape(30, 16)
        assert blocks4.assign(shown, flat, RED)[2].max() < 1e-6
    one = lambda c, n: (np.array([k | 0x4000 for k in range(n)]), np.zeros(n, np.int64), np.repeat(c, 2))
    assert blocks4.compacted(*one(np.arange(1, 5), 4)).tolist() == [1, 2, 3, 4]
    assert blocks4.compacted(*one(np.full(4, 9), 4)).tolist() == [9, -1]
    halfway = np.array([0xAAAAAAAA])
    assert blocks4.compacted(np.array([0x4000]), halfway, np.array([0, 8])).tolist() == [4, 4]
    assert len(blocks4.compacted(np.array([0x4000]), np.array([0xFFFFFFFF]), np.array([0, 8]))) == 0


def test_shared_first_color():
    """An opaque colour 0 of several palettes is the same in all, and the one that saves most."""
    rng = np.random.default_rng(5)
    tiles_of = [np.unique(palette.snap15_array(rng.integers(0, 1 << 24, 12) | 0xFF000000)) for _ in range(6)]
    odd = palette.snap15_array(np.array([0xFF00FF10]))
    points = [nearest.yiq_array(np.concatenate([t, odd])[:, None]) for t in tiles_of]
    weights = [np.r_[np.ones(len(t)), 3.0] for t in tiles_of]
    at, found = palette.merge_palettes(points, weights, 3, 4, RED, shared0=True)
    assert len({p[0, 0] for p in found}) == 1 and all(1 <= len(p) <= 4 for p in found)
    plain = palette.merge_palettes(points, weights, 3, 3, RED)[1]
    loss = lambda made, of: sum((nearest.nearest_entries(p, nearest.yiq_array(made[k]), RED)[1] * w).sum() for p, w, k in zip(points, weights, of, strict=True))
    assert loss(found, at) < loss(plain, at)
    assert palette.merge_palettes([np.zeros((0, 1, 4))] * 2, [np.zeros(0)] * 2, 2, 4, RED, shared0=True)[1][0].tolist() == [[-16777216]]


def test_blocks():
    px = image(16, 16, 40)
    px[:4, :2] = 0
    texel, pidx, pal = blocks4.encode_blocks(px, RED, 32)
    assert len(texel) == 64 and len(pidx) == 32 and len(pal) <= 32
    shown = blocks4.decode_blocks(np.frombuffer(texel, "<u4"), np.frombuffer(pidx, "<u2"), pal, 16, 16)
    assert (shown[:4, :2] == 0).all() and (((shown.astype(np.int64) >> 24) & 255)[4:] == 255).all()
    more = blocks4.encode_blocks(px, RED, 128)
    better = blocks4.decode_blocks(np.frombuffer(more[0], "<u4"), np.frombuffer(more[1], "<u2"), more[2], 16, 16)
    err = lambda s: nearest.differences(nearest.yiq_array(s.ravel()), nearest.yiq_array(px.ravel()), RED).diagonal().sum()
    assert err(better) <= err(shown)
    none = blocks4.encode_blocks(np.zeros((8, 8), np.int32), RED, 16)
    assert (blocks4.decode_blocks(np.frombuffer(none[0], "<u4"), np.frombuffer(none[1], "<u2"), none[2], 8, 8) == 0).all()


def test_trim():
    px = image(10, 16, 4)
    param, texel, pidx, _ = texture.encode_image(px, 4, RED)
    assert len(texture.trim(param, texel, pidx, 10)[0]) == 160
    param, texel, pidx, _ = texture.encode_image(px, 5, RED)
    t, p, rows = texture.trim(param, texel, pidx, 10)
    assert rows == 12 and len(t) == 48 and len(p) == 24


def test_edge_tiles_are_filled(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 3), (1, 7, 7, 9), (1, 9, 1, 4)], "image_id long, y int, x int, rgba int")
    got = {(r.tile_y, r.tile_x): list(r.px) for r in tiles.split_tiles(px).collect()}
    assert got == {(0, 0): [3] + [0] * 62 + [9], (1, 0): [0] * 9 + [4] + [0] * 54}


def test_places_within_groups(spark):
    from pyspark.sql import functions as F

    from tilewright.operators import histogram

    rows = [(g, v) for g in (1, None) for v in (7, 3, 12, 11, 25, 0)]
    got = histogram.placed(spark.createDataFrame(rows, "g int, v int"), ("g",), F.floor(F.col("v") / 10), ("v",), "place")
    assert sorted(((r.g or 0, r.v, r.place) for r in got.collect())) == [(g, v, k) for g in (0, 1) for k, v in enumerate((0, 3, 7, 11, 12, 25))]


def test_cuts_agree_with_one_pass(spark):
    from pyspark.sql import functions as F

    from tilewright.operators import histogram

    points = [(1, float(2 + k % 3), float(k * 7 % 11), float(k), 0.0, 1.0) for k in range(12)]
    df = spark.createDataFrame(points, "g int, weight double, y double, i double, q double, a double").withColumn("score", F.col("y") * 0.4 - 2)
    for r in histogram.split_table(df, ("g",)).collect():
        left = [p for p in points if (p[2], p[3], p[4], p[5]) <= (r.y, r.i, r.q, r.a)]
        right = [p for p in points if p not in left]
        want = 0.0
        for side in (left, right):
            w = sum(p[1] for p in side)
            want += sum(p[1] * p[k] ** 2 for p in side for k in (2, 3, 4, 5)) - (sum(sum(p[1] * p[k] for p in side) ** 2 for k in (2, 3, 4, 5)) / w if w else 0)
        assert r.wss is None if not right else abs(r.wss - want) < 1e-6
