"""Decoders, sinks, the command line and the streaming wrapper."""

import struct
import zlib

import numpy as np
import pytest

from tilewright import cli
from tilewright.config import EncodeOptions, Reduction
from tilewright.operators import codecs, texture
from tilewright.operators.palette import snap15_array
from tilewright.plans import convert
from tilewright.sources import decoders, files, sinks

RNG = np.random.default_rng(3)


def picture(h=6, w=5):
    return RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)


def rgba(v, alpha=255):
    v = v.astype(np.int64)
    return (v[..., 0] | v[..., 1] << 8 | v[..., 2] << 16 | alpha << 24).astype(np.uint32).view(np.int32)


def ppm(v):
    return b"P6\n# made here\n%d %d\n255\n" % (v.shape[1], v.shape[0]) + v.tobytes()


def png(v, kind=2, bits=8, laced=0, filters=(0, 1, 2, 3, 4)):
    h, w, n = v.shape
    rows, last = b"", np.zeros(w * n, np.int64)
    for y in range(h):
        line, f = v[y].ravel().astype(np.int64), filters[y % len(filters)]
        left = np.concatenate([np.zeros(n, np.int64), line[:-n]])
        corner = np.concatenate([np.zeros(n, np.int64), last[:-n]])
        if f == 4:
            p = left + last - corner
            pa, pb, pc = abs(p - left), abs(p - last), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, last, corner))
        else:
            guess = [0 * line, left, last, (left + last) // 2][f]
        rows += bytes([f]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        last = line
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, laced)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_pnm():
    v = picture()
    assert (decoders.decode(ppm(v)) == rgba(v)).all()
    text = "P3\n5 6\n255\n" + " ".join(map(str, v.ravel()))
    assert (decoders.decode(text.encode()) == rgba(v)).all()
    grey = b"P5 2 2 255\n" + bytes([0, 85, 170, 255])
    assert (decoders.decode(grey) & 255).ravel().tolist() == [0, 85, 170, 255]
    assert (decoders.decode(b"P4 3 1\n" + bytes([0b01000000])) & 255).ravel().tolist() == [255, 0, 255]


def test_png():
    v = picture()
    assert (decoders.decode(png(v)) == rgba(v)).all()
    four = RNG.integers(0, 256, (6, 5, 4), dtype=np.uint8)
    assert (decoders.decode(png(four, 6)) == rgba(four[..., :3], four[..., 3].astype(np.int64))).all()
    grey = RNG.integers(0, 256, (4, 4, 1), dtype=np.uint8)
    assert ((decoders.decode(png(grey, 0)) & 255) == grey[..., 0]).all()


def test_bmp_and_sink():
    index = RNG.integers(0, 12, (5, 7))
    table = (RNG.integers(0, 1 << 24, 12) | 0).astype(np.int64)
    assert ((decoders.decode(sinks.indexed_bmp(table, index)) & 0xFFFFFF) == table[index]).all()
    many = RNG.integers(0, 1 << 24, 40).astype(np.int64)
    wide = RNG.integers(0, 40, (3, 6))
    assert ((decoders.decode(sinks.indexed_bmp(many, wide)) & 0xFFFFFF) == many[wide]).all()
    v = picture(3, 3)
    rows = b"".join(v[y][:, ::-1].tobytes() + bytes(3) for y in (2, 1, 0))
    raw = struct.pack("<2sIII", b"BM", 54 + len(rows), 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (decoders.decode(raw) == rgba(v)).all()


def test_tga():
    v = picture(4, 3)
    head = lambda kind, bits, flags=32: struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, 3, 4, bits, flags)
    assert (decoders.decode(head(2, 24) + v[..., ::-1].tobytes()) == rgba(v)).all()
    assert (decoders.decode(head(2, 24, 0) + v[::-1, :, ::-1].tobytes()) == rgba(v)).all()
    run = b"".join(bytes([0x80]) + p[::-1].tobytes() for p in v.reshape(-1, 3))
    assert (decoders.decode(head(10, 24) + run) == rgba(v)).all()


def test_gif():
    # two by two, one-bit colours, codes: clear 0 1 1 0 end
    codes, acc, held = [4, 0, 1, 1, 0, 5], 0, 0
    size, out, words = 3, bytearray(), 6
    for k, code in enumerate(codes):
        acc |= code << held
        held += size
        if k > 1:
            words += 1
            size += words == 1 << size
        while held >= 8:
            out.append(acc & 255)
            acc, held = acc >> 8, held - 8
    out.append(acc & 255)
    raw = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes([1, 2, 3, 9, 8, 7]) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + bytes([2, len(out)]) + bytes(out) + b"\0;"
    assert (decoders.decode(raw) & 0xFFFFFF).tolist() == [[0x030201, 0x070809], [0x070809, 0x030201]]


def test_psd_pic_hdr():
    v = picture(3, 4)
    planes = b"".join(v[..., k].tobytes() for k in range(3))
    raw = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, 3, 4, 8, 3) + bytes(12) + b"\0\0" + planes
    assert (decoders.decode(raw) == rgba(v)).all()
    head = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", 4, 3, 1.0, 3, 0) + bytes([0, 8, 0, 0xE0])
    assert (decoders.decode(head + v.tobytes()) == rgba(v)).all()
    flat = np.full((2, 2, 4), 128, np.uint8)
    flat[..., 3] = 129
    shown = decoders.decode(b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 2 +X 2\n" + flat.tobytes())
    assert ((shown & 255) == 255).all()
    with pytest.raises(decoders.Unsupported):
        decoders.decode(b"nothing")


def test_c_source():
    body, extern = sinks.c_array("x_pal", bytes(range(5)), 2)
    assert body == "const uint16_t x_pal[] = {\n    0x0100, 0x0302, 0x0004,\n};\n" and extern == "extern const uint16_t x_pal[3];\n"
    assert "uint32_t" in sinks.c_array("x", bytes(4), 1, True)[0]


def chunks(raw):
    assert raw[:4] == b"RIFF" and struct.unpack("<I", raw[4:8])[0] == len(raw) - 8 and raw[8:12] == b"GRF "
    at, out = 12, {}
    while at < len(raw):
        tag, n = struct.unpack_from("<4sI", raw, at)
        out[tag] = raw[at + 8 : at + 8 + n]
        at += 8 + (n + 3 & ~3)
    return out


def test_containers():
    px = snap15_array(rgba(picture(8, 8)))
    param, texel, pidx, pal = texture.encode_image(px, 4, Reduction())
    c = chunks(sinks.grf_texture(4, 8, 8, texel, pidx, pal, False, ("lz", "none")))
    assert len(c[b"HDRX"]) == 24 and codecs.decode(c[b"GFX "]) == texel and codecs.decode(c[b"PAL "]) == pal
    n = sinks.nclr(pal, 8, "affine_ext")
    assert n[:4] == b"RLCN" and struct.unpack_from("<HHIHH", n, 4) == (0xFEFF, 0x0100, len(n), 16, 1) and n[16:20] == b"TTLP"
    assert struct.unpack_from("<H", sinks.nclr(pal, 4, "text4", 32, True), 14)[0] == 2
    assert b"RAHC" in sinks.ncgr(bytes(64), 1, 1, 8, merged=True) and b"NRCS" in sinks.nscr(bytes(2), "text4", 1, 1)
    raw = sinks.nns_tga(texture.decode_image(param, texel, pidx, pal), 4, texel, pidx, pal, "a_pl", True)
    assert (decoders.tga(raw) == px).all() and raw.endswith(b"nns_endb" + struct.pack("<I", 12)) and b"nns_c0xp" in raw


@pytest.fixture
def folder(tmp_path):
    v = (picture(16, 24) // 64) * 64
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ppm").write_bytes(ppm(v))
    (tmp_path / "in" / "b.png").write_bytes(png(v))
    return tmp_path, v


def test_reading(spark, folder):
    path, v = folder
    got = files.read_images(spark, str(path / "in")).collect()
    assert sorted(r.name.rsplit("/", 1)[-1] for r in got) == ["a.ppm", "b.png"]
    assert all((np.frombuffer(r.px, "<i4").reshape(16, 24) == rgba(v)).all() for r in got)
    px = files.pixels_of(files.read_images(spark, str(path / "in" / "a.ppm")))
    assert px.count() == 384 and {(r.y, r.x): r.rgba for r in px.collect()}[3, 5] == rgba(v)[3, 5]
    back = files.images_of(px).first()
    assert (np.frombuffer(back.px, "<i4").reshape(16, 24) == rgba(v)).all()
    (path / "w.bin").write_bytes(bytes([1, 2, 3, 4, 5]))
    assert [r.value for r in files.read_words(spark, str(path / "w.bin")).orderBy("i").collect()] == [0x0201, 0x0403]


KINDS = [["-gb", "-bt4", "-p", "2"], ["-gb", "-bt8"], ["-gb", "-ba"], ["-gb", "-bA", "-oc"], ["-gb", "-bB", "-od"], ["-gb", "-og", "-cbios"], ["-gb", "-onns", "-pc"], ["-gb", "-od"], ["-gt"], ["-gt", "-f", "palette16", "-d", "50", "-clz"], ["-gt", "-f", "5", "-og"], ["-gt", "-f", "a3i5", "-ot"], ["-gt", "-f", "direct", "-oc", "-tt"], ["-gt", "-f", "palette256", "-t0x", "-k", "#000000"]]


@pytest.mark.parametrize("switches", KINDS, ids=" ".join)
def test_conversions(folder, switches):
    _, v = folder
    o = cli.options_of([*switches, "-o", "out"])
    made = dict((convert.texture_files if o.mode == "texture" else convert.background_files)(rgba(v), "out", o))
    assert made and all(isinstance(d, bytes) and d for d in made.values())
    if "out_scr.bin" in made and o.bg_type in ("affine_ext", "text8"):
        entries = np.frombuffer(made["out_scr.bin"], "<u2").reshape(2, 3)
        chars = np.frombuffer(made["out_chr.bin"], np.uint8).reshape(-1, 64)
        words = np.frombuffer(made["out_pal.bin"], "<u2").reshape(-1, 256)
        shown = np.array([texture.colors24(words[e >> 12][chars[e & 1023][np.arange(64) ^ (0, 7, 56, 63)[e >> 10 & 3]]]) for e in entries.ravel()])
        grid = shown.reshape(2, 3, 8, 8).transpose(0, 2, 1, 3).reshape(16, 24)
        assert (grid == (snap15_array(rgba(v)) & 0xFFFFFF)).all()


def test_screen_from_existing_data(folder):
    path, v = folder
    first = dict(convert.background_files(rgba(v), "out", cli.options_of(["-gb", "-bA"])))
    (path / "p.bin").write_bytes(first["out_pal.bin"])
    (path / "c.bin").write_bytes(first["out_chr.bin"])
    o = cli.options_of(["-gb", "-bA", "-se", "-wp", str(path / "p.bin"), "-wc", str(path / "c.bin"), "-p0o"])
    again = dict(convert.background_files(rgba(v), "out", o))
    assert len(again["out_scr.bin"]) == len(first["out_scr.bin"])


def grey(h, w, level):
    return rgba(np.full((h, w, 3), level, np.uint8))


def test_diffusion_of_backgrounds():
    """A ramp of greys in two colours: diffusion mixes them, tile by tile, and the default keeps a plain edge."""
    ramp = np.concatenate([grey(16, 8, v) for v in (100, 110, 120, 130, 140, 150)], axis=1)
    plain, mixed = (convert.background(ramp, EncodeOptions(max_colors=3, bg_type=kind, diffuse=d).checked()) for kind, d in (("text4", 0.0), ("text4", 1.0)))
    assert all(len(np.unique(t)) == 1 for t in plain["chars"]) and any(len(np.unique(t)) == 2 for t in mixed["chars"])
    assert (mixed["chars"] > 0).all()
    opaque = convert.background(ramp, EncodeOptions(max_colors=2, diffuse=1.0, color0_opaque=True).checked())
    assert any(len(np.unique(t)) == 2 for t in opaque["chars"])


def test_diffusion_of_direct_and_layers():
    px = grey(32, 32, 100)
    plain, mixed = (texture.decode_image(*texture.encode_image(px, 7, Reduction(), diffuse=d)) & 255 for d in (0.0, 1.0))
    off = lambda shown: abs(shown.mean() - 100)
    assert len(np.unique(plain)) == 1 and off(mixed) <= off(plain)
    ramp = np.concatenate([grey(32, 8, v) for v in (60, 90, 120, 150)], axis=1)
    one, two = (texture.encode_layers([ramp, ramp], 2, Reduction(), 3, d)[0] for d in (0.0, 1.0))
    alone = texture.encode_layers([ramp], 2, Reduction(), 3, 1.0)[0]
    assert one != two and two == alone


def test_palette_swap_files():
    a, b = rgba(picture(8, 8) // 128 * 128), rgba(picture(8, 8) // 128 * 128)
    o = EncodeOptions(mode="texture", texture_format="palette256").checked()
    made = dict(convert.layered_files([a, b], "out", ["a", "b"], o))
    assert set(made) == {"out_tex.bin", "out_a_pal.bin", "out_b_pal.bin"}


def test_command_line(spark, folder, capsys):
    path, _ = folder
    assert cli.main(["-gt", "-f", "palette16", "-o", str(path / "made"), str(path / "in" / "a.ppm")]) == 0
    assert (path / "made_tex.bin").stat().st_size == 256 and "made_pal.bin" in capsys.readouterr().out
    assert cli.main(["-gt", "-onns", "x"]) == 1 and cli.main(["-gt", "-f", "nope"]) == 1


def test_stream(spark, folder):
    from tilewright.streaming.images import convert_stream

    path, _ = folder
    q = convert_stream(spark, str(path / "in"), str(path / "out"), str(path / "state"), EncodeOptions(mode="texture", texture_format="palette16").checked())
    q.awaitTermination(120)
    assert sorted(p.name for p in (path / "out").iterdir()) == ["a_pal.bin", "a_tex.bin", "b_pal.bin", "b_tex.bin"]


def test_files_are_written_whole(spark, tmp_path):
    rows = [(f"f{k}", bytes([k]) * k) for k in range(20)]
    out = sinks.write_files(spark.createDataFrame(rows, "name string, data binary"), str(tmp_path / "x")).collect()
    assert sorted((r.name, r.bytes) for r in out) == sorted((n, len(d)) for n, d in rows)
    assert all((tmp_path / "x" / n).read_bytes() == d for n, d in rows) and len(list((tmp_path / "x").iterdir())) == 20
