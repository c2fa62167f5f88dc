"""Command line: the switches of a conversion."""

from __future__ import annotations

import argparse
import os
import sys

from .config import EncodeOptions

BIOS = ("lz", "huffman4", "huffman8", "rle")
FORMAT_NAMES = ("", "a3i5", "palette4", "palette16", "palette256", "tex4x4", "a5i3", "direct")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright", description="Convert images to console textures and backgrounds.", add_help=False, allow_abbrev=False)
    flag = lambda name, dest, value, text: p.add_argument(name, dest=dest, action="store_const", const=value, help=text)
    more = lambda name, values, text: p.add_argument(name, dest="codecs", action="append_const", const=values, help=text)
    p.add_argument("inputs", nargs="*")
    p.add_argument("-h", action="help", help="show this and exit")
    flag("-s", "silent", True, "say nothing")
    flag("-v", "verbose", True, "say more")
    p.add_argument("-o", dest="base", help="base name of the output")
    p.add_argument("-k", dest="alpha_key", help="colour that becomes transparent")
    p.add_argument("-d", dest="diffuse", type=float, help="diffusion in percent")
    p.add_argument("-bb", dest="balance", type=int, help="lightness or colour, 1-39")
    p.add_argument("-bc", dest="color_balance", type=int, help="red or green, 1-39")
    flag("-be", "enhance", True, "favour widely used colours")
    p.add_argument("-cm", dest="max_colors", type=int, help="most colours of a palette")
    flag("-gb", "mode", "bg", "make backgrounds")
    flag("-gt", "mode", "texture", "make textures")
    for name, value in (("-ob", "bin"), ("-oc", "c"), ("-og", "grf"), ("-od", "bmp"), ("-onns", "nns"), ("-ot", "tga")):
        flag(name, "output", value, f"output {value}")
    for name, values in (("-cbios", BIOS), ("-cno", ("none",)), ("-clz", ("lz",)), ("-ch", ("huffman4", "huffman8")), ("-ch4", ("huffman4",)), ("-ch8", ("huffman8",)), ("-crl", ("rle",)), ("-clzx", ("lzx",))):
        more(name, values, "compress: " + ", ".join(values))
    flag("-c8", "vram_safe", False, "allow matches at distance 1")
    p.add_argument("-b", dest="legacy_bg", choices=("4", "8"), help="depth of a background")
    for name, value in (("-bt4", "text4"), ("-bt8", "text8"), ("-ba", "affine"), ("-bA", "affine_ext"), ("-bB", "bitmap")):
        flag(name, "bg_type", value, f"background {value}")
    for name, dest in (("-p", "palettes"), ("-pb", "palette_base"), ("-po", "palette_offset"), ("-cc", "max_chars"), ("-cb", "char_base"), ("-ct", "merge_threshold")):
        p.add_argument(name, dest=dest, type=int)
    flag("-p0o", "color0_opaque", True, "colour 0 is opaque")
    flag("-cn", "merge_chars", False, "merge no characters; no palette limit for tex4x4")
    flag("-ns", "screen", False, "no screen")
    flag("-se", "screen_only", True, "only a screen, from -wp and -wc")
    p.add_argument("-wp", dest="existing_palette")
    p.add_argument("-wc", dest="existing_chars")
    flag("-pc", "used_palettes_only", True, "output used palettes only")
    p.add_argument("-f", dest="texture_format", help="name or number 1-7")
    p.add_argument("-fp", dest="fixed_palette")
    flag("-fpo", "output_fixed_palette", True, "output the fixed palette too")
    flag("-tt", "trim", True, "trim the height")
    flag("-t0o", "color0_transparent", False, "colour 0 is opaque")
    flag("-t0x", "color0_transparent", True, "colour 0 is transparent")
    flag("-da", "dither_alpha", True, "dither alpha")
    return p


def parse_key(text: str) -> int:
    digits = "".join(c for c in text if c in "0123456789abcdefABCDEF")[-6:].rjust(6, "0")
    r, g, b = (int(digits[k : k + 2], 16) for k in (0, 2, 4))
    return r | g << 8 | b << 16


def options_of(argv: list[str]) -> EncodeOptions:
    """Parsed and checked options."""
    found = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    if "codecs" in found:
        found["codecs"] = tuple(dict.fromkeys(c for group in found["codecs"] for c in group))
    if "alpha_key" in found:
        found["alpha_key"] = parse_key(found["alpha_key"])
    if "diffuse" in found:
        found["diffuse"] /= 100
    if depth := found.pop("legacy_bg", None):
        found["bg_type"] = "text4" if depth == "4" else "affine_ext"
    if fmt := found.get("texture_format"):
        found["texture_format"] = FORMAT_NAMES[int(fmt)] if fmt.isdigit() and 1 <= int(fmt) <= 7 else fmt
        if found["texture_format"] not in FORMAT_NAMES[1:]:
            raise ValueError(f"unknown format {fmt}")
    found["inputs"] = tuple(found["inputs"])
    return EncodeOptions(**found).checked()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.convert import run_files

    try:
        o = options_of(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        print(f"tilewright: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tilewright").getOrCreate()
    folder, base = os.path.split(o.base or "")
    from dataclasses import replace

    written = run_files(spark, replace(o, base=base or None), os.path.abspath(folder or ".")).collect()
    if not o.silent:
        for r in written:
            print(f"{r['name']}: {r['bytes']} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())
