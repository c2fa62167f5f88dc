"""File formats as byte strings, and writers that put one file per row in a folder."""

from __future__ import annotations

import datetime as dt
import os
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.texture import FORMATS, TEXEL_BITS
from ..operators.codecs import smallest

VERSION = "1.0"
# Fixed values of the formats.
GRF_TEXTURE = {1: 0x81, 2: 0x02, 3: 0x04, 4: 0x08, 5: 0x82, 6: 0x80, 7: 0x10}
GRF_SCREEN = {"none": 0, "text4": 1, "text8": 2, "affine": 3, "affine_ext": 4, "bitmap": 0}
GRF_COLOR0, GRF_BACKGROUND = 0x0001, 0x4000
NNS_SCREEN = {"text4": (0, 0), "text8": (1, 0), "affine": (1, 1), "affine_ext": (2, 2)}
UNITS = {1: "uint8_t", 2: "uint16_t", 4: "uint32_t"}


# -- raw and C source -----------------------------------------------------------------------


def c_array(name: str, data: bytes, unit: int, compressed: bool = False) -> tuple[str, str]:
    """(definition, extern line) of a constant array: 32 bytes a line, whole words if compressed."""
    unit = 4 if compressed else unit if unit in UNITS else 1
    padded = data + bytes(-len(data) % unit)
    words = np.frombuffer(padded, f"<u{unit}")
    per = 32 // unit
    lines = [", ".join(f"0x{int(v):0{2 * unit}X}" for v in words[k : k + per]) + "," for k in range(0, len(words), per)]
    body = "\n    ".join(lines)
    return f"const {UNITS[unit]} {name}[] = {{\n    {body}\n}};\n", f"extern const {UNITS[unit]} {name}[{len(words)}];\n"


def banner(now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now()
    return f"// Generated by tilewright on {now:%m/%d/%Y} at {now:%I:%M %p}\n"


# -- bitmaps --------------------------------------------------------------------------------


def indexed_bmp(palette: np.ndarray, indices: np.ndarray) -> bytes:
    """4 bits a pixel for up to 16 colours, else 8; bottom row first, rows of whole words."""
    h, w = indices.shape
    bits = 4 if len(palette) <= 16 else 8
    rows = indices[::-1].astype(np.uint8)
    if bits == 4:
        rows = np.pad(rows, ((0, 0), (0, w % 2)))
        rows = rows[:, ::2] << 4 | rows[:, 1::2]
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    c = np.asarray(palette).astype(np.int64)
    table = np.stack([(c >> 16) & 255, (c >> 8) & 255, c & 255, np.zeros_like(c)], axis=-1).astype(np.uint8).tobytes()
    at = 54 + len(table)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 0x1068, 0x1068, len(c), len(c))
    return struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + info + table + rows.tobytes()


# -- chunked containers ---------------------------------------------------------------------


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + bytes(-len(body) % 4)


def grf(header: bytes, chunks: list[tuple[bytes, bytes]], codecs: tuple[str, ...], vram_safe: bool = True) -> bytes:
    """A RIFF file of an info chunk and chunks that are each compressed on their own."""
    body = b"GRF " + _chunk(b"HDRX", header) + b"".join(_chunk(tag, smallest(data, codecs or ("none",), vram_safe)) for tag, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def grf_header(attribute: int, screen: int, colors: int, side: int, flags: int, width: int, height: int) -> bytes:
    return struct.pack("<HHHHHBBBBHII", 2, attribute, screen, 0, colors, side, side, 0, 0, flags, width, height)


def grf_texture(fmt: int, width: int, height: int, texel: bytes, pidx: bytes, palette: bytes, transparent0: bool, codecs=(), vram_safe: bool = True) -> bytes:
    flags = GRF_COLOR0 if transparent0 and fmt in (2, 3, 4) else 0
    head = grf_header(GRF_TEXTURE[fmt], 0, len(palette) // 2, 4 if fmt == 5 else 1, flags, width, height)
    chunks = ([(b"PAL ", palette)] if palette else []) + [(b"GFX ", texel)] + ([(b"PIDX", pidx)] if pidx else [])
    return grf(head, chunks, codecs, vram_safe)


def grf_background(kind: str, depth: int, width: int, height: int, palette: bytes, chars: bytes, screen: bytes | None, codecs=(), vram_safe: bool = True) -> bytes:
    code = GRF_SCREEN[kind] if screen is not None else 0
    head = grf_header(depth, code, len(palette) // 2, 8 if code else 0, GRF_BACKGROUND, width, height)
    chunks = [(b"PAL ", palette), (b"GFX ", chars)] + ([(b"MAP ", screen)] if screen is not None else [])
    return grf(head, chunks, codecs, vram_safe)


def nns(name: bytes, blocks: list[tuple[bytes, bytes]], offsets: bool = False) -> bytes:
    """The little-endian container: reversed four-letter names, blocks of whole words, sizes filled in.

    ``offsets`` adds a table of where the blocks start, as models and textures use.
    """
    packed = []
    for tag, body in blocks:
        body += bytes(-len(body) % 4)
        packed.append(tag[::-1] + struct.pack("<I", len(body) + 8) + body)
    head = 16 + (4 * len(packed) if offsets else 0)
    table, at = b"", head
    for p in packed if offsets else ():
        table += struct.pack("<I", at)
        at += len(p)
    total = head + sum(map(len, packed))
    return name[::-1] + struct.pack("<HHIHH", 0xFEFF, 0x0100, total, 16, len(packed)) + table + b"".join(packed)


def nclr(palette: bytes, depth: int, kind: str, base: int = 0, compact: bool = False) -> bytes:
    """Palette file; ``compact`` adds the list of the palettes that it holds."""
    body = struct.pack("<IIII", 4 if depth == 8 else 3, kind == "affine_ext", len(palette), 16) + palette
    blocks = [(b"PLTT", body)]
    if compact:
        per = 1 << depth
        numbers = range(base // per, base // per + len(palette) // 2 // per)
        blocks.append((b"PCMP", struct.pack("<HHI", len(numbers), 0xBEEF, 8) + b"".join(struct.pack("<H", n) for n in numbers)))
    return nns(b"NCLR", blocks)


def ncgr(chars: bytes, width: int, height: int, depth: int, bitmap: bool = False, merged: bool = False) -> bytes:
    """Character file; merged characters have no width and height in common."""
    w, h = (0xFFFF, 0xFFFF) if merged and not bitmap else (width, height)
    return nns(b"NCGR", [(b"CHAR", struct.pack("<HHIIIII", w, h, 4 if depth == 8 else 3, 0x10, bitmap, len(chars), 24) + chars)])


def nscr(screen: bytes, kind: str, tiles_x: int, tiles_y: int) -> bytes:
    colors, layout = NNS_SCREEN[kind]
    return nns(b"NSCR", [(b"SCRN", struct.pack("<HHHHI", tiles_x * 8, tiles_y * 8, colors, layout, len(screen)) + screen)])


def nns_tga(shown: np.ndarray, fmt: int, texel: bytes, pidx: bytes, palette: bytes, name: str, transparent0: bool) -> bytes:
    """A 32-bit picture of the texture with its data in named sections after it."""
    h, w = shown.shape
    v = shown[::-1].astype(np.int64)
    bgra = (v & 0xFF00FF00) | (v & 255) << 16 | (v >> 16) & 255
    head = struct.pack("<BBBHHBHHHHBB", 20, 0, 2, 0, 0, 0, 0, 0, w, h, 32, 8) + b"NNS_Tga Ver 1.0\0" + struct.pack("<I", 38 + w * h * 4)

    def section(tag: bytes, body: bytes = b"") -> bytes:
        return tag + struct.pack("<I", len(body) + 12) + body

    fmt_name = next(k for k, n in FORMATS.items() if n == fmt)
    parts = [section(b"nns_frmt", fmt_name.encode()), section(b"nns_txel", texel)]
    if fmt == 5:
        parts.append(section(b"nns_pidx", pidx))
    if fmt != 7:
        parts += [section(b"nns_pnam", name.encode()), section(b"nns_pcol", palette[:8] if fmt == 2 else palette)]
    parts += [section(b"nns_gnam", b"tilewright"), section(b"nns_gver", VERSION.encode()), section(b"nns_imst")]
    parts += [section(b"nns_c0xp")] if transparent0 else []
    return head + bgra.astype("<u4").tobytes() + b"".join(parts) + section(b"nns_endb")


def texel_rows(fmt: int, width: int, rows: int) -> int:
    return width * TEXEL_BITS[fmt] // 8 * rows


# -- files ----------------------------------------------------------------------------------


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, data binary) as one file under ``folder``; returns (name, bytes) as written.

    Files appear whole or not at all, and a retried task writes the same again.  ``folder`` may be
    a local path that all executors share or any address pyarrow can open.  The result must be
    consumed for anything to be written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = urlsplit(folder)
        local = parts.scheme in ("", "file")
        if not local:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder)
        else:
            root = parts.path
            os.makedirs(root, exist_ok=True)
        for rows in batches:
            for r in rows.itertuples():
                if "/" in r.name or r.name in ("", ".", ".."):
                    raise ValueError(f"not a file name: {r.name!r}")
                if local:
                    part = f"{root}/.{r.name}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(r.data)
                    os.replace(part, f"{root}/{r.name}")
                else:
                    store.create_dir(root, recursive=True)
                    with store.open_output_stream(f"{root}/{r.name}") as f:
                        f.write(r.data)
            yield pd.DataFrame({"name": rows["name"], "bytes": rows["data"].map(len)})

    return files.select("name", "data").mapInPandas(run, "name string, bytes bigint")
