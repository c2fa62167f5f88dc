"""Image files to RGBA arrays: PNG, BMP, TGA, GIF, PSD, PIC, HDR and PNM; JPEG is read by Spark's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class Unsupported(ValueError):
    """A file of no known kind, or a variant that is not read."""


def _rgba(r, g, b, a=None) -> np.ndarray:
    r, g, b = (np.asarray(x).astype(np.uint32) for x in (r, g, b))
    a = np.full(r.shape, 255, np.uint32) if a is None else np.asarray(a).astype(np.uint32)
    return (r | g << 8 | b << 16 | a << 24).view(np.int32)


def pnm(data: bytes) -> np.ndarray:
    """P1 to P6; samples are scaled to 8 bits."""
    kind, at, fields = data[:2], 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * channels
    if kind in (b"P5", b"P6"):
        v = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1).astype(np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1)
        v = 1 - np.unpackbits(rows, axis=1)[:, :w].ravel().astype(np.int64)
    elif kind == b"P1":
        v = 1 - np.array([c - 48 for c in data[at:] if c in b"01"][:n], np.int64)
    else:
        v = np.array(data[at:].split()[:n], np.int64)
    v = (v * 255 // top).reshape(h, w, channels)
    return _rgba(*(v[..., k % channels] for k in range(3)))


def bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 16, 24 and 32 bits, and bit fields."""
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing, used, entry = 0, 0, 3
    else:
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    if packing not in (0, 3):
        raise Unsupported("compressed BMP")
    down, h = h < 0, abs(h)
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    if not down:
        rows = rows[::-1]
    if bits <= 8:
        raw = np.frombuffer(data, np.uint8, (used or 1 << bits) * entry, 14 + size).reshape(-1, entry)
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(raw)] = raw[:, :3]
        index = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1]) if bits < 8 else rows
        c = table[index[:, :w]]
        return _rgba(c[..., 2], c[..., 1], c[..., 0])
    if bits == 24:
        c = rows[:, : w * 3].reshape(h, w, 3)
        return _rgba(c[..., 2], c[..., 1], c[..., 0])
    px = rows[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
    masks = list(struct.unpack_from("<III", data, 54)) if packing == 3 else ([0x7C00, 0x3E0, 0x1F] if bits == 16 else [0xFF0000, 0xFF00, 0xFF])
    alpha = struct.unpack_from("<I", data, 66)[0] if packing == 3 and size >= 56 else 0

    def part(mask: int) -> np.ndarray:
        low = (mask & -mask).bit_length() - 1
        top = mask >> low
        return ((px & mask) >> low) * 255 // top

    return _rgba(*(part(m) for m in masks), part(alpha) if alpha else None)


def tga(data: bytes) -> np.ndarray:
    """Colour-mapped, true-colour and grey, plain or run-length."""
    id_len, mapped, kind, first, count, entry, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    if kind & 7 not in (1, 2, 3) or kind > 11 or not w or not h:
        raise Unsupported("TGA variant")
    at, width = 18 + id_len, (bits + 7) // 8
    table = data[at : at + count * ((entry + 7) // 8)] if mapped else b""
    at += len(table)
    n = w * h
    if kind & 8:
        out = bytearray()
        while len(out) < n * width:
            c, at = data[at], at + 1
            m = (c & 127) + 1
            if c & 128:
                out += data[at : at + width] * m
                at += width
            else:
                out += data[at : at + width * m]
                at += width * m
        raw = bytes(out[: n * width])
    else:
        raw = data[at : at + n * width]

    def colors(buf: bytes, size: int) -> np.ndarray:
        v = np.frombuffer(buf, np.uint8).reshape(-1, (size + 7) // 8).astype(np.int64)
        if size in (15, 16):
            word = v[:, 0] | v[:, 1] << 8
            r, g, b = (((word >> s) & 31) * 255 // 31 for s in (10, 5, 0))
            return _rgba(r, g, b)
        return _rgba(v[:, 2], v[:, 1], v[:, 0], v[:, 3] if size == 32 else None)

    if kind & 7 == 1:
        index = np.frombuffer(raw, np.uint8 if width == 1 else "<u2").astype(np.int64) - first
        px = colors(table, entry)[np.clip(index, 0, count - 1)]
    elif kind & 7 == 3:
        grey = np.frombuffer(raw, np.uint8).reshape(-1, width)
        px = _rgba(grey[:, 0], grey[:, 0], grey[:, 0], grey[:, 1] if width == 2 else None)
    else:
        px = colors(raw, bits)
    px = px.reshape(h, w)
    px = px if flags & 32 else px[::-1]
    return px[:, ::-1] if flags & 16 else px


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> tuple[np.ndarray, int]:
    out, at = np.zeros((h + 1, stride + step), np.uint8), 0
    for y in range(1, h + 1):
        kind = raw[at]
        line = np.frombuffer(raw, np.uint8, stride, at + 1)
        at += stride + 1
        row, up = out[y], out[y - 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + up[step:]
        elif kind == 1:
            for k in range(step):
                row[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        else:
            for x in range(stride):
                a, b, c = int(row[x]), int(up[x + step]), int(up[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x + step] = (int(line[x]) + guess) & 255
    return out[1:, step:], at


def png(data: bytes) -> np.ndarray:
    """All colour types and depths, interlaced or not; 16 bits are cut to 8."""
    at, idat, table, clear = 8, [], None, b""
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            table = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            idat.append(body)
        elif name == b"IEND":
            break
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw, out, at = zlib.decompress(b"".join(idat)), np.zeros((h, w, channels), np.int64), 0
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if laced else ((0, 0, 1, 1),)
    for y0, x0, dy, dx in passes:
        ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
        if ph <= 0 or pw <= 0:
            continue
        stride = (pw * channels * bits + 7) // 8
        rows, used = _unfilter(raw[at:], ph, stride, max(1, channels * bits // 8))
        at += used
        if bits == 16:
            v = np.ascontiguousarray(rows).view(">u2").astype(np.int64)
        elif bits == 8:
            v = rows.astype(np.int64)
        else:
            v = np.unpackbits(rows, axis=1).reshape(ph, -1, bits) @ (1 << np.arange(bits)[::-1])
        out[y0::dy, x0::dx] = v[:, : pw * channels].reshape(ph, pw, channels)
    if kind == 3:
        index = out[..., 0]
        alpha = np.full(256, 255)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        full = np.zeros((256, 3), np.int64)
        full[: len(table)] = table
        return _rgba(*(full[index, k] for k in range(3)), alpha[index])
    key = np.array(struct.unpack(f">{len(clear) // 2}H", clear)) if clear and kind in (0, 2) else None
    alpha = np.where((out == key).all(axis=-1), 0, 255) if key is not None else None
    eight = out >> 8 if bits == 16 else out * 255 // ((1 << bits) - 1)
    if kind in (4, 6):
        alpha = eight[..., -1]
    grey = kind in (0, 4)
    return _rgba(*(eight[..., 0 if grey else k] for k in range(3)), alpha)


def gif(data: bytes) -> np.ndarray:
    """The first frame on a transparent canvas."""
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    shared = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3) if flags & 128 else None
    at += 0 if shared is None else shared.size
    clear = -1
    while True:
        mark, at = data[at], at + 1
        if mark == 0x21:
            if data[at] == 0xF9 and data[at + 2] & 1:
                clear = data[at + 5]
            at += 1
            while data[at]:
                at += data[at] + 1
            at += 1
        elif mark == 0x2C:
            break
        else:
            raise Unsupported("GIF without a frame")
    x0, y0, fw, fh, local = struct.unpack_from("<HHHHB", data, at)
    at += 9
    table = np.frombuffer(data, np.uint8, 3 << (local & 7) + 1, at).reshape(-1, 3) if local & 128 else shared
    at += table.size if local & 128 else 0
    width, at, stream = data[at], at + 1, bytearray()
    while data[at]:
        stream += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    base = [bytes([k]) for k in range(1 << width)] + [b"", b""]
    words, size, out, last, acc, held = list(base), width + 1, bytearray(), b"", 0, 0
    for byte in stream:
        acc |= byte << held
        held += 8
        while held >= size:
            code, acc, held = acc & (1 << size) - 1, acc >> size, held - size
            if code == 1 << width:
                words, size, last = list(base), width + 1, b""
                continue
            if code == (1 << width) + 1:
                acc, held = 0, -1 << 30
                break
            word = words[code] if code < len(words) else last + last[:1]
            out += word
            if last and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << size and size < 12:
                    size += 1
            last = word
    index = np.zeros(fw * fh, np.int64)
    found = np.frombuffer(bytes(out), np.uint8)[: fw * fh]
    index[: len(found)] = found
    rows = index.reshape(fh, fw)
    if local & 64:
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, fh, step)]
        plain = np.zeros_like(rows)
        plain[order] = rows
        rows = plain
    c = table[np.minimum(rows, len(table) - 1)]
    canvas = np.zeros((h, w), np.int32)
    canvas[y0 : y0 + fh, x0 : x0 + fw] = np.where(rows == clear, 0, _rgba(c[..., 0], c[..., 1], c[..., 2]))[: h - y0, : w - x0]
    return canvas


def psd(data: bytes) -> np.ndarray:
    """The flattened image of an RGB file with 8 or 16 bits."""
    channels, h, w, bits, mode = struct.unpack_from(">HIIHH", data, 12)
    if mode != 3 or bits not in (8, 16):
        raise Unsupported("PSD variant")
    at = 26
    for _ in range(3):
        at += 4 + struct.unpack_from(">I", data, at)[0]
    packed, at = struct.unpack_from(">H", data, at)[0], at + 2
    planes = []
    if packed == 1:
        at += 2 * channels * h
        for _ in range(min(channels, 4)):
            out = bytearray()
            while len(out) < w * h:
                c, at = data[at], at + 1
                if c < 128:
                    out += data[at : at + c + 1]
                    at += c + 1
                elif c > 128:
                    out += data[at : at + 1] * (257 - c)
                    at += 1
            planes.append(np.frombuffer(bytes(out[: w * h]), np.uint8))
    elif packed == 0:
        step = w * h * bits // 8
        for k in range(min(channels, 4)):
            raw = np.frombuffer(data, np.uint8 if bits == 8 else ">u2", w * h, at + k * step)
            planes.append(raw if bits == 8 else raw >> 8)
    else:
        raise Unsupported("PSD compression")
    while len(planes) < 3:
        planes.append(planes[0])
    return _rgba(*planes[:3], planes[3] if len(planes) > 3 else None).reshape(h, w)


def pic(data: bytes) -> np.ndarray:
    """Softimage pictures: plain, pure and mixed run-length packets."""
    w, h = struct.unpack_from(">HH", data, 92)
    at, packets, chained = 104, [], 1
    while chained:
        chained, bits, kind, mask = data[at : at + 4]
        if bits != 8:
            raise Unsupported("PIC depth")
        packets.append((kind, [k for k in range(4) if mask & 0x80 >> k]))
        at += 4
    out = np.zeros((h, w, 4), np.uint8)
    out[..., 3] = 255
    for y in range(h):
        for kind, chans in packets:
            n, x = len(chans), 0
            while x < w:
                if kind == 0:
                    m, run = w, False
                elif kind == 1:
                    m, run, at = data[at], True, at + 1
                else:
                    c, at = data[at], at + 1
                    if c == 128:
                        m, at = struct.unpack_from(">H", data, at)[0], at + 2
                        run = True
                    else:
                        m, run = (c - 127, True) if c > 128 else (c + 1, False)
                m = min(m, w - x)
                size = n if run else n * m
                v = np.frombuffer(data, np.uint8, size, at).reshape(-1, n)
                at += size
                out[y, x : x + m, chans] = (np.repeat(v, m, axis=0) if run else v).T
                x += m
    return _rgba(*(out[..., k] for k in range(4)))


def hdr(data: bytes) -> np.ndarray:
    """Radiance pictures, brought to 8 bits with a gamma of 2.2."""
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    _, h, _, w = data[at:end].split()
    h, w, at = int(h), int(w), end + 1
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and data[at] == 2 and data[at + 1] == 2 and data[at + 2] < 128:
            at += 4
            for k in range(4):
                x = 0
                while x < w:
                    c, at = data[at], at + 1
                    if c > 128:
                        out[y, x : x + c - 128, k] = data[at]
                        x, at = x + c - 128, at + 1
                    else:
                        out[y, x : x + c, k] = np.frombuffer(data, np.uint8, c, at)
                        x, at = x + c, at + c
        else:
            out[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
    light = np.where(out[..., 3:] > 0, out[..., :3] * np.exp2(out[..., 3:].astype(float) - 136), 0)
    eight = np.clip(light ** (1 / 2.2) * 255 + 0.5, 0, 255).astype(np.int64)
    return _rgba(*(eight[..., k] for k in range(3)))


def decode(data: bytes, name: str = "") -> np.ndarray:
    """Any of these by its signature; TGA, which has none, by what remains."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png(data)
    if data[:2] == b"BM":
        return bmp(data)
    if data[:4] == b"GIF8":
        return gif(data)
    if data[:4] == b"8BPS":
        return psd(data)
    if data[:4] == b"\x53\x80\xf6\x34":
        return pic(data)
    if data[:2] == b"#?":
        return hdr(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and data[1:2]:
        return pnm(data)
    if data[:2] == b"\xff\xd8":
        raise Unsupported("JPEG files are read through read_images")
    try:
        return tga(data)
    except (struct.error, IndexError, ValueError) as e:
        raise Unsupported(f"no known image: {name}") from e
