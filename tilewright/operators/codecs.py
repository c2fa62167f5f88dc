"""Console compression formats over byte strings, with decoders.

Each payload starts with a little-endian word: kind in the low byte, size in the upper 24 bits.
Kernels take and return ``bytes``; ``compress`` and ``decompress`` apply them to binary columns
in Arrow batches, rows in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
LZ, LZX, HUFFMAN, RLE, NONE = 0x10, 0x11, 0x20, 0x30, 0x00
WINDOW, MIN_MATCH, LZ_LONGEST, LZX_LONGEST = 4096, 3, 18, 0x10110
RUN_MIN, RUN_MAX, LITERAL_MAX = 3, 130, 128
#: In this order a tie between codecs is settled.
CODECS = ("lz", "lzx", "huffman4", "huffman8", "rle", "none")
LIMIT = 1 << 24


def header(kind: int, size: int) -> bytes:
    if size >= LIMIT:
        raise ValueError("payloads are limited to 24 bits of size")
    return (size << 8 | kind).to_bytes(4, "little")


# -- dictionary codecs ----------------------------------------------------------------------


def _extend(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and b on agree, a < b."""
    n, step = 0, 16
    while n < most:
        m = min(step, most - n)
        if data[a + n : a + n + m] == data[b + n : b + n + m]:
            n, step = n + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
    return n


def longest_matches(data: bytes, nearest: int, longest: int) -> list[tuple[int, int]]:
    """(length, distance) of the longest earlier match within the window at each place; the nearest among equals."""
    places: dict[bytes, list[int]] = {}
    out = []
    for i in range(len(data)):
        best, far = 0, 0
        most = min(longest, len(data) - i)
        key = data[i : i + 3]
        if most >= MIN_MATCH:
            chain = places.setdefault(key, [])
            for j in reversed(chain):
                if i - j > WINDOW:
                    break
                if i - j < nearest or (best and data[j + best - 1 : j + best] != data[i + best - 1 : i + best]):
                    continue
                n = _extend(data, j, i, most)
                if n > best:
                    best, far = n, i - j
                    if n == most:
                        break
            chain.append(i)
            if len(chain) > 8192:
                del chain[:4096]
        out.append((best, far) if best >= MIN_MATCH else (1, 0))
    return out


def _token_bits(n: np.ndarray | int) -> np.ndarray | int:
    """Bits of an LZX token with its flag."""
    return 1 + 8 * (1 + (n >= 3) * 1 + (n >= 0x11) * 1 + (n >= 0x111) * 1)


def best_parse(matches: list[tuple[int, int]], wide: bool) -> list[tuple[int, int]]:
    """The cheapest sequence of literals and references, by dynamic programming from the end."""
    n = len(matches)
    cost = np.zeros(n + 1, np.int64)
    take = np.ones(n, np.int64)
    lengths = np.arange(LZX_LONGEST + 1)
    token = _token_bits(lengths) if wide else np.where(lengths >= MIN_MATCH, 17, 9)
    for i in range(n - 1, -1, -1):
        best, length = cost[i + 1] + 9, 1
        longest = matches[i][0]
        if longest >= MIN_MATCH:
            options = cost[i + MIN_MATCH : i + longest + 1] + token[MIN_MATCH : longest + 1]
            k = len(options) - 1 - int(options[::-1].argmin())
            if options[k] < best:
                best, length = options[k], k + MIN_MATCH
        cost[i], take[i] = best, length
    out, i = [], 0
    while i < n:
        out.append((int(take[i]), matches[i][1] if take[i] >= MIN_MATCH else 0))
        i += int(take[i])
    return out


def _dictionary(data: bytes, wide: bool, vram_safe: bool) -> bytes:
    longest = LZX_LONGEST if wide else LZ_LONGEST
    tokens = best_parse(longest_matches(data, 2 if vram_safe else 1, longest), wide)
    out, at = bytearray(header(LZX if wide else LZ, len(data))), 0
    for group in (tokens[k : k + 8] for k in range(0, len(tokens), 8)):
        flags, body = 0, bytearray()
        for k, (n, far) in enumerate(group):
            if not far:
                body += data[at : at + 1]
            else:
                flags |= 0x80 >> k
                if not wide:
                    body += ((n - 3) << 12 | far - 1).to_bytes(2, "big")
                elif n >= 0x111:
                    body += (1 << 28 | (n - 0x111) << 12 | far - 1).to_bytes(4, "big")
                elif n >= 0x11:
                    body += ((n - 0x11) << 12 | far - 1).to_bytes(3, "big")
                else:
                    body += ((n - 1) << 12 | far - 1).to_bytes(2, "big")
            at += n
        out.append(flags)
        out += body
    return bytes(out)


def lz(data: bytes, vram_safe: bool = True) -> bytes:
    return _dictionary(data, False, vram_safe)


def lzx(data: bytes, vram_safe: bool = True) -> bytes:
    return _dictionary(data, True, vram_safe)


def _undictionary(blob: bytes, size: int, wide: bool) -> bytes:
    out, at = bytearray(), 4
    while len(out) < size:
        flags, at = blob[at], at + 1
        for k in range(8):
            if len(out) >= size:
                break
            if not flags & 0x80 >> k:
                out.append(blob[at])
                at += 1
                continue
            width, base, top = 2, (1 if wide else 3), blob[at] >> 4
            if wide and top == 0:
                width, base = 3, 0x11
            elif wide and top == 1:
                width, base = 4, 0x111
            word = int.from_bytes(blob[at : at + width], "big")
            if width == 4:
                word &= (1 << 28) - 1
            at += width
            n, far = (word >> 12) + base, (word & 0xFFF) + 1
            if far > len(out):
                raise ValueError("reference before the start")
            while n > 0:  # a match may run into what it writes
                piece = out[len(out) - far : len(out) - far + min(n, far)]
                out += piece
                n -= len(piece)
    return bytes(out[:size])


# -- Huffman --------------------------------------------------------------------------------


def _tree(counts: dict[int, int]):
    """Nested pairs of symbols; the side with fewer leaves first.  At least two leaves."""
    for s in (0, 1):
        if len(counts) < 2 and s not in counts:
            counts = {**counts, s: 0}
    heap = [(c, s, 1, s) for s, c in counts.items()]  # count, tie, leaves, node
    heapq.heapify(heap)
    tie = 1 << 16
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        if a[2] > b[2]:
            a, b = b, a
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2], (a[3], b[3])))
        tie += 1
    return heap[0][3]


def _codes(node, code: str = "") -> dict[int, str]:
    if isinstance(node, tuple):
        return _codes(node[0], code + "0") | _codes(node[1], code + "1")
    return {node: code}


def _leaves(node) -> int:
    return _leaves(node[0]) + _leaves(node[1]) if isinstance(node, tuple) else 1


def _flatten(root) -> bytes:
    """The tree as byte pairs, each branch at most 63 pairs before its own pair.

    Pairs are laid out depth first, small subtrees first, except when a waiting branch would
    otherwise miss its last possible place: then the most urgent one comes first.
    """
    pairs: list[list] = []
    waiting: list[tuple[int, int, object, int]] = [(1 << 30, 0, root, -1)]  # last place, slot in parent, node, parent

    def fits(rest, at: int) -> bool:
        return all(last >= at + k for k, last in enumerate(sorted(w[0] for w in rest)))

    while waiting:
        at = len(pairs)
        pick = next((k for k in range(len(waiting) - 1, -1, -1) if fits(waiting[:k] + waiting[k + 1 :], at + 1)), None)
        if pick is None:
            pick = min(range(len(waiting)), key=lambda k: waiting[k][0])
        last, slot, node, parent = waiting.pop(pick)
        if at > last:
            raise ValueError("no layout of the tree")
        if parent >= 0:
            pairs[parent][slot][0] = at - parent - 1
        pairs.append([[child, 0, False] if not isinstance(child, tuple) else [0, (not isinstance(child[0], tuple)) << 7 | (not isinstance(child[1], tuple)) << 6, True] for child in node])
        branches = [(at + 64, k, child, at) for k, child in enumerate(node) if isinstance(child, tuple)]
        waiting += sorted(branches, key=lambda b: -_leaves(b[2]))
    flags = (not isinstance(root[0], tuple)) << 7 | (not isinstance(root[1], tuple)) << 6
    return bytes([flags, *(v if not branch else v | f for pair in pairs for v, f, branch in pair)])


def huffman(data: bytes, bits: int = 8) -> bytes:
    symbols = data if bits == 8 else bytes(x for b in data for x in (b & 15, b >> 4))
    found, counts = np.unique(np.frombuffer(symbols, np.uint8), return_counts=True)
    root = _tree(dict(zip(found.tolist(), counts.tolist(), strict=True)))
    table = _codes(root)
    nodes = _flatten(root)
    size = 1 + len(nodes)
    padded = size + -size % 4
    stream = "".join(map(table.__getitem__, symbols))
    stream += "0" * (-len(stream) % 32)
    words = b"".join(int(stream[k : k + 32], 2).to_bytes(4, "little") for k in range(0, len(stream), 32))
    return header(HUFFMAN | bits, len(data)) + bytes([padded // 2 - 1]) + nodes + bytes(padded - size) + words


def _unhuffman(blob: bytes, size: int, bits: int) -> bytes:
    tree = blob[4 : 4 + (blob[4] + 1) * 2]
    out: list[int] = []
    wanted = size * (8 // bits)
    node, at = 1, 1
    for k in range(4 + len(tree), len(blob), 4):
        word = int.from_bytes(blob[k : k + 4], "little")
        for b in range(31, -1, -1):
            if len(out) == wanted:
                break
            bit = word >> b & 1
            leaf = tree[at] & (0x40 if bit else 0x80)
            node = (at & ~1) + 2 * (tree[at] & 0x3F) + 2 + bit
            if leaf:
                out.append(tree[node])
                at = 1
            else:
                at = node
    if bits == 8:
        return bytes(out)
    return bytes(lo | hi << 4 for lo, hi in zip(out[::2], out[1::2], strict=True))


# -- runs -----------------------------------------------------------------------------------


def rle(data: bytes) -> bytes:
    """Runs of 3 to 130 and literals of 1 to 128 bytes, cheapest split by dynamic programming over runs."""
    n = len(data)
    ahead = np.zeros(n + 1, np.int64)
    at = 0
    for _, g in groupby(data):
        m = len(list(g))
        ahead[at : at + m] = np.arange(m, 0, -1)
        at += m
    cost = np.zeros(n + 1, np.int64)
    take, run = np.ones(n, np.int64), np.zeros(n, bool)
    for i in range(n - 1, -1, -1):
        most = min(LITERAL_MAX, n - i)
        options = cost[i + 1 : i + most + 1] + np.arange(2, most + 2)
        k = int(options.argmin())
        best, take[i] = options[k], k + 1
        r = min(int(ahead[i]), RUN_MAX)
        if r >= RUN_MIN:
            options = cost[i + RUN_MIN : i + r + 1] + 2
            k = len(options) - 1 - int(options[::-1].argmin())
            if options[k] <= best:
                best, take[i], run[i] = options[k], k + RUN_MIN, True
        cost[i] = best
    out, i = bytearray(header(RLE, n)), 0
    while i < n:
        m = int(take[i])
        out += bytes([0x80 | m - RUN_MIN, data[i]]) if run[i] else bytes([m - 1]) + data[i : i + m]
        i += m
    return bytes(out)


def _unrle(blob: bytes, size: int) -> bytes:
    out, at = bytearray(), 4
    while len(out) < size:
        flag = blob[at]
        if flag & 0x80:
            out += blob[at + 1 : at + 2] * ((flag & 0x7F) + RUN_MIN)
            at += 2
        else:
            out += blob[at + 1 : at + 2 + flag]
            at += 2 + flag
    return bytes(out[:size])


def stored(data: bytes) -> bytes:
    return header(NONE, len(data)) + data + bytes(-len(data) % 4)


# -- all ------------------------------------------------------------------------------------


def encode(data: bytes, codec: str, vram_safe: bool = True) -> bytes:
    if codec in ("lz", "lzx"):
        return (lz if codec == "lz" else lzx)(data, vram_safe)
    return {"huffman4": lambda: huffman(data, 4), "huffman8": lambda: huffman(data, 8), "rle": lambda: rle(data), "none": lambda: stored(data)}[codec]()


def smallest(data: bytes, codecs: Iterable[str], vram_safe: bool = True) -> bytes:
    """The shortest result; ties as in CODECS.  Without codecs, the data as they are."""
    names = [c for c in CODECS if c in set(codecs)]
    return min((encode(data, c, vram_safe) for c in names), key=len) if names else data


def decode(blob: bytes) -> bytes:
    word = int.from_bytes(blob[:4], "little")
    kind, size = word & 0xFF, word >> 8
    if kind in (LZ, LZX):
        return _undictionary(blob, size, kind == LZX)
    if kind in (HUFFMAN | 4, HUFFMAN | 8):
        return _unhuffman(blob, size, kind & 15)
    if kind == RLE:
        return _unrle(blob, size)
    if kind == NONE:
        return blob[4 : 4 + size]
    raise ValueError(f"unknown kind {kind:#x}")


def compress(data: str | Column, codecs: Iterable[str], vram_safe: bool = True) -> Column:
    """A binary column compressed by the best of ``codecs``; null stays null."""
    names = tuple(codecs)
    if unknown := set(names) - set(CODECS):
        raise ValueError(f"unknown codecs {sorted(unknown)}")

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else smallest(bytes(v), names, vram_safe))

    return run(data)


def decompress(blob: str | Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decode(bytes(v)))

    return run(blob)
