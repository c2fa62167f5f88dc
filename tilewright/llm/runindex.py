"""Long repeated passages through a run-length (r-)index of the candidate texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .arrow import flat, slices
from .rindex import late_spans
from .runtime import cut
from .shingles import BASE, mix

#: A random number for each byte; unlike in shingles, letter case counts.
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Most bits of a filter of anchors or keys: this bounds all that is collected and broadcast (16 MB each).
SLOT_BITS = 27
#: Slots of a filter for each entry, as a power of two, while SLOT_BITS allow it.
SPARE_BITS = 7
#: An anchor with more than this share of all occurrences, and more than HOT, has its strings dealt out in groups of SPLIT.
HOT_SHARE, HOT, SPLIT = 1 / 5000, 500, 4
#: A key with more distinct contexts than this has its strings dealt out in the same way before they are indexed.
BIG = 1 << 14
STRETCH = 1 << 20
#: Bytes of distinct contexts that are searched together.
INDEX_BYTES = 1 << 20
#: The second hash is a polynomial over the integers modulo this prime, with numbers of its own for the bytes.
PRIME, BASE2 = np.uint64((1 << 31) - 1), 1_103_515_245
BYTE2 = np.random.default_rng(13).integers(1, (1 << 31) - 1, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []
_residues: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        grow = [np.concatenate([np.ones(1, np.uint64), np.full(max(n, STRETCH + 4096) - 1, b)]) for b in (BASE, inverse)]
        _powers[:] = [np.cumprod(g, dtype=np.uint64) for g in grow]
    return _powers[0], _powers[1]


def _pow2(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE2 and of its inverse modulo PRIME."""
    if not _residues or len(_residues[0]) < n:
        n, p, made = max(n, STRETCH + 4096), int(PRIME), []
        for base in (BASE2, pow(BASE2, -1, p)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % PRIME])
            made.append(out)
        _residues[:] = made
    return _residues[0], _residues[1]


def _sliding(x: np.ndarray, w: int, ufunc: np.ufunc, pad) -> np.ndarray:
    """``ufunc`` over every ``w`` neighbours of ``x``: len(x) - w + 1 values."""
    n = len(x)
    m = -(-n // w) * w
    grid = np.full(m, pad, x.dtype)
    grid[:n] = x
    grid = grid.reshape(-1, w)
    left = ufunc.accumulate(grid, axis=1).ravel()
    right = ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(right[: n - w + 1], left[w - 1 : n])


class Hashes:
    """Prefix sums of a stretch of bytes; any substring's hash takes constant time."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _pow(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class SecondHashes:
    """As ``Hashes``, by a polynomial modulo a prime: strings that collide there do not collide here for that reason."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _pow2(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE2[raw] * up[: len(raw)] % PRIME, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) % PRIME * self.down[start] % PRIME


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, Hashes, np.ndarray]:
    """Positions and hashes of the ``gram``-byte strings that are least in some ``length``-byte string of a text.

    The last array has the least hash of each ``length``-byte string, 0 where none may start.
    Equal strings of ``length`` bytes have equal leasts at equal places.
    """
    hashes = Hashes(raw)
    n, w = len(raw), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), hashes, np.zeros(0, np.uint64)
    h = (hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    for end in at[1:-1]:  # windows that would cross into the next text
        least[max(end - length + 1, 0) : end] = 0
    # a gram is an anchor if it equals the least of some window over it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    where = np.flatnonzero((_sliding(padded, w, np.maximum, 0) == h) & (h != 0))
    return where, h[where], hashes, least


def led_strings(where: np.ndarray, h: np.ndarray, least: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose leftmost least is each anchor (none if first > last)."""
    if not len(where):
        return where, where
    values, number = np.unique(h, return_inverse=True)
    by = np.lexsort((where, number))
    before = np.full(len(where), -1)
    same = number[by][1:] == number[by][:-1]
    before[by[1:][same]] = where[by[:-1][same]]
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(start[1:], len(least)) - 1
    kind = np.searchsorted(values, least[start])
    known = (kind < len(values)) & (values[np.minimum(kind, len(values) - 1)] == least[start])
    start, end, kind = start[known], end[known], kind[known]
    order = np.lexsort((start, kind))
    start, end, kind = start[order], end[order], kind[order]
    run = np.searchsorted((kind << 40) + start, (number << 40) + where, side="right") - 1
    return np.maximum(np.maximum(start[run], where - reach), before + 1), np.minimum(end[run], where)


def _stretches(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The slice itself, or a single long text in overlapping parts: (start, bytes, offsets)."""
    if len(at) != 2 or len(raw) <= STRETCH:
        yield 0, raw, at
        return
    for here in range(0, len(raw) - length + 1, STRETCH):
        part = raw[here : here + STRETCH + length - 1]
        yield here, part, np.array([0, len(part)])


def _count_anchors(length: int, gram: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", slice_bytes):
            raw, at = flat(batch.column(0))
            found = [anchors(part, cuts, length, gram) for _, part, cuts in _stretches(raw, at, length)]
            values, counts = np.unique(np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    return run


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Substrings as one binary array."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw[index].tobytes())])


_PLACE = "key bigint, whole bigint, id bigint, tag bigint, `at` bigint, `to` bigint"
_CONTEXT = "key bigint, id bigint, tag bigint, `at` bigint, fresh boolean, ctx binary"


def _joined_spans(tags: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows without a context: spans that are settled, overlapping ones of a text as one."""
    by = np.lexsort((start, tags))
    tags, ids, start, end = tags[by], ids[by], start[by], end[by]
    if len(by):
        piece = np.cumsum(np.concatenate([[0], tags[1:] != tags[:-1]])).astype(np.int64) << 40
        reached = np.maximum.accumulate(piece + end)
        new = np.concatenate([[True], piece[1:] + start[1:] > reached[:-1]])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(by)) - 1
        tags, ids, start, end = tags[head], ids[head], start[head], (reached - piece)[last]
    return _places(mix((tags + start).astype(np.uint64)), None, ids, tags, start, end)


def _places(key, whole, ids, tags, start, end) -> pa.RecordBatch:
    hashed = pa.nulls(len(key), pa.int64()) if whole is None else pa.array(whole.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), hashed, *(pa.array(c) for c in (ids, tags, start, end))], names=["key", "whole", "id", "tag", "at", "to"])


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _contexts(length: int, gram: int, slice_bytes: int, crowded, hot, mixed=None, big=None, settle: bool = True):
    """Contexts of anchors that occur twice or more; within a slice, equal contexts are settled at once.

    Without ``mixed``, places and hashes; with it, the bytes of contexts whose key it has, those
    of anchors in ``big`` dealt out like those of hot ones.  Without ``settle``, the bytes of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, very = np.frombuffer(crowded.value, np.uint64), np.frombuffer(hot.value, np.uint64)
        shown, vast = (None if x is None else np.frombuffer(x.value, np.uint64) for x in (mixed, big))
        reach = length - gram
        for batch in slices(batches, "__text", slice_bytes):
            raw_all, at_all = flat(batch.column(2))
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            tags = batch.column(1).to_numpy()
            for base, raw, at in _stretches(raw_all, at_all, length):
                where, h, hashes, least = anchors(raw, at, length, gram)
                keep = _passes(many, h)
                where, h = where[keep], h[keep]
                floor, ceiling = led_strings(where, h, least, reach)
                doc = np.searchsorted(at, where, side="right") - 1
                newly = np.zeros(len(h), bool) if vast is None else _passes(vast, h) & ~_passes(very, h)
                is_hot = _passes(very, h) | newly
                # string starts of each row: all that the anchor leads, or a group of SPLIT of them for hot anchors
                c = ~is_hot
                rows = [(where[c], doc[c], h[c], where[c] - reach, where[c], floor[c], ceiling[c], newly[c])]
                w, d, x, f, u, v = where[is_hot], doc[is_hot], h[is_hot], floor[is_hot], ceiling[is_hot], newly[is_hot]
                for g in range(0, reach + 1, SPLIT):
                    rows.append((w, d, x, w - reach + g, np.minimum(w - reach + g + SPLIT - 1, w), f, u, v))
                w, d, x, lo, hi, f, u, v = (np.concatenate(c) for c in zip(*rows, strict=True))
                # hot rows are keyed by the bytes that all of their strings share, all others by their anchor;
                # where a text's end cuts the strings short, those bytes still lie within it
                inside = np.maximum(lo, f) <= np.minimum(hi, u)
                w, d, x, lo, hi, f, u, v = (c[inside] for c in (w, d, x, lo, hi, f, u, v))
                if not len(w):
                    continue
                key = np.where(v | _passes(very, x), mix(hashes.of(np.minimum(hi, len(raw)), np.minimum(lo + length, len(raw))) + (w - hi).astype(np.uint64)), x)
                lo, hi = np.maximum(lo, f), np.minimum(hi, u)
                end = hi + length
                if not settle:
                    yield from _bytes(raw, base - at[d] + lo, lo, end, key, ids[d], tags[d], v)
                    continue
                whole = mix(hashes.of(lo, end) + (end - lo).astype(np.uint64)) ^ mix(key + (w - lo).astype(np.uint64))
                whole = mix(whole ^ mix(SecondHashes(raw).of(lo, end)))
                by = np.lexsort((lo - at[d], tags[d], ids[d], whole))
                w, d, lo, end, key, whole, v = w[by], d[by], lo[by], end[by], key[by], whole[by], v[by]
                first = np.concatenate([[True], whole[1:] != whole[:-1]])
                start, to = base + lo - at[d], base + end - at[d]
                f = np.flatnonzero(first)
                if shown is None:
                    yield _joined_spans(tags[d[~first]], ids[d[~first]], start[~first], to[~first])
                    yield _places(key[f], whole[f], ids[d[f]], tags[d[f]], start[f], to[f])
                    continue
                # what is dealt out only now has not been settled, so all of it goes on
                f = np.flatnonzero(v | (first & _passes(shown, key)))
                yield from _bytes(raw, start[f], lo[f], end[f], key[f], ids[d[f]], tags[d[f]], v[f])

    return run


def _bytes(raw, start, lo, end, key, ids, tags, fresh) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 20000):
        g = slice(i, i + 20000)
        yield pa.RecordBatch.from_arrays([pa.array(key[g].astype(np.int64)), pa.array(ids[g]), pa.array(tags[g]), pa.array(start[g]), pa.array(fresh[g]), _gather(raw, lo[g], end[g])], names=["key", "id", "tag", "at", "fresh", "ctx"])


def _settle():
    """From places sorted by key, hash and order: spans of all but the first of equal contexts, and how often each key turns to another context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, hash, tag and place of the row before
        for batch in batches:
            settled = batch.column(1).is_null()
            done = batch.filter(settled)
            batch = batch.filter(pc.invert(settled))
            key, whole, _, tag, at, to = (c.to_numpy() for c in batch.columns)
            n = len(key)
            keys = turns = again = np.zeros(0, np.int64)
            if n:
                prior = last or (key[0] - 1, 0, 0, 0)
                before = lambda c, v: np.concatenate([[v], c[:-1]])
                same_key = key == before(key, prior[0])
                same = same_key & (whole == before(whole, prior[1]))
                same_place = same & (tag == before(tag, prior[2])) & (at == before(at, prior[3]))
                again = np.flatnonzero(same & ~same_place)
                keys, turns = np.unique(key[same_key & ~same], return_counts=True)
                last = (key[-1], whole[-1], tag[-1], at[-1])
            spans = [pa.concat_arrays([done.column(j), pa.array(c[again] if n else [], pa.int64()), pa.nulls(len(keys), pa.int64())]) for j, c in ((3, tag), (4, at), (5, to))]
            marks = [pa.concat_arrays([pa.nulls(len(spans[0]) - len(keys), pa.int64()), pa.array(c.astype(np.int64))]) for c in (keys, turns)]
            yield pa.RecordBatch.from_arrays([*spans, *marks], names=["tag", "s", "e", "key", "turns"])

    return run


def _mark(length: int, settle: bool = True):
    """Spans to remove, from contexts sorted by key, bytes and order; of equal ones the first goes to the index, and the others, unless settled before, are marked whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []  # distinct contexts of whole groups, to be searched together
        size, group, last_key, last_ctx = 0, [], None, None

        def search() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                rows = [r for g in held for r in sorted(g, key=lambda r: r[:3])]
                numbers = np.repeat(np.arange(len(held)), [len(g) for g in held])
                owner, s, e = late_spans([r[3] for r in rows], numbers, length)
                if len(owner):
                    tag, at = (np.array([r[j] for r in rows], np.int64)[owner] for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(at + s), pa.array(at + e)], names=["tag", "s", "e"])
            held, size = [], 0

        for batch in batches:
            again: list[tuple] = []
            for key, i, tag, at, fresh, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last_key:
                    if len(group) > 1:
                        held.append(group)
                        size += sum(len(g[3]) for g in group)
                        if size > INDEX_BYTES:
                            yield from search()
                    last_key, group = key, [(i, tag, at, ctx)]
                elif ctx != last_ctx or not settle:
                    group.append((i, tag, at, ctx))
                elif fresh:
                    again.append((tag, at, at + len(ctx)))
                last_ctx = ctx
            if again:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*again, strict=True)], names=["tag", "s", "e"])
        if len(group) > 1:
            held.append(group)
        yield from search()

    return run


def _cut_out():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 8 << 20):
            raw, at = flat(batch.column(1))
            kept, bounds = [], []
            for i in range(batch.num_rows):
                text, merged = raw[at[i] : at[i + 1]], []
                found = batch.column(2)[i].as_py()
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                here, parts = 0, []
                for s, e in merged:
                    parts.append(text[here:s].tobytes())
                    here = e
                parts.append(text[here:].tobytes())
                kept.append(b"".join(parts))
                bounds.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(bounds, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["__id", "n_bytes", "spans", "kept"],
            )

    return run


def _bitmaps(rows: DataFrame, count: int, key: str, kinds: dict[str, Column]) -> list[bytes]:
    """Bitmaps of the slots of ``key``, one for each kind of the ``count`` rows, sized by that and at most 2^SLOT_BITS."""
    bits = max(12, min(SLOT_BITS, count.bit_length() + SPARE_BITS))
    slot = F.shiftrightunsigned(key, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(F.shiftrightunsigned(slot, 6).alias("w")).agg(*[F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("long"))).alias(kind) for kind, test in kinds.items()]).toArrow()
    out = []
    for kind in kinds:
        words_of = np.zeros(1 << (bits - 6), np.int64)
        words_of[words.column("w").to_numpy()] = words.column(kind).to_numpy()
        out.append(words_of.tobytes())
    return out


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 100,
    gram: int = 40,
    slice_bytes: int = STRETCH,
    hot_share: float = HOT_SHARE,
    hot_count: int = HOT,
    big: int = BIG,
    settle: bool = True,
) -> DataFrame:
    """One row per row: ``id_col``, n_bytes, spans (start, end of each maximal removed run), kept (binary).

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a row with
    a smaller id (null ids last, equal ids by place in the scan), or earlier in the same text.
    Texts are UTF-8 bytes, null is empty, matches stay within texts, and strings are judged on
    the input.

    1. Anchors: the least of the ``gram``-byte strings in each ``length``-byte string.  Equal
       long strings hold equal anchors, so anchors that occur once are left out of all that
       follows.  Their counts are pre-aggregated by slice and by task.
    2. Each anchor that occurs twice brings its context, the bytes of the long strings that it is
       the least in, to the task of its key: first as a hash and a place.  Of equal contexts all
       but the earliest are marked whole, within a slice there and then, so a copied text sends
       one context a slice, not one a copy.  The strings of an anchor with more than ``hot_count``
       occurrences and ``hot_share`` of them all are dealt out in groups of SPLIT, keyed by the
       bytes they share, so no key gathers a passage that a third of the documents hold.  ``settle``
       turned off skips this step: the index then answers for equal contexts as well.
    3. Keys that have several distinct contexts send their bytes; a key with more than ``big`` of
       them has its strings dealt out like those of hot anchors.  Within a key, a run-length index
       holds earlier contexts (run heads and starts, text positions sampled at run ends), and the
       matching statistics of later ones stream through it: where they reach ``length``, the
       bytes go (see ``rindex.late_spans``).  Some megabyte of whole keys is searched together.
    4. Marks are merged by document and cut out.

    Three bitmaps of at most 2^SLOT_BITS slots are all that is collected and broadcast; their size
    follows the counts, and a slot shared by chance lets an anchor pass in vain, never drops
    one.  Equality of whole contexts is judged by two unrelated hashes mixed to 64 bits, that of
    the strings within them by bytes.  Rows are told apart by their place in the scan, so ``docs``
    should read a written table.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("tag"), F.col(text_col).alias("__text"))
    seen = Observation()
    counted = base.select("__text").mapInArrow(_count_anchors(length, gram, slice_bytes), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = cut(counted.observe(seen, F.sum("n").alias("all"), F.count("*").alias("rows")), "repeat-anchors")
    very = F.col("n") > max(hot_count, hot_share * (seen.get["all"] or 0))
    crowded, hot = (spark.sparkContext.broadcast(m) for m in _bitmaps(counts, seen.get["rows"], "h", {"many": F.lit(True), "hot": very}))
    picked = base.select(F.col("__id").cast("long").alias("id"), "tag", "__text")
    if settle:
        places = picked.mapInArrow(_contexts(length, gram, slice_bytes, crowded, hot), _PLACE)
        dealt = places.repartition("key").sortWithinPartitions("key", "whole", "id", "tag", "at")
        settled = cut(dealt.mapInArrow(_settle(), "tag bigint, s bigint, e bigint, key bigint, turns bigint"), "repeat-settled")
        turning = settled.where("key is not null").groupBy("key").agg(F.sum("turns").alias("turns"))
        kinds = {"mixed": F.lit(True), "big": F.col("turns") >= big}
        mixed, vast = (spark.sparkContext.broadcast(m) for m in _bitmaps(turning, turning.count(), "key", kinds))
        contexts = picked.mapInArrow(_contexts(length, gram, slice_bytes, crowded, hot, mixed, vast), _CONTEXT)
    else:
        contexts = picked.mapInArrow(_contexts(length, gram, slice_bytes, crowded, hot, settle=False), _CONTEXT)
    grouped = contexts.repartition("key").sortWithinPartitions("key", "ctx", "id", "tag", "at")
    marks = grouped.mapInArrow(_mark(length, settle), "tag bigint, s bigint, e bigint")
    if settle:
        marks = marks.union(settled.where("key is null").select("tag", "s", "e"))
    spans = marks.groupBy("tag").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    joined = base.join(spans, "tag", "left").select("__id", "__text", "found")
    kind = joined.schema[0].dataType.simpleString()
    out = joined.mapInArrow(_cut_out(), f"__id {kind}, n_bytes bigint, spans array<struct<start:bigint,`end`:bigint>>, kept binary")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "spans", "kept")
