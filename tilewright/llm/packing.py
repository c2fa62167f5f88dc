"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded."""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .arrow import slices
from .runtime import new_path

_worker: dict[str, Ids] = {}


class Ids(dict):
    """Little-endian uint32 ids of a pre-token, merged once and kept."""

    def __init__(self, path: str) -> None:
        self.merge = tokens.merger(path)

    def __missing__(self, word: str) -> bytes:
        found = self.merge(word)
        ids = pack(f"<{len(found)}I", *found)
        if len(word) <= tokens.CACHED:
            self[word] = ids
        return ids

    def bound(self) -> None:
        if len(self) > tokens.CACHE:
            self.clear()


def _encoder(path: str):
    """Texts to little-endian uint32 ids: through a bounded cache of pre-tokens, or by the library where splitting is not proven."""
    split, encode_whole = tokens.splitter(path), tokens.whole_ids(path)
    if split is None:
        return lambda texts: [np.array(ids, "<u4").tobytes() for ids in encode_whole(texts)]
    special = tokens.specials(path)
    added = {t.content: pack("<I", i) for i, t in tokens.library(path).get_added_tokens_decoder().items()}
    if path not in _worker:
        _worker[path] = Ids(path)
    ids = _worker[path]

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            pieces = special.split(text) if special and "<" in text else [text]
            body = [b"".join(map(ids.__getitem__, split(p))) for p in pieces[::2]]
            out.append(body[0] + b"".join(added[a] + b for a, b in zip(pieces[1::2], body[1:], strict=True)))
        ids.bound()
        return out

    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as pieces of ``longest`` and then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def decompose(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    longest: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document is the ids of its whole text under the vocabulary file ``path`` (nothing added)
    and then ``end_id``.  It is cut into pieces of ``longest`` (a power of two) ids and the binary
    decomposition of the remainder, so each piece fills a sequence of its own length exactly:
    sequences never mix documents, need no padding, and pieces of equal length form the bucket
    named by ``length`` (see ``pack_documents``).  offset is therefore always 0.

    One map over the scan, no shuffle.  sequence_id is the place in the scan, hence unique, and
    the same again when a task over the same splits is retried.  Memory is bounded by a slice of
    texts, or one text, and the cache of pre-tokens.  Null text is empty: one piece with the end
    id.  Repeated rows and ids are packed as often as they occur.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in slices(batches, "__text", 2 << 20):
            encode = encode or _encoder(path)
            rows, starts, lengths, pieces, totals = [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, longest):
                    rows.append(i)
                    starts.append(at)
                    lengths.append(size)
                    pieces.append(ids[4 * at : 4 * (at + size)])
                    totals.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())],
                names=["__id", "start", "length", "ids", "doc_tokens"],
            )

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = picked.schema[0].dataType.simpleString()
    out = picked.mapInArrow(run, f"__id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return out.select(
        F.col("__id").alias(id_col), "start", "length", "ids", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length: a batch drawn from a folder has equal lengths."""
    pieces.write.partitionBy("length").option("compression", "zstd").parquet(path)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, folder: str | None = None, **options) -> DataFrame:
    """The pieces of ``decompose``, written to buckets of equal length in ``folder`` and read back.

    A bucket is a folder of ``folder``, by default a new one of the shared folder; a filter on
    length reads the files of that bucket alone.
    """
    spark = docs.sparkSession
    pieces = decompose(docs, path, id_col, text_col, **options)
    folder = folder or new_path(spark, "packed")
    write_buckets(pieces, folder)
    return spark.read.schema(pieces.schema).parquet(folder).select(*pieces.columns)
