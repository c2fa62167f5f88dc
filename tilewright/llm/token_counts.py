"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .arrow import slices

_worker: dict[str, Counts] = {}


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that stand as one pre-token and encode alone as one token.

    Merges never cross pre-tokens, so wherever a text is split into such a pre-token it is
    exactly one token.  The proof runs the library over each string of the vocabulary once.
    """
    kind = tokens.kind_of(path)
    if kind is None:
        return []
    lib = tokens.library(path)
    special = {t.content for t in lib.get_added_tokens_decoder().values()}
    split = tokens.patterns()[kind].fullmatch
    strings = [s for s in tokens.vocabulary_strings(path) if s not in special and not tokens.beyond(s) and split(s)]
    encoded = lib.encode_batch_fast(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


class Counts(dict):
    """Tokens of a pre-token: one for the proven whole tokens, else merged once and kept."""

    def __init__(self, path: str, singles: list[str]) -> None:
        super().__init__(dict.fromkeys(singles, 1))
        self.merge, self.singles = tokens.merger(path), singles

    def __missing__(self, word: str) -> int:
        n = len(self.merge(word))
        if len(word) <= tokens.CACHED:
            self[word] = n
        return n

    def bound(self) -> None:
        if len(self) > tokens.CACHE + len(self.singles):
            self.clear()
            self.update(dict.fromkeys(self.singles, 1))


def _counter(path: str, singles: list[str]):
    split, whole = tokens.splitter(path), tokens.whole_ids(path)
    if split is None:
        return lambda texts: [len(ids) for ids in whole(texts)]
    special = tokens.specials(path)
    if path not in _worker:
        _worker[path] = Counts(path, singles)
    counts = _worker[path]

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            pieces = special.split(text) if special and "<" in text else [text]
            # every second piece is an added token
            out.append(len(pieces) // 2 + sum(sum(map(counts.__getitem__, split(p))) for p in pieces[::2]))
        counts.bound()
        return out

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col``, n_bytes (UTF-8), n_tokens, as the library encodes the whole text.

    ``path`` names a vocabulary file that every executor can read.  Files of the tokenizers library
    whose normaliser and pre-tokenizer are among the proven ones (``tokens.PROVEN``) take the
    shortcut, but for stretches between white space that hold a character from U+0250 on, which
    the library encodes; for any other file, and for sentencepiece models, it encodes whole texts.
    Added tokens inside texts count as the library's default has them, one each; nothing is added
    and nothing truncated.  Pre-tokens among the proven whole tokens count one without merging;
    all others are merged by the library, once per worker and cache generation.

    One map over the scan, no shuffle; memory is bounded by a slice of texts, one text and the
    cache.  The broadcast list of whole tokens is no longer than the vocabulary.  Null text is
    empty: 0 bytes, 0 tokens.  Repeated rows give repeated results; an empty table none.
    """
    singles = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in slices(batches, "__text", 2 << 20):
            count = count or _counter(path, singles.value)
            texts = batch.column(1).to_pylist()
            n = count([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64))], names=["__id", "n_tokens"])

    id_type = docs.select(F.col(id_col).alias("__id")).schema[0].dataType.simpleString()
    picked = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")).alias("__id"), F.col(text_col).alias("__text"))
    out = picked.mapInArrow(run, f"__id struct<id:{id_type},n:bigint>, n_tokens bigint")
    return out.select(F.col("__id.id").alias(id_col), F.col("__id.n").alias("n_bytes"), "n_tokens")
