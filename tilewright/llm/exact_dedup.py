"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Characters that equality ignores: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Null counts as empty; blanks are deleted."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _crowded(slots: DataFrame, slot: str) -> DataFrame:
    """Slots that hold more than one row.  Slot numbers are bounded by a parameter, so this may be broadcast."""
    return F.broadcast(slots.groupBy(slot).count().where("count > 1").select(slot, F.lit(True).alias(f"{slot}_hit")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prefix_chars: int = 256,
    length_slots: int = 1 << 16,
    prefix_slots: int = 1 << 20,
    hash_all: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, full_hash, row_tag.

    Texts are equal when identical after blanks are deleted.  Three scans refine the groups:
    lengths are counted in ``length_slots`` residues, rows in crowded residues have their first
    ``prefix_chars`` hashed and counted in ``prefix_slots`` residues, and only rows in crowded
    prefix residues get a SHA-256 of the whole text.  A residue that holds one row proves that
    row unique, so no pair is lost; the residue tables have a fixed largest size and are the
    only things broadcast.  ``hash_all`` fills full_hash for proven singletons too.

    No text is shuffled: only (id, code points, hash) rows are.  Groups are pre-aggregated before
    the shuffle and joined back from a written table, so a hot group can be split.

    Kept is the row with most code points in its original text, then the smallest id (null ids
    last), then the first in scan order: exactly one row per group, repeated rows included.
    Null text equals empty text.  An empty table gives an empty result.
    """
    n = F.col("__norm")
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__points"),
        normalised(F.col(text_col)).alias("__norm"),
        F.monotonically_increasing_id().alias("row_tag"),
    ).withColumn("__len", F.octet_length(n).cast("long"))
    lens = _crowded(base.select(F.pmod("__len", F.lit(length_slots)).alias("__l")), "__l")
    by_len = base.withColumn("__l", F.pmod("__len", F.lit(length_slots))).join(lens, "__l", "left")
    slot = F.pmod(F.xxhash64("__len", F.substring(n, 1, prefix_chars)), F.lit(prefix_slots))
    by_prefix = by_len.withColumn("__p", F.when(F.col("__l_hit"), slot))
    prefixes = _crowded(by_prefix.where("__p is not null").select("__p"), "__p")
    full = F.sha2(n, 256)
    light = cut(
        by_prefix.join(prefixes, "__p", "left").select(
            "__id",
            "__points",
            "row_tag",
            F.when(F.coalesce("__p_hit", F.lit(False)), full).alias("__key"),
            *([full.alias("full_hash")] if hash_all else []),
        ),
        "exact-keys",
    )
    if not hash_all:
        light = light.withColumn("full_hash", F.col("__key"))
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("z"), F.col("__id").alias("id"), F.col("row_tag").alias("tag")))
    groups = cut(
        light.where("__key is not null").groupBy("__key").agg(F.count("*").alias("__n"), best.alias("__best")).where("__n > 1"),
        "exact-groups",
    )
    # rows proven unique have no key, and would all meet in one task of a join
    alone = light.where("__key is null").select("*", F.lit(None).cast(groups.schema["__n"].dataType).alias("__n"), F.lit(None).cast(groups.schema["__best"].dataType).alias("__best"))
    joined = light.where("__key is not null").join(groups, "__key", "left").unionByName(alone)
    return joined.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__best.id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__n").isNull() | (F.col("__best.tag") == F.col("row_tag"))).alias("kept"),
        "full_hash",
        "row_tag",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts and with its own columns only.

    Rows are told apart by their place in the scan, so ``docs`` should read a written table;
    repeated ids, and columns with any name, are kept as they are.
    """
    tag = "__row_tag"
    while tag in docs.columns:
        tag += "_"
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("row_tag").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(kept, tag, "left_semi").select(*docs.columns)
