"""Documents to packed training sequences, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All stages but the last return the columns of documents.

Null and empty texts are scored like any other and go if the classifier rejects them; those that
stay count as equal to each other for exact copies, have no shingles and so no near copies, and
are packed as their end id alone.  Null ids and sources are kept.  With no documents every stage
returns an empty table, with no labels the classifier rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, minhash, mixing, packing, quality, runtime
from tilewright.llm.queries import MIX_SEED, SOURCE_WEIGHTS, tokenizer_path


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.drop_near_copies(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at their source's rate and shuffled globally."""
    return mixing.mix_sources(docs, SOURCE_WEIGHTS, rest_weight=1.0, seed=MIX_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each a piece of one document."""
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix),
    ("packing", pack),
]

#: The classifier, the near-duplicate classes and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = runtime.made(spark)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.cut(docs, f"stage-{k}")
            runtime.release(spark, before, keep=docs)  # what this stage alone has read
    return docs
