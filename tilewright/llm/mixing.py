"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most sources that may be listed with a weight of their own: bounds the broadcast rates.
MAX_SOURCES = 100_000
#: Copies of a row that one row expands into at a time.
CHUNK = 1024
#: The pooled rest: sources that are not listed, and null.
REST = None


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """(first, P(X <= first), P(X <= first + 1), ... until it is 1 in 52 bits); a uniform u gives first plus the count of entries <= u.

    Below ``first``, and beyond the last entry, lie twelve standard deviations or more: the list
    grows with the root of the rate only.
    """
    if rate <= 0:
        return 0, [1.0]
    reach = 12 * math.sqrt(rate) + 40
    first = max(0, math.floor(rate - reach))
    mass = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(first, math.floor(rate + reach) + 1)]
    whole = sum(mass) if first else 1.0  # far from 0, rounding of the exponents is a common factor
    out, total = [], 0.0
    for k, m in enumerate(mass, first):
        total += m / whole
        out.append(min(total, 1.0))
        if k > rate and total >= 1 - 2**-52:
            break
    return first, out


def uniform(*parts: Column) -> Column:
    """52 bits of MD5 over the parts, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", *, rest_weight: float = 0.0, epochs: float = 1.0) -> dict[str | None, float]:
    """Mean copies of a row of each listed source (REST: of all others together).

    A source's rate is its share of the weights times ``epochs`` times all rows, over its rows.
    Sources without rows take no share.  One aggregation, pre-aggregated before its shuffle,
    returns at most ``len(weights) + 1`` rows.
    """
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources may be listed")
    if rest_weight < 0 or any(not w >= 0 for w in weights.values()):
        raise ValueError("weights are 0 or more")
    name = F.col(source_col)
    listed = F.when(name.isin(list(weights)), name) if len(weights) <= 200 else None
    if listed is None:
        names = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in weights], "__s string"))
        grouped = docs.select(name.alias("__n")).join(names, F.col("__n") == F.col("__s"), "left").groupBy(F.col("__s").alias("s"))
    else:
        grouped = docs.groupBy(listed.alias("s"))
    sizes = {r["s"]: r["n"] for r in grouped.agg(F.count("*").alias("n")).collect()}
    share = {s: float(rest_weight if s is REST else weights[s]) for s in sizes}
    total = sum(share.values())
    rows = sum(sizes.values())
    return {s: (epochs * rows * share[s] / total / sizes[s] if total else 0.0) for s in sizes}


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    id_col: str = "doc_id",
    source_col: str = "source",
    *,
    rest_weight: float = 0.0,
    epochs: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Rows of ``docs`` repeated and shuffled, with copy_no (from 1), copies and shuffle_key.

    A row's count inverts the Poisson distribution with its source's rate at a uniform number
    hashed from (seed, id); equal ids get equal numbers.  Counts depend on nothing else, so a
    retried task gives the same rows.  The order is global: rows are dealt to range partitions
    of shuffle_key, a hash of (seed, id, copy_no), and sorted there, which also spreads a hot
    source evenly.  Only the listed rates are broadcast, each with a window of its distribution
    that grows with the root of the rate.  Where a rate exceeds CHUNK, copies are made in two
    steps, chunks of CHUNK copies being dealt to all tasks before they are expanded.

    Null ids hash as ``-``.  Null and unlisted sources form one pooled source with
    ``rest_weight``.  An empty table gives an empty result.  Input columns named like the
    three added ones are replaced; all others, whatever their names, are kept.
    """
    rates = repetition_rates(docs, weights, source_col, rest_weight=rest_weight, epochs=epochs)
    spark = docs.sparkSession
    mark = "__mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    name, first, cdf, draw, chunk = (mark + c for c in ("name", "first", "cdf", "draw", "chunk"))
    schema = T.StructType([T.StructField(name, T.StringType()), T.StructField(first, T.LongType()), T.StructField(cdf, T.ArrayType(T.DoubleType()))])
    table = F.broadcast(spark.createDataFrame([(s, *poisson_cdf(r)) for s, r in rates.items() if s is not REST], schema))
    rest_first, rest_cdf = poisson_cdf(rates.get(REST, 0.0))
    own = [c for c in docs.columns if c.lower() not in ("copy_no", "copies", "shuffle_key")]
    drawn = docs.withColumn(mark, F.col(id_col)).withColumn(draw, uniform(F.lit(seed), F.col(mark))).select(*own, F.col(source_col).alias(mark + "source"), F.col(id_col).alias(mark), draw)
    counted = drawn.join(table, F.col(mark + "source") == F.col(name), "left")
    counted = counted.withColumn(cdf, F.coalesce(cdf, F.array(*[F.lit(x) for x in rest_cdf]))).withColumn(first, F.coalesce(first, F.lit(rest_first)))
    copies = (F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(draw)))).cast("int")
    counted = counted.withColumn("copies", copies).where("copies > 0").select(*own, mark, "copies")
    if max(rates.values(), default=0.0) > CHUNK:
        counted = counted.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK).cast("int")))).repartition(F.xxhash64(mark, chunk))
        numbers = F.sequence(F.col(chunk) * CHUNK + 1, F.least((F.col(chunk) + 1) * CHUNK, F.col("copies")))
    else:
        numbers = F.sequence(F.lit(1), F.col("copies"))
    rows = counted.select(*own, mark, "copies", F.explode(numbers).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), F.coalesce(F.col(mark).cast("string"), F.lit("-")), F.col("copy_no")))
    return rows.withColumn("shuffle_key", key).drop(mark).orderBy("shuffle_key")
