"""Exact top-k by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Candidate vectors in a block of cells, queries in a block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Most blocks of cells in a part, and query blocks that meet a part in one task.
PART_BLOCKS, TASK_QUERIES = 16, 64
#: Least number of parts, where there are as many blocks.
PARTS = 32
#: Bits of a cell in each dimension.
CELL_BITS = 7
#: Whole numbers below this, in no more dimensions than that, have products that 64 bits hold.
NARROW, NARROW_SIZE = 2.0**24, 1 << 14
#: Scores are exact below this and equal beyond it.
LIMIT = 1e38


def _usable(vec: str, scale: float) -> str:
    return f"size({vec}) > 0 and not exists({vec}, x -> x is null or isnan(x) or abs({scale}D * x) = double('infinity'))"


def approximate(vectors: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (uint8), and the low and high edge of each cell by dimension.

    Edges are the dimension's own values at equal ranks, so a skewed dimension gets fine cells
    where its values are; every value lies within its cell.
    """
    n, d = vectors.shape
    ordered = np.sort(vectors, axis=0)
    cells = 1 << bits
    low = ordered[(np.arange(cells) * n) // cells]
    number = np.empty((n, d), np.uint8)
    high = np.empty((cells, d), vectors.dtype)
    for j in range(d):
        number[:, j] = np.maximum(np.searchsorted(low[:, j], vectors[:, j], side="right") - 1, 0)
        high[:, j] = low[:, j]
        np.maximum.at(high[:, j], number[:, j], vectors[:, j])
    return number, low, high


class Cells:
    """The cells of a block of candidates; the exact vectors are elsewhere."""

    def __init__(self, nums: np.ndarray, ids: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.nums, self.ids, self.number = nums, ids, number
        self.middle = low / 2 + high / 2
        self.half = np.maximum(high - self.middle, self.middle - low)
        self.most = np.maximum(np.abs(low), np.abs(high)).max(axis=0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with each candidate: by its cells' middles, give or take their halves, widened by far more than rounding."""
        rows = np.arange(self.number.shape[1])
        size = np.abs(q)
        with np.errstate(over="ignore", invalid="ignore"):
            centre, spread = q @ self.middle[self.number, rows].T, size @ self.half[self.number, rows].T
            spread += (size @ self.most)[:, None] * 1e-11
            least, most = centre - spread, centre + spread
        # scores are only told apart up to LIMIT, and so are bounds; what overflows may be anything
        least[np.isnan(least)], most[np.isnan(most)] = -LIMIT, LIMIT
        return np.clip(least, -LIMIT, LIMIT * (1 - 1e-9)), np.clip(most, -LIMIT * (1 - 1e-9), LIMIT)


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _whole(scale: float):
    """Vectors as little-endian doubles holding whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            values = np.floor(lists.flatten().to_numpy() * scale) + 0.0  # no negative zero: equal vectors have equal bytes
            at = np.concatenate([[0], np.cumsum(size)])
            largest = np.maximum.reduceat(np.abs(values), at[:-1]) if len(size) else np.zeros(0)
            wide = (largest >= NARROW) | (size > NARROW_SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(wide), _binary(values, at * 8)], names=["id", "q", "d", "wide", "v"])

    return run


def _kinds(batch: pa.RecordBatch, *keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each combination of ``keys``."""
    rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
    for kind in np.unique(rows, axis=0) if len(rows) else ():
        yield tuple(kind.tolist()), batch.filter(pa.array((rows == kind).all(axis=1)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _blocks(size: int, keys: tuple[int, ...], make):
    """Rows gathered by ``keys`` across batches into blocks of ``size`` that ``make`` turns into one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        for batch in batches:
            for kind, rows in _kinds(batch, *keys):
                mine = held.setdefault(kind, [])
                mine.append(rows)
                while sum(len(r) for r in mine) >= size:
                    table = pa.Table.from_batches(mine).combine_chunks()
                    yield make(kind, table.slice(0, size).combine_chunks().to_batches()[0])
                    mine[:] = table.slice(size).to_batches()
        for kind, mine in held.items():
            if mine:
                yield make(kind, pa.Table.from_batches(mine).combine_chunks().to_batches()[0])

    return run


def _cell_block(kind: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
    """id, d, wide, v, num: the cells of one block."""
    parts = [x.tobytes() for x in approximate(_matrix(rows.column(3), kind[0]))]
    nums, ids = rows.column(4).to_numpy().tobytes(), rows.column(0).to_numpy().tobytes()
    return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in (nums, ids, *parts))], names=["d", "nums", "ids", "cells", "low", "high"])


def _query_block(kind: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
    """qn, id, d, floor, v: one block of queries, in the columns of the cells."""
    floors = rows.column(3).fill_null(float("-inf")).to_numpy()
    found = [rows.column(0).to_numpy().tobytes(), rows.column(1).to_numpy().tobytes(), _matrix(rows.column(4), kind[0]).tobytes(), floors.tobytes(), b""]
    return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in found)], names=["d", "nums", "ids", "cells", "low", "high"])


def _survivors(k: int):
    """From rows of a part, its cells before its queries: the candidates that the bounds cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cells = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                d, nums, ids, body, low, high, part, group, asks = (c[i].as_py() for c in batch.columns)
                if (part, group) != task:
                    task, cells = (part, group), {}
                nums, ids = np.frombuffer(nums, np.int64), np.frombuffer(ids, np.int64)
                if not asks:
                    edges = (np.frombuffer(x, np.float64).reshape(-1, d) for x in (low, high))
                    cells.setdefault(d, []).append(Cells(nums, ids, np.frombuffer(body, np.uint8).reshape(-1, d), *edges))
                    continue
                q, floor = np.frombuffer(body, np.float64).reshape(-1, d), np.frombuffer(low, np.float64).copy()
                found = []
                for block in cells.get(d, ()):
                    least, most = block.bounds(q)
                    own = ids[:, None] == block.ids[None, :]
                    least[own], most[own] = -np.inf, -np.inf
                    if least.shape[1] >= k:
                        floor = np.maximum(floor, np.partition(least, least.shape[1] - k, axis=1)[:, least.shape[1] - k])
                    r, c = np.nonzero((most >= floor[:, None]) & ~own)
                    found.append((r, block.nums[c], most[r, c]))
                if found:
                    r, num, upper = (np.concatenate(x) for x in zip(*found, strict=True))
                    keep = upper >= floor[r]
                    yield pa.RecordBatch.from_arrays([pa.array(nums[r[keep]]), pa.array(num[keep]), pa.array(upper[keep])], names=["qn", "num", "upper"])

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, id, d, wide, qv, cv: exact scores, beyond 64 bits saturated and given as decimals too."""
    for batch in batches:
        for (d, wide), rows in _kinds(batch, 2, 3):
            q, c = _matrix(rows.column(4), d), _matrix(rows.column(5), d)
            if wide:
                exact = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(q.tolist(), c.tolist(), strict=True)]
                score = pa.array([max(-(1 << 63), min(x, (1 << 63) - 1)) for x in exact], pa.int64())
                big = pa.array([max(-(10**38) + 1, min(x, 10**38 - 1)) for x in exact], pa.decimal128(38, 0))
            else:
                score = pa.array((q.astype(np.int64) * c.astype(np.int64)).sum(axis=1))
                big = pa.nulls(len(rows), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), score, big], names=["query_id", "id", "score", "big"])


_BLOCK = "d int, nums binary, ids binary, cells binary, low binary, high binary"


def vector_topk(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vec_col: str = "embedding", *, scale: float = 256.0, k: int = 5) -> DataFrame:
    """Each query's ``k`` best rows other than itself: query_id, rank (from 1), ``id_col``, score.

    Components x become floor(scale * x), as doubles; the score is their integer inner product;
    ties go to the smaller id.  ``is_query`` is a predicate over ``vectors`` that picks the
    queries; every usable row is a candidate.  Vectors that are null, empty or hold components
    that are null or not finite (after scaling), and rows with null ids, take no part; vectors of
    different lengths never meet.  A row whose id equals the query's counts as the query itself,
    and rows equal in id and vector count once.  Scores are compared exactly up to 38 digits; one
    beyond 64 bits is returned as the nearest 64-bit number.  An empty table gives an empty result.

    1. Of rows with equal vectors only the k + 1 smallest ids can be among anyone's best, so only
       they become candidates, however many copies there are.
    2. The exact vectors are written as one table, their cells of CELL_BITS bits in each
       dimension, BLOCK vectors a row, as another.  Vectors with huge components have blocks of
       their own.
    3. Blocks of cells form parts; blocks of queries go to each part.  Lower bounds give a floor
       under the kth score; candidates whose upper bound reaches it survive.  Parts are scanned
       in rounds of four times as many each, and a round starts from the floors of the last, so
       survivors stay in proportion to k, not to the number of parts.
    4. Of a round's survivors, exact vectors are read for the 2 * k with the greatest upper bounds,
       and then for those whose bound still reaches the kth score found: no other can change it.

    What is shuffled is the vectors twice, the queries once a part, and two vectors a surviving
    pair.  Nothing is broadcast; only counts are collected.
    """
    usable = vectors.where(f"{id_col} is not null").where(_usable(vec_col, scale))
    raw = usable.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    rows = cut(raw.mapInArrow(_whole(scale), "id bigint, q boolean, d int, wide boolean, v binary").distinct(), "topk-rows")
    first_ids = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("rn", first_ids).where(F.col("rn") <= k + 1).select("id", "d", "wide", "v")
    exact = cut(few.withColumn("num", F.monotonically_increasing_id()), "topk-exact")
    queries = cut(rows.where("q").select("id", "d", "wide", "v").withColumn("qn", F.monotonically_increasing_id()), "topk-queries")
    cells = cut(exact.mapInArrow(_blocks(BLOCK, (1, 2), _cell_block), _BLOCK), "topk-cells")
    blocks, asked = cells.count(), queries.count()
    parts = max(1, min(blocks, PARTS), -(-blocks // PART_BLOCKS))
    groups = max(1, -(-asked // (QUERY_BLOCK * TASK_QUERIES)))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("nums"), F.lit(parts)).cast("int"))

    def score(pairs: DataFrame) -> DataFrame:
        candidates = exact.select("num", "id", "d", F.col("wide").alias("cw"), F.col("v").alias("cv")).hint("merge")
        asking = queries.select("qn", F.col("id").alias("query_id"), F.col("wide").alias("qw"), F.col("v").alias("qv")).hint("merge")
        both = pairs.join(candidates, "num").join(asking, "qn").select("query_id", "id", "d", (F.col("cw") | F.col("qw")).alias("wide"), "qv", "cv")
        return both.mapInArrow(_scores, "query_id bigint, id bigint, score bigint, big decimal(38,0)")

    order = Window.partitionBy("query_id").orderBy(F.coalesce("big", F.col("score").cast("decimal(38,0)")).desc(), "id")

    def top(found: DataFrame) -> DataFrame:
        return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "topk-best")

    def with_floor(pairs: DataFrame, best: DataFrame | None, id_of: str) -> DataFrame:
        """``pairs`` with the query's kth score, as a double no greater than it, if it has one."""
        if best is None:
            return pairs.withColumn("floor", F.lit(None).cast("double"))
        kth = F.coalesce("big", "score").cast("double")
        floors = best.where(F.col("rank") == k).select(F.col("query_id").alias(id_of), (kth - F.abs(kth) * 1e-12).alias("floor"))
        return pairs.join(floors.hint("merge"), id_of, "left")

    best, low, high = None, 0, max(1, parts // 16)
    while low < parts:
        asks = with_floor(queries, best, "id").select("qn", "id", "d", "floor", "v").repartition(max(1, -(-asked // (4 * QUERY_BLOCK))))
        asks = asks.mapInArrow(_blocks(QUERY_BLOCK, (2,), _query_block), _BLOCK).withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        asks = asks.withColumn("group", F.pmod(F.xxhash64("nums"), F.lit(groups)).cast("int")).withColumn("asks", F.lit(True))
        held = cells.where(F.col("part").between(low, high - 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(False))
        dealt = held.union(asks).repartition(min((high - low) * groups, 1 << 14), "part", "group").sortWithinPartitions("part", "group", "asks")
        bounds = cut(dealt.mapInArrow(_survivors(k), "qn bigint, num bigint, upper double"), "topk-bounds")
        ranked = bounds.withColumn("place", F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("upper"), "num")))
        leading = cut(ranked.where(F.col("place") <= 2 * k).select("qn", "num"), "topk-read")
        found = score(leading)
        best = top(found if best is None else found.union(best.select(found.columns)))
        rest = ranked.where(F.col("place") > 2 * k).join(queries.select("qn", F.col("id").alias("query_id")).hint("merge"), "qn")
        rest = cut(with_floor(rest, best, "query_id").where("floor is null or upper >= floor").select("qn", "num"), "topk-read")
        best = top(score(rest).union(best.select("query_id", "id", "score", "big")))
        low, high = high, min(parts, high * 5)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
