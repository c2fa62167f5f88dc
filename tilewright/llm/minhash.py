"""Near-duplicate classes by MinHash with tensored banding, every link confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import flat, slices
from .components import components
from .runtime import cut
from .shingles import mix, shingle_sets

#: Members of one side of a block that the residual kernel compares at once.
BLOCK = 256


def _signature(u: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """``len(seeds) / width`` keys, each of ``width`` minhashes of the set ``u``."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(u), 8192):
        part = u[at : at + 8192]
        for i, s in enumerate(seeds):
            v = (part ^ s) * np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            least[i] = min(least[i], v.min())
    keys = np.arange(len(seeds) // width, dtype=np.uint64)
    for j in range(width):
        keys = mix(keys ^ least[j::width])
    return keys


def _signatures(n: int, bands: int, width: int):
    seeds = np.random.default_rng(7).integers(1, 1 << 63, 2 * bands * width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 2 << 20):
            sets = shingle_sets(*flat(batch.column(1)), n)
            halves = [_signature(u, seeds, width).astype(np.int64) if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(u) for u in sets], pa.int64()),
                    pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in sets], pa.binary()),
                    pa.array([None if h is None else h[:bands] for h in halves], pa.list_(pa.int64())),
                    pa.array([None if h is None else h[bands:] for h in halves], pa.list_(pa.int64())),
                ],
                names=["__id", "n_shingles", "node", "a", "b"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 2 << 20):
            sets = [u for u in shingle_sets(*flat(batch.column(0)), n) if len(u)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets], pa.binary()), pa.array([u.astype(np.int64) for u in sets], pa.list_(pa.int64()))],
                names=["node", "s"],
            )

    return run


def _linked(common, n1, n2, percent: int):
    return 100 * common >= percent * (n1 + n2 - common)


def _residual(percent: int):
    """Links between members of a block's two sides that share a bucket and lie in different components, one per pair of components."""

    def block(u: list, m: list) -> list[tuple[int, int]]:
        sets = [x[2] for x in u] + [x[2] for x in m]
        slots = [x[1] for x in u] + [x[1] for x in m]
        inside = np.zeros((len(sets), 1 + max(int(x.max()) for x in slots)), np.float32)
        inside[np.repeat(np.arange(len(sets)), [len(x) for x in slots]), np.concatenate(slots)] = 1
        share = inside[: len(u)] @ inside[len(u) :].T > 0
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        common = np.zeros((len(u), len(m)), np.float32)
        for lo in range(0, len(names), 16384):  # exact: counts stay far below 2^24
            hit = (at >= lo) & (at < lo + 16384)
            dense = np.zeros((len(sets), min(16384, len(names) - lo)), np.float32)
            dense[rows[hit], at[hit] - lo] = 1
            common += dense[: len(u)] @ dense[len(u) :].T
        nu, nm = np.array([len(x[2]) for x in u]), np.array([len(x[2]) for x in m])
        cu, cm = np.array([x[0] for x in u]), np.array([x[0] for x in m])
        good = _linked(common.astype(np.int64), nu[:, None], nm[None, :], percent) & share & (cu[:, None] != cm[None, :])
        i, j = np.nonzero(good)
        pairs = {(min(a, b), max(a, b)) for a, b in zip(cu[i].tolist(), cm[j].tolist(), strict=True)}
        return sorted(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and (found := block(*sides)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns[:6]]
            slots, sets = batch.columns[6:]
            for r in range(batch.num_rows):
                here = tuple(int(c[r]) for c in cols[:3])
                if here != key:
                    yield from close()
                    key, sides = here, ([], [])
                sides[int(cols[3][r])].append((int(cols[5][r]), slots[r].values.to_numpy(), sets[r].values.to_numpy()))
        yield from close()

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    percent: int = 80,
    bands: int = 10,
    width: int = 2,
) -> DataFrame:
    """One row per row: ``id_col``, n_shingles, component_id, kept, row_tag.

    A text's set holds its distinct shingles of ``words`` words (runs of characters other than
    U+0009 to U+000D and space, A-Z lower-cased); fewer words form one shingle.  Texts whose sets
    have 100 * intersection >= ``percent`` * union are linked, and component_id is the smallest
    id reachable.  Kept is the row with that id (the first in the scan, if it repeats): one row a
    component.  Null and empty texts and texts of blanks have no set and are linked with nothing.
    Ids that are null take part but name no component unless all of its ids are null.

    Tensored banding: two collections of ``bands`` keys of ``width`` minhashes each are combined
    in pairs, so 2 * bands * width minhashes give bands^2 tables of 2 * width.  A pair of
    similarity p shares a table with probability (1 - (1 - p^width)^bands)^2: 0.99993 at 0.8 by
    default.  Then:

    1. Rows with equal sets collapse into one node.  Tables keep only keys that two nodes share.
    2. In every bucket the best connected node is the leader; each member is compared with it on
       full sets (as many candidates as members, never all pairs).  Confirmed links are joined
       into components.
    3. Buckets of all bands^2 tables that still hold several components are searched exactly:
       members outside the leader's component against all, in blocks of BLOCK by BLOCK within a
       kernel that returns one link per pair of components.  The buckets of one leader, at most
       one a table, are searched together, so that a member goes there once and not once a
       table; only pairs that share a bucket count.  No partner is capped.

    Sets are hashed to 64 bits and computed from whole texts: once for signatures, and again for
    the rows that have a candidate, so the sets of all other texts are never stored or shuffled.
    Hot keys: counts and leaders are aggregated before the shuffle and joined back from written
    tables, so that adaptive execution can split them.  Nothing is collected or broadcast.
    """
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = picked.schema[0].dataType.simpleString()
    made = picked.mapInArrow(_signatures(words, bands, width), f"__id {kind}, n_shingles bigint, node binary, a array<bigint>, b array<bigint>")
    rows = cut(made.withColumn("row_tag", F.monotonically_increasing_id()), "near-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.min("__id").alias("__first")
    )
    nodes = cut(nodes.withColumn("num", F.monotonically_increasing_id()), "near-nodes")

    half = nodes.select("num", "b", F.explode("a").alias("x"))
    keys = half.select("num", "x", F.explode("b").alias("y")).select("num", F.xxhash64("x", "y").alias("key"))
    crowded = cut(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "near-crowded")
    members = cut(keys.join(crowded, "key").select("key", "num", "c"), "near-members")
    degree = cut(members.groupBy("num").agg(F.sum("c").alias("degree")), "near-degree")
    led = members.join(degree, "num").groupBy("key").agg(F.max(F.struct(F.col("degree"), (-F.col("num")).alias("m"))).alias("best"))
    leaders = cut(led.select("key", (-F.col("best.m")).alias("leader")), "near-leaders")
    pairs = members.join(leaders, "key").where("num <> leader").select(F.least("num", "leader").alias("u"), F.greatest("num", "leader").alias("v")).distinct()
    size = nodes.select("num", "n")
    pairs = pairs.join(size.withColumnsRenamed({"num": "u", "n": "nu"}), "u").join(size.withColumnsRenamed({"num": "v", "n": "nv"}), "v")
    pairs = cut(pairs.where(F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")), "near-pairs")

    # full sets of every node that has a candidate, from the texts again
    wanted = pairs.select(F.col("u").alias("num")).union(pairs.select(F.col("v").alias("num"))).union(members.where("c > 2").select("num")).distinct()
    wanted = cut(nodes.join(wanted, "num").select("num", "node", F.col("__first").alias("__want")), "near-wanted")
    texts = picked.join(wanted.select("__want").distinct(), F.col("__id").eqNullSafe(F.col("__want")), "left_semi").select("__text")
    sets = texts.mapInArrow(_sets(words), "node binary, s array<bigint>").join(wanted.select("node", "num"), "node").dropDuplicates(["num"]).select("num", "s")
    sets = cut(sets, "near-sets")

    common = F.size(F.array_intersect("su", "sv")).cast("long")
    checked = pairs.join(sets.withColumnsRenamed({"num": "u", "s": "su"}), "u").join(sets.withColumnsRenamed({"num": "v", "s": "sv"}), "v")
    links = cut(checked.where(_linked(common, F.col("nu"), F.col("nv"), percent)).select("u", "v"), "near-links")
    comps = components(links)

    placed = members.where("c > 2").join(comps.withColumnRenamed("node", "num"), "num", "left").select("key", "num", F.coalesce("component", "num").alias("comp"))
    placed = cut(placed.join(leaders, "key"), "near-placed")
    head = placed.where("num = leader").select("key", F.col("comp").alias("lead_comp"))
    mixed = placed.join(head, "key").groupBy("key").agg(F.first("leader").alias("leader"), F.first("lead_comp").alias("lead_comp"), F.count_if(F.col("comp") != F.col("lead_comp")).alias("o")).where("o > 0").drop("o")
    slot = F.row_number().over(Window.partitionBy("leader").orderBy("key")).cast("short")
    mixed = cut(mixed.withColumn("slot", slot), "near-mixed")
    # a leader's mixed buckets, at most one a table, are searched as one: each member once, with the buckets it is in
    group = placed.join(mixed.drop("leader"), "key").groupBy("leader", "num").agg(F.first("comp").alias("comp"), F.first("lead_comp").alias("lead_comp"), F.collect_list("slot").alias("slots"))
    group = cut(group, "near-group")
    count = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sides = group.groupBy("leader").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("lead_comp")).alias("o"))
    sides = cut(sides.select("leader", count("o").alias("bu"), count("m").alias("bm")), "near-sides")
    group = group.join(sides, "leader")
    spread = F.xxhash64("num")
    outside = group.where("comp <> lead_comp").withColumn("i", F.pmod(spread, F.col("bu")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bm") - 1))).withColumn("side", F.lit(0))
    inside = group.withColumn("j", F.pmod(spread, F.col("bm")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bu") - 1))).withColumn("side", F.lit(1))
    cols = ["leader", "i", "j", "side", "num", "comp", "slots"]
    blocks = outside.select(*cols).union(inside.select(*cols)).join(sets, "num").select(*cols, "s")
    blocks = blocks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    late = cut(blocks.mapInArrow(_residual(percent), "u bigint, v bigint"), "near-late")
    joined = components(late)

    final = comps.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c2")), "component", "left").select(F.col("node").alias("num"), F.coalesce("c2", "component").alias("component"))
    alone = joined.join(comps.select(F.col("node").alias("node")), "node", "left_anti").select(F.col("node").alias("num"), "component")
    label = nodes.select("num", "node", "__first").join(final.union(alone), "num", "left").withColumn("component", F.coalesce("component", "num"))
    label = cut(label, "near-labels")
    least = cut(label.groupBy("component").agg(F.min("__first").alias("component_id")), "near-least")
    label = cut(label.join(least, "component").select("node", "component", "component_id"), "near-final")
    # the row that stays: one per component, by id and then by place in the scan
    out = rows.select("__id", "n_shingles", "node", "row_tag").join(label, "node", "left")
    first = out.where("node is not null and __id <=> component_id").groupBy("component").agg(F.min("row_tag").alias("stays"))
    stays = cut(first.select(F.col("stays").alias("row_tag"), F.lit(True).alias("__stays")), "near-stays")
    return out.join(stays, "row_tag", "left").select(
        F.col("__id").alias(id_col),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("node").isNull() | F.col("__stays").isNotNull()).alias("kept"),
        "row_tag",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, and every row without a set; columns unchanged.

    Rows are told apart by their place in the scan, so ``docs`` should read a written table.
    """
    tag = "__row_tag"
    while tag in docs.columns:
        tag += "_"
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("row_tag").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(kept, tag, "left_semi").select(*docs.columns)
