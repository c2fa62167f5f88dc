"""One query for each operator, over whole tables, with equivalent SQL where there is any."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EncodeOptions, Reduction
from .functions import color as c
from .functions import texture as t
from .operators import codecs, dither, histogram, images, nearest, palette, texture, tiles
from .operators.palette import snap15_array
from .plans import adapters as ad
from .plans import convert
from .sources import files, sinks
from .sql import D, LINEITEM, EVENTS, PARTS, ch, distance_sql, from15_sql, milli, pack_sql, snap6_sql, snap15_sql, to5_sql, yiq_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RED = Reduction()
#: Two colours and a palette that many queries use.
KEY, OTHER = 0x00204060, -12566464
PALETTE = [int(v) for v in (-16777216, -1, -16776961, -16711936, -65536, -8355712, -12599296, -4145152)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scaled(x: Column) -> Column:
    """Thousandths as a whole number, computed alike everywhere."""
    return F.floor(x * 1000 + 0.5).cast("long")


def scalar(name: str, cols: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Expressions over the pixels of lineitem, by key; they are built when a session is there."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        px = ad.lineitem_pixels(spark, folder)
        return px.select("image_id", "y", "x", *[e().alias(k) for k, (e, _) in cols.items()])

    query(name, f"WITH px AS ({LINEITEM}) SELECT image_id, y, x, " + ", ".join(f"{s} AS {k}" for k, (_, s) in cols.items()) + " FROM px")(run)




def A() -> Column:
    return c.yiq("rgba")


def B() -> Column:
    return c.yiq(F.lit(OTHER))


A_SQL, B_SQL = yiq_sql("rgba"), yiq_sql(f"({OTHER})")
scalar("f1_to15", {"v": (lambda: c.to15("rgba"), f"({to5_sql(ch('rgba', 0))} | ({to5_sql(ch('rgba', 1))} << 5) | ({to5_sql(ch('rgba', 2))} << 10))::INTEGER")})
scalar("f2_from15", {"v": (lambda: c.from15(F.col("rgba").bitwiseAND(F.lit(0xFFFF))), from15_sql("(rgba & 65535)"))})
scalar("f3_snap15", {"v": (lambda: c.snap15("rgba"), snap15_sql("rgba"))})
scalar("f4_snap18", {"v": (lambda: c.snap18("rgba"), pack_sql(*(snap6_sql(ch("rgba", k)) for k in range(3)), "0"))})
scalar("f5_interpolate15", {"v": (lambda: c.interpolate15(F.col("rgba").bitwiseAND(F.lit(0x7FFF)), F.lit(0x1234), 0.25), " | ".join(f"((floor((((rgba & 32767) >> {5 * k}) & 31) * 0.75::DOUBLE + {(0x1234 >> 5 * k) & 31} * 0.25::DOUBLE))::INTEGER << {5 * k})" for k in range(3)))})
scalar("f6_swap_channels", {"v": (lambda: c.swap_red_blue("rgba"), pack_sql(ch("rgba", 2), ch("rgba", 1), ch("rgba", 0), ch("rgba", 3))), "w": (lambda: c.swap_red_blue15(F.col("rgba").bitwiseAND(F.lit(0xFFFF))), "((rgba & 33760) | ((rgba & 31) << 10) | ((rgba >> 10) & 31))::INTEGER")})
scalar("f7_to_yiq", {f"c{n}": (lambda n=n: scaled(A()[n]), milli(A_SQL[n])) for n in "yiqa"})
scalar("f8_to_rgb", {"v": (lambda: c.to_rgb(A()), "CASE WHEN " + ch("rgba", 3) + " = 0 THEN 0 ELSE rgba END")})
scalar("f9_distance", {"d": (lambda: scaled(c.distance(A(), B())), milli(distance_sql(A_SQL, B_SQL)))})
scalar("f10_layered_distance", {"d": (lambda: scaled(c.layered_distance(F.array(A(), B()), F.array(B(), A()))), milli(f"(0.0::DOUBLE + {distance_sql(A_SQL, B_SQL)} + {distance_sql(B_SQL, A_SQL)})"))})
scalar("f11_gamut_mask", {"v": (lambda: c.mask("rgba"), pack_sql(*(f"(({snap15_sql('rgba')} >> {8 * k}) & 255)" for k in range(3)), ch("rgba", 3))), "w": (lambda: c.mask("rgba", False), "rgba")})
scalar("f12_color_equal", {"v": (lambda: c.same_color(F.col("rgba"), c.mask("rgba")), f"(rgba & 16777215) = {snap15_sql('rgba')}")})
scalar("f13_color_setters", {
    "o": (lambda: scaled(c.opaque(A())["y"]), milli(f"({A_SQL['y']} / CASE WHEN {A_SQL['a']} <> 0 THEN {A_SQL['a']} ELSE 1 END)")),
    "w": (lambda: scaled(c.white(A())["y"]), milli(f"(511.0::DOUBLE * {A_SQL['a']})")),
    "b": (lambda: scaled(c.black(A())["a"]), milli(A_SQL["a"])),
    "s": (lambda: scaled(c.scale(A(), 0.5)["q"]), milli(f"({A_SQL['q']} * 0.5::DOUBLE)")),
    "m": (lambda: scaled(c.subtract(A(), B())["i"]), milli(f"({A_SQL['i']} - {B_SQL['i']})")),
})
scalar("f14_diffuse_curve", {f"c{n}": (lambda n=n: scaled(c.diffuse_curve(A()[n], n)), milli(
    f"CASE WHEN {A_SQL[n]} < 0 THEN -1 ELSE 1 END * CASE WHEN abs({A_SQL[n]}) <= 8 THEN abs({A_SQL[n]}) ELSE 8.0::DOUBLE + pow(greatest(abs({A_SQL[n]}) - 8.0::DOUBLE, 0.0::DOUBLE), {D(c.DIFFUSE_CURVE[n][0])}) * {D(c.DIFFUSE_CURVE[n][1])} END")) for n in "yiq"})
scalar("f15_blend18", {f"v{k}": (lambda k=k: c.blend18("rgba", F.lit(OTHER), k), pack_sql(*(snap6_sql(f"(({ch('rgba', j)} * {8 - k} + {(OTHER >> 8 * j) & 255} * {k} + 4) // 8)") for j in range(3)), "255")) for k in (3, 4, 5)})
scalar("f16_luma", {"v": (lambda: scaled(c.luma("rgba")), milli(f"({D(0.5146329)} * {ch('rgba', 0)} + {D(1.2303905)} * {ch('rgba', 1)} + {D(0.2588982)} * {ch('rgba', 2)})"))})
scalar("f18_alpha_key", {"v": (lambda: c.apply_alpha_key("rgba", KEY), f"CASE WHEN (rgba & 16777215) = {KEY} THEN 0 ELSE rgba END")})
scalar("f19_zero_transparent", {"v": (lambda: c.zero_transparent("rgba"), f"CASE WHEN {ch('rgba', 3)} = 0 THEN 0 ELSE rgba END")})
scalar("f20_threshold_alpha", {"v": (lambda: c.threshold_alpha("rgba"), f"CASE WHEN {ch('rgba', 3)} < 128 THEN 0 ELSE {pack_sql(ch('rgba', 0), ch('rgba', 1), ch('rgba', 2), '255')} END")})
scalar("f29_alpha_levels", {
    "a3": (lambda: c.alpha_level(c.channel("rgba", 3), 7), f"(({ch('rgba', 3)} * 14 + 255) // 510)::INTEGER"),
    "a5": (lambda: c.alpha_level(c.channel("rgba", 3), 31), f"(({ch('rgba', 3)} * 62 + 255) // 510)::INTEGER"),
    "b3": (lambda: c.level_alpha(c.alpha_level(c.channel("rgba", 3), 7), 3), f"((((({ch('rgba', 3)} * 14 + 255) // 510) * 4 + (({ch('rgba', 3)} * 14 + 255) // 510) // 2) * 510 + 31) // 62)::INTEGER"),
})
scalar("f30_screen_entry", {
    "e": (lambda: t.screen_entry(F.col("y"), F.col("x") % 4, F.col("image_id").cast("int")), "((y & 1023) | ((x % 4) << 10) | (image_id::INTEGER << 12))::INTEGER"),
    "f": (lambda: t.screen_fields(t.screen_entry(F.col("y"), F.col("x") % 4, F.col("image_id").cast("int")))["flip"], "(x % 4)::INTEGER"),
})


@query("f17_parse_hex", f"WITH h AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part) SELECT p_partkey, {pack_sql(ch('v', 2), ch('v', 1), ch('v', 0), '0')} AS v FROM h")
def f17(spark, folder):
    text = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    return ad.table(spark, folder, "part").select("p_partkey", c.parse_hex(text).alias("v"))


@query("f21_translucent", f"WITH px AS ({LINEITEM}) SELECT image_id, bool_or({ch('rgba', 3)} BETWEEN 5 AND 250) AS translucent FROM px GROUP BY 1")
def f21(spark, folder):
    return histogram.image_facts(ad.lineitem_pixels(spark, folder)).select("image_id", "translucent")


@query("f22_has_transparent", f"WITH px AS ({EVENTS}) SELECT image_id, bool_or({ch('rgba', 3)} < 128) AS has_transparent FROM px GROUP BY 1")
def f22(spark, folder):
    return histogram.image_facts(ad.event_pixels(spark, folder)).select("image_id", "has_transparent")


_FACTS = "SELECT image_id, count(*) AS area, count(DISTINCT CASE WHEN {a} = 0 THEN 0 ELSE rgba END) AS colors, count(DISTINCT CASE WHEN {a} <> 0 THEN rgba & 16777215 END) AS opaque_colors, bool_or({a} BETWEEN 5 AND 250) AS translucent FROM px GROUP BY 1".format(a=ch("rgba", 3))


@query("f23_auto_format", f"WITH px AS ({EVENTS} UNION ALL SELECT image_id + 1000, layer, y, x, rgba FROM ({PARTS}) UNION ALL SELECT image_id + 2000, layer, y, x, rgba FROM ({LINEITEM})), f AS ({_FACTS}) SELECT image_id, CASE WHEN translucent THEN CASE WHEN opaque_colors < 16 THEN 'a5i3' ELSE 'a3i5' END WHEN colors <= 4 THEN 'palette4' WHEN area <= 524288 THEN 'tex4x4' WHEN colors <= 32 THEN 'palette16' ELSE 'palette256' END AS fmt FROM f")
def f23(spark, folder):
    move = lambda df, n: df.withColumn("image_id", F.col("image_id") + n)
    px = ad.event_pixels(spark, folder).unionByName(move(ad.part_pixels(spark, folder), 1000)).unionByName(move(ad.lineitem_pixels(spark, folder), 2000))
    return histogram.image_facts(px).select("image_id", t.choose_format("area", "opaque_colors", "colors", "translucent").alias("fmt"))


@query("f24_block_palette", "SELECT o_orderkey, ((CASE WHEN o_orderkey * 17 <= 16384 THEN floor(sqrt((o_orderkey * 17)::DOUBLE) * 8) ELSE floor((log2((o_orderkey * 17)::DOUBLE) - 10) * 256 + 1e-6::DOUBLE) END::BIGINT + 15) // 16 * 16)::INTEGER AS n FROM orders")
def f24(spark, folder):
    return ad.table(spark, folder, "orders").select("o_orderkey", t.block_palette_colors(F.col("o_orderkey") * 17).alias("n"))


@query("f25_sides", "WITH s AS (SELECT p_partkey, greatest(p_partkey, 1) AS n FROM part) SELECT p_partkey, floor(log2(n::DOUBLE))::INTEGER AS l, (bit_count(n) = 1 AND n BETWEEN 8 AND 1024) AS v, CASE WHEN n < 8 THEN 8 ELSE (1 << floor(log2((n * 2 - 1)::DOUBLE))::INTEGER) END::INTEGER AS r FROM s")
def f25(spark, folder):
    s = ad.table(spark, folder, "part").select("p_partkey", F.greatest("p_partkey", F.lit(1)).alias("n"))
    return s.select("p_partkey", t.log2_floor(F.col("n")).alias("l"), t.valid_side(F.col("n")).alias("v"), t.round_side(F.col("n")).cast("int").alias("r"))


_BITS = "[0, 8, 2, 4, 8, 2, 8, 16]"


@query("f26_sizes", f"WITH s AS (SELECT p_partkey, (p_partkey % 7 + 1)::INTEGER AS f, 8 << (p_partkey % 8)::INTEGER AS w, 8 << (p_size % 8)::INTEGER AS h FROM part) SELECT p_partkey, (w * h * ({_BITS})[f + 1] // 8)::BIGINT AS texel, CASE WHEN f = 5 THEN w * h * 2 // 8 // 2 ELSE 0 END::BIGINT AS idx, (w * h * CASE WHEN f = 5 THEN 3 ELSE ({_BITS})[f + 1] END // 8)::BIGINT AS vram, (['', 'a3i5', 'palette4', 'palette16', 'palette256', 'tex4x4', 'a5i3', 'direct'])[f + 1] AS name, w::INTEGER AS pw FROM s")
def f26(spark, folder):
    s = ad.table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 7 + 1).cast("int").alias("f"), F.expr("shiftleft(8, cast(p_partkey % 8 as int))").alias("w"), F.expr("shiftleft(8, cast(p_size % 8 as int))").alias("h"))
    param = t.image_param("w", "h", "f", F.lit(0))
    return s.select("p_partkey", t.texel_bytes("w", "h", "f").alias("texel"), t.index_bytes("w", "h", "f").alias("idx"), t.vram_bytes("w", "h", "f").alias("vram"), t.format_name("f").alias("name"), t.param_fields(param)["width"].alias("pw"))


_LINES = "SELECT l_orderkey, l_linenumber - 1 AS i, (l_partkey % 16)::INTEGER AS v FROM lineitem"


@query("f27_pack_indices", f"WITH v AS ({_LINES}) SELECT l_orderkey, (i // 2)::BIGINT AS byte_no, bit_or((v & 15) << (4 * (i % 2)))::INTEGER AS byte FROM v GROUP BY 1, 2")
def f27(spark, folder):
    v = ad.table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), (F.col("l_partkey") % 16).cast("int").alias("v"))
    return tiles.pack_indices(v, ("l_orderkey",), "i", "v", 4)


@query("f28_unpack_indices", f"WITH v AS ({_LINES}), p AS (SELECT l_orderkey, (i // 2)::BIGINT AS byte_no, bit_or((v & 15) << (4 * (i % 2)))::INTEGER AS byte FROM v GROUP BY 1, 2) SELECT l_orderkey, byte_no * 2 + k AS i, ((byte >> (4 * k)) & 15)::INTEGER AS value FROM p, (VALUES (0), (1)) s(k)")
def f28(spark, folder):
    return tiles.unpack_indices(f27(spark, folder), ("l_orderkey",), 4)


# -- aggregations ---------------------------------------------------------------------------


@query("a2_histogram", f"WITH px AS ({LINEITEM}) SELECT image_id, rgba, count(*)::DOUBLE AS weight FROM px GROUP BY 1, 2")
def a2(spark, folder):
    return histogram.histogram(ad.lineitem_pixels(spark, folder))


_Y = yiq_sql("rgba")["y"]
_NEAR = f"WITH px AS ({EVENTS}), v AS (SELECT *, {_Y} AS yy FROM px), n AS (SELECT v.*, coalesce(l.yy, v.yy) AS l, coalesce(r.yy, v.yy) AS r, coalesce(u.yy, v.yy) AS u, coalesce(d.yy, v.yy) AS d FROM v LEFT JOIN v l ON l.image_id = v.image_id AND l.y = v.y AND l.x = v.x - 1 LEFT JOIN v r ON r.image_id = v.image_id AND r.y = v.y AND r.x = v.x + 1 LEFT JOIN v u ON u.image_id = v.image_id AND u.x = v.x AND u.y = v.y - 1 LEFT JOIN v d ON d.image_id = v.image_id AND d.x = v.x AND d.y = v.y + 1), w AS (SELECT *, greatest(16.0::DOUBLE - abs(16.0::DOUBLE - abs(yy - 0.25::DOUBLE * (l + r + u + d))) / 8.0::DOUBLE, 1.0::DOUBLE) AS weight FROM n)"


@query("w1_pixel_weights", f"{_NEAR} SELECT image_id, y, x, {milli('weight')} AS w FROM w WHERE {ch('rgba', 3)} >= 128")
def w1(spark, folder):
    return histogram.pixel_weights(ad.event_pixels(spark, folder)).select("image_id", "y", "x", scaled(F.col("weight")).alias("w"))


@query("a4_weighted_histogram", f"{_NEAR} SELECT image_id, rgba, {milli('sum(weight)')} AS w FROM w WHERE {ch('rgba', 3)} >= 128 GROUP BY 1, 2")
def a4(spark, folder):
    return histogram.weighted_histogram(ad.event_pixels(spark, folder)).select("image_id", "rgba", scaled(F.col("weight")).alias("w"))


@query("a5_top_colors", f"WITH px AS ({LINEITEM}), h AS (SELECT image_id, rgba, count(*)::DOUBLE AS weight FROM px GROUP BY 1, 2), r AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, rgba) - 1)::INTEGER AS idx FROM h) SELECT image_id, rgba, weight, idx FROM r WHERE idx < 16")
def a5(spark, folder):
    return histogram.top_colors(a2(spark, folder), 16)


_PAL = "(VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(PALETTE)) + ") pal(idx, entry)"
_NN = f"h AS (SELECT image_id, rgba, count(*) AS n FROM px GROUP BY 1, 2), d AS (SELECT image_id, rgba, n, idx, {distance_sql(yiq_sql('rgba'), yiq_sql('entry'))} AS d FROM h, {_PAL}), nn AS (SELECT image_id, rgba, n, d, idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id, rgba ORDER BY d, idx) AS k FROM d) WHERE k = 1)"


@query("j1_nearest", f"WITH px AS ({LINEITEM}), {_NN} SELECT image_id, rgba, n, idx::INTEGER AS idx, {milli('d')} AS d FROM nn")
def j1(spark, folder):
    h = ad.lineitem_pixels(spark, folder).groupBy("image_id", "rgba").agg(F.count("*").alias("n"))
    return h.withColumn("s", nearest.nearest("rgba", PALETTE)).select("image_id", "rgba", "n", F.col("s.idx").alias("idx"), scaled(F.col("s.d")).alias("d"))


@query("j2_nearest_expr", ORACLES["j1_nearest"])
def j2(spark, folder):
    h = ad.lineitem_pixels(spark, folder).groupBy("image_id", "rgba").agg(F.count("*").alias("n"))
    return h.withColumn("s", nearest.nearest_expr("rgba", PALETTE)).select("image_id", "rgba", "n", F.col("s.idx").alias("idx"), scaled(F.col("s.d")).alias("d"))


@query("j3_nearest_reserve", f"WITH px AS ({LINEITEM}), h AS (SELECT image_id, rgba, count(*) AS n FROM px GROUP BY 1, 2), d AS (SELECT image_id, rgba, n, idx, {distance_sql(yiq_sql('rgba'), yiq_sql('entry'))} AS d FROM h, {_PAL} WHERE idx > 0), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, rgba ORDER BY d, idx) AS k FROM d) WHERE k = 1) SELECT image_id, rgba, n, CASE WHEN {ch('rgba', 3)} < 128 THEN 0 ELSE idx END::INTEGER AS idx FROM nn")
def j3(spark, folder):
    h = ad.lineitem_pixels(spark, folder).groupBy("image_id", "rgba").agg(F.count("*").alias("n"))
    return h.select("image_id", "rgba", "n", nearest.nearest("rgba", PALETTE, Reduction(alpha_mode="reserve"))["idx"].alias("idx"))


def _palette_table(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.broadcast(spark.createDataFrame([(k, v) for k, v in enumerate(PALETTE)], "idx int, entry int"))
    return ad.lineitem_pixels(spark, folder).select("image_id").distinct().join(ids)


@query("j4_nearest_join", ORACLES["j1_nearest"])
def j4(spark, folder):
    return nearest.nearest_join(ad.lineitem_pixels(spark, folder), _palette_table(spark, folder)).withColumn("d", scaled(F.col("d")))


@query("a6_palette_error", f"WITH px AS ({LINEITEM}), {_NN} SELECT image_id, floor(sum(n * d) / 1000000 + 0.5)::BIGINT AS error FROM nn GROUP BY 1")
def a6(spark, folder):
    e = nearest.palette_error(nearest.nearest_join(ad.lineitem_pixels(spark, folder), _palette_table(spark, folder)))
    return e.select("image_id", F.floor(F.col("error") / 1000000 + 0.5).alias("error"))


@query("a7_pixel_error", f"WITH px AS (SELECT * FROM ({LINEITEM}) WHERE {ch('rgba', 3)} >= 128), {_NN} SELECT image_id, floor(sum(n * d) / 1000000 + 0.5)::BIGINT AS error FROM nn GROUP BY 1")
def a7(spark, folder):
    px = ad.lineitem_pixels(spark, folder).where(c.channel("rgba", 3) >= 128)
    return nearest.palette_error(nearest.nearest_join(px, _palette_table(spark, folder))).select("image_id", F.floor(F.col("error") / 1000000 + 0.5).alias("error"))


_V = {n: f"({s} * {D(w)})" for (n, s), w in zip(yiq_sql("rgba").items(), (*RED.weights, RED.alpha_square**0.5), strict=True)}


@query("a8_covariance", f"WITH px AS ({LINEITEM}), v AS (SELECT image_id, {', '.join(f'{e} AS {n}v' for n, e in _V.items())} FROM px) SELECT image_id, count(*)::DOUBLE AS weight, " + ", ".join(f"floor(avg({n}v) + 0.5)::BIGINT AS mean_{n}" for n in "yiqa") + ", " + ", ".join(f"floor((avg({a}v * {b}v) - avg({a}v) * avg({b}v)) / 100 + 0.5)::BIGINT AS cov_{a}{b}" for k, a in enumerate("yiqa") for b in "yiqa"[k:]) + " FROM v GROUP BY 1")
def a8(spark, folder):
    cov = histogram.covariance(a2(spark, folder))
    return cov.select("image_id", "weight", *[F.floor(F.col(f"mean_{n}") + 0.5).alias(f"mean_{n}") for n in "yiqa"], *[F.floor(F.col(x) / 100 + 0.5).alias(x) for x in cov.columns if x.startswith("cov_")])


_CUT = {
    "sums": ", ".join(f"sum(w * {n}) OVER b AS s_{n}, sum(w * {n}) OVER g AS t_{n}" for n in "yiqa"),
    "left": " + ".join(f"s_{n} * s_{n}" for n in "yiqa"),
    "right": " + ".join(f"(t_{n} - s_{n}) * (t_{n} - s_{n})" for n in "yiqa"),
}


@query("a10_split", f"WITH px AS ({LINEITEM}), h AS (SELECT image_id, rgba, count(*)::DOUBLE AS w, " + ", ".join(f"({ch('rgba', k)})::DOUBLE AS {n}" for k, n in enumerate("yiqa")) + f" FROM px GROUP BY ALL), s AS (SELECT *, sum(w) OVER b AS wl, sum(w) OVER g AS wa, sum(w * (y*y + i*i + q*q + a*a)) OVER g AS sq, {_CUT['sums']} FROM h WINDOW g AS (PARTITION BY image_id), b AS (PARTITION BY image_id ORDER BY y + i + q, y, i, q, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), z AS (SELECT image_id, sq - ({_CUT['left']}) / wl - ({_CUT['right']}) / (wa - wl) AS wss FROM s WHERE wa > wl) SELECT image_id, floor(min(wss) / 1000 + 0.5)::BIGINT AS wss FROM z GROUP BY 1")
def a10(spark, folder):
    h = a2(spark, folder).select("image_id", "weight", *[c.channel("rgba", k).cast("double").alias(n) for k, n in enumerate("yiqa")]).withColumn("score", F.col("y") + F.col("i") + F.col("q"))
    s = histogram.split_table(h, ("image_id",))
    return s.groupBy("image_id").agg(F.floor(F.min("wss") / 1000 + 0.5).alias("wss"))


@query("a11_cluster_sums", f"WITH px AS ({LINEITEM}), {_NN} SELECT image_id, idx::INTEGER AS idx, count(*) AS colors, sum(n)::BIGINT AS weight, sum(n * {ch('rgba', 0)})::BIGINT AS r, sum(n * {ch('rgba', 1)})::BIGINT AS g, sum(n * {ch('rgba', 2)})::BIGINT AS b, floor(sum(n * d) / 1000000 + 0.5)::BIGINT AS error FROM nn GROUP BY 1, 2")
def a11(spark, folder):
    near = nearest.nearest_join(ad.lineitem_pixels(spark, folder), _palette_table(spark, folder))
    return near.groupBy("image_id", "idx").agg(F.count("*").alias("colors"), F.sum("n").alias("weight"), *[F.sum(F.col("n") * c.channel("rgba", k)).alias(n) for k, n in enumerate("rgb")], F.floor(F.sum(F.col("n") * F.col("d")) / 1000000 + 0.5).alias("error"))


@query("a13_background_moments", f"WITH px AS ({LINEITEM}) SELECT " + ", ".join(f"floor(avg({e}) * 10 + 0.5)::BIGINT AS mean_{n}, floor(avg({e} * {e}) + 0.5)::BIGINT AS square_{n}" for n, e in list(yiq_sql("rgba").items())[:3]) + " FROM px")
def a13(spark, folder):
    m = histogram.background_moments(ad.lineitem_pixels(spark, folder))
    return m.select(*[F.floor(F.col(f"mean_{n}") * 10 + 0.5).alias(f"mean_{n}") for n in "yiq"], *[F.floor(F.col(f"square_{n}") + 0.5).alias(f"square_{n}") for n in "yiq"])


@query("a14_distinct_colors", f"WITH px AS ({LINEITEM}) SELECT image_id, count(DISTINCT CASE WHEN {ch('rgba', 3)} < 128 THEN 0 ELSE (rgba & 16777215) + 16777216 END) AS colors FROM px GROUP BY 1")
def a14(spark, folder):
    return histogram.count_colors(ad.lineitem_pixels(spark, folder), binary_alpha=True)


@query("a18_symbol_counts", "WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark WHERE text IS NOT NULL), s AS (SELECT item_id, ('0x' || substr(h, 2 * k::BIGINT + 1, 2))::INTEGER AS symbol FROM b, range(0, 100000) r(k) WHERE k < length(h) // 2) SELECT item_id, symbol, count(*) AS count FROM s GROUP BY 1, 2")
def a18(spark, folder):
    blobs = ad.table(spark, folder, "benchmark").select("item_id", F.encode("text", "utf-8").alias("data"))
    return histogram.symbol_counts(blobs, keys=("item_id",))


@query("a19_lightness", f"WITH px AS ({LINEITEM}), h AS (SELECT DISTINCT image_id, rgba FROM px) SELECT image_id, {milli('(sum(' + _Y + ') / sum(' + yiq_sql('rgba')['a'] + '))')} AS lightness FROM h GROUP BY 1")
def a19(spark, folder):
    return histogram.average_lightness(a2(spark, folder)).select("image_id", scaled(F.col("lightness")).alias("lightness"))


# -- joins, windows, tiles ------------------------------------------------------------------

def _tiles_sql(side: int) -> str:
    """``tl``: the tiles of ``px`` row by row, absent pixels being 0."""
    n = side * side
    return (
        f"spots AS (SELECT image_id, (y // {side})::INTEGER AS tile_y, (x // {side})::INTEGER AS tile_x, (y % {side}) * {side} + x % {side} AS k, rgba FROM px), pl AS (SELECT * FROM (SELECT DISTINCT image_id, tile_y, tile_x FROM spots), range({n}) r(k)), "
        "tl AS (SELECT image_id, tile_y, tile_x, list(coalesce(rgba, 0) ORDER BY k) AS px FROM pl LEFT JOIN spots USING (image_id, tile_y, tile_x, k) GROUP BY 1, 2, 3)"
    )


_TILES = _tiles_sql(8)
_NUMBERED = f"WITH px AS ({PARTS}), {_TILES}, n AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY tile_y, tile_x) - 1)::INTEGER AS tile_no FROM tl)"


@query("j5_best_palette", f"WITH px AS ({EVENTS}), h AS (SELECT image_id, ((y // 8) * 8 + x // 8)::INTEGER AS tile_no, rgba, count(*) AS n FROM px GROUP BY ALL), p AS (SELECT (idx % 4)::INTEGER AS palette, entry FROM {_PAL}), d AS (SELECT image_id, tile_no, palette, rgba, n, min({distance_sql(yiq_sql('rgba'), yiq_sql('entry'))}) AS d FROM h, p GROUP BY ALL), e AS (SELECT image_id, tile_no, palette, sum(n * d) AS e FROM d GROUP BY ALL) SELECT image_id, tile_no, palette FROM (SELECT *, row_number() OVER (PARTITION BY image_id, tile_no ORDER BY e, palette) AS k FROM e) WHERE k = 1")
def j5(spark, folder):
    px = ad.event_pixels(spark, folder)
    h = px.groupBy("image_id", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int").alias("tile_no"), "rgba").agg(F.count("*").alias("n"))
    pal = F.broadcast(spark.createDataFrame([(k % 4, k // 4, v) for k, v in enumerate(PALETTE)], "palette int, idx int, entry int"))
    return nearest.best_palettes(h, px.select("image_id").distinct().join(pal)).select("image_id", "tile_no", "palette")


_TILE_D = "list_sum([{d} for k in range(64)])"


@query("u2_tile_dedup", f"{_NUMBERED}, f AS (SELECT image_id, tile_no, k AS flip, list_transform(range(64), lambda j: px[xor(j, ([0, 7, 56, 63])[k + 1]) + 1]) AS px FROM n, (VALUES (0), (1), (2), (3)) s(k)), cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, tile_no ORDER BY px, flip) AS r FROM f) WHERE r = 1), m AS (SELECT image_id, px, min(tile_no) AS master, count(*) AS represents FROM cf GROUP BY 1, 2) SELECT cf.image_id, cf.tile_no, m.master, xor(cf.flip, mf.flip)::INTEGER AS flip, m.represents FROM cf JOIN m ON m.image_id = cf.image_id AND m.px = cf.px JOIN cf mf ON mf.image_id = m.image_id AND mf.tile_no = m.master")
def u2(spark, folder):
    out = tiles.dedup_tiles(tiles.split_tiles(ad.part_pixels(spark, folder)))
    return out.select("image_id", "tile_no", "master", "flip", "represents")


@query("j6_tile_pairs", f"{_NUMBERED}, f AS (SELECT a.image_id, a.tile_no AS a, b.tile_no AS b, k AS flip, unnest(range(64)) AS j, a.px AS pa, b.px AS pb FROM n a JOIN n b ON a.image_id = b.image_id AND a.tile_no < b.tile_no, (VALUES (0), (1), (2), (3)) s(k)), v AS (SELECT image_id, a, b, flip, j, pa[j + 1] AS ra, pb[xor(j, ([0, 7, 56, 63])[flip + 1]) + 1] AS rb FROM f), e AS (SELECT image_id, a, b, flip, sum({distance_sql(yiq_sql('ra'), yiq_sql('rb'))}) AS d FROM v GROUP BY ALL) SELECT image_id, a, b, floor(min(d) / 1000 + 0.5)::BIGINT AS d FROM e GROUP BY ALL")
def j6(spark, folder):
    px = tiles.dedup_tiles(tiles.split_tiles(ad.part_pixels(spark, folder)), flips=False)
    return tiles.tile_pairs(px).select("image_id", "a", "b", F.floor(F.col("d") / 1000 + 0.5).alias("d"))


@query("a15_mean_tiles", f"{_NUMBERED}, g AS (SELECT image_id, (tile_no // 4)::INTEGER AS master, j AS k, px[j + 1] AS rgba FROM n, range(64) r(j)) SELECT image_id, master, k::INTEGER AS k, {milli('avg(' + _Y + ')')} AS y FROM g GROUP BY ALL")
def a15(spark, folder):
    d = tiles.dedup_tiles(tiles.split_tiles(ad.part_pixels(spark, folder)), flips=False)
    m = d.withColumn("master", F.floor(F.col("tile_no") / 4).cast("int")).withColumn("flip", F.lit(0))
    return tiles.mean_tiles(m).select("image_id", "master", "k", scaled(F.col("y")).alias("y"))


@query("j11_palette_lookup", f"WITH px AS ({LINEITEM}) SELECT image_id, y, x, (x % 12)::INTEGER AS idx, coalesce(entry, 0)::INTEGER AS entry FROM px LEFT JOIN {_PAL} ON px.x % 12 = idx")
def j11(spark, folder):
    px = ad.lineitem_pixels(spark, folder).select("image_id", "y", "x", (F.col("x") % 12).alias("idx"))
    return nearest.lookup(px, _palette_table(spark, folder)).select("image_id", "y", "x", "idx", "entry")


@query("j12_masked_duplicates", f"WITH px AS ({LINEITEM}) SELECT {snap15_sql('rgba')} AS masked, count(DISTINCT rgba) AS colors, count(*) AS weight FROM px GROUP BY 1")
def j12(spark, folder):
    px = ad.lineitem_pixels(spark, folder)
    return px.groupBy(c.snap15("rgba").alias("masked")).agg(F.count_distinct("rgba").alias("colors"), F.count("*").alias("weight"))


@query("j13_duplicate_blocks", f"WITH px AS ({PARTS}), {_tiles_sql(4)}, b AS (SELECT image_id, tile_y * 4 + tile_x AS block_no, px FROM tl) SELECT image_id, block_no, min(block_no) OVER (PARTITION BY image_id, px) AS first_no FROM b")
def j13(spark, folder):
    b = tiles.split_tiles(ad.part_pixels(spark, folder), 4).withColumn("block_no", F.col("tile_y") * 4 + F.col("tile_x"))
    firsts = b.groupBy("image_id", "px").agg(F.min("block_no").alias("first_no"))
    return b.join(firsts, ["image_id", "px"]).select("image_id", "block_no", "first_no")


@query("w5_runs", "WITH b AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark WHERE text IS NOT NULL), v AS (SELECT item_id, i, substr(text, i, 1) AS value FROM b), m AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY item_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM v), g AS (SELECT *, sum(f) OVER (PARTITION BY item_id ORDER BY i) - 1 AS run FROM m) SELECT item_id, run::BIGINT AS run, first(value) AS value, min(i)::INTEGER AS start, count(*) AS length FROM g GROUP BY 1, 2")
def w5(spark, folder):
    b = ad.table(spark, folder, "benchmark").where("text is not null").select("item_id", F.posexplode(F.split("text", "")).alias("p", "value")).where("value <> ''").withColumn("i", F.col("p") + 1)
    return histogram.run_lengths(b, ("item_id",), "i", "value")


@query("k13_panel_order", "WITH s AS (SELECT p_partkey // 40 AS ty, p_partkey % 40 AS tx, (p_partkey % 1024)::INTEGER AS entry FROM part), h AS (SELECT max(ty) + 1 AS h FROM s), g AS (SELECT ty, unnest(range(40)) AS tx FROM (SELECT unnest(range(h::BIGINT)) AS ty FROM h)), o AS (SELECT ty, tx, row_number() OVER (ORDER BY ty // 32, tx // 32, ty, tx) - 1 AS pos FROM g) SELECT ty::INTEGER AS ty, tx::INTEGER AS tx, entry, pos::BIGINT AS pos FROM s JOIN o USING (ty, tx)")
def k13(spark, folder):
    s = ad.table(spark, folder, "part").select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("p_partkey") / 40).cast("int").alias("ty"), F.pmod("p_partkey", F.lit(40)).cast("int").alias("tx"), (F.col("p_partkey") % 1024).cast("int").alias("entry"))
    rows = s.agg((F.max("ty") + 1).alias("h"))
    return tiles.panel_order(s.join(F.broadcast(rows)), F.lit(40), "h").select("ty", "tx", "entry", F.col("pos").cast("long").alias("pos"))


@query("t3_lightness_order", f"WITH px AS ({LINEITEM}), h AS (SELECT DISTINCT image_id, rgba, {ch('rgba', 3)} AS a, {_Y} AS yy FROM px) SELECT image_id, rgba, (row_number() OVER (PARTITION BY image_id ORDER BY a, yy, rgba) - 1)::INTEGER AS place FROM h")
def t3(spark, folder):
    h = ad.lineitem_pixels(spark, folder).select("image_id", "rgba").distinct().withColumn("a", c.channel("rgba", 3)).withColumn("yy", c.yiq("rgba")["y"])
    coarse = F.col("a") * 1024 + F.floor("yy")  # y stays below 512
    return histogram.placed(h, ("image_id",), coarse, ("a", "yy", "rgba"), "place").select("image_id", "rgba", F.col("place").cast("int").alias("place"))


@query("u1_layers", f"SELECT image_id, 0 AS layer, count(*) AS n FROM ({LINEITEM}) GROUP BY 1 UNION ALL SELECT image_id, 1, count(*) FROM ({EVENTS}) GROUP BY 1")
def u1(spark, folder):
    both = ad.lineitem_pixels(spark, folder).unionByName(ad.event_pixels(spark, folder).withColumn("layer", F.lit(1)))
    return both.groupBy("image_id", "layer").agg(F.count("*").alias("n"))


@query("u3_overlay", "SELECT coalesce(p_partkey, s_suppkey) AS k, coalesce(p_size, s_nationkey) AS v FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 3")
def u3(spark, folder):
    p = ad.table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    s = ad.table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("k3"), F.col("s_nationkey").alias("v"), "s_suppkey")
    out = tiles.overlay(p, s.select(F.col("k3").alias("k"), "v"), ["k"], "v")
    far = s.select(F.col("k3").alias("k"), "s_suppkey")
    known = p.select("k", F.lit(1).alias("own"))
    return out.join(far, "k", "left").join(known, "k", "left").select(F.when(F.col("own").isNull(), F.col("s_suppkey")).otherwise(F.col("k")).alias("k"), "v")


# -- images ---------------------------------------------------------------------------------


@query("g1_flip", f"WITH px AS ({EVENTS}) SELECT image_id, (63 - y)::INTEGER AS y, (63 - x)::INTEGER AS x, rgba FROM px")
def g1(spark, folder):
    return images.flip(ad.event_pixels(spark, folder), F.lit(64), F.lit(64), x=True, y=True).select("image_id", "y", "x", "rgba")


@query("g3_crop", f"WITH px AS ({EVENTS}), g AS (SELECT image_id, a.k AS y, b.k AS x FROM (SELECT DISTINCT image_id FROM px), range(40) a(k), range(40) b(k)) SELECT g.image_id, g.y::INTEGER AS y, g.x::INTEGER AS x, coalesce(px.rgba, 0)::INTEGER AS rgba FROM g LEFT JOIN px ON px.image_id = g.image_id AND px.y = g.y + 40 AND px.x = g.x - 4")
def g3(spark, folder):
    return images.crop(ad.event_pixels(spark, folder), -4, 40, 40, 40).select("image_id", "y", "x", "rgba")


_OVER = "CASE WHEN af = 255 THEN fg WHEN af = 0 THEN bg ELSE " + pack_sql(*(f"(({ch('fg', k)} * wf + {ch('bg', k)} * wb) // w)" for k in range(3)), "(w // 255)") + " END"


@query("g4_composite", f"WITH f AS (SELECT image_id, y, x, {pack_sql(ch('rgba', 0), ch('rgba', 1), ch('rgba', 2), '((x * 4) & 255)')} AS fg FROM ({EVENTS})), b AS (SELECT image_id, y, x, {pack_sql(ch('rgba', 2), ch('rgba', 0), ch('rgba', 1), '((y * 4) & 255)')} AS bg FROM ({EVENTS})), j AS (SELECT image_id, y, x, fg, bg, {ch('fg', 3)} AS af, {ch('fg', 3)} * 255 AS wf, (255 - {ch('fg', 3)}) * {ch('bg', 3)} AS wb FROM f JOIN b USING (image_id, y, x)), k AS (SELECT *, greatest(wf + wb, 1) AS w FROM j) SELECT image_id, y, x, {_OVER} AS rgba FROM k")
def g4(spark, folder):
    px = ad.event_pixels(spark, folder)
    front = px.withColumn("rgba", c.pack(*(c.channel("rgba", k) for k in range(3)), (F.col("x") * 4).bitwiseAND(F.lit(255))))
    back = px.withColumn("rgba", c.pack(c.channel("rgba", 2), c.channel("rgba", 0), c.channel("rgba", 1), (F.col("y") * 4).bitwiseAND(F.lit(255))))
    return images.composite(back, front)


@query("g5_alpha_mask", f"WITH px AS ({EVENTS}) SELECT image_id, y, (x // 8)::INTEGER AS byte_no, bit_or(CASE WHEN {ch('rgba', 3)} < 128 THEN 1 << (7 - x % 8) ELSE 0 END)::INTEGER AS byte FROM px GROUP BY ALL")
def g5(spark, folder):
    return images.alpha_mask(ad.event_pixels(spark, folder))


@query("g6_color_mask", f"WITH px AS ({EVENTS}) SELECT image_id, y, x, {pack_sql(ch('rgba', 2), ch('rgba', 1), ch('rgba', 0), '0')} AS bgr0 FROM px")
def g6(spark, folder):
    return images.color_mask(ad.event_pixels(spark, folder)).select("image_id", "y", "x", "bgr0")


@query("g7_scale", f"WITH px AS ({EVENTS}), o AS (SELECT px.*, a.k AS ty, b.k AS tx, (least((y + 1) * 24, (a.k + 1) * 64) - greatest(y * 24, a.k * 64)) * (least((x + 1) * 24, (b.k + 1) * 64) - greatest(x * 24, b.k * 64)) AS area FROM px, range(24) a(k), range(24) b(k) WHERE least((y + 1) * 24, (a.k + 1) * 64) > greatest(y * 24, a.k * 64) AND least((x + 1) * 24, (b.k + 1) * 64) > greatest(x * 24, b.k * 64)), s AS (SELECT image_id, ty::INTEGER AS y, tx::INTEGER AS x, sum({ch('rgba', 0)} * {ch('rgba', 3)} * area)::BIGINT AS r, sum({ch('rgba', 1)} * {ch('rgba', 3)} * area)::BIGINT AS g, sum({ch('rgba', 2)} * {ch('rgba', 3)} * area)::BIGINT AS b, sum({ch('rgba', 3)} * area)::BIGINT AS a FROM o GROUP BY 1, 2, 3) SELECT image_id, y, x, CASE WHEN a > 0 THEN {pack_sql(*(f'((2 * {n} + a) // (2 * a))' for n in 'rgb'), '((2 * a + 4096) // 8192)')} ELSE 0 END AS rgba FROM s")
def g7(spark, folder):
    px = ad.event_pixels(spark, folder)
    sizes = px.select("image_id").distinct().withColumn("width", F.lit(64)).withColumn("height", F.lit(64))
    return images.scale(px, sizes, 24, 24)


@query("g8_scale_into", "WITH s AS (" + ORACLES["g7_scale"].replace("* 24", "* 32").replace("range(24)", "range(32)") + f"), f AS (SELECT image_id, a.k AS y, b.k AS x FROM (SELECT DISTINCT image_id FROM ({EVENTS})), range(32) a(k), range(48) b(k)) SELECT f.image_id, f.y::INTEGER AS y, f.x::INTEGER AS x, coalesce(s.rgba, 0)::INTEGER AS rgba FROM f LEFT JOIN s ON s.image_id = f.image_id AND s.y = f.y AND s.x = f.x - 8")
def g8(spark, folder):
    return images.scale_into(ad.event_pixels(spark, folder), 64, 64, 48, 32, "fit").select("image_id", "y", "x", "rgba")


@query("c12_pad", f"WITH px AS ({PARTS}), n AS (SELECT image_id, max(y) AS h FROM px GROUP BY 1), g AS (SELECT image_id, a.k AS y, b.k AS x, least(a.k, h) AS sy, least(b.k, 15) AS sx FROM n, range(70) a(k), range(24) b(k)) SELECT g.image_id, g.y::INTEGER AS y, g.x::INTEGER AS x, coalesce(px.rgba, 0)::INTEGER AS rgba FROM g LEFT JOIN px ON px.image_id = g.image_id AND px.y = g.sy AND px.x = g.sx")
def c12(spark, folder):
    made = _part_images(spark, folder)
    return images.pad_clamped(files.pixels_of(made), made.select("image_id", "width", "height"), F.lit(24), F.lit(70)).select("image_id", "y", "x", "rgba")


# -- kernels: palettes, dithering, textures, codecs, files ----------------------------------


@query("c2_palettes")
def c2(spark, folder):
    return palette.palettes_of(histogram.weighted_histogram(ad.event_pixels(spark, folder)), 16)


@query("c5_layered_palettes")
def c5(spark, folder):
    px = ad.event_pixels(spark, folder)
    both = px.unionByName(px.withColumn("layer", F.lit(1)).withColumn("rgba", c.swap_red_blue("rgba")))
    return palette.palettes_of(histogram.layered_histogram(both), 16)


@query("c7_tile_palettes")
def c7(spark, folder):
    px = ad.part_pixels(spark, folder)
    h = px.groupBy("image_id", (F.floor(F.col("y") / 8) * 2 + F.floor(F.col("x") / 8)).cast("int").alias("tile_no"), "rgba").agg(F.count("*").cast("double").alias("weight"))
    return palette.tile_palettes(h, 2, 4)


@query("c8_dither")
def c8(spark, folder):
    px = ad.event_pixels(spark, folder)
    pal = palette.palettes_of(histogram.weighted_histogram(px), 16).select("image_id", "idx", "entry")
    return dither.index_images(files.images_of(px), pal, Reduction(), 0.5)


@query("c9_reduce_tiles")
def c9(spark, folder):
    d = tiles.dedup_tiles(tiles.split_tiles(ad.event_pixels(spark, folder))).where("master = tile_no")
    return tiles.reduce_tiles(d.select("image_id", "tile_no", "px"), 16).select("image_id", "tile_no", "master", "flip", "char_no")


_CHARS = "[0, 1, j % 8, j // 8][chr + 1]"
_SCREEN_PAL = "(VALUES " + ", ".join(f"({p}, {k}, {v})" for p, entries in enumerate((PALETTE, PALETTE[::-1])) for k, v in enumerate(entries)) + ") pal(pal, idx, entry)"


@query("j8_assemble_screen", f"{_NUMBERED}, v AS (SELECT image_id, tile_no, chr, flip, k, px[k + 1] AS rgba, xor(k, ([0, 7, 56, 63])[flip + 1]) AS j FROM n, range(64) r(k), range(4) c(chr), range(4) f(flip)), i AS (SELECT *, ({_CHARS})::INTEGER AS idx FROM v), e AS (SELECT image_id, tile_no, chr, pal, flip, {milli('sum(' + distance_sql(yiq_sql('rgba'), yiq_sql('entry')) + ')')} AS error FROM i JOIN {_SCREEN_PAL} USING (idx) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, tile_no ORDER BY error, chr, pal, flip) AS place FROM e) SELECT image_id, tile_no, chr::INTEGER AS \"char\", pal::INTEGER AS palette, flip::INTEGER AS flip, error, (chr | (flip << 10) | (pal << 12))::INTEGER AS entry FROM o WHERE place = 1")
def j8(spark, folder):
    d = tiles.dedup_tiles(tiles.split_tiles(ad.part_pixels(spark, folder)), flips=False)
    chars = [[0] * 64, [1] * 64, [k % 8 for k in range(64)], [k // 8 for k in range(64)]]
    found = tiles.assemble_screen(d.select("image_id", "tile_no", "px"), chars, [PALETTE, PALETTE[::-1]], transparent0=False)
    return found.withColumn("error", scaled(F.col("error")))


def _part_images(spark: SparkSession, folder: str) -> DataFrame:
    return files.images_of(ad.part_pixels(spark, folder))


def _frame_sql(pixels: str, shown: str, absent: str, width: int) -> str:
    """Every place of every image's rectangle: ``shown`` of its pixel, or ``absent``."""
    return (
        f"WITH px AS ({pixels}), n AS (SELECT image_id, max(y) AS h FROM px GROUP BY 1), g AS (SELECT image_id, unnest(range(h::BIGINT + 1)) AS y FROM n), f AS (SELECT image_id, y, unnest(range({width})) AS x FROM g) "
        f"SELECT f.image_id, f.y::INTEGER AS y, f.x::INTEGER AS x, CASE WHEN px.rgba IS NULL THEN {absent} ELSE {shown} END::INTEGER AS rgba FROM f LEFT JOIN px ON px.image_id = f.image_id AND px.y = f.y AND px.x = f.x"
    )


_OWN = "px.rgba"
_SNAPPED = pack_sql(*(f"(({snap15_sql(_OWN)} >> {8 * k}) & 255)" for k in range(3)), "255")
_SHOWN = _frame_sql(PARTS, _SNAPPED, "0", 16)


def _round_trip(fmt: str):
    def run(spark, folder):
        made = texture.encode_textures(_part_images(spark, folder), fmt, transparent0=fmt.startswith("palette"))
        # what is transparent shows no colour, though formats with alpha store some
        return files.pixels_of(texture.decode_textures(made)).select("image_id", "y", "x", c.zero_transparent("rgba").alias("rgba"))

    return run


for _fmt in ("palette4", "palette16", "palette256", "a3i5", "a5i3", "direct"):
    query(f"c14_texture_{_fmt}", _SHOWN)(_round_trip(_fmt))
query("c16_texture_tex4x4")(_round_trip("tex4x4"))  # blocks may be drawn from blends, so no exact twin


@query("c16_blocks")
def c16(spark, folder):
    return texture.encode_textures(files.images_of(ad.event_pixels(spark, folder)), "tex4x4", n_colors=64).select("image_id", "param", F.octet_length("texel").alias("texel_bytes"), F.octet_length("pidx").alias("pidx_bytes"), F.octet_length("palette").alias("palette_bytes"))


@query("c13_direct_diffused")
def c13_diffused(spark, folder):
    made = texture.encode_textures(_part_images(spark, folder), "direct", diffuse=0.5)
    return files.pixels_of(texture.decode_textures(made)).select("image_id", "y", "x", "rgba")


@query("c10_background_diffused")
def c10_diffused(spark, folder):
    named = files.images_of(ad.event_pixels(spark, folder)).withColumn("name", F.concat(F.lit("bg"), F.col("image_id")))
    made = convert.convert(named, EncodeOptions(bg_type="text4", diffuse=0.5))
    return made.select("image_id", "name", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("h"))


@query("c21_layers_diffused")
def c21_diffused(spark, folder):
    px = ad.part_pixels(spark, folder)
    layers = [files.images_of(px if k == "a" else px.withColumn("rgba", c.swap_red_blue("rgba"))).withColumn("name", F.lit(k)) for k in "ab"]
    made = convert.convert_layers(layers[0].unionByName(layers[1]), EncodeOptions(mode="texture", texture_format="palette16", diffuse=0.5), "image_id")
    return made.select("image_id", "name", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("h"))


_TEXTS = "SELECT item_id, octet_length(encode(coalesce(text, ''))) AS n, sha256(coalesce(text, '')) AS h FROM benchmark"


def _codec(names: tuple[str, ...]):
    def run(spark, folder):
        b = ad.table(spark, folder, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
        back = codecs.decompress(codecs.compress("data", names))
        return b.select("item_id", back.alias("d")).select("item_id", F.octet_length("d").cast("long").alias("n"), F.sha2("d", 256).alias("h"))

    return run


for _name, _set in (("z1_lz", ("lz",)), ("z2_lzx", ("lzx",)), ("z4_huffman8", ("huffman8",)), ("z4_huffman4", ("huffman4",)), ("z6_rle", ("rle",)), ("z7_stored", ("none",)), ("z8_smallest", codecs.CODECS)):
    query(_name, _TEXTS)(_codec(_set))


@query("k1_raw_files", "WITH t AS (SELECT s_suppkey FROM supplier) SELECT (s_suppkey || '_pal.bin') AS name, 32::BIGINT AS bytes FROM t")
def k1(spark, folder):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.lpad(F.hex((k * 256 + F.col("s_suppkey") % 256).cast("long")), 4, "0")), "")
    rows = ad.table(spark, folder, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("_pal.bin")).alias("name"), F.unhex(words).alias("data"))
    from .workspace import new_folder

    return sinks.write_files(rows, new_folder(spark, "files"))


def _read_back(spark: SparkSession, named: DataFrame, label: str) -> DataFrame:
    """Files (name as <image_id>.<kind>, data) written to a new folder and read again as pixels."""
    from .workspace import new_folder

    folder = new_folder(spark, label)
    sinks.write_files(named, folder).write.format("noop").mode("overwrite").save()
    found = files.read_images(spark, folder).withColumn("image_id", F.regexp_extract("name", r"(\d+)\.[a-z]+$", 1).cast("long"))
    return files.pixels_of(found).select("image_id", "y", "x", "rgba")


_SOLID = pack_sql(*(ch(_OWN, k) for k in range(3)), "255")


@query("s11_pnm_files", _frame_sql(EVENTS, _SOLID, "-16777216", 64))
def s11(spark, folder):
    im = files.images_of(ad.event_pixels(spark, folder))
    head = F.encode(F.concat(F.lit("P6\n"), "width", F.lit(" "), "height", F.lit("\n255\n")), "utf-8")
    body = F.unhex(F.regexp_replace(F.hex("px"), "(.{6}).{2}", "$1"))
    return _read_back(spark, im.select(F.concat("image_id", F.lit(".ppm")).alias("name"), F.concat(head, body).alias("data")), "pnm")


@query("s6_tga_files", _frame_sql(EVENTS, _OWN, "0", 64))
def s6(spark, folder):
    im = files.images_of(ad.event_pixels(spark, folder))
    word = lambda c: F.concat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col(c) / 256)), 2, "0"))
    # no name, true colour, 32 bits, eight of them alpha, top row first
    head = F.concat(F.lit("000002" + "00" * 9), word("width"), word("height"), F.lit("2028"))
    body = F.regexp_replace(F.hex("px"), "(..)(..)(..)(..)", "$3$2$1$4")
    return _read_back(spark, im.select(F.concat("image_id", F.lit(".tga")).alias("name"), F.unhex(F.concat(head, body)).alias("data")), "tga")


def _files_of(made: DataFrame, ending: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """One file (name, data) an image, by a function of its pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data = [make(np.frombuffer(r.px, "<u4").reshape(r.height, r.width)) for r in rows.itertuples()]
            yield pd.DataFrame({"name": rows["image_id"].astype(str) + "." + ending, "data": data})

    return made.mapInPandas(run, "name string, data binary")


def _bytes_of(px: np.ndarray, channels: int) -> np.ndarray:
    return px[..., None].view(np.uint8)[..., :channels]


def _png(px: np.ndarray) -> bytes:
    """Eight bits, four channels, every row by the filter of the left neighbour."""
    rows = _bytes_of(px, 4)
    left = np.concatenate([np.zeros_like(rows[:, :1]), rows[:, :-1]], axis=1)
    body = np.concatenate([np.ones((len(px), 1), np.uint8), (rows - left).reshape(len(px), -1)], axis=1)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body.tobytes())) + chunk(b"IEND", b"")


def _psd(px: np.ndarray) -> bytes:
    """Three raw planes."""
    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, *px.shape, 8, 3)
    return head + bytes(14) + _bytes_of(px, 3).transpose(2, 0, 1).tobytes()


def _pic(px: np.ndarray) -> bytes:
    """One packet of three raw channels."""
    head = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", px.shape[1], px.shape[0], 1.0, 3, 0)
    return head + bytes([0, 8, 0, 0xE0]) + _bytes_of(px, 3).tobytes()


def _gif(px: np.ndarray) -> bytes:
    """Codes of eight bits throughout: the table is cleared before it would need more."""
    table, index = np.unique(px & 0xFFFFFF, return_inverse=True)
    index = index.astype(np.uint8).ravel()
    codes = b"".join(b"\x80" + index[k : k + 100].tobytes() for k in range(0, len(index), 100)) + b"\x81"
    blocks = b"".join(bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255))
    colors = _bytes_of(table.astype("<u4"), 3).tobytes().ljust(384, b"\0")
    size = px.shape[::-1]
    return b"GIF89a" + struct.pack("<HHBBB", *size, 0xE6, 0, 0) + colors + b"," + struct.pack("<HHHHB", 0, 0, *size, 0) + b"\x07" + blocks + b"\0;"


def _indexed(px: np.ndarray) -> bytes:
    table, index = np.unique(px & 0xFFFFFF, return_inverse=True)
    return sinks.indexed_bmp(table, index.reshape(px.shape))


def _texture_tga(px: np.ndarray) -> bytes:
    """The picture without the rows that pad the texture."""
    param, texel, pidx, pal = texture.encode_image(px.view(np.int32), t.FORMATS["direct"], Reduction())
    return sinks.nns_tga(texture.decode_image(param, texel, pidx, pal)[: px.shape[0], : px.shape[1]], t.FORMATS["direct"], texel, pidx, pal, "pal", False)


for _name, _make, _events, _sql in (
    ("s4_png_files", _png, True, _frame_sql(EVENTS, _OWN, "0", 64)),
    ("s7_psd_files", _psd, True, _frame_sql(EVENTS, _SOLID, "-16777216", 64)),
    ("s8_pic_files", _pic, True, _frame_sql(EVENTS, _SOLID, "-16777216", 64)),
    ("s9_gif_files", _gif, False, _frame_sql(PARTS, _OWN, "-16777216", 16)),
    ("k3_bmp_files", _indexed, False, _frame_sql(PARTS, _OWN, "-16777216", 16)),
    ("k4_texture_tga_files", _texture_tga, False, _SHOWN),
):

    def _run(spark, folder, name=_name, make=_make, events=_events):
        made = files.images_of((ad.event_pixels if events else ad.part_pixels)(spark, folder))
        ending = "tga" if make is _texture_tga else "bmp" if make is _indexed else name[3:6]
        return _read_back(spark, _files_of(made, ending, make), name)

    query(_name, _sql)(_run)


def _supplier_words(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen little-endian words a supplier: s_suppkey, data."""
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.concat(byte(F.col("s_suppkey") % 256), byte(k))), "")
    return ad.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.unhex(words).alias("data"))


_WORDS = "array_to_string(list_transform(range(16), lambda k: printf('%02X%02X', s_suppkey % 256, k)), '')"


@query("s12_raw_words", "SELECT s_suppkey::BIGINT AS s_suppkey, k::INTEGER AS i, (k * 256 + s_suppkey % 256)::BIGINT AS value FROM supplier, range(16) r(k)")
def s12(spark, folder):
    from .workspace import new_folder

    target = new_folder(spark, "words")
    sinks.write_files(_supplier_words(spark, folder).select(F.concat("s_suppkey", F.lit("_pal.bin")).alias("name"), "data"), target).write.format("noop").mode("overwrite").save()
    return files.read_words(spark, target).select(F.regexp_extract("path", r"(\d+)_pal\.bin$", 1).cast("long").alias("s_suppkey"), "i", "value")


@query("k2_c_source", "SELECT s_suppkey::BIGINT AS s_suppkey, 'const uint16_t p' || s_suppkey || '_pal[] = {' || chr(10) || '    ' || array_to_string(list_transform(range(16), lambda k: printf('0x%02X%02X,', k, s_suppkey % 256)), ' ') || chr(10) || '};' || chr(10) AS body, 'extern const uint16_t p' || s_suppkey || '_pal[16];' || chr(10) AS extern FROM supplier")
def k2(spark, folder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [sinks.c_array(f"p{r.s_suppkey}_pal", r.data, 2) for r in rows.itertuples()]
            yield pd.DataFrame({"s_suppkey": rows["s_suppkey"], "body": [b for b, _ in made], "extern": [e for _, e in made]})

    return _supplier_words(spark, folder).mapInPandas(run, "s_suppkey bigint, body string, extern string")


def _container(name: str, make: Callable[[bytes], bytes], parts: tuple[bytes | None, ...]) -> None:
    """Files made of a supplier's words, against SQL that spells out all other bytes; None stands for the words."""

    def run(spark, folder):
        def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield pd.DataFrame({"s_suppkey": rows["s_suppkey"], "file": rows["data"].map(lambda d: make(bytes(d)).hex().upper())})

        return _supplier_words(spark, folder).mapInPandas(rows_of, "s_suppkey bigint, file string")

    spelt = " || ".join(_WORDS if p is None else f"'{p.hex().upper()}'" for p in parts)
    query(name, f"SELECT s_suppkey::BIGINT AS s_suppkey, {spelt} AS file FROM supplier")(run)


# The bytes of each format around 32 bytes of data.
_LITTLE = b"\xff\xfe\x00\x01"
_container("k5_palette_file", lambda d: sinks.nclr(d, 4, "text4"), (b"RLCN" + _LITTLE + struct.pack("<IHH", 72, 16, 1) + b"TTLP" + struct.pack("<5I", 56, 3, 0, 32, 16), None))
_container("k6_character_file", lambda d: sinks.ncgr(d, 1, 1, 4), (b"RGCN" + _LITTLE + struct.pack("<IHH", 80, 16, 1) + b"RAHC" + struct.pack("<IHH5I", 64, 1, 1, 3, 16, 0, 32, 24), None))
_container("k7_screen_file", lambda d: sinks.nscr(d, "text4", 4, 4), (b"RCSN" + _LITTLE + struct.pack("<IHH", 68, 16, 1) + b"NRCS" + struct.pack("<I4HI", 52, 32, 32, 0, 0, 32), None))
_STORED = struct.pack("<II", 36, 32 << 8)
_container(
    "k10_texture_container",
    lambda d: sinks.grf_texture(3, 8, 8, d, b"", d, False, ("none",)),
    (b"RIFF" + struct.pack("<I", 124) + b"GRF HDRX" + struct.pack("<I5H4BHII", 24, 2, 4, 0, 0, 16, 1, 1, 0, 0, 0, 8, 8) + b"PAL " + _STORED, None, b"GFX " + _STORED, None),
)


# -- the same kernels on images whose colours all fit, where the result is known exactly -------


def _few(spark: SparkSession, folder: str) -> DataFrame:
    return ad.part_pixels(spark, folder).withColumn("rgba", c.snap15("rgba").bitwiseOR(F.lit(-16777216)))


_FEW_ENTRIES = [int(v) for v in snap15_array(np.array([0xFFC82800, 0xFFC82864, 0xFFC828C8], np.uint32))]
_FEW = f"(SELECT image_id, y, x, {_SNAPPED} AS rgba FROM ({PARTS}) px)"
_FEW_FRAME = _frame_sql(f"SELECT * FROM {_FEW}", _OWN, "0", 16)
_BLUE_RED = pack_sql(ch("rgba", 2), ch("rgba", 1), ch("rgba", 0), ch("rgba", 3))


@query("c2_few_colors", f"SELECT image_id, 0 AS layer, (row_number() OVER (PARTITION BY image_id ORDER BY {ch('rgba', 0)}) - 1)::INTEGER AS idx, rgba AS entry FROM (SELECT DISTINCT image_id, rgba FROM {_FEW})")
def c2_few(spark, folder):
    return palette.palettes_of(histogram.weighted_histogram(ad.part_pixels(spark, folder)), 16)


@query("c5_few_colors", f"WITH d AS (SELECT image_id, rgba, (row_number() OVER (PARTITION BY image_id ORDER BY {ch('rgba', 0)}) - 1)::INTEGER AS idx FROM (SELECT DISTINCT image_id, rgba FROM {_FEW})) SELECT image_id, 0 AS layer, idx, rgba AS entry FROM d UNION ALL SELECT image_id, 1, idx, {_BLUE_RED} FROM d")
def c5_few(spark, folder):
    px = ad.part_pixels(spark, folder)
    both = px.unionByName(px.withColumn("layer", F.lit(1)).withColumn("rgba", c.swap_red_blue("rgba")))
    return palette.palettes_of(histogram.layered_histogram(both), 16)


@query("c7_tile_errors", f"SELECT image_id, (y // 8 * 2 + x // 8)::INTEGER AS tile_no, {milli('sum(' + distance_sql(yiq_sql('rgba'), yiq_sql('shown')) + ')')} AS error FROM (SELECT *, {_SNAPPED} AS shown FROM ({PARTS}) px) GROUP BY ALL")
def c7_errors(spark, folder):
    """Each tile against the palette it was given: what is left is what no palette can hold."""
    px = ad.part_pixels(spark, folder).withColumn("tile_no", (F.floor(F.col("y") / 8) * 2 + F.floor(F.col("x") / 8)).cast("int"))
    h = px.groupBy("image_id", "tile_no", "rgba").agg(F.count("*").cast("double").alias("weight"))
    made = palette.tile_palettes(h, 2, 4).persist()
    own = made.where("kind = 'tile'").select("image_id", "tile_no", "palette")
    entries = made.where("kind = 'entry'").select("image_id", "palette", "entry")
    d = h.join(own, ["image_id", "tile_no"]).join(entries, ["image_id", "palette"])
    least = d.groupBy("image_id", "tile_no", "rgba", "weight").agg(F.min(c.distance(c.yiq("rgba"), c.yiq("entry"))).alias("d"))
    return least.groupBy("image_id", "tile_no").agg(scaled(F.sum(F.col("weight") * F.col("d"))).alias("error"))


@query("c8_few_colors", _FEW_FRAME)
def c8_few(spark, folder):
    """Diffusion has no error to spread where every colour is in the palette."""
    px = _few(spark, folder)
    fixed = px.select(F.col("image_id").alias("image_id")).distinct().select("image_id", F.posexplode(F.array(F.lit(0), *map(F.lit, _FEW_ENTRIES))).alias("idx", "entry"))
    made = dither.index_images(files.images_of(px), fixed, Reduction(alpha_mode="reserve"), 0.5)
    words = F.regexp_extract_all(F.hex("indices"), F.lit("[0-9A-F]{4}"), F.lit(0))
    flat = made.select("image_id", "width", F.posexplode(words).alias("i", "h")).withColumn("idx", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    place = flat.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.pmod("i", "width").cast("int").alias("x"), "idx")
    return place.join(fixed, ["image_id", "idx"]).select("image_id", "y", "x", F.col("entry").alias("rgba"))


@query("c9_few_tiles", "SELECT image_id, tile_no, tile_no AS master, 0 AS flip, row_number() OVER (PARTITION BY image_id ORDER BY tile_no) - 1 AS char_no FROM (" + ORACLES["u2_tile_dedup"] + ") WHERE tile_no = master")
def c9_few(spark, folder):
    d = tiles.dedup_tiles(tiles.split_tiles(ad.part_pixels(spark, folder))).where("master = tile_no")
    return tiles.reduce_tiles(d.select("image_id", "tile_no", "px"), 16).select("image_id", "tile_no", "master", "flip", F.col("char_no").cast("long").alias("char_no"))


@query("c13_direct_fitting", _FEW_FRAME)
def c13_fitting(spark, folder):
    made = texture.encode_textures(files.images_of(_few(spark, folder)), "direct", diffuse=0.5)
    return files.pixels_of(texture.decode_textures(made)).select("image_id", "y", "x", "rgba")


@query("c16_blocks_fitting", _FEW_FRAME)
def c16_fitting(spark, folder):
    """Blocks of one colour that a palette can hold, through models, shared palette and refinement."""
    made = texture.encode_textures(files.images_of(_few(spark, folder)), "tex4x4")
    return files.pixels_of(texture.decode_textures(made)).select("image_id", "y", "x", c.zero_transparent("rgba").alias("rgba"))


def _redrawn(px: np.ndarray, options: EncodeOptions) -> np.ndarray:
    """A background, grown to whole tiles, drawn again from its palettes, characters and screen."""
    made = convert.background(np.pad(px, [(0, -n % 8) for n in px.shape]), options)
    entry = made["screen"]
    cells = made["chars"].reshape(-1, 8, 8)[entry & 0x3FF]
    cells = np.where((entry >> 10 & 1)[..., None, None] == 1, cells[..., ::-1], cells)
    cells = np.where((entry >> 11 & 1)[..., None, None] == 1, cells[..., ::-1, :], cells)
    word = made["palette"].astype(np.int64)[(entry >> 12)[..., None, None], cells]
    rgba = sum((((word >> 5 * k) & 31) * 510 + 31) // 62 << 8 * k for k in range(3)) | 255 << 24
    shown = np.where(cells > 0, rgba, 0).transpose(0, 2, 1, 3)
    return shown.reshape(shown.shape[0] * 8, -1).astype(np.uint32)[: px.shape[0], : px.shape[1]]


@query("c10_background_pixels", _SHOWN)
def c10_pixels(spark, folder):
    """Backgrounds with two palettes, all characters and flips, drawn again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shown = [_redrawn(np.frombuffer(r.px, "<i4").reshape(r.height, r.width), EncodeOptions(bg_type="text4", palettes=2, max_colors=4, max_chars=1024)) for r in rows.itertuples()]
            yield rows.assign(px=[v.astype("<u4").tobytes() for v in shown])

    return files.pixels_of(_part_images(spark, folder).mapInPandas(run, "image_id bigint, width int, height int, px binary")).select("image_id", "y", "x", "rgba")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
