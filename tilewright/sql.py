"""SQL text of the colour expressions, for the equivalent queries of an independent engine."""

from __future__ import annotations

from .config import Reduction
from .functions.color import TO_YIQ


def D(x: float) -> str:
    """A double literal."""
    return f"{x!r}::DOUBLE"


def ch(v: str, k: int) -> str:
    return f"(({v} >> {8 * k}) & 255)"


def pack_sql(r: str, g: str, b: str, a: str) -> str:
    """Four channels as a signed 32-bit integer."""
    return f"((({r}) + ({g}) * 256 + ({b}) * 65536 + ({a})::BIGINT * 16777216 + 2147483648) % 4294967296 - 2147483648)::INTEGER"


def to5_sql(x: str) -> str:
    return f"((({x}) * 62 + 255) // 510)"


def to8_sql(x: str) -> str:
    return f"((({x}) * 510 + 31) // 62)"


def snap6_sql(x: str) -> str:
    return f"((((({x}) * 126 + 255) // 510) * 510 + 63) // 126)"


def from15_sql(v: str) -> str:
    return pack_sql(*(to8_sql(f"(({v} >> {5 * k}) & 31)") for k in range(3)), "0")


def snap15_sql(v: str) -> str:
    return pack_sql(*(to8_sql(to5_sql(ch(v, k))) for k in range(3)), "0")


def yiq_sql(v: str) -> dict[str, str]:
    a = f"({ch(v, 3)} / {D(255.0)})"
    out = {n: f"({a} * ({D(m[0])} * {ch(v, 0)}::DOUBLE + {D(m[1])} * {ch(v, 1)}::DOUBLE + {D(m[2])} * {ch(v, 2)}::DOUBLE))" for n, m in zip("yiq", TO_YIQ, strict=True)}
    return out | {"a": a}


def distance_sql(p: dict[str, str], q: dict[str, str], reduction: Reduction = Reduction()) -> str:
    d = {n: f"({p[n]} - {q[n]})" for n in "yiqa"}
    plain = " + ".join(f"{D(w)} * {d[n]} * {d[n]}" for n, w in zip("yiq", reduction.squares, strict=True))
    mixed = " + ".join(f"{D(w)} * {d[n]}" for n, w in zip("yiq", reduction.interaction, strict=True))
    return f"({plain} + CASE WHEN {d['a']} <> 0 THEN {D(reduction.alpha_square)} * {d['a']} * {d['a']} - {d['a']} * ({mixed}) ELSE 0.0::DOUBLE END)"


def milli(x: str) -> str:
    return f"floor(({x}) * 1000 + {D(0.5)})::BIGINT"


LINEITEM = "SELECT l_orderkey % 4 AS image_id, 0 AS layer, (l_orderkey // 4)::INTEGER AS y, l_linenumber::INTEGER AS x, " + pack_sql("l_orderkey % 256", "l_partkey % 256", "l_suppkey % 256", "CASE l_linenumber % 8 WHEN 7 THEN 0 WHEN 6 THEN 100 ELSE 255 END") + " AS rgba FROM lineitem"
EVENTS = "SELECT event_id // 4096 AS image_id, 0 AS layer, (event_id % 4096 // 64)::INTEGER AS y, (event_id % 64)::INTEGER AS x, " + pack_sql("(event_id % 64 * 4 + user_id % 8) % 256", "(event_id % 4096 // 64 * 4) % 256", "(user_id // 16 * 16) % 256", "CASE WHEN event_id % 97 = 0 THEN 0 ELSE 255 END") + " AS rgba FROM events"
PARTS = "SELECT p_partkey // 1024 AS image_id, 0 AS layer, (p_partkey % 1024 // 16)::INTEGER AS y, (p_partkey % 16)::INTEGER AS x, " + pack_sql("(p_partkey % 16 // 4 + p_partkey % 1024 // 16 // 4 * 2) % 3 * 100", "40", "200", "255") + " AS rgba FROM part"
