"""Nearest entries and their distances, to the last bit as in SQL."""

import numpy as np
import pytest

from tilewright.operators import nearest
from tilewright.queries import _PAL, PALETTE
from tilewright.sql import distance_sql, yiq_sql

#: Colours whose distances, in thousandths, lie where the last bit decides how they are rounded.
ODD = [-2692427, -6478517, -11127362, 1691684696, -11227290, -15956913]


@pytest.fixture(scope="module")
def colors():
    drawn = np.random.default_rng(3).integers(-(1 << 31), 1 << 31, 3000).tolist()
    return sorted({*ODD, *PALETTE, *drawn})


@pytest.fixture(scope="module")
def want(colors):
    import duckdb

    values = ", ".join(f"({v})" for v in colors)
    found = duckdb.connect().execute(f"SELECT rgba, idx, {distance_sql(yiq_sql('rgba'), yiq_sql('entry'))} AS d FROM (VALUES {values}) h(rgba), {_PAL} QUALIFY row_number() OVER (PARTITION BY rgba ORDER BY d, idx) = 1").fetchall()
    return sorted(found)


def pixels(spark, colors):
    return spark.createDataFrame([(0, v) for v in colors], "image_id long, rgba int")


def test_nearest(spark, colors, want):
    got = pixels(spark, colors).withColumn("s", nearest.nearest("rgba", PALETTE)).select("rgba", "s.idx", "s.d").collect()
    assert sorted(map(tuple, got)) == want


def test_nearest_join(spark, colors, want):
    palettes = spark.createDataFrame([(0, k, v) for k, v in enumerate(PALETTE)], "image_id long, idx int, entry int")
    got = nearest.nearest_join(pixels(spark, colors), palettes).select("rgba", "idx", "d").collect()
    assert sorted(map(tuple, got)) == want


def test_nearest_expr(spark, colors, want):
    got = pixels(spark, colors).withColumn("s", nearest.nearest_expr("rgba", PALETTE)).select("rgba", "s.idx", "s.d").collect()
    assert sorted(map(tuple, got)) == want
