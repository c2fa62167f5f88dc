from pathlib import Path

import pytest

from tilewright.llm import runtime


def test_cut_and_release(spark):
    df = runtime.cut(spark.range(10), "test")
    assert df.count() == 10 and "Parquet" in df._jdf.queryExecution().toString()
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and str(folder).startswith(runtime.shared_dir(spark).removeprefix("file://"))
    assert runtime.release(spark) >= 1 and not folder.exists()


def test_named_folder_is_used():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return "file:///somewhere/shared/" if key == "spark.checkpoint.dir" else default

    assert runtime.shared_dir(Session) == "file:///somewhere/shared"


def test_a_cluster_needs_a_named_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)


def test_release_spares_what_is_read(spark):
    before = runtime.made(spark)
    first, second = (runtime.cut(spark.range(n), "test") for n in (5, 6))
    assert runtime.release(spark, before, keep=second) == 1
    assert second.count() == 6 and runtime.made(spark) == before + 1
    assert runtime.release(spark, before) == 1
