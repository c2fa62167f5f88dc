"""Shared-folder helpers: every intermediate table lives where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and all runs on this machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tilewright/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> int:
    """How many tables this application has written so far."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what this application's operators have written to the shared folder from the ``since``-th table on, but not what ``keep`` reads.

    To be called once all results that read those tables are stored elsewhere.
    """
    tables = _made.get(spark.sparkContext.applicationId, [])
    read = [f.rsplit("/", 1)[0] for f in keep.inputFiles()] if keep is not None else []
    spared = [p for p in tables[since:] if any(f.endswith(p.rsplit("/", 1)[-1]) for f in read)]
    gone = [p for p in tables[since:] if p not in spared]
    tables[since:] = spared
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives later joins a plain
    scan under their exchange, which adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
