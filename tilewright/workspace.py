"""Folders for files that queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset (local tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix=f"tilewright-{label}-")
