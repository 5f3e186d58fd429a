"""The tables of a folder, and intermediate ones in the folder that a cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..sources.tables import discard, shared_dir, stash
from ..sources.tables import read_table as table

__all__ = ["batch_bytes", "discard", "shared_dir", "stash", "table"]
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """While jobs run in it, Python gets batches of about ``most`` bytes."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)
