"""How much of a table goes to Python at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, mb: int = 4) -> Iterator[None]:
    """Arrow batches of ``mb`` MB at most for what runs inside; Spark's 64 MB of texts are held several times over by both sides of each task."""
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, f"{mb}m")
    try:
        yield
    finally:
        spark.conf.set(NAME, before)
