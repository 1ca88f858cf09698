"""How much text goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Batches of ``rows`` rows and ``size`` bytes at most: rows of this package hold whole texts.

    Lowers the session's settings, never raises them.
    """
    if not 0 < int(spark.conf.get(ROWS)) <= rows:
        spark.conf.set(ROWS, str(rows))
    try:
        held = int(spark.conf.get(BYTES).rstrip("bB"))
    except ValueError:
        held = -1
    if not 0 < held <= size:
        spark.conf.set(BYTES, str(size))
