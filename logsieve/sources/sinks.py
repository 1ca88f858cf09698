"""Sinks and staging tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, a folder beside the warehouse."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete their shuffle files when they end, not when the driver's memory is next cleared."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(rows: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``rows`` as a table and read it back.

    Cuts the lineage and lets several consumers read the parse without repeating it. The table
    survives lost executors, and each consumer reads only its columns. The shuffles that made it are
    deleted at once. The caller owns the table: it stays until it is deleted.
    """
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = rows.write if codec is None else rows.write.option("compression", codec)
    with shuffles_released(spark):
        writer.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


ACCEPTED, QUARANTINED = "accepted", "quarantined"
#: Packets that a task must hold of each project, on average, to write them itself.
TASK_PACKETS = 64
#: Distinct values of a column, in bytes, that a row group of packets keeps apart from their uses.
DICTIONARY_BYTES = 16 << 20


def _held_by_tasks(runs: DataFrame) -> bool:
    """Whether tasks that hold the runs in no order of projects each have many of every project."""
    sizes = runs.groupBy("project_root").count().agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("projects")).first()
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sizes["n"] or 0) >= TASK_PACKETS * tasks * sizes["projects"]


def write_packets(
    packets: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", runs: DataFrame | None = None
) -> dict[str, int]:
    """Packets as JSON or parquet under ``status=…/project_root=…``; returns the rows of each status.

    ``packets`` has the ``reasons`` of ``validate_packets``: a packet with any goes to the quarantined
    side with them, its run is not lost and no other run fails for it. One pass writes both sides and
    counts them. Rows are gathered by project, so small projects are one file; adaptive
    execution cuts a hot project into many files of the advisory size, not one slow task. A null
    project is the partition of null.

    ``runs`` holds the ``project_root`` of each packet's run and is cheap to read. It is counted first:
    where every task has many packets of every project, gathering would move all packets once more and
    spare few files, so each task writes its own, a file for each side and project.
    """
    bad = F.size("reasons") > 0
    rows = packets.withColumn("status", F.when(bad, QUARANTINED).otherwise(ACCEPTED))
    counts = Observation()
    rows = rows.observe(
        counts, F.count_if(~bad).alias(ACCEPTED), F.count_if(bad).alias(QUARANTINED)
    )
    if runs is None or not _held_by_tasks(runs):
        rows = rows.hint("rebalance", "status", "project_root")
    writer = rows.write.mode(mode).partitionBy("status", "project_root").format(fmt)
    with shuffles_released(packets.sparkSession):
        if fmt == "parquet":
            # Page contents and diffs may repeat between packets: a codec that looks back further than a
            # page's line, and dictionaries that hold many long values; those that gain nothing are dropped.
            writer = writer.option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        writer.save(path)
    return dict(counts.get)
