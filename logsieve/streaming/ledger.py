"""A keyed table that micro-batches replace rows in, each batch exactly once.

A batch writes the whole new set of rows of every key that it touches, under its own version. The
table is the set of each key's latest version, so a batch that runs again after a failure reads only
versions before its own, and overwrites what it wrote. Every ``compact`` versions one holds all keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

VERSION, GONE = "_version", "_gone"


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose write was committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath().getName() for status in files.listStatus(root) if status.isDirectory()]
    return [name for name in names if files.exists(hadoop.Path(f"{path}/{name}/_SUCCESS"))]


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null keys are keys too."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


class Ledger:
    """Rows of ``schema`` by ``keys`` in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], compact: int = 32):
        self.spark, self.path, self.keys, self.compact = spark, path.rstrip("/"), keys, compact
        # A tombstone has its keys alone.
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.stored = T.StructType([*self.schema, T.StructField(VERSION, T.LongType()), T.StructField(GONE, T.BooleanType())])

    def _folders(self, before: int | None) -> tuple[list[str], int]:
        """Folders from the latest full version on, and how many follow it."""
        found = sorted((int(name.split("-")[1]), name) for name in finished_folders(self.spark, self.path))
        found = [(v, name) for v, name in found if before is None or v < before]
        full = max((i for i, (_, name) in enumerate(found) if name.startswith("full")), default=0)
        return [f"{self.path}/{name}" for _, name in found[full:]], len(found) - full

    def rows(self, before: int | None = None) -> DataFrame:
        """The table as of the versions below ``before``."""
        folders, _ = self._folders(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(self.stored).parquet(*folders)
        latest = F.max(VERSION).over(Window.partitionBy(*self.keys))
        return stored.withColumn("_latest", latest).where(f"{VERSION} = _latest AND NOT {GONE}").select(*self.schema.names)

    def of_keys(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The table's rows whose keys are in ``keys``."""
        wanted = keys.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys]).distinct()
        return self.rows(before).join(wanted, same_keys(self.keys, "_of_"), "left_semi")

    def put(self, version: int, rows: DataFrame, touched: DataFrame) -> None:
        """Makes ``rows`` the rows of the keys in ``touched``; a touched key without rows goes."""
        touched = touched.select(*self.keys).distinct()
        have = rows.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys]).distinct()
        gone = touched.join(have, same_keys(self.keys, "_of_"), "left_anti")
        for field in self.schema:
            if field.name not in self.keys:
                gone = gone.withColumn(field.name, F.lit(None).cast(field.dataType))
        _, since = self._folders(version)
        kind = "full" if since >= self.compact else "delta"
        rows = rows.select(*self.schema.names)
        if kind == "full":
            mine = touched.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys])
            rows = rows.unionByName(self.rows(version).join(mine, same_keys(self.keys, "_of_"), "left_anti"))
            stored = rows.withColumn(GONE, F.lit(False))
        else:
            stored = rows.withColumn(GONE, F.lit(False)).unionByName(gone.withColumn(GONE, F.lit(True)))
        stored = stored.withColumn(VERSION, F.lit(version).cast("long")).select(*self.stored.names)
        stored.write.mode("overwrite").parquet(f"{self.path}/{kind}-{version}")


def merge_stream(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keeps ``ledger`` equal to ``operator`` over all rows that the stream has brought.

    ``operator`` must give the same for its own result with more rows as for all rows at once, as a
    first or a minimum by key does. Only the keys of a micro-batch are read and written again.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            merged = operator(ledger.of_keys(rows, batch).unionByName(rows.select(*ledger.schema.names)))
            ledger.put(batch, merged, rows)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(merge).start()
    )
