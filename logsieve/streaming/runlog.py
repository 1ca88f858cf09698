"""Lines of a stream gathered into runs, with one small row of state for each run.

A micro-batch appends its lines to a table and adds their number and latest time to the row of their
run. A run whose last line is ``gap`` behind the clock is closed: its lines are read back and parsed at
line grain, so no run is ever held as one value. The clock is the latest time seen, less ``delay``. A
line for a closed run is also kept in a side table; it opens its run again, and when that closes the
run, and no other, is parsed anew. Late and timely input therefore end with the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logsieve.operators import longlogs
from logsieve.operators.scan import numbered
from logsieve.streaming.ledger import Ledger, finished_folders

LINES = "run_id bigint, project_root string, ts timestamp, line_no bigint, line string"
RUNS = (
    "run_id bigint, project_root string, n_lines bigint, late bigint, last_ts timestamp, first_batch bigint, closed boolean"
)
FAILURES = (
    "run_id bigint, project_root string, failure_idx bigint, test_name string, test_file string, error_message string, "
    "error_type string, raw_syntax boolean, raw_unhandled boolean, raw_block string"
)
FRAMES = (
    "run_id bigint, project_root string, failure_idx bigint, frame_idx bigint, function string, file string, line int, col int, "
    "is_project_file boolean"
)


class RunLog:
    """The tables of one stream of lines under ``path``.

    ``gap`` and ``delay`` are in seconds. Lines with a null run_id or line_no belong to no place in a
    run and are dropped. A line that comes twice (same run and number) counts once when the run is
    parsed, the first that came. Line numbers may have holes, as where a line is still to come.
    """

    def __init__(self, spark: SparkSession, path: str, gap: float = 30, delay: float = 60, size: int = longlogs.CHUNK):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size
        self.gap, self.delay = gap, delay
        self.runs, self.failures, self.frames = [
            Ledger(spark, f"{self.path}/{name}", StructType.fromDDL(schema), ["run_id"])
            for name, schema in (("runs", RUNS), ("failures", FAILURES), ("frames", FRAMES))
        ]

    def start(self, lines: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Follows a stream of lines (run_id, project_root, ts, line_no, line)."""
        return (
            lines.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(self.take).start()
        )

    def take(self, lines: DataFrame, batch: int) -> None:
        """One micro-batch; again with the same number it does the same."""
        folder = f"{self.path}/lines/batch-{batch}"
        lines.select("run_id", "project_root", "ts", "line_no", "line").where("run_id IS NOT NULL AND line_no IS NOT NULL").write.mode("overwrite").parquet(folder)
        lines = self.spark.read.schema(LINES).parquet(folder)
        came = lines.groupBy(F.col("run_id").alias("of")).agg(F.count(F.lit(1)).alias("came"), F.max("ts").alias("ts"), F.min("project_root").alias("root"))
        # Even versions are batches, the odd one after them closes what is open at the end.
        known = self.runs.rows(2 * batch)
        merged = known.join(came, F.col("run_id") == F.col("of"), "full_outer").select(
            F.coalesce("run_id", "of").alias("run_id"), F.coalesce("project_root", "root").alias("project_root"),
            (F.coalesce("n_lines", F.lit(0)) + F.coalesce("came", F.lit(0))).alias("n_lines"),
            (F.coalesce("late", F.lit(0)) + F.when(F.col("closed"), F.coalesce("came", F.lit(0))).otherwise(0)).alias("late"),
            F.greatest("last_ts", "ts").alias("last_ts"), F.coalesce("first_batch", F.lit(batch)).alias("first_batch"),
            (F.coalesce("closed", F.lit(False)) & F.col("came").isNull()).alias("closed"), F.col("came").isNotNull().alias("touched"),
        )
        late = lines.join(known.where("closed").select(F.col("run_id").alias("of")), F.col("run_id") == F.col("of"), "left_semi")
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch-{batch}")
        clock = merged.agg(F.max("last_ts")).first()[0]
        self._close(merged, 2 * batch, clock and clock - dt.timedelta(seconds=self.delay + self.gap))

    def finish(self) -> None:
        """Closes every run that is still open, as when no more lines will come."""
        versions = [int(name.split("-")[1]) for name in finished_folders(self.spark, f"{self.path}/runs")]
        if versions:
            version = max(versions) // 2 * 2 + 1
            self._close(self.runs.rows(version).withColumn("touched", F.lit(False)), version, None, every=True)

    def _close(self, runs: DataFrame, version: int, until: dt.datetime | None, every: bool = False) -> None:
        silent = F.lit(every) if until is None else F.coalesce(F.col("last_ts") < F.lit(until), F.lit(False))
        changed = runs.withColumn("closing", ~F.col("closed") & silent).where("touched OR closing").persist()
        try:
            closing = changed.where("closing").select("run_id", "first_batch")
            first = closing.agg(F.min("first_batch")).first()[0]
            if first is not None:
                self._parse(closing, version, first)
            # The runs' rows come last: until they are written the batch has closed nothing.
            rows = changed.withColumn("closed", F.col("closed") | F.col("closing"))
            self.runs.put(version, rows, rows)
        finally:
            changed.unpersist()

    def _parse(self, closing: DataFrame, version: int, first: int) -> None:
        lines = self.lines(first, version // 2).join(closing.select(F.col("run_id").alias("of")), F.col("run_id") == F.col("of"), "left_semi")
        once = lines.groupBy("run_id", "project_root", "line_no").agg(F.min_by("line", F.struct("batch", "ts")).alias("line"))
        placed = once.withColumn("part", F.floor(F.col("line_no") / self.size)).withColumnRenamed("line_no", "number")
        placed = numbered(placed, ["run_id"], ["part"], ["number"], "line_no")
        failures, frames = longlogs.parse_lines(placed, self.size)
        self.failures.put(version, failures, closing)
        self.frames.put(version, frames, closing)

    def lines(self, first: int = 0, last: int | None = None) -> DataFrame:
        """Lines that batches ``first`` to ``last`` brought, with the number of their batch."""
        return self._batches("lines", first, last)

    def late_lines(self) -> DataFrame:
        """Lines that came when their run was closed already."""
        return self._batches("late", 0, None)

    def _batches(self, kind: str, first: int, last: int | None) -> DataFrame:
        numbers = sorted(int(name.split("-")[1]) for name in finished_folders(self.spark, f"{self.path}/{kind}"))
        folders = [f"{self.path}/{kind}/batch-{n}" for n in numbers if n >= first and (last is None or n <= last)]
        if not folders:
            return self.spark.createDataFrame([], LINES).withColumn("batch", F.lit(None).cast("long"))
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)/", 1).cast("long")
        return self.spark.read.schema(LINES).parquet(*folders).select("*", batch.alias("batch"))
