"""Structured Streaming over run outputs.

A complete run is one row and every parse and inference step is narrow, so classification needs
no state and gives the batch result, ranking and first-of-key order included. State appears
only where lines have to be gathered into runs, rows are deduplicated across triggers, or
counts are kept per window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from logsieve.functions.text import each
from logsieve.operators.infer import confidence_name, match_rules
from logsieve.operators.parse import failures_of, parse_runs, with_causes
from logsieve.operators.rules import KEY_LENGTH


def stream_classify(runs: DataFrame, dispatch: bool = True) -> DataFrame:
    """runs with ``ts`` -> (run_id, ts, format, hyp_idx, category, confidence, …); stateless."""
    rows = with_causes(parse_runs(runs, dispatch, keep=("ts",)))
    return each(rows, "top", "at", "c", "run_id", "ts", "format").select(
        "run_id",
        "ts",
        "format",
        (F.col("at") + 1).alias("hyp_idx"),
        F.col("c.category").alias("category"),
        confidence_name(-F.col("c.order")).alias("confidence"),
        F.col("c.failure_idx").alias("failure_idx"),
        F.col("c.rule_rank").alias("rule_rank"),
    )


def stream_matches(runs: DataFrame, dispatch: bool = True) -> DataFrame:
    """runs with ``ts`` -> one row per failure and matching rule; stateless."""
    parsed = parse_runs(runs, dispatch, keep=("ts",))
    return match_rules(failures_of(parsed, keep_raw=False, keep=("ts",)), keep=("ts",))


def assemble_runs(lines: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """(run_id, project_root, ts, line_no, line) -> runs, once a run has been silent for ``gap``.

    A run is complete when the watermark passes its session; lines that come later are dropped
    and counted by ``LateRows``. State holds the lines of open runs only.
    """
    closed = (
        lines.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("session"), "run_id", "project_root")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    return closed.select(
        "run_id",
        "project_root",
        F.lit("(assembled output)").alias("command"),
        F.lit(1).alias("exit_code"),
        F.array_join(F.transform("lines", lambda l: l["line"]), "\n").alias("stdout"),
        F.lit("").alias("stderr"),
        F.lit(0.0).alias("duration_ms"),
        F.window_time("session").alias("ts"),
        "n_lines",
    )


def dedupe_failures_stream(matches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per run, category and message prefix across triggers.

    Keeps a row of each key, not the first in failure order: order across triggers is only
    known to the batch operator.
    """
    return (
        matches.withColumn("prefix", F.substring("error_message", 1, KEY_LENGTH))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["run_id", "category", "prefix"])
    )


def category_rate(
    hypotheses: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Hypotheses per category in tumbling or sliding windows; counts are partial per task."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        hypotheses.withWatermark("ts", delay)
        .groupBy(window.alias("window"), "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "category",
            "n",
        )
    )


def write_batches(
    stream: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and write it under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so each is written once.
    ``trigger`` holds the arguments of the trigger; without it all that is there now is taken.
    """

    def write(rows: DataFrame, batch: int) -> None:
        operator(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that came behind the watermark, over the whole life of each query.

    Add it with ``spark.streams.addListener`` before the query starts; a query itself only
    remembers its latest triggers.
    """

    def __init__(self):
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for state in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += state.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
