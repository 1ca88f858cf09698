"""Reading run outputs and normalising their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.text import lines_of
from logsieve.operators.scan import before_chunks
from logsieve.sources.sinks import stage

RUNS_SCHEMA = (
    "run_id bigint, project_root string, command string, exit_code int, stdout string, "
    "stderr string, duration_ms double, ts timestamp"
)
# Fixed value: terminal colour and cursor sequences.
ANSI = "\\x1b\\[[0-9;]*[a-zA-Z]"


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet", project_root: str = "/") -> DataFrame:
    """Run outputs from parquet, JSON lines, or a folder of log files (one file, one run).

    Log files carry no id: it is derived from the path, so it does not depend on listing order.
    """
    if fmt in ("parquet", "orc", "json"):
        return spark.read.schema(RUNS_SCHEMA).format(fmt).load(path)
    if fmt != "text":
        raise ValueError(f"unknown run source format: {fmt}")
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("path", F.input_file_name())
        .select(
            F.xxhash64("path").alias("run_id"),
            F.lit(project_root).alias("project_root"),
            F.lit("(provided output)").alias("command"),
            F.lit(1).alias("exit_code"),
            F.col("value").alias("stdout"),
            F.lit("").alias("stderr"),
            F.lit(0.0).alias("duration_ms"),
            F.lit(None).cast("timestamp").alias("ts"),
        )
    )


def read_log_lines(spark: SparkSession, path: str, project_root: str = "/") -> DataFrame:
    """Log files of any size as ``run_id, project_root, path, line_no, line``, one file one run.

    Spark reads byte ranges of a file in many tasks, each from its first line start. Lines are
    numbered within their range as they are read, then by the counts of the ranges before, so a
    file's lines count from 0 without its lines meeting in one task. ``run_id`` is that of
    ``read_runs``. Lines end at line feeds; a last line feed opens no further line. Carriage
    returns stay.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(F.input_file_name()).alias("run_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    # Written once: the numbers must be the same for the counts and for the lines.
    read = stage(read)
    ranges = read.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = before_chunks(ranges, ["path"], "start", before=F.sum("n"))
    ranges = ranges.select("path", "start", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift"))
    return read.join(ranges, ["path", "start"]).select(
        "run_id", F.lit(project_root).alias("project_root"), "path",
        (F.col("id") + F.col("shift")).alias("line_no"), "line",
    )


def combined(stdout: Column, stderr: Column) -> Column:
    return F.concat_ws("\n", F.nullif(stdout, F.lit("")), F.nullif(stderr, F.lit("")))


def without_ansi(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x1b[")), F.regexp_replace(text, ANSI, "")).otherwise(text)


def combine_output(runs: DataFrame) -> DataFrame:
    """runs -> runs + ``text``: standard output and error, empty ones left out."""
    return runs.withColumn("text", combined(F.col("stdout"), F.col("stderr")))


def strip_ansi(runs: DataFrame) -> DataFrame:
    return runs.withColumn("text", without_ansi(F.col("text")))


def explode_lines(runs: DataFrame) -> DataFrame:
    """(run_id, text) -> (run_id, line_no, line); narrow, line numbers start at 0."""
    return runs.select(
        "run_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")
    )
