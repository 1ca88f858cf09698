"""Counts and ratios over runs, steps and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(passed: Column, total: Column) -> Column:
    return F.when(total > 0, passed / total * 100).otherwise(F.lit(0.0))


def _filled(counts: DataFrame) -> DataFrame:
    passed = F.coalesce("passed", F.lit(0))
    failed = F.coalesce("failed", F.lit(0))
    return counts.withColumn("total", F.coalesce("total", passed + failed)).withColumns(
        {"passed": passed, "failed": failed}
    )


def test_pass_ratio(run_counts: DataFrame) -> DataFrame:
    """(run_id, total, passed, failed) -> + ratio in percent; a missing total is passed + failed."""
    return _filled(run_counts).select(
        "run_id", "passed", "failed", "total", _ratio(F.col("passed"), F.col("total")).alias("ratio")
    )


def pass_ratio_by_project(run_counts: DataFrame, runs: DataFrame) -> DataFrame:
    """The same over all runs of a project; sums are formed before the shuffle."""
    joined = _filled(run_counts).join(runs.select("run_id", "project_root"), "run_id")
    return (
        joined.groupBy("project_root")
        .agg(*[F.sum(c).alias(c) for c in ("passed", "failed", "total")])
        .select("*", _ratio(F.col("passed"), F.col("total")).alias("ratio"))
    )


def step_label(status: Column, error: Column) -> Column:
    return (
        F.when(status == "success", "OK")
        .when(status == "skipped", "SKIP")
        .otherwise(F.concat(F.lit("FAIL: "), F.coalesce(error, F.lit("unknown"))))
    )


def step_summary(run_steps: DataFrame) -> DataFrame:
    """Each step with its label and the run's total time (a run has a fixed set of steps)."""
    per_run = Window.partitionBy("run_id")
    return run_steps.select(
        "run_id",
        "step",
        step_label(F.col("status"), F.col("error")).alias("label"),
        "duration_ms",
        F.sum("duration_ms").over(per_run).alias("total_ms"),
    )


def step_totals(run_steps: DataFrame) -> DataFrame:
    return run_steps.groupBy("step", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("duration_ms")
    )


def outcome_counts(analysed: DataFrame) -> DataFrame:
    """(run_id, failures, top) -> (run_id, n_failures, n_hypotheses, code); narrow."""
    n = F.size("failures")
    return analysed.select(
        "run_id",
        n.alias("n_failures"),
        F.size("top").alias("n_hypotheses"),
        F.when(n > 0, 1).otherwise(0).alias("code"),
    )


def outcome_counts_of_tables(
    runs: DataFrame, failures: DataFrame, hypotheses: DataFrame
) -> DataFrame:
    """The same from tables: counts are aggregated first and joined to the runs."""
    f = failures.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_failures"))
    h = hypotheses.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_hypotheses"))
    n = F.coalesce("n_failures", F.lit(0))
    return (
        runs.select("run_id")
        .join(f, "run_id", "left")
        .join(h, "run_id", "left")
        .select(
            "run_id",
            n.alias("n_failures"),
            F.coalesce("n_hypotheses", F.lit(0)).alias("n_hypotheses"),
            F.when(n > 0, 1).otherwise(0).alias("code"),
        )
    )
