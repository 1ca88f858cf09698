import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = (
    "run_id bigint, project_root string, command string, exit_code int, stdout string, "
    "stderr string, duration_ms double, ts timestamp"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def runs_of(spark):
    def build(*texts, root="/repo/p1"):
        rows = [(i, root, "cmd", 1, t, "", 1.0, None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, RUNS)

    return build


@pytest.fixture(scope="session")
def failures_for(runs_of):
    """Failures (with frames) of one text, through format detection unless told otherwise."""
    from logsieve.operators.parse import parse_runs

    def run(text, root="/repo/p1", dispatch=True):
        row = parse_runs(runs_of(text, root=root), dispatch).select("format", "failures").first()
        return row["format"], row["failures"]

    return run
