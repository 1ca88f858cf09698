"""Streams replayed from files and compared with the batch operators."""

import datetime as dt
import time

from pyspark.sql import functions as F

from logsieve.operators.parse import hypotheses_of, parse_runs
from logsieve.streaming import jobs as J

LINES = "run_id bigint, project_root string, ts timestamp, line_no int, line string"
START = dt.datetime(2024, 1, 1)


def event(run, second, number, line):
    return (run, "/repo/p1", START + dt.timedelta(seconds=second), number, line)


def replay(spark, folder, batches):
    """One file per batch, read one file per trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return (
        spark.readStream.schema(LINES)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(folder)
    )


def test_lines_become_runs(spark, tmp_path):
    text = ["start", "TypeError: x is not a function", "    at f (a.ts:1:2)"]
    first = [event(1, 2 - i, 2 - i, text[2 - i]) for i in range(3)]
    first += [event(2, 1, 0, "Error: Timeout")]
    # Far in the future: lets the watermark pass the sessions above. A trigger drops what was
    # late at the trigger before it, so one more lies between.
    sentinel = [event(99, 86400, 0, "end")]
    between = [event(99, 86401, 1, "end")]
    late = [event(1, 3, 3, "too late")]
    stream = replay(spark, str(tmp_path / "in"), [first, sentinel, between, late])
    runs = J.assemble_runs(stream, gap="30 seconds", delay="1 minute")
    out = str(tmp_path / "out")
    late_rows = J.LateRows()
    spark.streams.addListener(late_rows)
    query = J.write_batches(runs, lambda rows: rows, out, str(tmp_path / "state"))
    query.awaitTermination()
    rows = spark.read.schema(runs.schema).parquet(out)
    got = {r.run_id: r for r in rows.collect()}
    assert set(got) == {1, 2}
    assert got[1].stdout == "\n".join(text) and got[1].n_lines == 3
    for _ in range(100):
        if late_rows.dropped[str(query.id)]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late_rows)
    assert late_rows.dropped[str(query.id)] == 1
    causes = {(r.run_id, r.category) for r in hypotheses_of(parse_runs(rows)).collect()}
    assert causes == {(1, "type_mismatch"), (2, "timeout")}


def test_windows_slide(spark):
    rows = [(START + dt.timedelta(minutes=m), c) for m, c in ((1, "a"), (6, "a"), (7, "b"))]
    table = spark.createDataFrame(rows, "ts timestamp, category string")
    got = J.category_rate(table, "10 minutes", "5 minutes").orderBy("window_start", "category")
    assert [(r.window_start.minute, r.category, r.n) for r in got.collect()] == [
        (55, "a", 1), (0, "a", 2), (0, "b", 1), (5, "a", 1), (5, "b", 1),
    ]


def test_classify_needs_no_state(spark):
    from logsieve.sources import bridge as B

    stream = J.stream_classify(B.runs_of(spark, B.events_stream(spark, "/root/testdata/sf0.001")))
    assert stream.isStreaming
    assert stream.select(F.col("run_id")).schema.simpleString() == "struct<run_id:bigint>"
