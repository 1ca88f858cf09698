"""Streams whose state is a table: any split into triggers, replays and late lines end the same."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from logsieve.operators import infer as I
from logsieve.operators.parse import frames_of, parse_runs, run_texts
from logsieve.sources import bridge as B
from logsieve.streaming.ledger import Ledger
from logsieve.streaming.runlog import LINES, RunLog

START = dt.datetime(2024, 1, 1)
CELLS = ["run_id", "failure_idx", "test_name", "test_file", "error_message", "error_type"]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows.collect())


def test_first_in_order_for_any_split_and_after_a_replay(spark, tmp_path):
    rng = random.Random(1)
    names = ["a", "b", "c"]
    rows = [
        (rng.choice([1, 2, 3, None]), i // 3, rng.randrange(50), rng.choice(names), rng.choice(["high", "medium", "low"]), f"m{rng.randrange(4)}")
        for i in range(120)
    ]
    schema = "run_id long, failure_idx int, rule_rank int, category string, confidence string, error_message string"
    whole = spark.createDataFrame(rows, schema)
    want = bag(I.rank_hypotheses(I.dedupe_hypotheses(whole)))
    for split, compact in ((1, 32), (5, 2)):
        ledger = Ledger(spark, str(tmp_path / f"s{split}"), whole.schema, ["run_id"], compact)
        mixed = rows[:]
        rng.shuffle(mixed)
        parts = [spark.createDataFrame(mixed[k::split], schema) for k in range(split)]

        def take(number, ledger=ledger, parts=parts):
            merged = I.dedupe_hypotheses(ledger.of_keys(parts[number], number).unionByName(parts[number]))
            ledger.put(number, merged, parts[number])

        for number in range(split):
            take(number)
            take(number)
        assert bag(I.rank_hypotheses(ledger.rows())) == want


def test_ledger_forgets_keys_without_rows(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    ledger = Ledger(spark, str(tmp_path / "l"), table.schema, ["k"], compact=2)
    assert ledger.rows().collect() == []
    ledger.put(0, table, table)
    ledger.put(1, table.where("k = 9"), table.where("k = 1"))
    assert bag(ledger.rows()) == {(2, "c"): 1} and bag(ledger.rows(1)) == bag(table)
    for version in range(2, 6):
        one = spark.createDataFrame([(3, str(version))], "k int, v string")
        ledger.put(version, one, one)
    assert bag(ledger.rows()) == {(2, "c"): 1, (3, "5"): 1}


def test_late_lines_end_as_timely_ones(spark, tmp_path):
    runs = B.runs(spark, "/root/testdata/sf0.001").where("run_id < 40")
    want = parse_runs(runs)
    lines = [
        (r["run_id"], r["project_root"], START + dt.timedelta(seconds=1000 * (i // 10) + n // 5), n, line)
        for i, r in enumerate(run_texts(runs, strip=False).orderBy("run_id").collect())
        for n, line in enumerate(r["text"].split("\n"))
    ]
    rng = random.Random(2)
    late = {(x[0], x[3]) for x in lines if x[0] % 7 == 3 and rng.random() < 0.5}
    timely = [x for x in lines if (x[0], x[3]) not in late]
    batches = [[x for x in timely if x[2] < START + dt.timedelta(seconds=1000 * (k + 1)) and x[2] >= START + dt.timedelta(seconds=1000 * k)] for k in range(4)]
    rng.shuffle(batches[0])
    # One line comes twice, and one has no place.
    batches.append([x for x in lines if (x[0], x[3]) in late] + [timely[0], (None, "/r", START, 1, "x"), (1, "/r", START, None, "x")])
    log = RunLog(spark, str(tmp_path / "log"), size=5)
    for number, rows in enumerate(batches):
        log.take(spark.createDataFrame(rows, LINES), number)
        if number == 2:
            log.take(spark.createDataFrame(rows, LINES), number)
    assert 0 < log.runs.rows().where("closed").count() < 40
    assert log.late_lines().count() == log.runs.rows().agg(F.sum("late")).first()[0] > 0
    reopened = log.runs.rows().where("late > 0").count()
    before = {name for name in map(str, (tmp_path / "log" / "failures").iterdir())}
    log.finish()
    assert log.runs.rows().where("NOT closed").count() == 0
    # Only runs with late lines and those open at the end are parsed again.
    fresh = [p for p in map(str, (tmp_path / "log" / "failures").iterdir()) if p not in before]
    assert spark.read.parquet(*fresh).select("run_id").distinct().count() <= reopened + 10
    from logsieve.operators.parse import failures_of

    assert bag(log.failures.rows().select(*CELLS)) == bag(failures_of(want).select(*CELLS))
    frames = ["run_id", "failure_idx", "frame_idx", "function", "file", "line"]
    assert bag(log.frames.rows().select(*frames)) == bag(frames_of(want).select(*frames))
    log.finish()
    assert bag(log.failures.rows().select(*CELLS)) == bag(failures_of(want).select(*CELLS))


def test_no_lines(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.finish()
    log.take(spark.createDataFrame([], LINES), 0)
    log.finish()
    assert log.runs.rows().collect() == [] and log.failures.rows().collect() == [] and log.late_lines().collect() == []
