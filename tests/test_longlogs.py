"""The line grain against the run grain, on every template and on texts made of random lines."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from logsieve.functions.text import each, lines_of
from logsieve.operators import longlogs as L
from logsieve.operators import parse as P
from logsieve.operators.scan import before_chunks, numbered
from logsieve.sources import bridge as B
from logsieve.sources.runs import read_log_lines, read_runs
from logsieve.sources.sinks import stage

FRAME = ["run_id", "failure_idx", "frame_idx", "function", "file", "line", "col", "is_project_file"]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows.collect())


def run_grain(runs):
    parsed = P.parse_runs(runs)
    failures = each(parsed, "failures", "failure_idx", "f", "run_id").select(
        "run_id", "failure_idx", "f.test_name", "f.test_file", "f.error_message", "f.error_type", "f.raw_block"
    )
    hints = P.failures_of(parsed).select("run_id", "failure_idx", "raw_syntax", "raw_unhandled")
    return bag(failures), bag(hints), bag(P.frames_of(parsed).select(*FRAME))


def line_grain(runs, size, **more):
    texts = P.run_texts(runs, strip=False)
    lines = texts.select("run_id", "project_root", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    failures, frames = L.parse_lines(lines, size, **more)
    return (
        bag(failures.select("run_id", "failure_idx", "test_name", "test_file", "error_message", "error_type", "raw_block")),
        bag(failures.select("run_id", "failure_idx", "raw_syntax", "raw_unhandled")), bag(frames.select(*FRAME)),
    )


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_every_template(spark, size):
    runs = B.runs(spark, "/root/testdata/sf0.001").where("run_id % 1000 < 250")
    want = run_grain(runs)
    assert sum(want[0].values()) > 200
    assert line_grain(runs, size) == want


#: Lines that open, continue and end blocks of every format.
PARTS = {
    "python": ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "ValueError: bad", "x Traceback (most recent call last): y", "FAILED a.py::t - E", "", "text"],
    "java": ["\tat a.B(C.java:1)", "java.lang.FooException: no", "Caused by: x.BarError: why", "text", "", 'Exception in thread "m" a.QError: z'],
    "eslint": ["src/a.ts", "  1:2  error  Bad thing  no-var", "  3:4  warning  Odd  semi", "", "2 problems (1 error, 1 warning)", "src/b.ts", "two  words"],
    "go": ["panic: oh no", "goroutine 1 [running]:", "main.f(0x1)", "\t/a/b.go:3 +0x1f", "--- FAIL: TestA (0.1s)", "--- FAIL: TestAB (0.2s)", "    a_test.go:4: wrong", "text"],
    "rust": ["thread 'main' panicked at src/a.rs:1:2:", "assertion failed", "  left: 1", "test a::b ... FAILED", "error[E0308]: mismatch", "  --> src/a.rs:3:4", "text"],
    "npm": ["npm ERR! code ERESOLVE", "npm ERR! Could not resolve dependency:", 'npm ERR! peer react@"^17" from x', "npm ERR! nothing", "text"],
    "generic": ["FAIL a.test.ts", " FAIL  b.spec.ts > c", "AssertionError: no", "    at f (a.ts:1:2)", "✗ name (3 ms)", "", "text", "FAIL", "TypeError: x"],
}


@pytest.mark.parametrize("size", [1, 4])
def test_random_lines(spark, runs_of, size):
    rng = random.Random(size)
    texts = ["\n".join(rng.choice(part) for _ in range(rng.randrange(1, 25))) for part in PARTS.values() for _ in range(60)]
    runs = runs_of(*texts, "", "\n", "\nText", " \n")
    assert line_grain(runs, size) == run_grain(runs)


def test_long_blocks_leave_their_text_out(spark, runs_of):
    runs = runs_of("\n".join(["FAIL a.test.ts", "TypeError: x"] + [f"    at f (a.ts:{i}:2)" for i in range(1, 200)] + ["FAIL b.test.ts", "Error: y"]))
    failures, _, frames = line_grain(runs, 10, raw_lines=50)
    assert {(f[1], f[4], f[6] is None) for f in failures} == {(0, "x", True), (1, "y", False)}
    assert [sorted(f[2] for f in frames if f[1] == 0)] == [list(range(199))]


def test_longest_blocks_keep_their_whole_text(spark, runs_of):
    """A null text stands for the whole output, so a block that lost its own would be given that of others."""
    block = "\n".join(["FAIL a.test.ts", "TypeError: x", *["y"] * 180_000, ""])
    failures, _, _ = line_grain(runs_of(f"{block}FAIL b.test.ts\nError: y"), 10_000)
    assert {f[1]: f[6] for f in failures} == {0: block, 1: "FAIL b.test.ts\nError: y"}


def test_odd_lines(spark):
    schema = "run_id long, project_root string, line_no long, line string, chunk string"
    assert line_bags(L.parse_lines(spark.createDataFrame([], schema))) == ([], [])
    rows = [(None, "/r", 0, "Error: a", "x"), (None, "/r", 1, None, "x"), (2, None, 0, "", "x")]
    failures, frames = line_bags(L.parse_lines(spark.createDataFrame(rows, schema), 1))
    assert [(r["run_id"], r["error_message"]) for r in failures] == [(None, "a")] and frames == []


def line_bags(tables):
    return tuple(t.collect() for t in tables)


def test_files_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"{k}.log": [("é" * rng.randrange(0, 40)) + f"line {i}\r" for i in range(n)] for k, n in enumerate((5000, 1, 700, 0))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = read_log_lines(spark, str(tmp_path))
        got = collections.defaultdict(list)
        for r in rows.orderBy("path", "line_no").collect():
            got[r["path"].rsplit("/", 1)[1]].append((r["line_no"], r["line"]))
        ids = {r["run_id"] for r in rows.select("run_id").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert dict(got) == {name: list(enumerate(lines)) for name, lines in texts.items() if lines}
    assert ids <= {r["run_id"] for r in read_runs(spark, str(tmp_path), "text").collect()}


def test_numbers_and_folds_over_chunks(spark):
    rows = [(k, c, i) for k in "ab" for c in (0, 2, 5) for i in range(c + 1)]
    table = spark.createDataFrame(rows, "k string, c int, i int").repartition(5)
    got = numbered(table, ["k"], ["c"], ["i"], "n").collect()
    assert sorted((r["k"], r["n"], r["c"], r["i"]) for r in got) == sorted((k, n, *x[1:]) for k in "ab" for n, x in enumerate(r for r in rows if r[0] == k))
    chunks = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("a", 2, 3), ("a", 3, None)], "k string, c int, v int")
    got = before_chunks(chunks, ["k"], "c", s=F.sum("v"), last=F.last("v", ignorenulls=True)).orderBy("c").collect()
    assert [(r["s"], r["last"]) for r in got] == [(None, None), (1, 1), (1, 1), (4, 3)]


def test_one_chunk_of_many_marker_lines_takes_no_square(spark):
    """A list that a lambda puts together anew for every line costs the square of a chunk's lines."""
    lines = {
        "go": ["main.f(0x1)", "\t/a/b.go:3 +0x1f"], "eslint": ["  1:2  error  Bad thing  no-var"],
        "python": ["  text", "  other"], "rust": ["note: text", "help: other"],
    }

    def seconds(fmt, n):
        own = (lines[fmt] * n)[:n]
        row = spark.createDataFrame([(1, "/repo/p1", fmt, 1, 4, ["text"], own, ["text"])], "run_id long, project_root string, format string, chunk long, way int, before array<string>, own array<string>, after array<string>")
        # From a file: the optimizer would compute a local row by itself.
        parsed = L.parse_chunks(stage(row))
        started = time.perf_counter()
        parsed.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for fmt in lines:
        seconds(fmt, 100)
        assert seconds(fmt, 16_000) < 12, fmt
