"""Hand-written expectations per output format, odd cases included."""

import time

import pytest
from pyspark.sql import functions as F


def shown(failures):
    return [(f["error_type"], f["error_message"]) for f in failures]


def places(failure):
    return [
        (s["function"], s["file"], s["line"], s["col"], s["is_project_file"])
        for s in failure["frames"]
    ]


def test_compiler_lines(failures_for):
    fmt, found = failures_for("src/a.ts(007,5): error TS1005: ';' expected.\r\n x(1,1): error TS2: y")
    assert fmt == "typescript"
    assert shown(found) == [("TypeError", "TS1005: ';' expected."), ("TypeError", "TS2: y")]
    assert found[0]["raw_block"] == "src/a.ts(7,5): error TS1005: ';' expected."
    assert places(found[0]) == [(None, "/repo/p1/src/a.ts", 7, 5, True)]


def test_compiler_warning_is_not_an_error(failures_for):
    assert failures_for("src/a.ts(1,1): warning TS6133: unused")[0] == "unknown"


def test_linter_prose_becomes_the_file(failures_for):
    text = "  1:1  error  lost  a-rule\nnow checking things\n  2:2  error  found  b-rule\n1 problem (1 error, 0 warnings)"
    fmt, found = failures_for(text)
    assert fmt == "eslint"
    assert shown(found) == [("ESLintError", "[b-rule] found")]
    assert found[0]["frames"][0]["file"] == "now checking things"


def test_linter_warnings_only_are_capped(failures_for):
    body = "\n".join(f"  {i}:1  warning  w{i}  semi" for i in range(1, 8))
    _, found = failures_for(f"src/a.ts\n{body}\n7 problems (0 errors, 7 warnings)")
    assert len(found) == 5
    assert found[4]["error_message"] == "[semi] w5 (auto-fixable with eslint --fix)"
    assert found[4]["error_type"] == "ESLintWarning"


def test_linter_one_line_form_is_detected_but_empty(failures_for):
    assert failures_for("src/a.ts:1:2 error Unexpected var no-var") == ("eslint", [])


@pytest.mark.parametrize(
    "text, message",
    [
        ("npm error code E404\nnpm error 404 Not Found - GET https://r/x - no\nnpm error 'x@1' is not in this registry",
         "E404: Package 'x' not found in the npm registry — https://r/x"),
        ("npm ERR! code ERESOLVE\nCould not resolve dependency:\nnpm ERR! peer react \"^17\" from w",
         "ERESOLVE: Peer dependency conflict: react requires \"^17\" — Try: npm install --legacy-peer-deps"),
        ("npm error code ENOENT\nnpm error Missing script: \"go\"",
         "ENOENT: npm script 'go' not found in package.json"),
        ("npm error code EODD\nnpm error\nnpm error first note", "EODD: first note"),
        ("npm error code EODD", "EODD: npm error EODD"),
    ],
)
def test_package_manager(failures_for, text, message):
    fmt, found = failures_for(text)
    assert fmt == "npm"
    assert shown(found) == [("NpmError", message)]
    assert found[0]["raw_block"] is None


def test_package_manager_without_code(failures_for):
    assert failures_for("npm ERR! network down") == ("npm", [])


def test_traceback_takes_last_error_and_all_frames(failures_for):
    text = (
        "Traceback (most recent call last):\n  File \"a/b.py\", line 3, in f\n    x\n"
        "ValueError: first\nKeyError: 'k'\nFAILED t.py::test_a - KeyError"
    )
    fmt, found = failures_for(text)
    assert fmt == "python"
    assert shown(found) == [("KeyError", "'k'")]
    assert (found[0]["test_name"], found[0]["test_file"]) == ("test_a", "t.py")
    assert places(found[0]) == [("f", "/repo/p1/a/b.py", 3, None, True)]


def test_dotted_error_type_is_not_read(failures_for):
    _, found = failures_for(
        "Traceback (most recent call last):\n  File \"a.py\", line 1\na.b.XError: boom"
    )
    assert shown(found) == [("Exception", "Python error occurred")]


def test_empty_traceback_does_not_use_up_a_test(failures_for):
    text = (
        "Traceback (most recent call last):\n\nTraceback (most recent call last):\n"
        "  File \"a.py\", line 1\nFAILED t.py::t1 - OSError"
    )
    _, found = failures_for(text)
    assert [f["test_name"] for f in found] == ["t1"]


def test_installer_error_stops(failures_for):
    _, found = failures_for("FAILED x.py::y - KeyError\nERROR: no such package")
    assert shown(found) == [("PipError", "no such package")]


def test_standalone_error_looks_three_lines_back(failures_for):
    _, found = failures_for("  File \"a.py\", line 2\n    code\n    ^\nSyntaxError: bad")
    assert places(found[0]) == [(None, "/repo/p1/a.py", 2, None, True)]
    _, found = failures_for("  File \"a.py\", line 2\n1\n2\n3\nSyntaxError: bad")
    assert places(found[0]) == []


def test_java_cause_opens_a_new_failure(failures_for):
    text = (
        "java.lang.RuntimeException: top\n\tat a.B.c(B.java:1)\nCaused by: x.YError: root\n"
        "\tat a.D.e(D.java:2)\n z.Exception: indented\njava.lang.NullPointerException\n\tat a.F.g(F.java:3)"
    )
    fmt, found = failures_for(text)
    assert fmt == "java"
    assert shown(found) == [("java.lang.RuntimeException", "top"), ("x.YError", "root")]
    # A header without a message opens nothing, so its frame stays with the one before.
    assert [s["line"] for s in found[1]["frames"]] == [2, 3]
    assert found[0]["raw_block"] == "java.lang.RuntimeException: top\n\tat a.B.c(B.java:1)"


def test_java_compile_errors_hide_traces(failures_for):
    text = "src/A.java:3: error: cannot find symbol\njava.lang.Error: hidden\n[ERROR] B.java:[2,5] bad"
    _, found = failures_for(text)
    assert shown(found) == [("CompilerError", "cannot find symbol"), ("CompilerError", "bad")]
    assert places(found[1]) == [(None, "/repo/p1/B.java", 2, 5, True)]


def test_java_chain_keeps_root(spark, runs_of):
    from logsieve.operators.parse import java_exception_chain
    from logsieve.sources.runs import combine_output

    text = "a.XError: one\nCaused by: b.YError: two\nCaused by: c.ZError: three\nd.WError: four"
    texts = combine_output(runs_of(text))
    rows = java_exception_chain(texts).orderBy("block_id", "chain_pos").collect()
    assert [(r.block_id, r.chain_pos, r.error_message) for r in rows] == [
        (0, 0, "one"), (0, 1, "two"), (0, 2, "three"), (1, 0, "four"),
    ]
    roots = java_exception_chain(texts, root_only=True).orderBy("block_id").collect()
    assert [(r.block_id, r.error_message) for r in roots] == [(0, "three"), (1, "four")]


def test_go_panic_function_is_used_once(failures_for):
    text = (
        "panic: boom\n\ngoroutine 1 [running]:\nmain.run(0x1)\n\ta.go:1 +0x1\n\tb.go:2 +0x2\n"
        "main.(*S).Go(...)\nnoise\n\tc.go:3 +0x3"
    )
    fmt, found = failures_for(text)
    assert fmt == "go"
    assert [(s["function"], s["line"]) for s in found[0]["frames"]] == [
        ("main.run", 1), (None, 2), ("main.(*S).Go", 3),
    ]


def test_go_test_name_prefix_hits_the_longer_name(failures_for):
    text = "--- FAIL: TestAB (0.0s)\n    ab_test.go:1: ab\n--- FAIL: TestA (0.0s)\n    a_test.go:2: a"
    _, found = failures_for(text)
    assert [(f["test_name"], f["error_message"]) for f in found] == [("TestAB", "ab"), ("TestA", "ab")]
    assert [s["line"] for s in found[1]["frames"]] == [1, 2]


def test_rust_location_within_four_lines(failures_for):
    text = (
        "error[E0308]: mismatched\n1\n2\n3\n --> src/a.rs:4:1\nerror[E0382]: moved\n1\n2\n3\n4\n"
        " --> src/b.rs:5:1\nerror: aborting due to 2 previous errors"
    )
    fmt, found = failures_for(text)
    assert fmt == "rust"
    assert [len(f["frames"]) for f in found] == [1, 0, 0]
    assert shown(found)[2] == ("RustError", "aborting due to 2 previous errors")
    assert failures_for("error: could not compile `x`")[0] == "unknown"


def test_rust_panic_assertion_lines(failures_for):
    text = "thread 'main' panicked at src/l.rs:9:5:\nassertion `left == right` failed\n  left: 1\n right: 2"
    _, found = failures_for(text)
    assert shown(found) == [("panic", "assertion `left == right` failed; left: 1; right: 2")]
    assert found[0]["frames"][0]["function"] is None


@pytest.mark.parametrize(
    "text, messages",
    [
        ("FAIL a.test.ts\nError: x", ["x"]),
        ("pre\nFAIL a.test.ts\nError: x\nFAIL b.test.ts\nTypeError: y", ["x", "y"]),
        ("Error: one\nmore\nTypeError: two", ["one", "two"]),
        ("Error: only", ["only"]),
        ("log\n✗ first\n✗ second", ["✗ first", "✗ second"]),
        ("nothing here", ["nothing here"]),
        (" \n\t ", []),
        ("xFAIL no marker\nFAILED neither", ["xFAIL no marker"]),
    ],
)
def test_generic_blocks(failures_for, text, messages):
    assert [f["error_message"] for f in failures_for(text, dispatch=False)[1]] == messages


def test_generic_block_parts(failures_for):
    text = (
        "x\nFAIL src/a.spec.ts > adds (12 ms)\nAssertionError [ERR]: bad sum\n"
        "    at run (/repo/p10/src/a.ts:1:2)\n    at /repo/p1/node_modules/m.js:3:4\n"
        " ❯ src/a.spec.ts:5:6\n  File: src/c.ts:7:8\n    at node:internal/x:9:1\n"
    )
    _, found = failures_for(text, dispatch=False)
    assert shown(found) == [("AssertionError", "bad sum")]
    assert (found[0]["test_name"], found[0]["test_file"]) == ("src/a.spec.ts > adds", "src/a.spec.ts")
    # A sibling root and a bare internal name count as project files.
    assert [(p[0], p[1], p[4]) for p in places(found[0])] == [
        ("run", "/repo/p10/src/a.ts", True),
        (None, "/repo/p1/node_modules/m.js", False),
        (None, "src/a.spec.ts", True),
        (None, "src/c.ts", True),
        (None, "node:internal/x", True),
    ]


def test_command_path_ignores_the_format_and_colours(failures_for):
    fmt, found = failures_for("src/a.ts(1,1): error TS1: x", dispatch=False)
    assert fmt == "typescript"
    assert shown(found) == [(None, "src/a.ts(1,1): error TS1: x")]
    _, found = failures_for("\x1b[31mError\x1b[0m: red", dispatch=False)
    assert shown(found) == [("Error", "red")]


def test_counts(spark):
    from logsieve.operators.parse import extract_test_counts

    texts = ["Tests  1 failed | 2 passed (3)", "Tests: 4 failed, 5 total", "Tests: 2 total", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "run_id int, text string")
    got = [tuple(r)[1:] for r in extract_test_counts(rows).orderBy("run_id").collect()]
    assert got == [(3, 2, 1), (5, None, 4), (2, None, None), (None, None, None)]


@pytest.mark.parametrize(
    "file, full",
    [
        ("/abs/x.ts", "/abs/x.ts"), ("src/x.ts", "/repo/p1/src/x.ts"), ("./x.ts", "/repo/p1/x.ts"),
        ("../x.ts", "/repo/x.ts"), ("a/../../../../x", "/x"), ("a//b/./c", "/repo/p1/a/b/c"),
        ("a/..", "/repo/p1"), (".hidden/..x", "/repo/p1/.hidden/..x"),
    ],
)
def test_resolve_path(spark, file, full):
    from pyspark.sql import functions as F

    from logsieve.functions.text import resolve_path

    row = spark.range(1).select(resolve_path(F.lit(file), F.lit("/repo/p1")).alias("p")).first()
    assert row.p == full


def test_languages(spark):
    from pyspark.sql import functions as F

    from logsieve.functions.text import language_from_ext

    names = ["a/b.TSX", "x.py", "Makefile", ".bashrc", "a.b/c", "x.", "y.rs"]
    rows = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in rows.select(language_from_ext(F.col("f"))).collect()]
    assert got == ["typescript", "python", "text", "text", "text", "text", "rust"]


def seconds(run):
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


@pytest.mark.parametrize(
    "text",
    ["\n" * 80_000 + "error .go: .rs: File .java: at (:", "at " + "(" * 500_000 + ":1 error", "x" * 1_000_000 + " error"],
    ids=["blank lines", "one line of brackets", "one long word"],
)
def test_detection_is_linear(runs_of, text):
    from logsieve.operators.detect import format_of

    def run(t):
        runs_of(t).select(format_of(F.col("stdout")).alias("f")).collect()

    run("warm")
    assert seconds(lambda: run(text)) < 20


def test_many_go_tests_are_linear(runs_of):
    from logsieve.operators.parse import parse_runs

    def run(n):
        text = "\n".join(f"--- FAIL: TestCase{i} (0.00s)\n    a_test.go:{i + 1}: bad {i}" for i in range(n))
        rows = parse_runs(runs_of(text)).select(F.size("failures").alias("n"), F.get("failures", F.lit(n - 1))["error_message"].alias("m")).first()
        assert rows["n"] == n and rows["m"] == f"bad {n - 1}"

    run(10)
    assert seconds(lambda: run(8_000)) < 20


def test_go_tests_of_one_name_and_prefixes(failures_for):
    text = "\n".join([
        "--- FAIL: TestAB (0.00s)", "    a_test.go:1: first", "--- FAIL: TestA (0.00s)", "    a_test.go:2: second",
        "--- FAIL: TestA (0.00s)", "--- FAIL: TestB (0.00s)",
    ])
    _, found = failures_for(text)
    assert [(f["test_name"], f["error_message"]) for f in found] == [
        ("TestAB", "first"), ("TestA", "first"), ("TestA", "first"), ("TestB", "Test TestB failed"),
    ]


def test_failing_peer_search_is_linear(runs_of):
    from logsieve.operators.parse import parse_runs

    text = "npm ERR! code ERESOLVE\nCould not resolve dependency:\n" + "npm ERR! peerless\n" * 40_000
    assert seconds(lambda: parse_runs(runs_of(text)).select("failures").collect()) < 20


def test_detection_takes_linear_time(spark):
    """Texts that made a pattern read the rest of the text, or of a line, again and again."""
    import time

    from logsieve.operators.detect import detect_format

    def took(text):
        rows = spark.createDataFrame([(1, text)], "run_id int, text string")
        started = time.time()
        detect_format(rows).collect()
        return time.time() - started

    took("warm")
    makers = [
        lambda n: "\tat a.b(x\n" * (n // 10) + ".java:", lambda n: "\tat a.b(" + "x\n" * (n // 2) + ".java:",
        lambda n: "thread '" * (n // 8) + " panicked at", lambda n: "1" * n + " problem",
        lambda n: "\n" * n + ".java: .rs: .go: File .py:: Error: at ( error",
    ]
    for make in makers:
        assert took(make(1_000_000)) < 5


def test_scanning_patterns_equal_the_plain_ones(spark):
    import random

    from logsieve.operators import detect as D

    rng = random.Random(1)
    parts = [
        "\tat a.b(", "x", "\n", ".java:3", ")", " at c.d(", "thread '", "'", " panicked at", "12", " problems (1 error, ",
        "2 warnings)", "\r\n", "at ", "(A", ".java:",
    ]
    texts = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))),) for _ in range(4000)]
    texts += [("\tat a.B(\n  C.java:12)",), ("at a.B(C.java:12)",), ("\n\tat a.b(.java:3)",)]
    rows = spark.createDataFrame(texts, "text string")
    for plain, scan in (
        (D.JAVA_FRAME, D.JAVA_FRAME_SCAN), (D.RUST_PANIC, D.RUST_PANIC_SCAN), (D.ESLINT_SUMMARY, D.ESLINT_SUMMARY_SCAN),
    ):
        assert rows.where(rows.text.rlike(plain)).count() > 0
        assert rows.where(rows.text.rlike(plain) != rows.text.rlike(scan)).count() == 0
