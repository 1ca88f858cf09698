"""Format detection: one CASE over the whole text, first match wins, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import gated, has

# Patterns that tell the formats apart. Each carries a literal that must be
# present for it to match, so the byte search spares most texts the regex. White space at the
# start of a line stops at the line's end: a run over blank lines would cost its square.
TSC_LINE = r"\(\d+,\d+\):\s*error\s+TS\d+:"
RUST_CODE = r"error\[E\d{4}\]:"
RUST_PANIC = r"thread '[^\r\n]*' panicked at"
RUST_ARROW = r"(?m)^[^\S\n]*-->\s+\S+\.rs:\d+:\d+"
GO_ROUTINE = r"goroutine\s+\d+\s+\["
GO_PANIC = r"(?m)^panic:"
GO_FILE = r"\.go:\d+"
GO_TEST = r"---\s+FAIL:\s+Test\w+"
GO_COMPILE = r"(?m)^\./?[^\s:]+\.go:\d+:\d+:"
PY_TRACEBACK = "Traceback (most recent call last):"
PY_FILE = r"(?m)^[^\S\n]*File\s+\"[^\"]+\",\s+line\s+\d+"
PY_TEST = r"FAILED\s+\S+\.py::"
JAVA_FRAME = r"(?m)^[^\S\n]*(?:[^\S\n]|\n)at\s+[\w.$]+\([^)]+\.java:\d+\)"
JAVA_COMPILE = r"\.java:\d+:\s+error:"
JAVA_THREAD = "Exception in thread"
VITEST_BANNER = r"RUN\s+v\d"
VITEST_ARROW = r"❯\s+\S+"
VITEST_COUNT = r"(?i)Tests?\s+\d+\s+failed"
JEST_SUITES = r"Test Suites?:\s+\d+"
JEST_FAIL = r"FAIL\s"
JEST_COUNT = r"(?i)Tests?:\s+\d+\s+failed,\s+\d+\s+passed,\s+\d+\s+total"
ESLINT_SUMMARY = r"\d+\s+problems?\s+\(\d+\s+errors?,\s+\d+\s+warnings?\)"
ESLINT_UNIX = r"(?m)^[^\S\n]*\S+:\d+:\d+\s+(?:error|warning)\s+[^\r\n]+\s+\S+(?:\r|$)"
NPM_LINE = r"npm\s+(?:error|ERR!)"
BUILD_FAILED = r"(?i)Build failed"
BUILD_TEST = r"(?i)test"
BUILD_MISSING = r"(?i)Module not found|Cannot resolve"
BUILD_TOOL = r"(?i)webpack|vite|esbuild|next"
NODE_ERROR = r"(?m)^\w*Error:[^\r\n]*\n\s+at\s"
NODE_FRAME = r"(?m)^[^\S\n]*(?:[^\S\n]|\n)at\s+[^\r\n][^(\r\n]*\([^\r\n]+:\d+:\d+\)(?:\r|$)"


# The same tests for engines with atomic groups and look-behind, in one pass over any text: the first
# thread name of a line answers for the others; a bracket is read up to the next frame's start only, which
# answers for this one; a number is tried from its first digit.
RUST_PANIC_SCAN = r"(?<![^\r\n])(?>[^\r\n]*?thread ')[^\r\n]*' panicked at"
JAVA_FRAME_SCAN = (
    r"(?m)^[^\S\n]*(?:[^\S\n]|\n)at\s+[\w.$]++\((?!\.java:\d+\))[^)\n]*+(?:\n(?![^\S\n]*at\s+[\w.$]++\()[^)\n]*+)*+"
    r"(?<=\.java:\d{1,18})\)"
)
ESLINT_SUMMARY_SCAN = r"(?<!\d)" + ESLINT_SUMMARY

def lowered(text: Column, needle: str, pattern: str) -> Column:
    """A test without regard to case behind a byte search in the lower-case text, which other tests share."""
    return has(F.lower(text), needle) & text.rlike(pattern)


#: Every test that tells formats apart, by name, over a text. A text has a test's mark if any part
#: of it has, so long logs are tested chunk by chunk.
MARKS = {
    "tsc": lambda t: gated(t, "TS", TSC_LINE),
    "rust_code": lambda t: gated(t, "error[E", RUST_CODE),
    "rust_panic": lambda t: gated(t, "panicked at", RUST_PANIC_SCAN),
    "rust_arrow": lambda t: gated(t, ".rs:", RUST_ARROW),
    "go_routine": lambda t: gated(t, "goroutine", GO_ROUTINE),
    "go_panic": lambda t: gated(t, "panic:", GO_PANIC),
    "go_file": lambda t: gated(t, ".go:", GO_FILE),
    "go_test": lambda t: gated(t, "FAIL:", GO_TEST),
    "go_compile": lambda t: gated(t, ".go:", GO_COMPILE),
    "py_traceback": lambda t: has(t, PY_TRACEBACK),
    "py_file": lambda t: gated(t, "File", PY_FILE),
    "py_test": lambda t: gated(t, ".py::", PY_TEST),
    "java_frame": lambda t: gated(t, ".java:", JAVA_FRAME_SCAN),
    "java_compile": lambda t: gated(t, ".java:", JAVA_COMPILE),
    "java_thread": lambda t: has(t, JAVA_THREAD),
    "vitest_banner": lambda t: gated(t, "RUN", VITEST_BANNER),
    "vitest_arrow": lambda t: gated(t, "❯", VITEST_ARROW),
    "vitest_count": lambda t: lowered(t, "failed", VITEST_COUNT),
    "jest_suites": lambda t: gated(t, "Test Suite", JEST_SUITES),
    "jest_fail": lambda t: gated(t, "FAIL", JEST_FAIL),
    "jest_count": lambda t: lowered(t, "failed,", JEST_COUNT),
    "eslint_summary": lambda t: gated(t, "problem", ESLINT_SUMMARY_SCAN),
    "eslint_unix": lambda t: (has(t, "error") | has(t, "warning")) & t.rlike(ESLINT_UNIX),
    "npm": lambda t: gated(t, "npm", NPM_LINE),
    "build_failed": lambda t: lowered(t, "build failed", BUILD_FAILED),
    "build_missing": lambda t: (has(F.lower(t), "module not found") | has(F.lower(t), "cannot resolve")) & t.rlike(BUILD_MISSING),
    "build_tool": lambda t: t.rlike(BUILD_TOOL),
    "node_error": lambda t: gated(t, "Error:", NODE_ERROR),
    "node_frame": lambda t: has(t, "at") & has(t, "(") & gated(t, ":", NODE_FRAME),
}
#: The build test looks for a word among the first characters of the whole text.
BUILD_HEAD = 100


def build_tested(head: Column) -> Column:
    return F.substring(head, 1, BUILD_HEAD).rlike(BUILD_TEST)


def format_by(mark: Callable[[str], Column], tested: Column) -> Column:
    """The format by the marks of a text; ``tested`` is ``build_tested`` of its start."""
    return (
        F.when(mark("tsc"), "typescript")
        .when(mark("rust_code") | mark("rust_panic") | mark("rust_arrow"), "rust")
        .when(mark("go_routine") | (mark("go_panic") & mark("go_file")) | mark("go_test") | mark("go_compile"), "go")
        .when(mark("py_traceback") | mark("py_file") | mark("py_test"), "python")
        .when(mark("java_frame") | mark("java_compile") | mark("java_thread"), "java")
        .when(mark("vitest_banner") | (mark("vitest_arrow") & mark("vitest_count")), "vitest")
        .when(mark("jest_suites") | (mark("jest_fail") & mark("jest_count")), "jest")
        .when(mark("eslint_summary") | mark("eslint_unix"), "eslint")
        .when(mark("npm"), "npm")
        .when((mark("build_failed") & ~tested) | (mark("build_missing") & mark("build_tool")), "build")
        .when(mark("node_error") | mark("node_frame"), "node")
        .otherwise("unknown")
    )


def format_of(text: Column) -> Column:
    return format_by(lambda name: MARKS[name](text), build_tested(text))


def detect_format(runs: DataFrame) -> DataFrame:
    """(run_id, text, …) -> (run_id, format)."""
    return runs.select("run_id", format_of(F.col("text")).alias("format"))
