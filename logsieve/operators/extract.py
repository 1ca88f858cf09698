"""Failure extraction, one column expression per output format.

A run is one row, so every extractor works inside the row: it splits the text once, keeps
the marker lines and returns ``ARRAY<failure>``. Nothing here shuffles, and a run's text
never leaves the task that read it. Blocks that belong to a header line are cut out by
position (:func:`blocks_by`), so the work stays linear in the text.

``raw_block`` is null when a failure's raw output is the run's whole text; the text is not
copied once per failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsieve.functions.text import (
    captured,
    captured_int,
    gated,
    has,
    let,
    lines_of,
    owned_path,
    resolve_path,
    trimmed,
)

FRAME_TYPE = "struct<function:string,file:string,line:int,col:int>"
FAILURE_TYPE = (
    "struct<test_name:string,test_file:string,error_message:string,error_type:string,"
    f"raw_block:string,frames:array<{FRAME_TYPE}>>"
)

# Line patterns of each tool's output.
TSC = r"^([^\r\n]+?)\((\d+),(\d+)\):\s*error\s+(TS\d+):\s*([^\r\n]+)\z"
TSC_SUMMARY = r"(?i)Found\s+(\d+)\s+errors?\s+in\s+(\d+)\s+files?"
ESLINT_ISSUE = r"^\s*(\d+):(\d+)\s+(error|warning)\s+([^\r\n]+?)\s{2,}(\S+)\s*\z"
ESLINT_TOTAL = r"(\d+)\s+problems?\s+\((\d+)\s+errors?,\s+(\d+)\s+warnings?\)"
ESLINT_FILE = r"^[\w./\\]"
NPM_CODE = r"(?i)npm\s+(?:error|ERR!)\s+code\s+(\w+)"
NPM_404 = r"(?i)404\s+Not Found[^\r\n]*?-\s*GET\s+(https?://\S+)"
NPM_PACKAGE = r"(?i)'([^']+)@[^']*'\s+is not in this registry"
NPM_PEER = r"(?is)Could not resolve dependency(?>.*?\n).*?peer\s+(\S+)\s+\"([^\"]+)\""
NPM_SCRIPT = r"(?i)Missing script:\s*\"([^\"]+)\""
NPM_ANY = r"(?i)npm\s+(?:error|ERR!)"
NPM_PREFIX = r"(?is)\A(.*?)npm\s+(?:error|ERR!)\s*"
PY_MARK = "Traceback (most recent call last):"
PY_FRAME = r"^\s*File\s+\"([^\"]+)\",\s+line\s+(\d+)(?:,\s+in\s+([^\r\n]+))?\z"
PY_ERROR = r"^(\w+(?:Error|Exception|Warning)):\s*([^\r\n]+)\z"
PY_TEST = r"FAILED\s+([^\s:]+)::(\S+)\s*-\s*(\w+)"
PY_PIP = r"(?m)^ERROR:\s*([^\r\n]+)"
JAVA_HEAD = r"(?:Exception in thread \"[^\"]+\"\s+)?([\w.]+(?:Exception|Error)):\s*([^\r\n]+)"
JAVA_FRAME = r"^\s+at\s+([\w.$]+)\(([^:)]+\.java):(\d+)\)\z"
JAVA_CAUSE = r"^Caused by:\s+([\w.]+(?:Exception|Error)):\s*([^\r\n]+)\z"
JAVAC = r"^([^\s:]+\.java):(\d+):\s+error:\s+([^\r\n]+)\z"
MAVEN = r"^\[ERROR\]\s+([^\s:]+\.java):\[(\d+),(\d+)\]\s+([^\r\n]+)\z"
GO_PANIC = r"(?m)^panic:\s*([^\r\n]+)"
GO_ROUTINE = r"(?m)^goroutine\s+\d+\s+\["
GO_FRAME = r"^\t([^\s:]+\.go):(\d+)\s+\+0x[0-9a-f]+\z"
GO_FUNC = r"^([\w./]+(?:\.\(?\*?[\w]+\)?)?\.[\w]+)\([^\r\n]*\)\z"
GO_COMPILE = r"^\.?/?([^\s:]+\.go):(\d+):(\d+):\s+([^\r\n]+)\z"
GO_TEST = r"(?m)^---\s+FAIL:\s+(\w+)\s+\(([\d.]+)s\)(?:\r|$)"
GO_DETAIL = r"^\s+([\w_]+\.go):(\d+):\s+([^\r\n]+)\z"
RUST_ERROR = r"^error(?:\[E(\d{4})\])?:\s*([^\r\n]+)\z"
RUST_ARROW = r"^\s*-->\s+([^:]+):(\d+):(\d+)\z"
RUST_PANIC = r"thread '([^']+)' panicked at (?:'([^']*)',\s*)?([^:]+):(\d+):(\d+)"
RUST_TEST = r"(?m)^test\s+([\w:]+)\s+\.\.\.\s+FAILED(?:\r|$)"
RUST_ASSERT = r"(?i)assertion[^\r\n]*failed"
RUST_DETAIL = r"(?i)assertion|left:|right:|expected|actual"
STACK_FRAME = r"^\s+at\s+(?:([^\r\n]+?)\s+\()?([^\r\n]+?):(\d+):(\d+)\)?\z"
ARROW_FRAME = r"^\s*❯\s+(?:(\S+)\s+)?([^\r\n]+?):(\d+):(\d+)\z"
FILE_NOTE = r"^\s*File:\s*([^\r\n]+?):(\d+):(\d+)"
ASSERTION = r"^(AssertionError)(?:\s*\[[^\r\n]*?\])?:\s*([^\r\n]+)\z"
ERROR_LINE = r"^(\w*Error):\s*([^\r\n]+)\z"
TEST_FILE = r"(?i)(?:FAIL|✕|×|✗)\s+([^\r\n]+\.(?:test|spec)\.\w+)"
TEST_NAME = r"(?m)(?:✕|×|✗|FAIL)\s+([^\r\n]+?)(?:\s+\(\d+\s*m?s\))?(?:\r|$)"
COUNTS_BAR = r"(?i)Tests\s+(\d+)\s+failed\s*\|\s*(\d+)\s+passed\s*\((\d+)\)"
COUNTS_TOTAL = (
    r"(?i)Tests?(?:\s+Files)?:\s+(?:(\d+)\s+failed,?\s*)?(?:(\d+)\s+passed,?\s*)?(\d+)\s+total"
)

# Lint rules whose findings the linter can repair by itself.
FIXABLE_RULES = [
    "semi", "quotes", "indent", "no-var", "prefer-const", "comma-dangle", "eol-last",
    "no-trailing-spaces", "no-multiple-empty-lines", "object-curly-spacing",
    "array-bracket-spacing", "arrow-parens", "space-before-function-paren", "keyword-spacing",
    "space-infix-ops", "no-extra-semi", "no-extra-parens", "prefer-arrow-callback",
    "arrow-body-style", "object-shorthand", "@typescript-eslint/semi",
    "@typescript-eslint/quotes", "@typescript-eslint/indent", "@typescript-eslint/comma-dangle",
]
FIXABLE_SUFFIX = " (auto-fixable with eslint --fix)"
MAX_WARNINGS = 5

# Message and detail of each package-manager error code.
NPM_TEXTS = {
    "missing_package": ("Package '", "' not found in the npm registry", "unknown package"),
    "peer": ("Peer dependency conflict: ", " requires \"", "\""),
    "peer_unknown": "Unable to resolve dependency tree — peer dependency conflict",
    "peer_hint": "Try: npm install --legacy-peer-deps",
    "access": "Permission denied during npm operation",
    "access_hint": "Fix permissions or use a different global prefix",
    "script": ("npm script '", "' not found in package.json"),
    "no_entry": "File or directory not found during npm operation",
    "integrity": "Package integrity check failed — corrupted cache",
    "integrity_hint": "Try: npm cache clean --force && npm install",
    "target": "Requested package version does not exist",
    "target_hint": "Check available versions: npm view <package> versions",
    "other": "npm error ",
    "separator": " — ",
}


def _null() -> Column:
    return F.lit(None).cast("string")


def no_frames() -> Column:
    return F.array().cast(f"array<{FRAME_TYPE}>")


def no_failures() -> Column:
    return F.array().cast(f"array<{FAILURE_TYPE}>")


def frame(function: Column, file: Column, line: Column, col: Column | None = None) -> Column:
    return F.struct(
        function.alias("function"),
        file.alias("file"),
        line.cast("int").alias("line"),
        (F.lit(None).cast("int") if col is None else col).alias("col"),
    ).cast(FRAME_TYPE)


def finished(failures: Column, root: Column, keep_paths: Column) -> Column:
    """Failures with ``is_project_file`` on every frame and, unless kept, resolved paths.

    One pass for all formats: the linter and the generic extractor show paths as printed.
    """

    def place(s: Column) -> Column:
        return let(
            resolve_path(s["file"], root),
            lambda full: F.struct(
                s["function"].alias("function"),
                F.when(keep_paths, s["file"]).otherwise(full).alias("file"),
                s["line"].alias("line"),
                s["col"].alias("col"),
                owned_path(s["file"], full, root).alias("is_project_file"),
            ),
        )

    return F.transform(
        failures, lambda f: f.withField("frames", F.transform(f["frames"], place))
    )


def failure(
    message: Column,
    error_type: Column,
    frames: Column,
    raw: Column | None = None,
    test_name: Column | None = None,
    test_file: Column | None = None,
) -> Column:
    return F.struct(
        (_null() if test_name is None else test_name).alias("test_name"),
        (_null() if test_file is None else test_file).alias("test_file"),
        message.alias("error_message"),
        error_type.alias("error_type"),
        (_null() if raw is None else raw).alias("raw_block"),
        frames.alias("frames"),
    ).cast(FAILURE_TYPE)


def blocks_by(lines: Column, is_head: Callable[[Column], Column]) -> Column:
    """``ARRAY<STRUCT<at, head, body>>``: each header line with the lines up to the next one."""
    heads = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda i: is_head(F.get(lines, i))
    )
    return let(
        heads,
        lambda h: F.transform(
            h,
            lambda at, k: F.struct(
                at.alias("at"),
                F.get(lines, at).alias("head"),
                F.slice(
                    lines, at + 2, F.coalesce(F.get(h, k + 1), F.size(lines)) - at - 1
                ).alias("body"),
            ),
        ),
    )


def positions(lines: Column, test: Callable[[Column], Column], n: Column | None = None) -> Column:
    """Places of the lines that pass, among the first ``n`` if given."""
    n = F.size(lines) if n is None else n
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: test(F.get(lines, i)))


# ── compiler: one failure per matching line ──────────────────────────────────────────────


def tsc_failures(text: Column, lines: Column) -> Column:
    hits = F.filter(F.transform(lines, trimmed), lambda l: gated(l, "error", TSC))

    def build(l: Column) -> Column:
        file = F.regexp_extract(l, TSC, 1)
        row, col = captured_int(l, TSC, 2), captured_int(l, TSC, 3)
        code = F.regexp_extract(l, TSC, 4)
        message = F.concat(code, F.lit(": "), F.regexp_extract(l, TSC, 5))
        place = F.concat(
            F.lit("("), row.cast("string"), F.lit(","), col.cast("string"), F.lit("): error ")
        )
        return failure(
            message,
            F.lit("TypeError"),
            F.array(frame(_null(), file, row, col)),
            F.concat(file, place, message),
        )

    return F.transform(hits, build)


# ── linter: the file line is carried down to its findings ────────────────────────────────


def eslint_issues(lines: Column) -> Column:
    """``ARRAY<STRUCT<line_no, file, line, col, severity, message, rule>>`` of every finding."""

    def is_file(line: Column) -> Column:
        return let(
            trimmed(line),
            lambda t: t.rlike(ESLINT_FILE)
            & ~has(t, "  ")
            & ~t.rlike(ESLINT_ISSUE)
            & ~t.rlike(ESLINT_TOTAL),
        )

    def findings(block: Column) -> Column:
        body = F.transform(
            block["body"],
            lambda l, k: F.struct((block["at"] + 1 + k).alias("no"), l.alias("text")),
        )
        return F.transform(
            F.filter(body, lambda b: b["text"].rlike(ESLINT_ISSUE)),
            lambda b: F.struct(
                b["no"].cast("int").alias("line_no"),
                trimmed(block["head"]).alias("file"),
                captured_int(b["text"], ESLINT_ISSUE, 1).alias("line"),
                captured_int(b["text"], ESLINT_ISSUE, 2).alias("col"),
                F.regexp_extract(b["text"], ESLINT_ISSUE, 3).alias("severity"),
                F.regexp_extract(b["text"], ESLINT_ISSUE, 4).alias("message"),
                F.regexp_extract(b["text"], ESLINT_ISSUE, 5).alias("rule"),
            ),
        )

    return F.flatten(F.transform(blocks_by(lines, is_file), findings))


def eslint_kept(issues: Column) -> Column:
    """Errors only; when a run has warnings alone, its first five."""
    errors = F.filter(issues, lambda e: e["severity"] == "error")
    return let(
        errors,
        lambda e: F.when(F.size(e) > 0, e).otherwise(F.slice(issues, 1, MAX_WARNINGS)),
    )


def eslint_message(rule: Column, message: Column) -> Column:
    hint = F.when(rule.isin(FIXABLE_RULES), F.lit(FIXABLE_SUFFIX)).otherwise("")
    return F.concat(F.lit("["), rule, F.lit("] "), message, hint)


def eslint_failure(e: Column) -> Column:
    place = F.concat_ws(":", e["file"], e["line"].cast("string"), e["col"].cast("string"))
    return failure(
        eslint_message(e["rule"], e["message"]),
        F.when(e["severity"] == "error", "ESLintError").otherwise("ESLintWarning"),
        F.array(
            frame(_null(), e["file"], e["line"], e["col"])
        ),
        F.concat_ws(" ", place, e["severity"], e["message"], e["rule"]),
    )


def eslint_failures(text: Column, lines: Column) -> Column:
    return F.transform(let(eslint_issues(lines), eslint_kept), eslint_failure)


# ── package manager: at most one failure per run ─────────────────────────────────────────


def npm_failure(
    code: Column, package: Column, peer: Column, script: Column, note: Column, source: Column
) -> Column:
    """The failure of an error code; ``peer`` is a struct (by, of), all but ``source`` may be null."""
    t = NPM_TEXTS
    conflict = F.when(
        peer.isNotNull(),
        F.concat(F.lit(t["peer"][0]), peer["by"], F.lit(t["peer"][1]), peer["of"], F.lit(t["peer"][2])),
    ).otherwise(t["peer_unknown"])
    missing = F.when(
        script.isNotNull(), F.concat(F.lit(t["script"][0]), script, F.lit(t["script"][1]))
    ).otherwise(t["no_entry"])
    package = F.coalesce(package, F.lit(t["missing_package"][2]))
    message = (
        F.when(
            code == "E404",
            F.concat(F.lit(t["missing_package"][0]), package, F.lit(t["missing_package"][1])),
        )
        .when(code == "ERESOLVE", conflict)
        .when(code == "EACCES", t["access"])
        .when(code == "ENOENT", missing)
        .when(code == "EINTEGRITY", t["integrity"])
        .when(code == "ETARGET", t["target"])
        .otherwise(F.coalesce(note, F.concat(F.lit(t["other"]), code)))
    )
    detail = (
        F.when(code == "E404", source)
        .when(code == "ERESOLVE", t["peer_hint"])
        .when(code == "EACCES", t["access_hint"])
        .when(code == "EINTEGRITY", t["integrity_hint"])
        .when(code == "ETARGET", t["target_hint"])
        .otherwise("")
    )
    full = let(
        detail,
        lambda d: F.concat(
            code, F.lit(": "), message,
            F.when(d != "", F.concat(F.lit(t["separator"]), d)).otherwise(""),
        ),
    )
    return failure(full, F.lit("NpmError"), no_frames())


def npm_failures(text: Column, lines: Column) -> Column:
    peer = F.when(
        text.rlike(NPM_PEER),
        F.struct(
            F.regexp_extract(text, NPM_PEER, 1).alias("by"), F.regexp_extract(text, NPM_PEER, 2).alias("of")
        ),
    )
    notes = F.transform(
        F.filter(lines, lambda l: l.rlike(NPM_ANY)),
        lambda l: trimmed(F.regexp_replace(l, NPM_PREFIX, "$1")),
    )
    note = F.get(
        F.filter(notes, lambda n: (n != "") & ~F.startswith(n, F.lit("code"))), F.lit(0)
    )
    code = F.regexp_extract(text, NPM_CODE, 1)
    return F.transform(
        F.filter(F.array(code), lambda c: c != ""),
        lambda c: npm_failure(
            c, captured(text, NPM_PACKAGE), peer, captured(text, NPM_SCRIPT), note,
            F.regexp_extract(text, NPM_404, 1),
        ),
    )


# ── python ───────────────────────────────────────────────────────────────────────────────


def _python_frames(lines: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda l: gated(l, "File", PY_FRAME)),
        lambda l: frame(
            captured(l, PY_FRAME, 3),
            F.regexp_extract(l, PY_FRAME, 1),
            captured_int(l, PY_FRAME, 2),
        ),
    )


def _python_error_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, trimmed), lambda l: gated(l, ":", PY_ERROR))


def pytest_lines(text: Column) -> Column:
    return F.when(
        has(text, "FAILED"), F.regexp_extract_all(text, F.lit(PY_TEST), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def python_tracebacks(text: Column) -> Column:
    """Kept traceback blocks: those with a frame or an error line, in order."""

    def read(block: Column) -> Column:
        return let(
            lines_of(block),
            lambda ls: F.struct(
                F.try_element_at(_python_error_lines(ls), F.lit(-1)).alias("error"),
                _python_frames(ls).alias("frames"),
                F.concat(F.lit(PY_MARK), block).alias("raw"),
            ),
        )

    blocks = F.split(text, r"Traceback \(most recent call last\):")
    # The text before the first marker is not a block.
    found = F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), read)
    return F.filter(found, lambda b: b["error"].isNotNull() | (F.size(b["frames"]) > 0))


def python_traced(text: Column, lines: Column) -> Column:
    def pair(kept: Column, tests: Column) -> Column:
        # The k-th kept traceback belongs to the k-th FAILED line.
        return F.transform(
            kept,
            lambda b, k: failure(
                F.coalesce(captured(b["error"], PY_ERROR, 2), F.lit("Python error occurred")),
                F.coalesce(captured(b["error"], PY_ERROR, 1), F.lit("Exception")),
                b["frames"],
                b["raw"],
                captured(F.get(tests, k), PY_TEST, 2),
                captured(F.get(tests, k), PY_TEST, 1),
            ),
        )

    return let(
        pytest_lines(text), lambda tests: pair(python_tracebacks(text), tests)
    )


def _python_alone(text: Column, lines: Column) -> Column:
    pip = F.array(failure(F.regexp_extract(text, PY_PIP, 1), F.lit("PipError"), no_frames()))
    first = F.slice(positions(lines, lambda l: trimmed(l).rlike(PY_ERROR)), 1, 1)
    alone = F.transform(
        first,
        lambda at: failure(
            F.regexp_extract(trimmed(F.get(lines, at)), PY_ERROR, 2),
            F.regexp_extract(trimmed(F.get(lines, at)), PY_ERROR, 1),
            _python_frames(
                F.slice(lines, F.greatest(at - 3, F.lit(0)) + 1, F.least(at, F.lit(3)))
            ),
        ),
    )
    failed = F.transform(
        pytest_lines(text),
        lambda m: failure(
            F.concat(F.lit("Test failed: "), F.regexp_extract(m, PY_TEST, 3)),
            F.regexp_extract(m, PY_TEST, 3),
            no_frames(),
            None,
            F.regexp_extract(m, PY_TEST, 2),
            F.regexp_extract(m, PY_TEST, 1),
        ),
    )
    return F.when(gated(text, "ERROR:", PY_PIP), pip).otherwise(F.concat(alone, failed))


def python_standalone(text: Column, lines: Column) -> Column:
    """Installer errors, single error lines and FAILED lines of runs without a traceback."""
    return F.when(F.size(python_tracebacks(text)) > 0, no_failures()).otherwise(
        _python_alone(text, lines)
    )


def python_failures(text: Column, lines: Column) -> Column:
    return let(
        python_traced(text, lines),
        lambda t: F.when(F.size(t) > 0, t).otherwise(_python_alone(text, lines)),
    )


# ── java ─────────────────────────────────────────────────────────────────────────────────


def java_is_head(line: Column) -> Column:
    return (
        (has(line, "Exception:") | has(line, "Error:"))
        & ~F.startswith(line, F.lit(" "))
        & line.rlike(JAVA_HEAD)
    )


def java_compile_failures(lines: Column) -> Column:
    hits = F.filter(lines, lambda l: has(l, ".java:") & (l.rlike(JAVAC) | l.rlike(MAVEN)))

    def build(l: Column) -> Column:
        javac = l.rlike(JAVAC)

        def pick(a: Column, b: Column) -> Column:
            return F.when(javac, a).otherwise(b)

        file = pick(F.regexp_extract(l, JAVAC, 1), F.regexp_extract(l, MAVEN, 1))
        return failure(
            pick(F.regexp_extract(l, JAVAC, 3), F.regexp_extract(l, MAVEN, 4)),
            F.lit("CompilerError"),
            F.array(
                frame(
                    _null(),
                    file,
                    pick(captured_int(l, JAVAC, 2), captured_int(l, MAVEN, 2)),
                    pick(F.lit(None).cast("int"), captured_int(l, MAVEN, 3)),
                )
            ),
            l,
        )

    return F.transform(hits, build)


def java_exception_failures(lines: Column) -> Column:
    def build(b: Column) -> Column:
        stack = F.filter(b["body"], lambda l: gated(l, ".java:", JAVA_FRAME))
        return let(
            stack,
            lambda s: failure(
                F.regexp_extract(b["head"], JAVA_HEAD, 2),
                F.regexp_extract(b["head"], JAVA_HEAD, 1),
                F.transform(
                    s,
                    lambda l: frame(
                        F.regexp_extract(l, JAVA_FRAME, 1),
                        F.regexp_extract(l, JAVA_FRAME, 2),
                        captured_int(l, JAVA_FRAME, 3),
                    ),
                ),
                F.array_join(F.concat(F.array(b["head"]), s), "\n"),
            ),
        )

    return F.transform(blocks_by(lines, java_is_head), build)


def java_failures(text: Column, lines: Column) -> Column:
    return let(
        java_compile_failures(lines),
        lambda c: F.when(F.size(c) > 0, c).otherwise(java_exception_failures(lines)),
    )


# ── go ───────────────────────────────────────────────────────────────────────────────────


def go_compile_failures(lines: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda l: gated(l, ".go:", GO_COMPILE)),
        lambda l: failure(
            F.regexp_extract(l, GO_COMPILE, 4),
            F.lit("CompilerError"),
            F.array(
                frame(
                    _null(),
                    F.regexp_extract(l, GO_COMPILE, 1),
                    captured_int(l, GO_COMPILE, 2),
                    captured_int(l, GO_COMPILE, 3),
                )
            ),
            l,
        ),
    )


def go_panic_failures(text: Column, lines: Column) -> Column:
    marks = F.filter(lines, lambda l: l.rlike(GO_FUNC) | l.rlike(GO_FRAME))

    def stack(m: Column) -> Column:
        # A frame takes the function line right before it among the marker lines;
        # another frame in between has used it up.
        paired = F.transform(
            m, lambda l, k: F.struct(l.alias("text"), F.get(m, k - 1).alias("before"))
        )
        return F.transform(
            F.filter(paired, lambda p: p["text"].rlike(GO_FRAME)),
            lambda p: frame(
                captured(p["before"], GO_FUNC),
                F.regexp_extract(p["text"], GO_FRAME, 1),
                captured_int(p["text"], GO_FRAME, 2),
            ),
        )

    one = failure(F.regexp_extract(text, GO_PANIC, 1), F.lit("panic"), let(marks, stack))
    return F.when(
        gated(text, "panic:", GO_PANIC) & gated(text, "goroutine", GO_ROUTINE), F.array(one)
    ).otherwise(no_failures())


def go_test_failures(text: Column, lines: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(GO_TEST), F.lit(1))
    marks = positions(lines, lambda l: has(l, "--- FAIL: "))

    def build(name: Column, at: Column) -> Column:
        near = F.filter(
            # Nine look-ups: a slice would copy the whole array first.
            F.when(
                at.isNotNull(),
                F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.get(lines, at + k)),
            ).otherwise(F.array().cast("array<string>")),
            lambda l: F.coalesce(gated(l, ".go:", GO_DETAIL), F.lit(False)),
        )
        return let(
            near,
            lambda d: failure(
                F.coalesce(
                    F.regexp_extract(F.get(d, F.lit(0)), GO_DETAIL, 3),
                    F.concat(F.lit("Test "), name, F.lit(" failed")),
                ),
                F.lit("TestFailure"),
                F.transform(
                    d,
                    lambda l: frame(
                        name,
                        F.regexp_extract(l, GO_DETAIL, 1),
                        captured_int(l, GO_DETAIL, 2),
                    ),
                ),
                None,
                name,
            ),
        )

    # Bound once each: a lambda would evaluate them anew for every element.
    found = let(
        names,
        lambda n: let(
            F.array_distinct(F.transform(n, F.length)),
            lambda sizes: let(marks, lambda m: go_first_lines(n, sizes, lines, m)),
        ),
    )
    return let(found, lambda all_: F.transform(all_, lambda f: build(f["name"], f["at"])))


def steps(low: Column, high: Column) -> Column:
    """The integers from ``low`` to ``high``, none if they cross."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(
        F.array().cast("array<int>")
    )


def go_first_lines(names: Column, lengths: Column, lines: Column, marks: Column) -> Column:
    """(nth, name, at) per failing test: the first line that names it after the marker.

    Any word that starts with the name will do, so 'TestAB' also answers for 'TestA'. Words are
    cut to the lengths that names have, and one sort brings each name behind its first cut; a
    comparison of all names with all lines would cost the square.
    """

    def cuts(i: Column) -> Column:
        words = F.regexp_extract_all(F.get(lines, i), F.lit(r"--- FAIL: (\w+)"), F.lit(1))
        return F.flatten(
            F.transform(
                words,
                lambda w: F.transform(
                    F.filter(lengths, lambda n: n <= F.length(w)),
                    lambda n: F.struct(F.left(w, n).alias("word"), i.alias("at")),
                ),
            )
        )

    def first_of_each(c: Column) -> Column:
        return F.filter(
            c, lambda x, k: (k == 0) | (F.coalesce(F.get(c, k - 1)["word"], F.lit("")) != x["word"])
        )

    def merged(c: Column) -> Column:
        wanted = F.transform(
            names,
            lambda n, k: F.struct(
                n.alias("word"), F.lit(1).alias("kind"), k.alias("nth"), F.lit(None).cast("int").alias("at")
            ),
        )
        known = F.transform(
            c,
            lambda x: F.struct(
                x["word"].alias("word"), F.lit(0).alias("kind"), F.lit(-1).alias("nth"), x["at"].alias("at")
            ),
        )
        return F.sort_array(F.concat(known, wanted))

    def answers(both: Column) -> Column:
        # The entries of kind 0, by place: each is followed by the tests of its name.
        heads = F.filter(F.transform(both, lambda x, k: F.when(x["kind"] == 0, k)), lambda k: k.isNotNull())
        return let(
            heads,
            lambda h: F.flatten(
                F.transform(
                    h,
                    lambda k, j: F.transform(
                        steps(k + 1, F.coalesce(F.get(h, j + 1), F.size(both)) - 1),
                        lambda p: F.struct(
                            F.get(both, p)["nth"].alias("nth"),
                            F.get(both, p)["word"].alias("name"),
                            F.get(both, k)["at"].alias("at"),
                        ),
                    ),
                )
            ),
        )

    cut = F.sort_array(F.flatten(F.transform(marks, cuts)))
    return let(cut, lambda c: let(merged(first_of_each(c)), lambda b: F.sort_array(answers(b))))


def go_failures(text: Column, lines: Column) -> Column:
    return let(
        go_compile_failures(lines),
        lambda c: F.when(F.size(c) > 0, c).otherwise(
            let(
                go_panic_failures(text, lines),
                lambda p: F.when(F.size(p) > 0, p).otherwise(
                    go_test_failures(text, lines)
                ),
            )
        ),
    )


# ── rust ─────────────────────────────────────────────────────────────────────────────────


def rust_compile_failures(lines: Column, own: Column | None = None) -> Column:
    """Failures of the error lines, of those among the first ``own`` lines if given."""
    heads = positions(lines, lambda l: gated(l, "error", r"^\s*error") & trimmed(l).rlike(RUST_ERROR), own)

    def build(at: Column) -> Column:
        head = trimmed(F.get(lines, at))
        code = F.concat(F.lit("E"), captured(head, RUST_ERROR, 1))
        arrow = F.get(
            F.filter(F.slice(lines, at + 2, 4), lambda l: gated(l, "-->", RUST_ARROW)), F.lit(0)
        )
        place = F.filter(
            F.transform(
                F.array(arrow),
                lambda a: frame(
                    _null(),
                    F.regexp_extract(a, RUST_ARROW, 1),
                    captured_int(a, RUST_ARROW, 2),
                    captured_int(a, RUST_ARROW, 3),
                ),
            ),
            lambda f: f["line"].isNotNull() & (f["line"] != 0),
        )
        text = F.regexp_extract(head, RUST_ERROR, 2)
        return failure(
            F.coalesce(F.concat(code, F.lit(": "), text), text),
            F.coalesce(
                F.concat(F.lit("RustError["), code, F.lit("]")), F.lit("RustError")
            ),
            place,
            F.array_join(F.slice(lines, at + 1, 10), "\n"),
        )

    return F.transform(heads, build)


def rust_panic_failures(text: Column, lines: Column) -> Column:
    thread = F.regexp_extract(text, RUST_PANIC, 1)
    said = captured(text, RUST_PANIC, 2)
    file = F.regexp_extract(text, RUST_PANIC, 3)
    details = F.transform(F.filter(lines, lambda l: l.rlike(RUST_DETAIL)), trimmed)
    joined = F.nullif(F.array_join(details, "; "), F.lit(""))
    message = F.when(said.isNull() | text.rlike(RUST_ASSERT), F.coalesce(joined, said)).otherwise(
        said
    )
    one = failure(
        F.coalesce(message, F.concat(F.lit("panic in thread '"), thread, F.lit("'"))),
        F.lit("panic"),
        F.array(
            frame(
                F.nullif(thread, F.lit("main")),
                file,
                captured_int(text, RUST_PANIC, 4),
                captured_int(text, RUST_PANIC, 5),
            )
        ),
        None,
        captured(text, RUST_TEST),
    )
    return F.when(gated(text, "panicked at", RUST_PANIC), F.array(one)).otherwise(no_failures())


def rust_failures(text: Column, lines: Column) -> Column:
    return let(
        rust_compile_failures(lines),
        lambda c: F.when(F.size(c) > 0, c).otherwise(rust_panic_failures(text, lines)),
    )


# ── generic: test runners, bundlers, node and everything unknown ─────────────────────────

# A marker opens a block only where text precedes it: at offset 0 it does not split.
_AFTER = [
    ("FAIL", r"\WFAIL\s", r"(?<!\w)(?=FAIL\s)", r"\AFAIL\s"),
    ("Error:", r"[\n\r\u2028\u2029]\w*Error:", r"(?<=[\n\r\u2028\u2029])(?=\w*Error:)", r"\A\w*Error:"),
    (None, r"(?s).[✕×✗]\s", r"(?=[✕×✗]\s)", r"\A[✕×✗]\s"),
]


def split_strategy(text: Column) -> Column:
    chosen = None
    for number, (literal, inside, _, _) in enumerate(_AFTER, 1):
        test = gated(text, literal, inside) if literal else text.rlike(inside)
        chosen = F.when(test, number) if chosen is None else chosen.when(test, number)
    return chosen.otherwise(len(_AFTER) + 1)


def _sections(text: Column, boundary: str, head: str) -> Column:
    return F.filter(F.split(text, boundary), lambda s: s.rlike(head))


def failure_blocks(text: Column) -> Column:
    """Blocks of the first strategy that cuts the text; sections without the marker go."""

    def cut(strategy: Column) -> Column:
        chosen = None
        for number, (_, _, boundary, head) in enumerate(_AFTER, 1):
            parts = _sections(text, boundary, head)
            test = strategy == number
            chosen = F.when(test, parts) if chosen is None else chosen.when(test, parts)
        return chosen.otherwise(F.array(text))

    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(
        let(split_strategy(text), cut)
    )


def error_of(lines: Column) -> Column:
    """``STRUCT<error_type, error_message>`` of a block's first error line."""
    clean = F.transform(lines, trimmed)

    def read(ls: Column) -> Column:
        hit = F.get(
            F.filter(
                ls, lambda l: has(l, "Error") & (l.rlike(ASSERTION) | l.rlike(ERROR_LINE))
            ),
            F.lit(0),
        )
        first = F.get(F.filter(ls, lambda l: l != ""), F.lit(0))
        return let(
            hit,
            lambda h: F.struct(
                F.coalesce(captured(h, ASSERTION, 1), captured(h, ERROR_LINE, 1)).alias(
                    "error_type"
                ),
                F.coalesce(
                    captured(h, ASSERTION, 2),
                    captured(h, ERROR_LINE, 2),
                    first,
                    F.lit("Unknown error"),
                ).alias("error_message"),
            ),
        )

    return let(clean, read)


def frames_of(lines: Column) -> Column:
    """Frames of the three generic shapes; the first shape that fits a line wins."""
    shapes = [(STACK_FRAME, 1, "at"), (ARROW_FRAME, 1, "❯"), (FILE_NOTE, 0, "File:")]
    hits = F.filter(
        lines,
        lambda l: (gated(l, "at", STACK_FRAME))
        | gated(l, "❯", ARROW_FRAME)
        | gated(l, "File:", FILE_NOTE),
    )

    def read(l: Column) -> Column:
        chosen = None
        for pattern, shift, _ in shapes:
            file = F.regexp_extract(l, pattern, 1 + shift)
            built = frame(
                captured(l, pattern, 1) if shift else _null(),
                file,
                captured_int(l, pattern, 2 + shift),
                captured_int(l, pattern, 3 + shift),
            )
            test = l.rlike(pattern)
            chosen = F.when(test, built) if chosen is None else chosen.when(test, built)
        return chosen

    return F.transform(hits, read)


def generic_failures(text: Column, lines: Column) -> Column:
    def build(block: Column) -> Column:
        return let(
            lines_of(block),
            lambda ls: let(
                error_of(ls),
                lambda e: failure(
                    e["error_message"],
                    e["error_type"],
                    frames_of(ls),
                    block,
                    captured(block, TEST_NAME),
                    captured(block, TEST_FILE),
                ),
            ),
        )

    return F.transform(failure_blocks(text), build)


EXTRACTORS = {
    "typescript": tsc_failures,
    "eslint": eslint_failures,
    "npm": npm_failures,
    "python": python_failures,
    "go": go_failures,
    "rust": rust_failures,
    "java": java_failures,
}
