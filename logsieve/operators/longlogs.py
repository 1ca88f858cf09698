"""Failures of logs that are too long for one row, from their lines.

A log's lines are cut into chunks. Every chunk is parsed on its own, with a few lines of look-ahead and
look-back, into small partial results; a block that reaches over chunks leaves one piece in each.
What a chunk has to know of the text before it (the block that is open, the last file line, the last
stack line) is folded over one small row per chunk, and pieces of a block are joined by folds that take
them in any grouping: first or last of a value, lists in order, or. No step holds more of a log than
one chunk, except the text of a single block, which is whole however many lines it has.

The results are those of the run grain (``parse.failures_of`` and ``parse.frames_of``) for a text whose
lines are the given ones. A pattern that spans lines is seen when it ends within ``AFTER`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.text import captured, captured_int, each, gated, has, let, lines_of, owned_path, resolve_path, reusable, trimmed
from logsieve.operators import extract as X
from logsieve.operators.detect import BUILD_HEAD, MARKS, build_tested, format_by
from logsieve.operators.infer import SYNTAX_RAW, UNHANDLED_RAW, raw_test
from logsieve.operators.scan import before_chunks, numbered
from logsieve.sources.sinks import stage

#: Lines of a chunk, and lines that a chunk sees behind and before its own.
CHUNK, AFTER, BEFORE = 10_000, 9, 3
#: A line that cannot be a file name stands for the file line of an earlier chunk.
CARRIED_FILE = "/\x01"
# Fixed value: the two ends of a peer conflict, each on a line of its own.
PEER_HEAD = r"(?i)Could not resolve dependency"
PEER = r"(?i)peer\s+(\S+)\s+\"([^\"]+)\""

PIECE = (
    "struct<head:boolean,error_type:string,error_message:string,first:string,test_name:string,test_file:string,"
    f"frames:array<{X.FRAME_TYPE}>,raw:string,raw_syntax:boolean,raw_unhandled:boolean>"
)
#: Rows that a group of failures keeps; groups not named keep all. (priority, group) -> rows.
LIMITS = {("eslint", 1, 0): X.MAX_WARNINGS, ("python", 1, 0): 1, ("python", 2, 0): 1}


def chunk_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """(run_id, project_root, line_no, line) -> one row per chunk of ``size`` lines with ``own``,
    ``before`` and ``after`` lines. Line numbers of a run count from 0 without gaps."""
    chunks = f"explode(sequence(greatest(0, line_no - {AFTER}) div {size}, (line_no + {BEFORE}) div {size}))"
    spread = lines.select("run_id", "project_root", F.col("line_no").cast("long").alias("line_no"), "line").select("*", F.expr(chunks).alias("chunk"))
    gathered = spread.groupBy("run_id", "project_root", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("all")
    )
    part = lambda test: F.transform(F.filter("all", lambda x: test(F.floor(x["line_no"] / size))), lambda x: x["line"])
    return gathered.select(
        "run_id", "project_root", "chunk", part(lambda c: c < F.col("chunk")).alias("before"),
        part(lambda c: c == F.col("chunk")).alias("own"), part(lambda c: c > F.col("chunk")).alias("after"),
    ).where(F.size("own") > 0)


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _strategies(text: Column) -> list[Column]:
    """Whether each way to cut a text applies; the text begins with a line feed unless it starts the run."""
    return [gated(text, literal, inside) if literal else text.rlike(inside) for literal, inside, _, _ in X._AFTER]


def run_facts(chunks: DataFrame, size: int) -> DataFrame:
    """One row per run: format, way to cut blocks, and what the rules need from the whole text."""
    seen = chunks.select("run_id", "chunk", _join(F.concat("own", "after")).alias("text"), "own", "after")
    cut = F.concat(F.when(F.col("chunk") > 0, "\n").otherwise(""), _join(F.col("own")), F.when(F.size("after") > 0, "\n").otherwise(""))
    marks = [F.bool_or(test(F.col("text"))).alias(name) for name, test in MARKS.items()]
    ways = [F.bool_or(test).alias(f"way_{k}") for k, test in enumerate(_strategies(F.col("cut")), 1)]
    facts = seen.withColumn("cut", cut).groupBy("run_id").agg(
        *marks, *ways,
        F.bool_or(raw_test(F.col("text"), SYNTAX_RAW)).alias("text_syntax"),
        F.bool_or(raw_test(F.col("text"), UNHANDLED_RAW)).alias("text_unhandled"),
        F.bool_and(trimmed(F.col("cut")) == "").alias("blank"),
    )
    # Every line has a character, its end, so the text's head lies in as many lines.
    head = chunks.where(F.col("chunk") <= BUILD_HEAD // size).select(
        "run_id", "chunk", F.transform(F.slice("own", 1, BUILD_HEAD), lambda l: F.substring(l, 1, BUILD_HEAD)).alias("own")
    ).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "own"))).alias("head"))
    head = head.select(F.col("run_id").alias("head_run"), _join(F.flatten("head.own")).alias("head"))
    way = F.lit(len(X._AFTER) + 1)
    for k in range(len(X._AFTER), 0, -1):
        way = F.when(F.col(f"way_{k}"), k).otherwise(way)
    return facts.join(head, facts["run_id"].eqNullSafe(F.col("head_run")), "left").select(
        "run_id", format_by(F.col, build_tested(F.col("head"))).alias("format"), way.alias("way"), "blank", "text_syntax", "text_unhandled"
    )


# ── pieces of blocks ─────────────────────────────────────────────────────────────────────


def _piece(head: Column, raw: Column, frames: Column, error_type=None, message=None, first=None, name=None, file=None, hints=None) -> Column:
    none = F.lit(None).cast("string")
    hints = raw if hints is None else hints
    values = [none if v is None else v for v in (error_type, message, first, name, file)]
    return F.struct(head, *values, frames, raw, raw_test(hints, SYNTAX_RAW), raw_test(hints, UNHANDLED_RAW)).cast(PIECE)


def _python_pieces(own: Column, first_chunk: Column) -> Column:
    def read(block: Column, k: Column) -> Column:
        return let(
            F.try_element_at(X._python_error_lines(lines_of(block)), F.lit(-1)),
            lambda error: _piece(
                k > 0, F.concat(F.when(k > 0, F.lit(X.PY_MARK)).otherwise("\n"), block), X._python_frames(lines_of(block)),
                captured(error, X.PY_ERROR, 1), captured(error, X.PY_ERROR, 2),
            ),
        )

    return F.transform(F.split(_join(own), r"Traceback \(most recent call last\):"), read)


def _java_pieces(own: Column, first_chunk: Column) -> Column:
    def stack(lines: Column) -> Column:
        return F.filter(lines, lambda l: gated(l, ".java:", X.JAVA_FRAME))

    def frames(s: Column) -> Column:
        return F.transform(s, lambda l: X.frame(F.regexp_extract(l, X.JAVA_FRAME, 1), F.regexp_extract(l, X.JAVA_FRAME, 2), captured_int(l, X.JAVA_FRAME, 3)))

    def raw(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda l: F.concat(F.lit("\n"), l)), "")

    def blocks(found: Column) -> Column:
        lead = F.slice(own, F.lit(1), F.coalesce(F.get(found, F.lit(0))["at"], F.size(own)))
        return F.concat(
            F.array(let(stack(lead), lambda s: _piece(F.lit(False), raw(s), frames(s)))),
            F.transform(found, lambda b: let(stack(b["body"]), lambda s: _piece(
                F.lit(True), F.concat(b["head"], raw(s)), frames(s),
                F.regexp_extract(b["head"], X.JAVA_HEAD, 1), F.regexp_extract(b["head"], X.JAVA_HEAD, 2),
            ))),
        )

    return let(X.blocks_by(own, X.java_is_head), blocks)


def _generic_pieces(own: Column, after: Column, first_chunk: Column, way: Column) -> Column:
    """Pieces with the lines behind them, as far as no other block begins there."""
    text = F.concat(F.when(first_chunk, "").otherwise("\n"), _join(own))
    seen = F.concat(text, F.when(F.size(after) > 0, F.concat(F.lit("\n"), _join(after))).otherwise(""))

    def cut(t: Column) -> Column:
        parts = None
        for number, (_, _, boundary, head) in enumerate(X._AFTER, 1):
            found = F.transform(F.split(t["seen"], boundary), lambda p: F.struct(p.alias("seen"), p.rlike(head).alias("head")))
            parts = F.when(way == number, found) if parts is None else parts.when(way == number, found)
        parts = parts.otherwise(F.array(F.struct(t["seen"].alias("seen"), first_chunk.alias("head"))))
        return let(parts, lambda p: let(starts(p), lambda s: F.transform(
            F.filter(F.arrays_zip(p.alias("p"), s.alias("s")), lambda z: (z["s"] == 0) | (z["s"] < t["size"])),
            lambda z: read(z["p"]["seen"], F.left(z["p"]["seen"], F.least(F.length(z["p"]["seen"]), t["size"] - z["s"])), z["p"]["head"]),
        )))

    def starts(parts: Column) -> Column:
        summed = F.aggregate(
            parts, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("sum")),
            lambda acc, p: F.struct(F.concat(acc["at"], F.array(acc["sum"])).alias("at"), (acc["sum"] + F.length(p["seen"])).alias("sum")),
        )
        return summed["at"]

    def read(whole: Column, mine: Column, head: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            clean = F.transform(lines, trimmed)
            hit = F.get(F.filter(clean, lambda l: has(l, "Error") & (l.rlike(X.ASSERTION) | l.rlike(X.ERROR_LINE))), F.lit(0))
            return let(hit, lambda h: _piece(
                head, mine, X.frames_of(lines),
                F.coalesce(captured(h, X.ASSERTION, 1), captured(h, X.ERROR_LINE, 1)),
                F.coalesce(captured(h, X.ASSERTION, 2), captured(h, X.ERROR_LINE, 2)),
                F.get(F.filter(clean, lambda l: l != ""), F.lit(0)),
                captured(whole, X.TEST_NAME), captured(whole, X.TEST_FILE), whole,
            ))

        return let(lines_of(mine), of_lines)

    return let(F.struct(seen.alias("seen"), F.length(text).alias("size")), cut)


# ── one chunk ────────────────────────────────────────────────────────────────────────────


def _local(own: Column, before: Column, after: Column) -> Column:
    """Failures that lie in a few lines: ``ARRAY<STRUCT<priority, grp, f>>`` by format."""
    kind = f"array<struct<priority:int,grp:int,f:{X.FAILURE_TYPE}>>"

    def of(failures: Column, priority: int, grp: int = 0) -> Column:
        return F.transform(failures, lambda f: F.struct(F.lit(priority).alias("priority"), F.lit(grp).alias("grp"), f.alias("f")))

    text = _join(own)
    pip = F.when(gated(text, "ERROR:", X.PY_PIP), F.array(X.failure(F.regexp_extract(text, X.PY_PIP, 1), F.lit("PipError"), X.no_frames()))).otherwise(X.no_failures())

    def alone_in(near: Column) -> Column:
        first = F.slice(F.filter(X.positions(near, lambda l: trimmed(l).rlike(X.PY_ERROR)), lambda at: at >= F.size(before)), 1, 1)
        return F.transform(first, lambda at: X.failure(
            F.regexp_extract(trimmed(F.get(near, at)), X.PY_ERROR, 2), F.regexp_extract(trimmed(F.get(near, at)), X.PY_ERROR, 1),
            X._python_frames(F.slice(near, F.greatest(at - 3, F.lit(0)) + 1, F.least(at, F.lit(3)))),
        ))

    # Lists that are put together are bound once: a lambda would put them together anew for every line.
    alone = let(F.concat(before, own), alone_in)
    failed = F.transform(X.pytest_lines(text), lambda m: X.failure(
        F.concat(F.lit("Test failed: "), F.regexp_extract(m, X.PY_TEST, 3)), F.regexp_extract(m, X.PY_TEST, 3), X.no_frames(), None,
        F.regexp_extract(m, X.PY_TEST, 2), F.regexp_extract(m, X.PY_TEST, 1),
    ))
    fmt = F.col("format")
    return (
        F.when(fmt == "typescript", of(X.tsc_failures(text, own), 0))
        .when(fmt == "python", F.concat(of(pip, 1), of(alone, 2), of(failed, 2, 1)))
        .when(fmt == "java", of(X.java_compile_failures(own), 0))
        .when(fmt == "go", of(X.go_compile_failures(own), 0))
        .when(fmt == "rust", of(let(F.concat(own, after), lambda near: X.rust_compile_failures(near, F.size(own))), 0))
        .otherwise(F.array()).cast(kind)
    )


@reusable
def _chunk_columns() -> list[Column]:
    own, before, after, first = F.col("own"), F.col("before"), F.col("after"), F.col("chunk") == 0
    fmt, seen = F.col("format"), _join(F.concat("own", "after"))
    special = ["typescript", "eslint", "npm", "python", "go", "rust", "java"]
    pieces = (
        F.when(fmt == "python", _python_pieces(own, first)).when(fmt == "java", _java_pieces(own, first))
        .when(fmt.isin(special), F.array().cast(f"array<{PIECE}>")).otherwise(_generic_pieces(own, after, first, F.col("way")))
    )
    issues = let(F.when(first, own).otherwise(F.concat(F.array(F.lit(CARRIED_FILE)), own)), X.eslint_issues)
    is_file = lambda l: let(trimmed(l), lambda t: t.rlike(X.ESLINT_FILE) & ~has(t, "  ") & ~t.rlike(X.ESLINT_ISSUE) & ~t.rlike(X.ESLINT_TOTAL))
    stack = let(
        F.filter(own, lambda l: l.rlike(X.GO_FUNC) | l.rlike(X.GO_FRAME)),
        lambda s: F.transform(s, lambda l, k: F.struct(l.alias("text"), F.get(s, k - 1).alias("above"))),
    )
    named = let(F.concat(own, after), lambda near: F.transform(
        X.positions(own, lambda l: has(l, "--- FAIL: ")),
        lambda i: F.struct(
            F.regexp_extract_all(F.get(own, i), F.lit(r"--- FAIL: (\w+)"), F.lit(1)).alias("words"),
            F.transform(
                F.filter(
                    F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.get(near, i + k)),
                    lambda l: F.coalesce(gated(l, ".go:", X.GO_DETAIL), F.lit(False)),
                ),
                lambda l: F.struct(F.regexp_extract(l, X.GO_DETAIL, 3).alias("message"), X.frame(F.lit(None).cast("string"), F.regexp_extract(l, X.GO_DETAIL, 1), captured_int(l, X.GO_DETAIL, 2)).alias("frame")),
            ).alias("details"),
        ),
    ))
    npm = fmt == "npm"
    after_head = F.slice(own, F.coalesce(F.get(X.positions(own, lambda l: l.rlike(PEER_HEAD)), F.lit(0)), F.size(own)) + 2, F.size(own))
    peer = lambda lines: F.get(F.transform(F.filter(lines, lambda l: l.rlike(PEER)), lambda l: F.struct(F.regexp_extract(l, PEER, 1).alias("by"), F.regexp_extract(l, PEER, 2).alias("of"))), F.lit(0))
    notes = F.transform(F.filter(own, lambda l: l.rlike(X.NPM_ANY)), lambda l: trimmed(F.regexp_replace(l, X.NPM_PREFIX, "$1")))
    note = F.get(F.filter(notes, lambda n: (n != "") & ~F.startswith(n, F.lit("code"))), F.lit(0))
    go, rust = fmt == "go", fmt == "rust"
    details = F.transform(F.filter(own, lambda l: l.rlike(X.RUST_DETAIL)), trimmed)
    panic = F.when(rust & gated(seen, "panicked at", X.RUST_PANIC), F.struct(
        F.regexp_extract(seen, X.RUST_PANIC, 1).alias("thread"), captured(seen, X.RUST_PANIC, 2).alias("said"),
        F.regexp_extract(seen, X.RUST_PANIC, 3).alias("file"), captured_int(seen, X.RUST_PANIC, 4).alias("line"), captured_int(seen, X.RUST_PANIC, 5).alias("col"),
    ))
    return [
        _local(own, before, after).alias("local"), pieces.alias("pieces"),
        F.when(fmt == "eslint", issues).alias("issues"),
        F.when(fmt == "eslint", trimmed(F.try_element_at(F.filter(own, is_file), F.lit(-1)))).alias("last_file"),
        F.when(go, stack).alias("stack"),
        F.when(go, captured(seen, X.GO_PANIC)).alias("go_panic"), F.when(go, gated(seen, "goroutine", X.GO_ROUTINE)).alias("go_routine"),
        F.when(go, named).alias("named"), F.when(go, F.regexp_extract_all(_join(own), F.lit(X.GO_TEST), F.lit(1))).alias("tests"),
        panic.alias("panic"), F.when(rust, captured(seen, X.RUST_TEST)).alias("rust_test"),
        F.when(rust, seen.rlike(X.RUST_ASSERT)).alias("rust_assert"), F.when(rust, details).alias("rust_details"),
        F.when(npm, captured(seen, X.NPM_CODE)).alias("npm_code"), F.when(npm, captured(seen, X.NPM_PACKAGE)).alias("npm_package"),
        F.when(npm, captured(seen, X.NPM_SCRIPT)).alias("npm_script"), F.when(npm, captured(seen, X.NPM_404)).alias("npm_404"),
        F.when(npm, note).alias("npm_note"), F.when(npm, F.exists(own, lambda l: l.rlike(PEER_HEAD))).alias("peer_head"),
        F.when(npm, peer(own)).alias("peer_any"), F.when(npm, peer(after_head)).alias("peer_after"),
    ]


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with their run's facts -> partial results, without the text but for the pieces' own."""
    return chunks.select("run_id", "project_root", "format", "chunk", *_chunk_columns())


# ── joining chunks ───────────────────────────────────────────────────────────────────────

KEY = ["run_id", "project_root", "format"]
ROW = [*KEY, "priority", "grp", "chunk", "idx"]
TEXTS = ["test_name", "test_file", "error_message", "error_type", "raw_block", "raw_syntax", "raw_unhandled"]


def _first(value: Column | str, chunk: str = "chunk") -> Column:
    """The value of the earliest chunk that has one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min(F.when(value.isNotNull(), F.struct(F.col(chunk), value.alias("v"))))["v"]


def _last(value: str) -> Column:
    return F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("chunk"), F.col(value).alias("v"))))["v"]


def _failure_row(f: Column) -> list[Column]:
    block = f["raw_block"]
    return [
        *[f[c].alias(c) for c in TEXTS[:5]],
        raw_test(block, SYNTAX_RAW).alias("raw_syntax"), raw_test(block, UNHANDLED_RAW).alias("raw_unhandled"), f["frames"].alias("frames"),
    ]


def _local_rows(parsed: DataFrame) -> DataFrame:
    rows = each(parsed, "local", "idx", "x", *KEY, "chunk")
    return rows.select(*KEY, F.col("x.priority").alias("priority"), F.col("x.grp").alias("grp"), "chunk", "idx", *_failure_row(F.col("x.f")))


def _eslint_rows(parsed: DataFrame) -> DataFrame:
    carried = before_chunks(parsed.where("format = 'eslint'").select(*KEY, "chunk", "issues", "last_file"), ["run_id"], "chunk", carried=F.last("last_file", ignorenulls=True))
    rows = each(carried, "issues", "idx", "e", *KEY, "chunk", "carried")
    e = F.col("e").withField("file", F.when(F.col("e.file") == CARRIED_FILE, F.col("carried")).otherwise(F.col("e.file")))
    rows = rows.withColumn("e", e).where("e.file IS NOT NULL")
    priority = F.when(F.col("e.severity") == "error", 0).otherwise(1)
    return rows.select(*KEY, priority.alias("priority"), F.lit(0).alias("grp"), "chunk", "idx", X.eslint_failure(F.col("e")).alias("f")).select(
        *ROW, *_failure_row(F.col("f"))
    )


def _single(rows: DataFrame, priority: int, f: Column) -> DataFrame:
    """One failure of a run."""
    zero = [F.lit(v).cast(t).alias(n) for v, t, n in ((priority, "int", "priority"), (0, "int", "grp"), (0, "long", "chunk"), (0, "int", "idx"))]
    return rows.select(*KEY, *zero, f.alias("f")).select(*ROW, *_failure_row(F.col("f")))


def _npm_rows(parsed: DataFrame) -> DataFrame:
    mine = parsed.where("format = 'npm'").select(*KEY, "chunk", "npm_code", "npm_package", "npm_script", "npm_404", "npm_note", "peer_head", "peer_any", "peer_after")
    mine = before_chunks(mine, ["run_id"], "chunk", opened=F.max("peer_head"))
    peer = F.when(F.col("opened"), F.col("peer_any")).otherwise(F.col("peer_after"))
    run = mine.withColumn("peer", peer).groupBy(*KEY).agg(
        *[_first(c).alias(c) for c in ("npm_code", "npm_package", "npm_script", "npm_404", "npm_note", "peer")]
    ).where("npm_code IS NOT NULL")
    return _single(run, 0, X.npm_failure(
        F.col("npm_code"), F.col("npm_package"), F.col("peer"), F.col("npm_script"), F.col("npm_note"), F.coalesce("npm_404", F.lit(""))
    ))


def _rust_rows(parsed: DataFrame) -> DataFrame:
    mine = parsed.where("format = 'rust'")
    run = mine.groupBy(*KEY).agg(
        _first("panic").alias("panic"), _first("rust_test").alias("test"), F.bool_or("rust_assert").alias("asserts"),
    ).where("panic IS NOT NULL")
    # Only runs that panic gather the lines that say why; they become the message.
    told = mine.join(run.select(F.col("run_id").alias("of")), F.col("run_id").eqNullSafe(F.col("of")), "left_semi").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", F.col("rust_details").alias("d")))).alias("told")
    ).select(F.col("run_id").alias("of"), F.nullif(F.array_join(F.flatten("told.d"), "; "), F.lit("")).alias("joined"))
    p, said = F.col("panic"), F.col("panic.said")
    message = F.when(said.isNull() | F.col("asserts"), F.coalesce("joined", said)).otherwise(said)
    return _single(run.join(told, F.col("run_id").eqNullSafe(F.col("of")), "left"), 1, X.failure(
        F.coalesce(message, F.concat(F.lit("panic in thread '"), p["thread"], F.lit("'"))), F.lit("panic"),
        F.array(X.frame(F.nullif(p["thread"], F.lit("main")), p["file"], p["line"], p["col"])), None, F.col("test"),
    ))


def _go_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures of panics and tests, and the frames of the panics."""
    mine = parsed.where("format = 'go'")
    run = mine.groupBy(*KEY).agg(_first("go_panic").alias("panic"), F.bool_or("go_routine").alias("routine")).where("panic IS NOT NULL AND routine")
    panics = _single(run, 1, X.failure(F.col("panic"), F.lit("panic"), X.no_frames()))
    marks = before_chunks(mine.select(*KEY, "chunk", "stack"), ["run_id"], "chunk", above=F.last(F.try_element_at("stack", F.lit(-1))["text"], ignorenulls=True))
    marks = each(marks, "stack", "idx", "m", *KEY, "chunk", "above").where(F.col("m.text").rlike(X.GO_FRAME))
    above = F.when(F.col("idx") == 0, F.col("above")).otherwise(F.col("m.above"))
    of_panic = marks.select("run_id", "chunk", "idx", X.frame(captured(above, X.GO_FUNC), F.regexp_extract("m.text", X.GO_FRAME, 1), captured_int(F.col("m.text"), X.GO_FRAME, 2)).alias("s"))
    of_panic = numbered(of_panic, ["run_id"], ["chunk"], ["idx"], "frame_idx").select(
        "run_id", F.lit(1).alias("priority"), F.lit(0).alias("grp"), F.lit(0).cast("long").alias("chunk"), F.lit(0).alias("idx"), "frame_idx", "s"
    )
    # A test's details follow the first line that holds a word which starts with its name.
    tests = each(mine, "tests", "idx", "name", *KEY, "chunk")
    words = each(mine, "named", "at", "w", "run_id", "chunk")
    sizes = tests.groupBy("run_id").agg(F.collect_set(F.length("name")).alias("sizes")).withColumnRenamed("run_id", "of")
    words = words.join(sizes, F.col("run_id").eqNullSafe(F.col("of"))).drop("of")
    cuts = F.flatten(F.transform("w.words", lambda v: F.transform(F.filter("sizes", lambda n: n <= F.length(v)), lambda n: F.left(v, n))))
    named = words.select("run_id", F.explode(F.array_distinct(cuts)).alias("word"), F.struct("chunk", "at", "w.details").alias("place")).groupBy(
        F.col("run_id").alias("of"), "word"
    ).agg(F.min("place").alias("place"))
    found = tests.join(named, F.col("run_id").eqNullSafe(F.col("of")) & (F.col("name") == F.col("word")), "left")
    d = F.coalesce("place.details", F.array().cast(f"array<struct<message:string,frame:{X.FRAME_TYPE}>>"))
    f = X.failure(
        F.coalesce(F.get(d, F.lit(0))["message"], F.concat(F.lit("Test "), F.col("name"), F.lit(" failed"))), F.lit("TestFailure"),
        F.transform(d, lambda x: x["frame"].withField("function", F.col("name"))), None, F.col("name"),
    )
    tested = found.select(*KEY, F.lit(2).alias("priority"), F.lit(0).alias("grp"), "chunk", "idx", f.alias("f")).select(*ROW, *_failure_row(F.col("f")))
    return panics.union(tested), of_panic


def _block_rows(parsed: DataFrame, raw_chunks: int | None) -> tuple[DataFrame, DataFrame]:
    """Failures of blocks joined from their pieces, and their frames.

    Blocks over more than ``raw_chunks`` chunks come without their text; None: each has its whole text.
    """
    n_heads = F.size(F.filter("pieces", lambda p: p["head"]))
    opened = before_chunks(
        parsed.select("run_id", "chunk", F.when(n_heads > 0, F.struct("chunk", (n_heads - 1).alias("idx"))).alias("last_head")),
        ["run_id"], "chunk", open=F.last("last_head", ignorenulls=True),
    ).select(F.col("run_id").alias("of"), F.col("chunk").alias("in"), "open")
    pieces = each(parsed, "pieces", "k", "p", *KEY, "chunk", F.get("pieces", F.lit(0))["head"].alias("headed"))
    # The first piece goes on with the open block unless it is a head itself.
    pieces = pieces.join(opened, F.col("run_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in")))
    own = F.struct("chunk", (F.col("k") - F.when(F.col("headed"), 0).otherwise(1)).alias("idx"))
    pieces = pieces.withColumn("block", F.when(F.col("p.head"), own).otherwise(F.col("open"))).where("block IS NOT NULL")
    pieces = pieces.select(*KEY, "chunk", "block.idx", F.col("block.chunk").alias("start"), "p.*")
    piece, raw = F.struct("chunk", "raw"), F.col("raw")
    if raw_chunks is not None:
        # Texts that nobody asked for are not gathered either.
        piece = F.when(F.col("chunk") - F.col("start") < raw_chunks, piece)
        raw = F.when(F.col("end") - F.col("chunk") < raw_chunks, raw)
    blocks = pieces.groupBy(*KEY, "start", "idx").agg(
        _first("error_type").alias("first_type"), _first("error_message").alias("first_message"),
        _last("error_type").alias("last_type"), _last("error_message").alias("last_message"),
        _first("first").alias("first"), _first("test_name").alias("test_name"), _first("test_file").alias("test_file"),
        F.bool_or("raw_syntax").alias("raw_syntax"), F.bool_or("raw_unhandled").alias("raw_unhandled"),
        F.sum(F.size("frames")).alias("n_frames"), F.max("chunk").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda t: t["raw"]), "").alias("raw"),
    )
    python, java = F.col("format") == "python", F.col("format") == "java"
    blocks = blocks.where(~python | F.col("last_message").isNotNull() | (F.col("n_frames") > 0)).withColumnRenamed("start", "chunk")
    message = F.when(python, F.coalesce("last_message", F.lit("Python error occurred"))).when(java, F.col("first_message")).otherwise(
        F.coalesce("first_message", "first", F.lit("Unknown error"))
    )
    kind = F.when(python, F.coalesce("last_type", F.lit("Exception"))).otherwise(F.col("first_type"))
    rows = blocks.select(
        *KEY, F.when(java, 1).otherwise(0).alias("priority"), F.lit(0).alias("grp"), "chunk", "idx", "test_name", "test_file",
        message.alias("error_message"), kind.alias("error_type"),
        raw.alias("raw_block"), "raw_syntax", "raw_unhandled",
    )
    counts = pieces.select("run_id", "start", "idx", "chunk", F.size("frames").alias("n"), "frames").where("n > 0")
    counts = before_chunks(counts, ["run_id", "start", "idx"], "chunk", earlier=F.sum("n"))
    frames = each(counts, "frames", "at", "s", "run_id", "start", "idx", "earlier")
    return rows, frames.select("run_id", F.col("start").alias("chunk"), "idx", (F.coalesce("earlier", F.lit(0)) + F.col("at")).alias("frame_idx"), "s")


def _paired(blocks: DataFrame, parsed: DataFrame) -> DataFrame:
    """The k-th kept traceback of a run belongs to the k-th FAILED line."""
    python = F.col("format") == "python"
    tests = _local_rows(parsed.where(python)).where("priority = 2 AND grp = 1").select(F.col("run_id").alias("of"), "chunk", "idx", F.col("test_name").alias("name"), F.col("test_file").alias("file"))
    tests = numbered(tests, ["of"], ["chunk"], ["idx"], "nth").select("of", "nth", "name", "file")
    mine = numbered(blocks.where(python), ["run_id"], ["chunk"], ["idx"], "k")
    mine = mine.join(tests, F.col("run_id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("nth")), "left")
    mine = mine.withColumn("test_name", F.col("name")).withColumn("test_file", F.col("file")).select(*blocks.columns)
    return blocks.where(~python).union(mine)


def parse_lines(lines: DataFrame, size: int = CHUNK, raw_lines: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, project_root, line_no, line) -> (failures, frames), as from the run grain.

    failures: run_id, project_root, failure_idx, test_name, test_file, error_message, error_type,
    raw_syntax, raw_unhandled, raw_block (null: the whole text). A caller who can do without the text of
    long blocks gives ``raw_lines``: blocks over more lines then have null too. frames: run_id,
    project_root, failure_idx, frame_idx and the frame's columns. Runs without lines have no rows; null
    lines count as empty.

    The text is shuffled once, into chunks of ``size`` lines, and written twice: cut, and parsed into
    partial results. Neither a hot run nor a large one meets in one task.
    """
    chunks = stage(chunk_lines(lines.withColumn("line", F.coalesce("line", F.lit(""))), size))
    facts = stage(run_facts(chunks, size))
    known = facts.select(F.col("run_id").alias("of"), "format", "way", "blank")
    parsed = stage(parse_chunks(chunks.join(known, F.col("run_id").eqNullSafe(F.col("of"))).where("NOT blank OR format <> 'unknown'")))
    blocks, block_frames = _block_rows(parsed, None if raw_lines is None else max(1, raw_lines // size))
    go, panic_frames = _go_rows(parsed)
    blocks = _paired(blocks, parsed)
    direct = _local_rows(parsed).union(_eslint_rows(parsed)).union(_npm_rows(parsed)).union(_rust_rows(parsed)).union(go)
    rows = stage(direct.unionByName(blocks.withColumn("frames", F.lit(None).cast(f"array<{X.FRAME_TYPE}>"))))
    best = rows.groupBy("run_id").agg(F.min("priority").alias("best")).withColumnRenamed("run_id", "of")
    rows = rows.join(best, F.col("run_id").eqNullSafe(F.col("of")) & (F.col("priority") == F.col("best"))).drop("of", "best")
    for (fmt, priority, grp), limit in LIMITS.items():
        limited = (F.col("format") == fmt) & (F.col("priority") == priority) & (F.col("grp") == grp)
        order = Window.partitionBy("run_id").orderBy("chunk", "idx")
        some = rows.where(limited).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")
        rows = rows.where(~limited).union(some)
    rows = stage(numbered(rows, ["run_id"], ["grp", "chunk"], ["idx"], "failure_idx"))
    at = rows.select(F.col("run_id").alias("of"), "project_root", "format", F.col("priority").alias("p"), F.col("grp").alias("g"), F.col("chunk").alias("c"), F.col("idx").alias("i"), "failure_idx")
    listed = each(rows, "frames", "frame_idx", "s", "run_id", "priority", "grp", "chunk", "idx")
    of_blocks = block_frames.select("run_id", F.lit(None).cast("int").alias("priority"), F.lit(0).alias("grp"), "chunk", "idx", "frame_idx", "s")
    frames = listed.unionByName(panic_frames).unionByName(of_blocks)
    same = (
        F.col("run_id").eqNullSafe(F.col("of")) & (F.col("grp") == F.col("g")) & (F.col("chunk") == F.col("c")) & (F.col("idx") == F.col("i"))
        & F.coalesce(F.col("priority") == F.col("p"), ~F.col("format").isin("typescript", "eslint", "npm", "go", "rust") & (F.col("p") == F.when(F.col("format") == "java", 1).otherwise(0)))
    )
    placed = frames.join(at, same)
    file, root = F.col("s.file"), F.col("project_root")
    full = resolve_path(file, root)
    kept = F.col("format").isin("eslint") | ~F.col("format").isin(list(X.EXTRACTORS))
    frames = placed.select(
        "run_id", "project_root", "failure_idx", "frame_idx", F.col("s.function").alias("function"),
        F.when(kept, file).otherwise(full).alias("file"), F.col("s.line").alias("line"), F.col("s.col").alias("col"),
        owned_path(file, full, root).alias("is_project_file"),
    )
    whole = facts.select(F.col("run_id").alias("of"), "text_syntax", "text_unhandled")
    failures = rows.join(whole, F.col("run_id").eqNullSafe(F.col("of"))).select(
        "run_id", "project_root", "failure_idx", "test_name", "test_file", "error_message", "error_type",
        F.coalesce("raw_syntax", "text_syntax").alias("raw_syntax"), F.coalesce("raw_unhandled", "text_unhandled").alias("raw_unhandled"), "raw_block",
    )
    return failures, frames
