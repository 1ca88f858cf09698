"""From run outputs to failures, frames and hypotheses in one pass over the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import (
    captured,
    captured_int,
    each,
    language_from_ext,
    let,
    lines_of,
    resolve_path,
    reusable,
)
from logsieve.functions.text import is_project_file as owned_by
from logsieve.operators import extract as X
from logsieve.operators.detect import format_of
from logsieve.operators.infer import (
    SYNTAX_RAW,
    UNHANDLED_RAW,
    FRAMES_RULE,
    cause_texts,
    confidence_name,
    first_project_frame,
    project_frame_texts,
    ranked_causes,
    raw_test,
    text_hints,
)
from logsieve.operators.rules import UNKNOWN, UNKNOWN_RANK, Rule
from logsieve.sources.runs import combined, without_ansi


def run_texts(runs: DataFrame, strip: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    text = combined(F.col("stdout"), F.col("stderr"))
    return runs.select(
        "run_id", "project_root", *keep, (without_ansi(text) if strip else text).alias("text")
    )


def parse_runs(runs: DataFrame, dispatch: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per run: run_id, project_root, format, text, text hints and ``failures``.

    With ``dispatch`` the text goes to the extractor of its format, as for supplied output;
    without it every run takes the generic extractor on colour-free text, as for a command
    that was run. The formats share one scan: a CASE picks the extractor per row.
    """
    texts = run_texts(runs, not dispatch, keep).withColumn("format", format_of(F.col("text")))
    return parse_texts(texts, dispatch)


KEEPS_PATHS = ["eslint"]


@reusable
def _failures(dispatch: bool) -> Column:
    """Failures of a row with the columns text, lines, project_root and format."""
    args = (F.col("text"), F.col("lines"))
    found = X.generic_failures(*args)
    if not dispatch:
        return X.finished(found, F.col("project_root"), F.lit(True))
    chosen = None
    for name, extractor in X.EXTRACTORS.items():
        test = F.col("format") == name
        built = extractor(*args)
        chosen = F.when(test, built) if chosen is None else chosen.when(test, built)
    resolves = [name for name in X.EXTRACTORS if name not in KEEPS_PATHS]
    return X.finished(
        chosen.otherwise(found), F.col("project_root"), ~F.col("format").isin(resolves)
    )


def _prepared(texts: DataFrame) -> DataFrame:
    text = F.col("text")
    return texts.select("*", lines_of(text).alias("lines"), *text_hints(text))


def parse_texts(texts: DataFrame, dispatch: bool = True) -> DataFrame:
    return _prepared(texts).withColumn("failures", _failures(dispatch)).drop("lines")


def parse_with(texts: DataFrame, fmt: str, extractor) -> DataFrame:
    """Parse the texts of one format with one given extractor.

    Other texts get an empty list instead of being filtered out: a filter on the computed
    format would be pushed below the text and repeat its expression per pattern.
    """
    found = X.finished(
        extractor(F.col("text"), F.col("lines")),
        F.col("project_root"),
        F.lit(fmt in KEEPS_PATHS or fmt not in X.EXTRACTORS),
    )
    mine = F.when(F.col("format") == fmt, found)
    return _prepared(texts).withColumn("failures", mine).drop("lines")


def texts_of_format(texts: DataFrame, fmt: str) -> DataFrame:
    """texts with the text of other formats set to null."""
    marked = texts.withColumn("format", format_of(F.col("text")))
    return marked.withColumn("text", F.when(F.col("format") == fmt, F.col("text")))


def failures_of(
    parsed: DataFrame, keep_raw: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """parsed runs -> failures(run_id, failure_idx, test_name, …, raw_output) plus hint columns.

    A failure that stands for the whole text gets it back here, and only if a later step
    asks for ``raw_output``.
    """
    rows = each(
        parsed, "failures", "failure_idx", "f",
        "run_id", "project_root", "text", "text_syntax", "text_unhandled", *keep,
    )
    block = F.col("f.raw_block")
    columns = [
        "run_id",
        "project_root",
        *keep,
        "failure_idx",
        F.col("f.test_name").alias("test_name"),
        F.col("f.test_file").alias("test_file"),
        F.col("f.error_message").alias("error_message"),
        F.col("f.error_type").alias("error_type"),
        F.coalesce(raw_test(block, SYNTAX_RAW), F.col("text_syntax")).alias("raw_syntax"),
        F.coalesce(raw_test(block, UNHANDLED_RAW), F.col("text_unhandled")).alias("raw_unhandled"),
        F.col("f.frames").alias("frames"),
    ]
    if keep_raw:
        columns.append(F.coalesce(block, F.col("text")).alias("raw_output"))
    return rows.select(*columns)


def frames_of(parsed: DataFrame) -> DataFrame:
    """parsed runs -> frames(run_id, failure_idx, frame_idx, function, file, line, col, …)."""
    rows = each(parsed, "failures", "failure_idx", "f", "run_id", "project_root")
    return each(
        rows, "f.frames", "frame_idx", "s", "run_id", "project_root", "failure_idx"
    ).select("run_id", "project_root", "failure_idx", "frame_idx", "s.*")


def parse_errors(runs: DataFrame, dispatch: bool = True) -> tuple[DataFrame, DataFrame]:
    """runs -> (failures, frames)."""
    parsed = parse_runs(runs, dispatch)
    return failures_of(parsed).drop("frames"), frames_of(parsed)


def normalise_frames(frames: DataFrame) -> DataFrame:
    """frames -> frames + resolved_file, is_project_file, language."""
    file, root = F.col("file"), F.col("project_root")
    return frames.select(
        "*",
        resolve_path(file, root).alias("resolved_file"),
        owned_by(file, root).alias("in_project"),
        language_from_ext(resolve_path(file, root)).alias("language"),
    )


@reusable
def _top() -> Column:
    return ranked_causes(F.col("failures"), F.col("text_syntax"), F.col("text_unhandled"))


def with_causes(parsed: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """parsed runs -> + ``top``, the ranked causes of each run; narrow."""
    if not extra_rules:
        return parsed.withColumn("top", _top())
    top = ranked_causes(
        F.col("failures"), F.col("text_syntax"), F.col("text_unhandled"), extra_rules
    )
    return parsed.withColumn("top", top)


def hypotheses_of(parsed: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """parsed runs -> hypotheses; no shuffle, texts built for the survivors only."""
    return explain_top(with_causes(parsed, extra_rules), extra_rules)


def ranked_or_unknown(parsed: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """parsed runs -> the ranked causes of each run, or one ``unknown`` row where no rule matched.

    The same rows as ranking and ``unknown_fallback`` over failure tables, but inside the run's row:
    the texts are parsed once and nothing moves. Runs without failures have none.
    """
    rows = with_causes(parsed, extra_rules).select("run_id", "failures", "top")
    found = F.transform(
        "top",
        lambda c: F.struct(
            c["failure_idx"].cast("int").alias("failure_idx"),
            c["rule_rank"].alias("rule_rank"),
            c["category"].alias("category"),
            confidence_name(-c["order"]).alias("confidence"),
            F.get("failures", c["failure_idx"])["error_message"].alias("error_message"),
        ),
    )
    unknown = F.struct(
        F.lit(0).alias("failure_idx"),
        F.lit(UNKNOWN_RANK).alias("rule_rank"),
        F.lit(UNKNOWN.category).alias("category"),
        F.lit(UNKNOWN.confidence).alias("confidence"),
        F.get("failures", F.lit(0))["error_message"].alias("error_message"),
    )
    causes = F.when(F.size("top") > 0, found).when(F.size("failures") > 0, F.array(unknown))
    return each(rows, causes, "at", "c", "run_id").select("run_id", "c.*", (F.col("at") + 1).alias("hyp_idx"))


def _explained(extra_rules: list[Rule] | None) -> Column:
    """The causes in ``chosen`` with their texts, one rule's branch evaluated per cause."""

    def texts(c: Column) -> Column:
        def of_failure(f: Column) -> Column:
            first = first_project_frame(f["frames"])
            return let(
                F.struct(
                    f["error_message"].alias("error_message"),
                    f["test_name"].alias("test_name"),
                    first["file"].alias("p_file"),
                    first["line"].alias("p_line"),
                    F.when(c["rule_rank"] == FRAMES_RULE, project_frame_texts(f["frames"]))
                    .otherwise(F.array().cast("array<string>"))
                    .alias("p_frames"),
                ),
                lambda v: F.struct(
                    c["category"].alias("category"),
                    confidence_name(-c["order"]).alias("confidence"),
                    *cause_texts(c["rule_rank"], v, extra_rules),
                    c["failure_idx"].alias("failure_idx"),
                    c["rule_rank"].alias("rule_rank"),
                ),
            )

        return let(F.get("failures", c["failure_idx"]), of_failure)

    return F.transform("chosen", texts)


@reusable
def explained_by_rules() -> Column:
    """Texts of the causes in the columns ``chosen`` and ``failures``."""
    return _explained(None)


def with_explained(
    rows: DataFrame, extra_rules: list[Rule] | None = None, k: int | None = None
) -> DataFrame:
    """(run_id, failures, top, …) -> + ``causes``, the hypotheses of each run in its row; narrow."""
    top = F.col("top") if k is None else F.slice("top", 1, k)
    texts = _explained(extra_rules) if extra_rules else explained_by_rules()
    return rows.withColumn("chosen", top).withColumn("causes", texts).drop("chosen")


def explain_top(
    rows: DataFrame, extra_rules: list[Rule] | None = None, k: int | None = None
) -> DataFrame:
    """(run_id, failures, top) -> hypotheses, of the first ``k`` causes if given."""
    shown = with_explained(rows.select("run_id", "failures", "top"), extra_rules, k).select("run_id", "causes")
    return each(shown, "causes", "at", "c", "run_id").select(
        "run_id", (F.col("at") + 1).alias("hyp_idx"), "c.*"
    )


# ── single steps as table jobs ───────────────────────────────────────────────────────────


def tsc_summary(texts: DataFrame) -> DataFrame:
    text = F.col("text")
    return texts.select(
        "run_id",
        captured_int(text, X.TSC_SUMMARY, 1).alias("total_errors"),
        captured_int(text, X.TSC_SUMMARY, 2).alias("total_files"),
    )


def extract_test_counts(texts: DataFrame) -> DataFrame:
    """(run_id, text) -> (run_id, total, passed, failed); the bar form wins over the total form."""
    text = F.col("text")
    bar = text.rlike(X.COUNTS_BAR)

    def pick(group_bar: int, group_total: int) -> Column:
        return F.when(bar, captured_int(text, X.COUNTS_BAR, group_bar)).otherwise(
            captured_int(text, X.COUNTS_TOTAL, group_total)
        )

    return texts.select(
        "run_id",
        pick(3, 3).alias("total"),
        pick(2, 2).alias("passed"),
        pick(1, 1).alias("failed"),
    )


def eslint_issues(texts: DataFrame) -> DataFrame:
    issues = X.eslint_issues(lines_of(F.col("text")))
    return each(texts, issues, "at", "e", "run_id").select("run_id", "e.*")


def eslint_severity_filter(texts: DataFrame) -> DataFrame:
    issues = let(X.eslint_issues(lines_of(F.col("text"))), X.eslint_kept)
    return each(texts, issues, "at", "e", "run_id").select("run_id", "e.*")


def eslint_autofixable(issues: DataFrame) -> DataFrame:
    return issues.withColumn("auto_fixable", F.col("rule").isin(X.FIXABLE_RULES))


def java_exception_chain(texts: DataFrame, root_only: bool = False) -> DataFrame:
    """Exceptions grouped with their causes: block_id per chain, chain_pos along it.

    ``root_only`` keeps the last cause of each chain, what the failure list does not do.
    """
    heads = F.filter(lines_of(F.col("text")), X.java_is_head)
    chains = let(
        X.positions(heads, lambda h: ~h.rlike(X.JAVA_CAUSE)),
        lambda starts: F.struct(heads.alias("heads"), starts.alias("starts")),
    )

    def members(c: Column) -> Column:
        # A cause without an exception before it starts a chain of its own.
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), c["starts"]))
        return let(
            starts,
            lambda s: F.transform(
                s, lambda at, k: F.slice(
                    c["heads"], at + 1, F.coalesce(F.get(s, k + 1), F.size(c["heads"])) - at
                )
            ),
        )

    found = F.when(F.size(heads) > 0, let(chains, members))
    grouped = each(texts, found, "block_id", "chain", "run_id")
    if root_only:
        last = F.size("chain") - 1
        rows = grouped.select(
            "run_id", "block_id", last.alias("chain_pos"), F.get("chain", last).alias("head")
        )
    else:
        rows = each(grouped, "chain", "chain_pos", "head", "run_id", "block_id")
    return rows.select(
        "run_id",
        "block_id",
        "chain_pos",
        F.regexp_extract("head", X.JAVA_HEAD, 1).alias("error_type"),
        F.regexp_extract("head", X.JAVA_HEAD, 2).alias("error_message"),
    )


def split_failure_blocks(texts: DataFrame, *keep: str) -> DataFrame:
    """(run_id, text) -> (run_id, failure_idx, strategy, block)."""
    text = F.col("text")
    cut = texts.select("run_id", "text", X.split_strategy(text).alias("strategy"), *keep)
    blocks = X.failure_blocks(text)
    return each(cut, blocks, "failure_idx", "block", "run_id", "strategy", *keep)


def extract_error_info(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "run_id", "failure_idx", X.error_of(lines_of(F.col("block"))).alias("e")
    ).select("run_id", "failure_idx", "e.*")


def extract_test_info(blocks: DataFrame) -> DataFrame:
    block = F.col("block")
    return blocks.select(
        "run_id",
        "failure_idx",
        captured(block, X.TEST_NAME).alias("test_name"),
        captured(block, X.TEST_FILE).alias("test_file"),
    )


def extract_frames(blocks: DataFrame) -> DataFrame:
    """blocks (with project_root) -> frames."""
    found = X.frames_of(lines_of(F.col("block")))
    keep = ("run_id", "failure_idx", "project_root")
    return each(blocks, found, "frame_idx", "s", *keep).select(
        "run_id",
        "failure_idx",
        "frame_idx",
        "s.*",
        owned_by(F.col("s.file"), F.col("project_root")).alias("is_project_file"),
    )


def pair_pytest(texts: DataFrame) -> DataFrame:
    """Kept tracebacks with the FAILED line of the same position; both sides stay in the row."""
    text = F.col("text")
    tests = texts.select("*", X.pytest_lines(text).alias("tests"))
    kept = X.python_tracebacks(text)
    return (
        each(tests, kept, "k", "b", "run_id", "tests")
        .withColumn("mark", F.get("tests", F.col("k")))
        .select(
            "run_id",
            "k",
            captured(F.col("b.error"), X.PY_ERROR, 1).alias("error_type"),
            captured(F.col("b.error"), X.PY_ERROR, 2).alias("error_message"),
            captured(F.col("mark"), X.PY_TEST, 1).alias("test_file"),
            captured(F.col("mark"), X.PY_TEST, 2).alias("test_name"),
        )
    )
