"""Registered queries: each reads the driver's tables through the bridge and runs one operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import assemble as A
from logsieve.operators import context as C
from logsieve.operators import external as E
from logsieve.operators import extract as X
from logsieve.operators import history as H
from logsieve.operators import infer as I
from logsieve.operators import inventory as G
from logsieve.operators import longlogs as L
from logsieve.operators import metrics as M
from logsieve.operators import parse as P
from logsieve.operators.detect import detect_format, format_of
from logsieve.plans.analysis import analyse_runs, condense_runs
from logsieve.sources import bridge as B
from logsieve.sources import runs as S
from logsieve.sources.sinks import shared_dir, stage, write_packets
from logsieve.streaming import jobs as J
from logsieve.streaming.ledger import Ledger, merge_stream
from logsieve.streaming.runlog import RunLog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def stack_text(frames: Column) -> Column:
    return F.array_join(
        F.transform(
            frames,
            lambda f: F.concat_ws(
                "|",
                F.coalesce(f["function"], F.lit("-")),
                f["file"],
                f["line"].cast("string"),
                F.coalesce(f["col"].cast("string"), F.lit("-")),
                f["is_project_file"].cast("string"),
            ),
        ),
        ";",
    )


FAILURE_COLUMNS = [
    "run_id", "failure_idx", "test_name", "test_file", "error_message", "error_type", "raw_output",
]


def flat(parsed: DataFrame) -> DataFrame:
    """Failures with their frames written out as one text."""
    return P.failures_of(parsed).select(*FAILURE_COLUMNS, stack_text(F.col("frames")).alias("stack"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.combine_output(B.runs(spark, sf_dir))


def texts_of(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    return P.texts_of_format(texts(spark, sf_dir), fmt)


def generic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour-free texts, as a run command leaves them."""
    return S.strip_ansi(texts(spark, sf_dir))


def only(spark: SparkSession, sf_dir: str, fmt: str, extractor) -> DataFrame:
    rows = P.run_texts(B.runs(spark, sf_dir), strip=False).withColumn(
        "format", format_of(F.col("text"))
    )
    return flat(P.parse_with(rows, fmt, extractor))


@query
def combine_output(spark, sf_dir):
    return texts(spark, sf_dir).select("run_id", "text")


@query
def strip_ansi(spark, sf_dir):
    return generic_texts(spark, sf_dir).select("run_id", "text")


@query
def explode_lines(spark, sf_dir):
    return S.explode_lines(texts(spark, sf_dir))


@query
def detect_format_(spark, sf_dir):
    return detect_format(texts(spark, sf_dir))


@query
def extract_tsc(spark, sf_dir):
    return only(spark, sf_dir, "typescript", X.tsc_failures)


@query
def tsc_summary(spark, sf_dir):
    return P.tsc_summary(texts(spark, sf_dir))


@query
def extract_eslint(spark, sf_dir):
    return only(spark, sf_dir, "eslint", X.eslint_failures)


@query
def eslint_severity_filter(spark, sf_dir):
    return P.eslint_severity_filter(texts_of(spark, sf_dir, "eslint"))


@query
def eslint_autofixable(spark, sf_dir):
    return P.eslint_autofixable(P.eslint_issues(texts_of(spark, sf_dir, "eslint")))


@query
def extract_npm(spark, sf_dir):
    return only(spark, sf_dir, "npm", X.npm_failures)


@query
def extract_python(spark, sf_dir):
    return only(spark, sf_dir, "python", X.python_traced)


@query
def pair_pytest(spark, sf_dir):
    return P.pair_pytest(texts_of(spark, sf_dir, "python"))


@query
def python_standalone(spark, sf_dir):
    return only(spark, sf_dir, "python", X.python_standalone)


@query
def extract_java_compile(spark, sf_dir):
    return only(spark, sf_dir, "java", lambda t, ls: X.java_compile_failures(ls))


@query
def extract_java_exceptions(spark, sf_dir):
    def traces(text, lines):
        return F.when(
            F.size(X.java_compile_failures(lines)) > 0, X.no_failures()
        ).otherwise(X.java_exception_failures(lines))

    return only(spark, sf_dir, "java", traces)


@query
def java_exception_chain(spark, sf_dir):
    return P.java_exception_chain(texts_of(spark, sf_dir, "java"))


@query
def java_root_causes(spark, sf_dir):
    return P.java_exception_chain(texts_of(spark, sf_dir, "java"), root_only=True)


@query
def extract_go_compile(spark, sf_dir):
    return only(spark, sf_dir, "go", lambda t, ls: X.go_compile_failures(ls))


@query
def extract_go_panic(spark, sf_dir):
    def panics(text, lines):
        return F.when(F.size(X.go_compile_failures(lines)) > 0, X.no_failures()).otherwise(
            X.go_panic_failures(text, lines)
        )

    return only(spark, sf_dir, "go", panics)


@query
def extract_go_tests(spark, sf_dir):
    def tests(text, lines):
        earlier = F.concat(
            X.go_compile_failures(lines), X.go_panic_failures(text, lines)
        )
        return F.when(F.size(earlier) > 0, X.no_failures()).otherwise(
            X.go_test_failures(text, lines)
        )

    return only(spark, sf_dir, "go", tests)


@query
def extract_rust_compile(spark, sf_dir):
    return only(spark, sf_dir, "rust", lambda t, ls: X.rust_compile_failures(ls))


@query
def extract_rust_panic(spark, sf_dir):
    def panics(text, lines):
        return F.when(F.size(X.rust_compile_failures(lines)) > 0, X.no_failures()).otherwise(
            X.rust_panic_failures(text, lines)
        )

    return only(spark, sf_dir, "rust", panics)


@query
def split_failure_blocks(spark, sf_dir):
    return P.split_failure_blocks(generic_texts(spark, sf_dir))


def blocks(spark, sf_dir):
    return P.split_failure_blocks(generic_texts(spark, sf_dir))


@query
def extract_error_info(spark, sf_dir):
    return P.extract_error_info(blocks(spark, sf_dir))


@query
def extract_test_info(spark, sf_dir):
    return P.extract_test_info(blocks(spark, sf_dir))


@query
def extract_frames(spark, sf_dir):
    return P.extract_frames(P.split_failure_blocks(generic_texts(spark, sf_dir), "project_root"))


@query
def extract_test_counts(spark, sf_dir):
    return P.extract_test_counts(generic_texts(spark, sf_dir))


@query
def parse_failures(spark, sf_dir):
    """The run-a-command path: colour codes stripped, generic extractor for every run."""
    return flat(P.parse_runs(B.runs(spark, sf_dir), dispatch=False))


@query
def parse_errors(spark, sf_dir):
    """The supplied-output path: format detection, then that format's extractor."""
    return flat(P.parse_runs(B.runs(spark, sf_dir)))


def log_lines(spark, sf_dir):
    rows = P.run_texts(B.runs(spark, sf_dir), strip=False)
    return rows.select("run_id", "project_root", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query
def parse_long_logs(spark, sf_dir):
    """Supplied output line by line: small chunks, so that blocks reach over many of them."""
    failures, frames = L.parse_lines(log_lines(spark, sf_dir), size=7)
    stacks = frames.groupBy("run_id", "failure_idx").agg(
        stack_text(F.sort_array(F.collect_list(F.struct("frame_idx", "function", "file", "line", "col", "is_project_file")))).alias("stack")
    )
    whole = P.run_texts(B.runs(spark, sf_dir), strip=False).select("run_id", "text")
    rows = failures.join(stacks, ["run_id", "failure_idx"], "left").join(whole, "run_id")
    return rows.select(
        "run_id", F.col("failure_idx").cast("int").alias("failure_idx"), *FAILURE_COLUMNS[2:6],
        F.coalesce("raw_block", "text").alias("raw_output"), F.coalesce("stack", F.lit("")).alias("stack"),
    )


@query
def read_log_lines(spark, sf_dir):
    """Runs written as one log file per project and read back in byte ranges."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    rows = log_lines(spark, sf_dir).withColumn("project", F.regexp_extract("project_root", r"(\d+)$", 1))
    rows = rows.repartition("project").sortWithinPartitions("project", "run_id", "line_no")
    rows.select("project", F.col("line").alias("value")).write.option("lineSep", "\n").partitionBy("project").text(folder)
    return S.read_log_lines(spark, folder).select(
        F.regexp_extract("path", r"project=(\d+)", 1).cast("int").alias("project"), "line_no", "line"
    )


def parsed(spark, sf_dir):
    return P.parse_runs(B.runs(spark, sf_dir))


def failures(spark, sf_dir):
    return P.failures_of(parsed(spark, sf_dir), keep_raw=False)


@query
def parse_frames(spark, sf_dir):
    return P.frames_of(parsed(spark, sf_dir)).drop("project_root")


@query
def normalise_frames(spark, sf_dir):
    rows = P.normalise_frames(P.frames_of(parsed(spark, sf_dir)))
    return rows.select(
        "run_id", "failure_idx", "frame_idx", "file", "resolved_file", "in_project", "language"
    )


@query
def match_rules(spark, sf_dir):
    return I.match_rules(failures(spark, sf_dir))


@query
def dedupe_hypotheses(spark, sf_dir):
    return I.dedupe_hypotheses(I.match_rules(failures(spark, sf_dir)))


@query
def rank_hypotheses(spark, sf_dir):
    return I.rank_hypotheses(I.dedupe_hypotheses(I.match_rules(failures(spark, sf_dir))))


@query
def unknown_fallback(spark, sf_dir):
    return P.ranked_or_unknown(parsed(spark, sf_dir))


@query
def first_project_location(spark, sf_dir):
    return I.first_project_location(P.frames_of(parsed(spark, sf_dir)))


def flat_evidence(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.withColumn("evidence", F.array_join("evidence", " | "))


@query
def explain(spark, sf_dir):
    """Hypotheses inside the run's row: no shuffle."""
    return flat_evidence(P.hypotheses_of(parsed(spark, sf_dir)))


@query
def infer_root_causes(spark, sf_dir):
    """The same hypotheses from failure and frame tables."""
    rows = parsed(spark, sf_dir)
    return flat_evidence(I.infer_root_causes(P.failures_of(rows, False), P.frames_of(rows)))


@query
def infer_root_causes_command(spark, sf_dir):
    return flat_evidence(P.hypotheses_of(P.parse_runs(B.runs(spark, sf_dir), dispatch=False)))


QUERIES["detect_format"] = QUERIES.pop("detect_format_")


# ── context ──────────────────────────────────────────────────────────────────────────────


def analysed(spark, sf_dir, dispatch=True):
    return analyse_runs(B.runs(spark, sf_dir), dispatch)


@query
def failure_locations(spark, sf_dir):
    return C.failure_locations(parsed(spark, sf_dir))


@query
def related_files(spark, sf_dir):
    return C.related_files(parsed(spark, sf_dir))


def snippets(spark, sf_dir, k=C.MAX_SNIPPETS):
    return C.collect_snippets(
        # Read for the cited files and for the windows: parsed once.
        stage(C.failure_locations(parsed(spark, sf_dir))), B.source_lines(spark, sf_dir), k=k
    )


@query
def collect_snippets(spark, sf_dir):
    return snippets(spark, sf_dir)


@query
def mark_error_lines(spark, sf_dir):
    # Read for the locations and for the frames: parsed once.
    rows = stage(parsed(spark, sf_dir).select("run_id", "project_root", "failures"))
    found = C.collect_snippets(C.failure_locations(rows), B.source_lines(spark, sf_dir))
    return C.mark_error_lines(found, P.frames_of(rows))


@query
def validate_frames(spark, sf_dir):
    rows = A.validate_frames(P.frames_of(parsed(spark, sf_dir)))
    return rows.select("run_id", "failure_idx", "frame_idx", "line", "col", "valid", "reason")


@query
def validate_hypotheses(spark, sf_dir):
    rows = A.validate_hypotheses(P.hypotheses_of(parsed(spark, sf_dir)))
    return rows.select("run_id", "hyp_idx", "category", "confidence", "valid", "reason")


# ── external knowledge ───────────────────────────────────────────────────────────────────


@query
def dedupe_by_domain(spark, sf_dir):
    return E.dedupe_by_domain(B.search_results(spark, sf_dir)).drop("content")


@query
def external_summary(spark, sf_dir):
    return E.external_summary(B.runs(spark, sf_dir), B.search_results(spark, sf_dir))


@query
def dedupe_by_url(spark, sf_dir):
    return E.dedupe_by_url(B.search_results(spark, sf_dir))


@query
def search_queries(spark, sf_dir):
    return E.search_queries(parsed(spark, sf_dir))


# ── history and metrics ──────────────────────────────────────────────────────────────────


@query
def hot_files(spark, sf_dir):
    return H.hot_files(B.file_changes(spark, sf_dir))


@query
def recent_commits(spark, sf_dir):
    return H.recent_commits(B.file_changes(spark, sf_dir))


@query
def latest_commit(spark, sf_dir):
    return H.latest_commit(B.file_changes(spark, sf_dir))


@query
def diff_for_project(spark, sf_dir):
    return H.diff_for_project(B.file_changes(spark, sf_dir))


@query
def diff_line_stats(spark, sf_dir):
    return H.diff_line_stats(H.diff_for_project(B.file_changes(spark, sf_dir)))


@query
def test_pass_ratio(spark, sf_dir):
    return M.test_pass_ratio(P.extract_test_counts(generic_texts(spark, sf_dir)))


@query
def pass_ratio_by_project(spark, sf_dir):
    return M.pass_ratio_by_project(
        P.extract_test_counts(generic_texts(spark, sf_dir)), B.runs(spark, sf_dir)
    )


@query
def step_summary(spark, sf_dir):
    return M.step_summary(B.run_steps(spark, sf_dir))


@query
def step_totals(spark, sf_dir):
    return M.step_totals(B.run_steps(spark, sf_dir))


@query
def outcome_counts(spark, sf_dir):
    return M.outcome_counts(analysed(spark, sf_dir))


# ── project inventory ────────────────────────────────────────────────────────────────────


@query
def dependencies(spark, sf_dir):
    return G.dependencies(B.project_files(spark, sf_dir))


@query
def scripts(spark, sf_dir):
    return G.scripts(B.project_files(spark, sf_dir))


@query
def manifest_facts(spark, sf_dir):
    return G.manifest_facts(B.project_files(spark, sf_dir))


@query
def compiler_options(spark, sf_dir):
    return G.compiler_options(B.project_files(spark, sf_dir))


@query
def env_vars(spark, sf_dir):
    return G.env_vars(B.project_files(spark, sf_dir))


@query
def test_framework(spark, sf_dir):
    return G.test_framework(B.project_files(spark, sf_dir))


@query
def project_language(spark, sf_dir):
    return G.project_language(B.project_files(spark, sf_dir))


@query
def file_listing(spark, sf_dir):
    return G.file_listing(B.project_files(spark, sf_dir)).drop("sort_key")


@query
def key_files(spark, sf_dir):
    return G.key_files(B.project_files(spark, sf_dir))


@query
def readme_excerpt(spark, sf_dir):
    return G.readme_excerpt(B.project_files(spark, sf_dir))


# ── assembled outputs ────────────────────────────────────────────────────────────────────


@query
def parse_enhancements(spark, sf_dir):
    rows = A.parse_enhancements(B.model_replies(spark, sf_dir))
    return rows.withColumn("alternatives", F.array_join("alternatives", " | "))


@query
def condense(spark, sf_dir):
    """The flagship: one condensed row per run."""
    return condense_runs(
        B.runs(spark, sf_dir),
        B.source_lines(spark, sf_dir),
        B.search_results(spark, sf_dir),
    )


@query
def condense_command(spark, sf_dir):
    """Condensed rows of the run-a-command path, with model replies and without a search."""
    replies = A.parse_enhancements(B.model_replies(spark, sf_dir)).withColumn(
        "alternatives", F.array_join("alternatives", " | ")
    )
    return condense_runs(
        B.runs(spark, sf_dir), B.source_lines(spark, sf_dir), enhancements=replies, dispatch=False
    )


def parts(spark, sf_dir, k=C.MAX_SNIPPETS) -> dict[str, DataFrame]:
    """Inputs of the assembled outputs; the analysis is staged because several of them read it."""
    rows = stage(
        analysed(spark, sf_dir).select("run_id", "project_root", "format", "failures", "top"), codec="zstd"
    )
    changes = B.file_changes(spark, sf_dir)
    latest = stage(H.latest_commit(changes))
    return {
        # Hypotheses stay in the run's row: as rows of their own they would be placed by run again.
        "analysed": P.with_explained(rows),
        "hypotheses": None,
        "snippets": C.collect_snippets(C.failure_locations(rows), B.source_lines(spark, sf_dir), k=k, listed=True),
        "summaries": E.external_summary(B.runs(spark, sf_dir), B.search_results(spark, sf_dir)),
        "repo": A.repo_state(latest, H.diff_for_project(changes, latest=latest)),
    }


def packets(spark, sf_dir, ready=None):
    ready = ready or parts(spark, sf_dir)
    return A.assemble_packets(
        B.runs(spark, sf_dir),
        related=C.related_files(ready["analysed"]),
        steps=B.run_steps(spark, sf_dir),
        sources=B.search_results(spark, sf_dir),
        **ready,
    )


@query
def assemble_packets(spark, sf_dir):
    """Packets with their nested parts read back as flat columns."""
    p = "packet."

    def listed(array: str, field: str) -> Column:
        return F.array_join(F.transform(F.col(p + array), lambda s: s[field].cast("string")), "|")

    return packets(spark, sf_dir).select(
        "run_id",
        "project_root",
        F.col(p + "version").alias("version"),
        F.col(p + "test_run.command").alias("command"),
        F.col(p + "test_run.exit_code").alias("exit_code"),
        F.col(p + "test_run.total").alias("total"),
        listed("test_run.failures", "error_message").alias("errors"),
        listed("root_causes", "category").alias("categories"),
        listed("local_context.snippets", "start_line").alias("snippet_starts"),
        F.array_join(p + "local_context.related_files", "|").alias("related_files"),
        F.col(p + "git_context.last_commit_hash").alias("last_commit_hash"),
        F.col(p + "git_context.branch").alias("branch"),
        F.length(p + "git_context.diff").alias("diff_length"),
        F.col(p + "external_knowledge.search_available").alias("search_available"),
        F.aggregate(
            p + "external_knowledge.sources", F.lit(0), lambda n, s: n + F.size(s["results"])
        ).cast("long").alias("n_results"),
        F.length(p + "external_knowledge.summary").alias("summary_length"),
        listed("metadata.analysis_steps", "status").alias("steps"),
    )


@query
def quarantine_packets(spark, sf_dir):
    """Packets through the sink and back, with the side that each went to."""
    path = f"{shared_dir(spark)}/packets-{uuid.uuid4().hex}"
    ready = parts(spark, sf_dir)
    made = A.validate_packets(packets(spark, sf_dir, ready))
    write_packets(made, path, "parquet", runs=ready["analysed"].select("project_root"))
    rows = spark.read.parquet(path)
    return rows.select("run_id", "project_root", "status", F.array_join("reasons", "|").alias("reasons"), F.size("packet.test_run.failures").alias("n_failures"))


@query
def assemble_packets_command(spark, sf_dir):
    """Packets of commands that were run: their own exit code, test counts and the model's reply."""
    rows = stage(analysed(spark, sf_dir, dispatch=False).select("run_id", "project_root", "format", "failures", "top"), codec="zstd")
    changes = B.file_changes(spark, sf_dir)
    latest = stage(H.latest_commit(changes))
    runs = B.runs(spark, sf_dir)
    made = A.assemble_packets(
        runs, P.with_explained(rows), None, C.collect_snippets(C.failure_locations(rows), B.source_lines(spark, sf_dir), listed=True),
        C.related_files(rows), E.external_summary(runs, B.search_results(spark, sf_dir)),
        A.repo_state(latest, H.diff_for_project(changes, latest=latest)), B.run_steps(spark, sf_dir),
        counts=P.extract_test_counts(generic_texts(spark, sf_dir)),
        enhancements=A.parse_enhancements(B.model_replies(spark, sf_dir)),
    )
    run, reply = "packet.test_run.", "packet.llm_enhancement."
    return made.select(
        "run_id", *[F.col(run + c).alias(c) for c in ("command", "exit_code", "total", "passed", "failed")],
        F.length(run + "stdout").alias("stdout_length"),
        F.array_join(F.transform(run + "failures", lambda f: f["error_message"]), "|").alias("errors"),
        F.array_join(F.transform("packet.root_causes", lambda c: c["category"]), "|").alias("categories"),
        F.col("packet.git_context.branch").alias("branch"),
        *[F.col(reply + c).alias(c) for c in ("narrative", "fix_file", "model")],
    )


@query
def agent_prompts(spark, sf_dir):
    return A.agent_prompts(**parts(spark, sf_dir, A.AGENT_SNIPPETS))


@query
def enhancement_prompts(spark, sf_dir):
    return A.enhancement_prompts(**parts(spark, sf_dir, A.MODEL_SNIPPETS), contexts=project_briefs(spark, sf_dir))


@query
def project_briefs(spark, sf_dir):
    changes = B.file_changes(spark, sf_dir)
    return A.project_briefs(
        B.project_files(spark, sf_dir), H.recent_commits(changes), H.hot_files(changes), H.latest_commit(changes)
    )


# ── streams: the events table read as a file stream, run to its end ──────────────────────


def drained(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = J.write_batches(stream, lambda rows: rows, f"{folder}/out", f"{folder}/state", mode)
    running.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    if mode == "complete":
        # Every batch wrote the whole result; the last one counts.
        last = running.lastProgress["batchId"] if running.lastProgress else 0
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={last}")
    return rows.select(stream.columns)


def stream_runs(spark, sf_dir):
    return B.runs_of(spark, B.events_stream(spark, sf_dir))


@query
def stream_classify(spark, sf_dir):
    return drained(spark, J.stream_classify(stream_runs(spark, sf_dir)))


@query
def dedupe_failures_stream(spark, sf_dir):
    keys = J.dedupe_failures_stream(J.stream_matches(stream_runs(spark, sf_dir)))
    return drained(spark, keys.select("run_id", "category", "prefix"))


@query
def category_rate(spark, sf_dir):
    rates = J.category_rate(J.stream_classify(stream_runs(spark, sf_dir)), "1 day")
    return drained(spark, rates, "complete")


@query
def merge_hypotheses_stream(spark, sf_dir):
    """Matches that come in any order over several triggers, ranked as the batch ranks them."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    matches = I.match_rules(failures(spark, sf_dir))
    # A file for each core in each of the four triggers: one file would leave the others idle.
    cores = spark.sparkContext.defaultParallelism
    matches.repartition(4 * cores, "failure_idx", "rule_rank", F.col("run_id") % cores).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(matches.schema).option("maxFilesPerTrigger", cores).parquet(f"{folder}/in")
    ledger = Ledger(spark, f"{folder}/best", matches.schema, ["run_id"])
    merge_stream(stream, I.dedupe_hypotheses, ledger, f"{folder}/state").awaitTermination()
    return I.rank_hypotheses(ledger.rows())


@query
def assemble_runs(spark, sf_dir):
    """A stream of lines gathered into runs and parsed as each falls silent."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    runs = P.run_texts(stream_runs(spark, sf_dir), strip=False, keep=("ts",))
    lines = runs.select("run_id", "project_root", "ts", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    log = RunLog(spark, f"{folder}/log")
    log.start(lines, f"{folder}/state").awaitTermination()
    log.finish()
    return log.failures.rows().select(
        "run_id", F.col("failure_idx").cast("int").alias("failure_idx"), "test_name", "test_file", "error_message", "error_type"
    )
