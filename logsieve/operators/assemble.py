"""Condensed rows, packets, prompts and briefs: the outputs joined per run or project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import let, strict_json
from logsieve.operators import inventory as G
from logsieve.operators.context import location_keys
from logsieve.operators.infer import first_project_frame
from logsieve.operators.parse import explained_by_rules as first_cause
from logsieve.operators.rules import CATEGORIES, CONFIDENCE
from logsieve.operators.scan import placed
from logsieve.sources.sinks import stage

VERSION = "1.0.0"
# Limits of the model prompt and of the agent prompt.
CONTEXT_CHARS, SNIPPET_CHARS, EXTERNAL_CHARS, DIFF_CHARS = 2000, 3000, 1500, 1000
MODEL_SNIPPETS, AGENT_SNIPPETS = 4, 3
BRIEF_DEPENDENCIES, BRIEF_COMMITS, BRIEF_FILES, BRIEF_SCRIPTS = 20, 5, 5, 10
# Texts of a reply's missing parts and of a run without failures.
NO_NARRATIVE = "Analysis unavailable"
NO_FAILURES = "No failures detected"


def truthy(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def validate_frames(frames: DataFrame) -> DataFrame:
    """frames -> + valid, reason; a frame is kept for quarantine instead of failing its run."""
    reason = frame_reason(F.col("line"), F.col("col"))
    return frames.select("*", reason.isNull().alias("valid"), reason.alias("reason"))


def validate_hypotheses(hypotheses: DataFrame) -> DataFrame:
    reason = hypothesis_reason(F.col("category"), F.col("confidence"))
    return hypotheses.select("*", reason.isNull().alias("valid"), reason.alias("reason"))


def frame_reason(line: Column, col: Column) -> Column:
    bad_line = F.coalesce(line < 1, F.lit(False))
    bad_col = F.coalesce(col < 1, F.lit(False))
    return F.when(bad_line, "line must be positive").when(bad_col, "column must be positive")


def hypothesis_reason(category: Column, confidence: Column) -> Column:
    return F.when(~category.isin(CATEGORIES), "unknown category").when(
        ~confidence.isin(list(CONFIDENCE)), "unknown confidence"
    )


def validate_packets(packets: DataFrame) -> DataFrame:
    """packets -> + ``reasons``, the distinct faults of a packet's frames and causes, sorted; narrow.

    A packet without faults has an empty list.
    """
    frames = F.flatten(F.transform("packet.test_run.failures", lambda f: f["stack_trace"]))
    reasons = F.concat(
        F.transform(frames, lambda s: frame_reason(s["line"], s["col"])),
        F.transform("packet.root_causes", lambda c: hypothesis_reason(c["category"], c["confidence"])),
    )
    known = F.filter(F.array_distinct(reasons), lambda r: r.isNotNull())
    return packets.withColumn("reasons", F.coalesce(F.array_sort(known), F.array().cast("array<string>")))


def snippet_head(file: Column, start: Column, end: Column) -> Column:
    return F.concat(
        file, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")")
    )


def first_hint(summary: Column) -> Column:
    """First line of a summary that lists a source."""
    lines = F.filter(F.split(summary, "\n"), lambda l: F.startswith(l, F.lit("-")))
    return F.trim(F.get(lines, F.lit(0)))


def digest(analysed: DataFrame) -> DataFrame:
    """What condensing needs of a run's analysis: one flat row and the location keys; narrow.

    The first failure, its place and the first cause's texts are taken inside the row.
    """
    first = F.get("failures", F.lit(0))
    place = F.coalesce(first_project_frame(first["frames"]), F.get(first["frames"], F.lit(0)))
    cause = F.get(first_cause(), F.lit(0))
    return (
        analysed.withColumn("chosen", F.slice("top", 1, 1))
        .select(
            "run_id",
            first.alias("first"),
            place.alias("place"),
            cause.alias("cause"),
            location_keys().alias("keys"),
        )
        .select(
            "run_id",
            F.coalesce("first.error_message", F.lit(NO_FAILURES)).alias("error"),
            F.concat(
                truthy(F.col("place.file")),
                F.lit(":"),
                F.coalesce(F.col("place.line").cast("string"), F.lit("null")),
            ).alias("file"),
            F.col("first.test_name").alias("test_name"),
            *[
                F.col(f"cause.{name}").alias(name)
                for name in ("category", "confidence", "explanation", "suggested_fix")
            ],
            "keys",
        )
    )


def condense(
    digests: DataFrame,
    snippets: DataFrame | None = None,
    summaries: DataFrame | None = None,
    enhancements: DataFrame | None = None,
    contents: DataFrame | None = None,
) -> DataFrame:
    """One flat row per run: first failure, first cause, first snippet, first hint.

    Every input holds at most one row per run after its filter, so no join can fan out. ``contents`` are
    those of snippets collected apart: runs are then placed by the location they show, as the last step,
    so a content is moved for its location and not for each run.
    """
    rows = digests.drop("keys")
    nothing = F.lit(None).cast("string")
    if snippets is None:
        rows = rows.withColumn("code_context", nothing)
    else:
        head = F.concat(
            F.lit("// "), snippet_head(F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("\n")
        )
        shown = snippets.filter("snippet_idx = 1")
        if contents is None:
            shown = shown.select("run_id", F.concat(head, F.col("content")).alias("code_context"))
        else:
            shown = shown.select(
                "run_id", head.alias("code_context"), F.col("file").alias("_file"), F.col("focus_line").alias("_line")
            )
        rows = rows.join(shown, "run_id", "left")
    if summaries is None:
        rows = rows.withColumn("external_hint", nothing)
    else:
        hints = summaries.filter("available").select(
            "run_id", first_hint(F.col("summary")).alias("external_hint")
        )
        rows = rows.join(hints, "run_id", "left")
    if enhancements is not None:
        parts = enhancements.filter("not failed").select(
            "run_id", "narrative", "code_fix", "fix_file", "fix_explanation", "alternatives"
        )
        rows = rows.join(parts, "run_id", "left")
    if snippets is None or contents is None:
        return rows
    texts = contents.select(F.col("file").alias("_of"), F.col("focus_line").alias("_at"), "content")
    # Runs that show nothing have no line and so meet no content: their ids spread them.
    spread = F.coalesce("_file", F.col("run_id").cast("string"))
    rows = rows.withColumn("_file", spread).join(texts, (F.col("_file") == F.col("_of")) & (F.col("_line") == F.col("_at")), "left")
    shown = F.concat("code_context", F.coalesce("content", F.lit("")))
    return rows.withColumn("code_context", shown).drop("_file", "_line", "_of", "_at", "content")


def parse_enhancements(replies: DataFrame) -> DataFrame:
    """Model replies -> six fields with defaults; a reply that is not JSON, or null, is a failed row.

    Fields are read one by one: a list that is a single value counts as a list of it.
    """
    raw = F.trim(F.regexp_replace("text", r"\A\s+|\s+\z", ""))
    bare = F.when(F.startswith(raw, F.lit("{")), raw).otherwise(
        F.regexp_replace(F.regexp_replace(raw, r"\A```(?:json)?\n?", ""), r"\n?```\z", "")
    )
    failed = F.col("p").isNull() | (F.trim("p") == "null")

    def part(name: str) -> Column:
        return F.get_json_object("p", f"$.{name}")

    def filled(name: str, default: str) -> Column:
        return F.when(~failed, F.coalesce(part(name), F.lit(default)))

    listed = F.coalesce(
        F.from_json(part("fixAlternatives"), "array<string>"),
        F.when(part("fixAlternatives").isNotNull(), F.array(part("fixAlternatives"))),
        F.array().cast("array<string>"),
    )
    return replies.select("run_id", "model", strict_json(bare).alias("p")).select(
        "run_id",
        filled("rootCauseNarrative", NO_NARRATIVE).alias("narrative"),
        filled("codeFix", "").alias("code_fix"),
        filled("fixFile", "").alias("fix_file"),
        filled("fixExplanation", "").alias("fix_explanation"),
        F.when(~failed, listed).alias("alternatives"),
        F.when(~failed, part("externalSynthesis")).alias("external_synthesis"),
        "model",
        failed.alias("failed"),
    )


# ── per-run collections: every group below is bounded by a cap or by one run's row ───────


def _listed(rows: DataFrame, order: str, name: str, *fields: str) -> DataFrame:
    """Rows of a capped per-run table as one sorted array."""
    return rows.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name)
    )


def _first(snippets: DataFrame | None, shown: int) -> DataFrame | None:
    """The snippets that a text shows; the others need not move. Lists have them all."""
    if snippets is None or "snippets" in snippets.columns:
        return snippets
    return snippets.filter(F.col("snippet_idx") <= shown)


def _with_causes(analysed: DataFrame, hypotheses: DataFrame | None) -> DataFrame:
    """``analysed`` with the column ``causes``: the given hypotheses placed by run, or those in the row already."""
    if hypotheses is None:
        return analysed
    causes = _listed(
        hypotheses, "hyp_idx", "causes", "category", "confidence", "explanation", "evidence",
        "suggested_fix",
    )
    return analysed.join(causes, "run_id", "left")


def _joined(rows: DataFrame, snippets: DataFrame | None, summaries: DataFrame | None) -> DataFrame:
    """``rows`` with the snippets, as rows or listed, and the summary of each run; each is placed by run once."""
    if snippets is not None:
        shown = snippets if "snippets" in snippets.columns else _listed(
            snippets, "snippet_idx", "snippets", "file", "start_line", "end_line", "content",
            "language",
        )
        rows = rows.join(shown, "run_id", "left")
    if summaries is not None:
        rows = rows.join(summaries.select("run_id", "summary", "available"), "run_id", "left")
    return rows


def _with_repo(rows: DataFrame, repo_state: DataFrame | None) -> DataFrame:
    """``rows`` with their project's facts: after all joins by run, so a diff is never moved with them."""
    return rows if repo_state is None else rows.join(repo_state, "project_root", "left")


def repo_state(latest: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row per project, written once.

    Few projects have many runs each. Only a table whose size is known is broadcast before the runs are
    shuffled by project; by adaptive execution it is broadcast after they were.
    """
    return stage(latest.select("project_root", "hash", "subject", "branch").join(diffs, "project_root", "left"))


def _external(rows: DataFrame) -> Column:
    if "summary" not in rows.columns:
        return F.lit(None).cast("string")
    return F.when(F.col("available"), truthy(F.col("summary")))


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def agent_prompts(analysed, hypotheses=None, snippets=None, summaries=None, repo=None) -> DataFrame:
    """(run_id, text): the whole analysis as instructions; sections that are empty go.

    ``hypotheses`` None: they are the column ``causes`` of ``analysed``. Failures and causes become text
    in the run's row, so their arrays are not placed by run.
    """

    def spaced(category: Column) -> Column:
        return F.replace(category, F.lit("_"), F.lit(" "))

    def failure_text(f: Column) -> Column:
        def body(p: Column) -> Column:
            kind = F.coalesce(F.concat(truthy(f["error_type"]), F.lit(": ")), F.lit(""))
            file = F.when(
                F.coalesce(p["line"] != 0, F.lit(False)),
                F.concat(F.lit("FILE: "), truthy(p["file"]), F.lit(":"), p["line"].cast("string")),
            )
            return F.concat_ws(
                "\n",
                F.lit("---\n"),
                F.concat(F.lit("ERROR: "), kind, f["error_message"]),
                file,
                F.concat(F.lit("TEST: "), truthy(f["test_name"])),
                F.lit(""),
            )

        return let(first_project_frame(f["frames"]), body)

    def cause_text(c: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.concat(
                F.lit("["), F.upper(c["confidence"]), F.lit("] "), spaced(c["category"]),
                F.lit(": "), c["explanation"],
            ),
            F.concat(F.lit("  SUGGESTED FIX: "), truthy(c["suggested_fix"])),
            F.lit(""),
        )

    def snippet_text(s: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.concat(
                F.lit("--- "), snippet_head(s["file"], s["start_line"], s["end_line"]), F.lit(" ---")
            ),
            F.concat(F.lit("```"), s["language"]),
            s["content"],
            F.lit("```\n"),
        )

    def section(title: str, items: Column) -> Column:
        """Null, and so left out, when there are no items."""
        return F.when(
            F.coalesce(F.size(items), F.lit(0)) > 0,
            F.concat(F.lit(title + ":\n\n"), F.array_join(items, "\n")),
        )

    code = (
        F.transform(F.slice("snippets", 1, AGENT_SNIPPETS), snippet_text)
        if snippets is not None
        else F.array().cast("array<string>")
    )
    lead = F.get("causes", F.lit(0))
    where = first_project_frame(F.get("failures", F.lit(0))["frames"])
    start = F.concat(
        F.lit("Start with "), spaced(lead["category"]), F.lit(" in "), truthy(where["file"]),
        F.when(
            F.coalesce(where["line"] != 0, F.lit(False)),
            F.concat(F.lit(" near line "), where["line"].cast("string")),
        ).otherwise(""),
        F.lit("."),
    )
    told = F.concat_ws(
        "\n",
        truthy(F.array_join(F.transform("failures", failure_text), "\n")),
        section("ROOT CAUSE ANALYSIS", F.transform("causes", cause_text)),
    )
    own = _with_causes(analysed, hypotheses).select(
        "run_id", "project_root", truthy(told).alias("told"), start.alias("start")
    )
    rows = _with_repo(_joined(own, _first(snippets, AGENT_SNIPPETS), summaries), repo)
    text = F.concat_ws(
        "\n",
        F.lit("You are debugging a test failure. Here is the structured analysis:\n"),
        F.col("told"),
        section("RELEVANT CODE", code),
        F.concat(F.lit("EXTERNAL CONTEXT (from web search):\n"), _external(rows), F.lit("\n")),
        F.concat(
            F.lit("GIT DIFF (recent changes that may be relevant):\n```diff\n"),
            truthy(_column(rows, "diff")),
            F.lit("\n```\n"),
        ),
        F.lit("---\n"),
        F.lit("Please fix this issue. Focus on the root cause analysis above."),
        F.col("start"),
    )
    return rows.select("run_id", text.alias("text"))


def enhancement_prompts(
    analysed, hypotheses=None, snippets=None, summaries=None, repo=None, contexts=None
) -> DataFrame:
    """(run_id, text): the model prompt of each run with failures, parts cut to their limits.

    ``hypotheses`` None: they are the column ``causes`` of ``analysed``. What the prompt says of them and
    of the failures is made in the run's row, and contents are cut, before anything is placed by run.
    """
    failed = analysed.filter(F.size("failures") > 0)
    first = F.get("failures", F.lit(0))
    lead = F.get("causes", F.lit(0))
    kind = F.coalesce(F.concat(truthy(first["error_type"]), F.lit(": ")), F.lit(""))
    stack = F.array_join(
        F.transform(
            F.filter(first["frames"], lambda f: f["is_project_file"]),
            lambda f: F.concat(
                F.coalesce(f["function"], F.lit("")), F.lit(" "), f["file"], F.lit(":"),
                F.coalesce(f["line"].cast("string"), F.lit("null")),
            ),
        ),
        "\n",
    )
    heuristic = F.concat(
        F.lit("## Heuristic Analysis\nCategory: "), lead["category"], F.lit(" ("),
        lead["confidence"], F.lit(" confidence)\nExplanation: "), lead["explanation"],
        F.lit("\nSuggested fix: "), F.coalesce(lead["suggested_fix"], F.lit("none")),
    )
    own = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Error\n"), kind, first["error_message"]),
        F.concat(F.lit("## Stack Trace\n"), truthy(stack)),
        heuristic,
    )
    rows = _with_causes(failed, hypotheses).select("run_id", "project_root", truthy(own).alias("own"))
    if snippets is not None:
        # All code together is cut to the same length, so no content shows more than this of itself.
        snippets = _first(snippets, MODEL_SNIPPETS)
        if "content" in snippets.columns:
            snippets = snippets.withColumn("content", F.substring("content", 1, SNIPPET_CHARS))
    if summaries is not None:
        summaries = summaries.withColumn("summary", F.substring("summary", 1, EXTERNAL_CHARS))
    rows = _with_repo(_joined(rows, snippets, summaries), repo)
    if contexts is not None:
        # Written for the projects that have runs: broadcast by its size, or else few rows to shuffle.
        heads = contexts.select("project_root", F.substring("text", 1, CONTEXT_CHARS).alias("context"))
        cited = failed.select("project_root").distinct()
        rows = rows.join(stage(heads.join(cited, "project_root", "left_semi")), "project_root", "left")
    code = F.lit(None).cast("string")
    if snippets is not None:
        shown = F.transform(
            F.slice("snippets", 1, MODEL_SNIPPETS),
            lambda s: F.concat(
                F.lit("### "), snippet_head(s["file"], s["start_line"], s["end_line"]),
                F.lit("\n```"), s["language"], F.lit("\n"), s["content"], F.lit("\n```"),
            ),
        )
        code = F.concat(
            F.lit("## Relevant Code\n"),
            truthy(F.substring(F.array_join(shown, "\n\n"), 1, SNIPPET_CHARS)),
        )
    text = F.concat_ws(
        "\n\n",
        truthy(_column(rows, "context")),
        F.col("own"),
        code,
        F.concat(F.lit("## External Context (web search results)\n"), _external(rows)),
        F.concat(
            F.lit("## Recent Git Changes\n```diff\n"),
            F.substring(truthy(_column(rows, "diff")), 1, DIFF_CHARS),
            F.lit("\n```"),
        ),
    )
    return rows.select("run_id", text.alias("text"))


SOURCES_TYPE = (
    "array<struct<query:string,results:array<struct<title:string,url:string,content:string,score:double>>>>"
)
REPLY_TYPE = (
    "struct<narrative:string,code_fix:string,fix_file:string,fix_explanation:string,"
    "alternatives:array<string>,external_synthesis:string,model:string>"
)


def _sources(results: DataFrame) -> DataFrame:
    """Search results of each run as queries with their results, both in order.

    Page contents move once: results are placed by run and cut by query inside the run's row.
    """
    hit = F.struct("query_idx", "query", "result_idx", "title", "url", "content", "score")
    hits = (
        placed(results.select("run_id", hit.alias("hit")), "run_id")
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    )
    # Places where a query starts; its results reach to the next one.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("hits") - 1),
        lambda i: (i == 0)
        | ~_asked(F.get("hits", i)).eqNullSafe(_asked(F.get("hits", i - 1))),
    )

    def found(start: Column, stop: Column) -> Column:
        return F.transform(
            F.slice("hits", start + 1, stop - start),
            lambda h: F.struct(*[h[f].alias(f) for f in ("title", "url", "content", "score")]),
        )

    return hits.withColumn("starts", starts).select(
        "run_id",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("hits", s)["query"].alias("query"),
                found(s, F.coalesce(F.get("starts", k + 1), F.size("hits"))).alias("results"),
            ),
        ).alias("sources"),
    )


def _asked(hit: Column) -> Column:
    return F.struct(hit["query_idx"], hit["query"])


def assemble_packets(
    runs: DataFrame,
    analysed: DataFrame,
    hypotheses: DataFrame | None,
    snippets: DataFrame,
    related: DataFrame,
    summaries: DataFrame,
    repo: DataFrame,
    steps: DataFrame,
    counts: DataFrame | None = None,
    sources: DataFrame | None = None,
    enhancements: DataFrame | None = None,
    tool_version: str = VERSION,
) -> DataFrame:
    """(run_id, project_root, packet): the nested result with defaults for missing parts.

    With ``counts`` the packet is that of a command. Without, it is that of supplied output: named
    after its format, exit code 1, everything in stdout, no counts. ``sources`` are the search
    results by query, ``enhancements`` the parsed model replies; failed ones are left out.
    ``hypotheses`` None: they are the column ``causes`` of ``analysed``. The run's own output stays in
    ``runs`` and is joined once, after the small parts; the project's facts come last.
    """
    rows = _joined(
        _with_causes(analysed, hypotheses).select("run_id", "project_root", "format", "failures", "causes"), snippets, summaries
    )
    files = _listed(related, "file_idx", "related", "file")
    timeline = _listed(steps, "step_idx", "steps", "step", "status", "duration_ms", "error")
    if sources is not None:
        rows = rows.join(_sources(sources), "run_id", "left")
    if enhancements is not None:
        reply = F.struct(
            "narrative", "code_fix", "fix_file", "fix_explanation", "alternatives",
            "external_synthesis", "model",
        )
        good = enhancements.filter("not failed").select("run_id", reply.alias("reply"))
        rows = rows.join(good, "run_id", "left")
    if counts is not None:
        rows = rows.join(counts, "run_id", "left")
    rows = (
        rows.join(files, "run_id", "left")
        .join(timeline, "run_id", "left")
        .join(
            runs.select("run_id", "command", "exit_code", "stdout", "stderr", "duration_ms", "ts"),
            "run_id",
        )
    )
    rows = _with_repo(rows, repo)
    found = F.transform(
        "failures",
        lambda f: F.struct(
            f["test_name"].alias("test_name"),
            f["test_file"].alias("test_file"),
            f["error_message"].alias("error_message"),
            f["error_type"].alias("error_type"),
            f["frames"].alias("stack_trace"),
            # Null stands for the whole output, which the packet already holds.
            f["raw_block"].alias("raw_output"),
        ),
    )

    def without_order(name: str, *fields: str) -> Column:
        items = F.transform(
            name, lambda s: F.struct(*[s[f].alias(f) for f in fields])
        )
        return F.coalesce(items, F.array())

    none = F.lit(None).cast("int")
    if counts is not None:
        test_run = F.struct(
            "command", "exit_code", "stdout", "stderr", "duration_ms",
            found.alias("failures"), "total", "passed", "failed",
        )
    else:
        output = F.concat_ws("\n", F.nullif("stdout", F.lit("")), F.nullif("stderr", F.lit("")))
        test_run = F.struct(
            F.concat(F.lit("("), F.col("format"), F.lit(" output)")).alias("command"),
            F.lit(1).alias("exit_code"), output.alias("stdout"), F.lit("").alias("stderr"),
            F.lit(0.0).alias("duration_ms"), found.alias("failures"),
            none.alias("total"), none.alias("passed"), none.alias("failed"),
        )
    if sources is not None:
        listed_sources = F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType))
    else:
        listed_sources = F.array().cast(SOURCES_TYPE)

    packet = F.struct(
        F.lit(VERSION).alias("version"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("project_root"),
        test_run.alias("test_run"),
        F.struct(
            without_order(
                "snippets", "file", "start_line", "end_line", "content", "language"
            ).alias("snippets"),
            F.coalesce(
                F.transform("related", lambda s: s["file"]), F.array().cast("array<string>")
            ).alias("related_files"),
        ).alias("local_context"),
        F.struct(
            F.col("hash").isNotNull().alias("available"),
            "diff",
            truthy(F.col("branch")).alias("branch"),
            F.col("subject").alias("last_commit_message"),
            F.col("hash").alias("last_commit_hash"),
        ).alias("git_context"),
        F.struct(
            listed_sources.alias("sources"),
            F.coalesce("summary", F.lit("")).alias("summary"),
            F.coalesce("available", F.lit(False)).alias("search_available"),
        ).alias("external_knowledge"),
        without_order(
            "causes", "category", "confidence", "explanation", "evidence", "suggested_fix"
        ).alias("root_causes"),
        (F.col("reply") if enhancements is not None else F.lit(None).cast(REPLY_TYPE)).alias(
            "llm_enhancement"
        ),
        F.struct(
            F.lit(tool_version).alias("tool_version"),
            without_order("steps", "step", "status", "duration_ms", "error").alias("analysis_steps"),
        ).alias("metadata"),
    )
    return rows.select("run_id", "project_root", packet.alias("packet"))


def project_briefs(
    project_files: DataFrame, recent: DataFrame, hot: DataFrame, latest: DataFrame | None = None
) -> DataFrame:
    """(project_root, text): a project's facts as markdown; every list is capped before it is collected.

    ``latest`` is ``latest_commit``, for the branch.
    """

    def lines(rows: DataFrame, order: str, text: Column, limit: int | None, name: str) -> DataFrame:
        kept = rows if limit is None else rows.filter(F.col(order) <= limit)
        return kept.groupBy("project_root").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))),
                    lambda s: s["t"],
                ),
                "\n",
            ).alias(name)
        )

    item = lambda c: F.concat(F.lit("- "), c)
    tree = G.file_listing(project_files)
    shown = F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.substring_index("path", "/", -1),
        F.when(F.col("is_dir"), "/").otherwise(""),
    )
    base = G.manifest_facts(project_files)
    for extra in (
        G.project_language(project_files),
        G.test_framework(project_files),
        G.compiler_options(project_files).withColumn("has_options", F.lit(True)),
        lines(
            G.dependencies(project_files).filter("not is_dev"), "nth", item(F.col("name")),
            BRIEF_DEPENDENCIES, "dependencies",
        ),
        lines(tree, "sort_key", shown, None, "structure"),
        lines(G.env_vars(project_files), "nth", item(F.col("name")), None, "env"),
        lines(
            recent, "rk",
            item(F.concat(F.substring("hash", 1, 7), F.lit(" "), F.col("subject"))),
            BRIEF_COMMITS, "commits",
        ),
        lines(
            hot, "rk",
            item(
                F.concat(
                    F.col("path"), F.lit(" ("), F.col("changes").cast("string"), F.lit(" changes)")
                )
            ),
            BRIEF_FILES, "hot",
        ),
        lines(
            G.scripts(project_files), "nth",
            F.concat(F.lit("- `npm run "), F.col("name"), F.lit("`: "), F.col("command")),
            BRIEF_SCRIPTS, "script_lines",
        ),
    ):
        base = base.join(extra, "project_root", "left")
    if latest is not None:
        base = base.join(latest.select("project_root", truthy(F.col("branch")).alias("branch")), "project_root", "left")
    module = F.when(F.col("type") == "module", "ESM").otherwise("CommonJS")

    def block(title: str, body: Column) -> Column:
        return F.concat(F.lit(title + "\n"), body, F.lit("\n"))

    options = F.when(
        F.col("has_options"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("- strict: "), F.col("strict").cast("string")),
            F.concat(F.lit("- target: "), F.col("target")),
            F.concat(F.lit("- module: "), F.col("module")),
            F.concat(F.lit("- noUncheckedIndexedAccess: "), F.col("unchecked_index").cast("string")),
            F.concat(F.lit("- paths: "), F.col("paths")),
        ),
    )
    activity = F.concat_ws(
        "\n",
        F.concat(F.lit("Branch: "), _column(base, "branch")),
        F.concat(F.lit("\nRecent commits:\n"), F.col("commits")),
        F.concat(F.lit("\nMost active files:\n"), F.col("hot")),
    )
    text = F.concat_ws(
        "\n",
        F.lit("# Project Context\n"),
        F.lit("## Overview"),
        F.concat(F.lit("- **Name**: "), F.col("name")),
        F.concat(F.lit("- **Description**: "), truthy(F.col("description"))),
        F.concat(F.lit("- **Language**: "), F.col("language")),
        F.concat(F.lit("- **Module system**: "), module),
        F.concat(F.lit("- **Runtime**: "), F.col("runtime")),
        F.concat(F.lit("- **Test framework**: "), F.col("framework")),
        F.lit(""),
        block("## Dependencies", F.col("dependencies")),
        block("## TypeScript Configuration", options),
        block("## Project Structure", F.concat(F.lit("```\n"), F.col("structure"), F.lit("\n```"))),
        block("## Environment Variables", F.col("env")),
        F.when(F.col("commits").isNotNull(), block("## Recent Git Activity", activity)),
        block("## Available Scripts", F.col("script_lines")),
    )
    return base.select("project_root", text.alias("text"))


__all__ = [
    "agent_prompts", "assemble_packets", "condense", "enhancement_prompts",
    "parse_enhancements", "project_briefs", "repo_state", "validate_frames", "validate_hypotheses", "validate_packets",
]
