"""Snippets, prompts, packets and sources on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from logsieve.operators import assemble as A
from logsieve.operators import context as C
from logsieve.operators import external as E
from logsieve.operators import parse as P
from logsieve.plans.analysis import analyse_runs, condense_runs
from logsieve.sources import runs as S
from logsieve.sources import sinks

LINES = "project_root string, file string, line_no int, text string"
RESULTS = (
    "run_id bigint, query_idx int, query string, result_idx int, title string, url string, "
    "content string, score double"
)


def source(spark, **files):
    rows = []
    for name, text in files.items():
        for i, line in enumerate(text.split("\n"), 1):
            rows.append(("/repo/p1", f"/repo/p1/{name}.ts", i, line))
    return spark.createDataFrame(rows, LINES)


def locations(spark, *pairs):
    rows = [(1, i, f"/repo/p1/{f}.ts", n) for i, (f, n) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "run_id bigint, loc_idx int, file string, line int")


def test_snippet_windows(spark):
    long = "\n".join(f"l{i}" for i in range(1, 101))
    files = source(spark, long=long, empty="", blank="\n", one="x")
    wanted = locations(
        spark, ("gone", 1), ("long", 50), ("empty", 1), ("long", 3), ("long", 99), ("one", 200),
        ("blank", 2),
    )
    rows = C.collect_snippets(wanted, files).orderBy("snippet_idx").collect()
    got = [(r.file[9:], r.start_line, r.end_line, r.content.count("\n") + 1) for r in rows]
    assert got == [
        ("long.ts", 35, 65, 31), ("long.ts", 1, 18, 18), ("long.ts", 84, 100, 17),
        # Far behind the end of a readable file: an empty snippet, not a missing one.
        ("one.ts", 185, 1, 1), ("blank.ts", 1, 2, 2),
    ]
    assert rows[0].content.startswith("l35\n") and rows[0].content.endswith("\nl65")
    assert rows[3].content == ""


def test_snippet_cap_skips_missing_files(spark):
    files = source(spark, **{f"f{i}": "x" for i in range(0, 30, 2)})
    wanted = locations(spark, *[(f"f{i}", 1) for i in range(30)])
    rows = C.collect_snippets(wanted, files).orderBy("snippet_idx").collect()
    assert [r.file for r in rows] == [f"/repo/p1/f{i}.ts" for i in range(0, 20, 2)]


def test_hot_location(spark):
    """A location that nearly every run cites."""
    rows = [(r, 1, "/repo/p1/a.ts", 1 if r % 50 else 2) for r in range(5000)]
    hot = spark.createDataFrame(rows, "run_id bigint, loc_idx int, file string, line int")
    got = C.collect_snippets(hot, source(spark, a="x\ny")).groupBy("focus_line").count().collect()
    assert {(r.focus_line, r["count"]) for r in got} == {(1, 4900), (2, 100)}


def test_error_lines_by_number_only(spark, runs_of):
    text = "FAIL a.test.ts\nError: x\n    at f (a.ts:2:1)\n    at g (other.ts:3:1)"
    parsed = P.parse_runs(runs_of(text))
    snippets = C.collect_snippets(C.failure_locations(parsed), source(spark, a="1\n2\n3\n4"))
    marked = C.mark_error_lines(snippets, P.frames_of(parsed)).filter("is_error").collect()
    assert sorted(r.line_no for r in marked) == [2, 3]


def test_validation(spark, runs_of):
    parsed = P.parse_runs(runs_of("Error: x\n    at f (a.ts:0:3)\n    at g (a.ts:3:0)\n    at h (a.ts:1:1)"))
    rows = A.validate_frames(P.frames_of(parsed)).orderBy("frame_idx").collect()
    assert [(r.valid, r.reason) for r in rows] == [
        (False, "line must be positive"), (False, "column must be positive"), (True, None),
    ]


def test_search_summary_cases(spark, runs_of):
    rows = [
        (1, 0, "q", 0, "low", "http://a.x/1", "A. B.", 0.2),
        (2, 0, "q", 0, "T1", "HTTP://Host.Y/1", "One. Two! Three?", 0.5),
        (2, 0, "q", 1, "T2", "http://host.y:80/2", "dup", 0.9),
        (2, 1, "q", 0, "T3", "no url", "no end", 0.9),
    ]
    results = spark.createDataFrame(rows, RESULTS)
    runs = runs_of("a", "b", "c")
    got = {r.run_id: r for r in E.external_summary(runs, results).collect()}
    assert (got[0].summary, got[0].available) == ("", False)
    assert got[1].summary == "Web search returned no highly relevant results."
    assert got[2].summary == (
        "Found 2 relevant source(s) across 2 domain(s):\n\n"
        "- **[T3](no url)**: no end\n- **[T1](HTTP://Host.Y/1)**: One. Two!"
    )
    assert got[2].n_sources == 2


def test_queries(spark, runs_of):
    text = (
        "run\nFAIL src/a.test.ts > b\nTypeError: Cannot read properties of undefined at /x/y.ts:1   react\n"
        "    at render (src/a.ts:1:2)\nrun by vitest"
    )
    rows = E.search_queries(P.parse_runs(runs_of(text))).orderBy("query_idx").collect()
    assert [r.query for r in rows] == [
        "TypeError: Cannot read properties of undefined at react fix",
        "\"TypeError\" in \"render\" typescript",
        "react \"Cannot read properties of undefined at react\"",
        "TypeError cannot read properties of undefined common causes javascript",
        "TypeError vitest troubleshooting",
    ]


def test_query_length(spark, runs_of):
    rows = E.search_queries(P.parse_runs(runs_of("Error: " + "word " * 60))).collect()
    assert len(rows[0].query) == 120 and rows[0].query.endswith("...")


def test_condense_defaults(spark, runs_of):
    rows = condense_runs(runs_of("", "Error: x\n    at f (/lib/a.js:1:2)"), source(spark, a="x"))
    got = {r.run_id: r for r in rows.collect()}
    assert got[0].error == "No failures detected"
    assert got[0].category is None and got[0].file is None
    # Without a project frame the first frame shows the place.
    assert got[1].file == "/lib/a.js:1" and got[1].code_context is None


def test_agent_prompt(spark, runs_of):
    text = "src/a.ts(2,1): error TS2345: Argument of type 'a' is not assignable to parameter of type 'b'."
    analysed = analyse_runs(runs_of(text))
    snippets = C.collect_snippets(C.failure_locations(analysed), source(spark, a="let a\nf(a)"))
    repo = spark.createDataFrame(
        [("/repo/p1", "abc", "subject", "+x")],
        "project_root string, hash string, subject string, diff string",
    )
    message = text[text.index("TS2345"):]
    row = A.agent_prompts(analysed, P.explain_top(analysed), snippets, None, repo).first()
    assert row.text == "\n".join(
        [
            "You are debugging a test failure. Here is the structured analysis:", "", "---", "",
            f"ERROR: TypeError: {message}", "FILE: /repo/p1/src/a.ts:2", "",
            "ROOT CAUSE ANALYSIS:", "",
            f"[HIGH] compilation error: TypeScript argument type mismatch: {message}. "
            "The argument passed to a function doesn't match the expected parameter type.",
            "  SUGGESTED FIX: Fix the argument type at /repo/p1/src/a.ts:2. "
            "Check the function signature and pass a value of the correct type.", "",
            "GIT DIFF (recent changes that may be relevant):", "```diff", "+x", "```", "",
            "---", "", "Please fix this issue. Focus on the root cause analysis above.",
            "Start with compilation error in /repo/p1/src/a.ts near line 2.",
        ]
    )


def test_model_prompt(spark, runs_of):
    analysed = analyse_runs(runs_of("Error: heap\n    at f (a.ts:1:2)", ""))
    snippets = C.collect_snippets(C.failure_locations(analysed), source(spark, a="let a"))
    rows = A.enhancement_prompts(analysed, P.explain_top(analysed), snippets).collect()
    assert len(rows) == 1
    assert rows[0].text == (
        "## Error\nError: heap\n\n## Stack Trace\nf a.ts:1\n\n## Heuristic Analysis\n"
        "Category: resource_limit (high confidence)\n"
        "Explanation: Node.js ran out of memory. The process exceeded the default heap size limit.\n"
        "Suggested fix: Increase memory: NODE_OPTIONS=--max-old-space-size=4096. "
        "Or investigate memory leaks / large data processing.\n\n"
        "## Relevant Code\n### /repo/p1/a.ts (lines 1-1)\n```typescript\nlet a\n```"
    )


def test_packets_are_written_per_project(spark, tmp_path):
    from logsieve.plans.queries import packets

    rows = A.validate_packets(packets(spark, "/root/testdata/sf0.001"))
    counts = sinks.write_packets(rows, str(tmp_path / "packets"))
    back = spark.read.json(str(tmp_path / "packets"))
    # Frames on line 0 take their packet to the other side; nothing else does.
    bad = {r.run_id for r in rows.collect() if any(s.line == 0 or s.col == 0 for f in r.packet.test_run.failures for s in f.stack_trace)}
    assert bad and counts == {"accepted": 1000 - len(bad), "quarantined": len(bad)}
    assert {r.run_id for r in back.where("status = 'quarantined'").collect()} == bad
    files = [p.parent for p in (tmp_path / "packets").glob("status=*/project_root=*/part-*")]
    assert max(files.count(folder) for folder in files) <= 2
    assert back.count() == 1000 and back.select("project_root").distinct().count() == 12
    packet = back.filter("run_id = 50").first().packet.asDict(recursive=True)
    assert packet["version"] == "1.0.0"
    assert [f["test_file"] for f in packet["test_run"]["failures"]] == [
        "src/math.test.ts", "src/other.spec.ts",
    ]
    assert packet["root_causes"][0]["category"] == "undefined_or_null"
    assert len(packet["metadata"]["analysis_steps"]) == 12


def test_read_runs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("Error: one\nmore\n")
    (tmp_path / "logs" / "b.log").write_text("Error: two")
    rows = S.read_runs(spark, str(tmp_path / "logs"), "text", "/repo/p1")
    assert sorted(r.stdout for r in rows.collect()) == ["Error: one\nmore\n", "Error: two"]
    assert rows.select("run_id").distinct().count() == 2
    rows.write.json(str(tmp_path / "json"))
    assert S.read_runs(spark, str(tmp_path / "json"), "json").count() == 2
    with pytest.raises(ValueError):
        S.read_runs(spark, "x", "csv")


def test_staging_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert sinks.shared_dir(spark) == folder
    assert sinks.stage(spark.range(5)).inputFiles()[0].startswith("file://" + folder)


def test_diff_of_a_hot_commit(spark):
    import datetime as dt

    from logsieve.operators import history as H

    when = dt.datetime(2024, 1, 1)
    rows = [("/r", "c1", when, "s", f"f{i:06}", i, "x" * (i % 3)) for i in range(20_000)]
    rows += [("/q", "c2", when, "s", "a", 0, "long " * 3000), ("/n", "c3", when, "s", "a", 0, None), ("/n", "c3", when, "s", "b", 1, "one")]
    table = spark.createDataFrame(rows, "project_root string, commit_hash string, commit_ts timestamp, subject string, path string, change_no int, diff string")
    got = {r["project_root"]: r["diff"] for r in H.diff_for_project(table.repartition(6), 500).collect()}
    whole = "\n".join(r[6] for r in rows[:20_000])
    assert got["/r"] == whole[:497] + "..." and got["/q"] == ("long " * 3000)[:497] + "..."
    plan = H.diff_for_project(table, 500)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def exchanges(rows):
    """Hash exchanges that the plan of ``rows`` starts with."""
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_results_are_placed_by_run_once(spark, runs_of):
    rows = [(r, q, "q", i, "t", f"http://h{i}.x/{q}", "One. Two.", 0.5) for r in range(3) for q in range(2) for i in range(3)]
    results = spark.createDataFrame(rows, RESULTS)
    assert exchanges(E.dedupe_by_url(results)) == 1
    # The second places the runs, by their ids alone.
    assert exchanges(E.external_summary(runs_of("a", "b", "c"), results)) == 2
    assert E.dedupe_by_url(results).count() == 18
    assert {r.n_sources for r in E.external_summary(runs_of("a", "b", "c"), results).collect()} == {3}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_sources_move_once_and_keep_their_order(spark):
    rows = [
        (1, 1, "b", 0, "t4", "u4", "c4", 0.4), (1, 0, "a", 1, "t2", "u2", None, None), (1, 0, "a", 0, "t1", "u1", "c1", 0.1),
        (1, 1, "a", 0, "t3", "u3", "c3", 0.3), (2, 0, None, 0, "t5", "u5", "c5", 0.5), (2, None, "z", 0, "t6", "u6", "c6", 0.6),
    ]
    sources = A._sources(spark.createDataFrame(rows, RESULTS))
    assert exchanges(sources) == 1
    got = {r.run_id: [(q.query, [(h.title, h.content) for h in q.results]) for q in r.sources] for r in sources.collect()}
    assert got[1] == [("a", [("t1", "c1"), ("t2", None)]), ("a", [("t3", "c3")]), ("b", [("t4", "c4")])]
    assert got[2] == [("z", [("t6", "c6")]), (None, [("t5", "c5")])]


@pytest.mark.parametrize("build", [A.agent_prompts, A.enhancement_prompts])
def test_runs_are_not_shuffled_by_project(spark, runs_of, build):
    analysed = analyse_runs(runs_of("Error: x\n    at f (a.ts:1:2)"))
    latest = spark.createDataFrame([("/repo/p1", "abc", "s", "b")], "project_root string, hash string, subject string, branch string")
    diffs = spark.createDataFrame([("/repo/p1", "+x")], "project_root string, diff string")
    rows = build(analysed, P.explain_top(analysed), repo=A.repo_state(latest, diffs))
    assert "hashpartitioning(project_root" not in plan(rows)
    assert "+x" in rows.first().text


def test_lines_of_sources_move_once(spark):
    rows = C.collect_snippets(locations(spark, ("a", 1)), source(spark, a="x\ny", b="z"))
    assert "LeftSemi" not in plan(rows)
    assert [r.content for r in rows.collect()] == ["x\ny"]


def test_windows_meet_line_numbers_before_they_are_cut(spark, runs_of):
    parsed = P.parse_runs(runs_of("Error: x\n    at f (a.ts:2:1)"))
    snippets = C.collect_snippets(C.failure_locations(parsed), source(spark, a="1\n2\n3"))
    rows = C.mark_error_lines(snippets, P.frames_of(parsed))
    assert "hashpartitioning(run_id" in plan(rows)
    assert not [line for line in plan(rows).split("\n") if "hashpartitioning(run_id" in line and "line_no" in line]
    assert sorted((r.line_no, r.is_error) for r in rows.collect()) == [(1, False), (2, True), (3, False)]


def test_packets_are_packed_with_zstd(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/repo/p1", "x", [])], "run_id bigint, project_root string, packet string, reasons array<string>")
    assert sinks.write_packets(rows, str(tmp_path / "p"), "parquet") == {"accepted": 1, "quarantined": 0}
    assert [f for f in (tmp_path / "p").rglob("part-*") if ".zstd." in f.name]


def test_first_sentences_of_a_head_are_those_of_the_whole_text(spark):
    """The head answers only where it holds every sentence and a character behind them."""
    from logsieve.functions.text import SENTENCE, SENTENCE_END, SENTENCE_HEAD, first_sentences, trimmed

    n = SENTENCE_HEAD
    texts = [None, "", ".", "...", "a", "a.", "a. b", "a. b.", "a. b. c", " a! b? c. d", "?!a.b!c", "..a...b!!", "a\nb. \nc.\n d", "x" * n]
    for k in (n - 4, n - 3, n - 2, n - 1, n, n + 1):
        texts += [tail.join(["x" * k, ""]) for tail in (". b. c", ". b.", ".", "...", ".b...c", "é. ✗! c")]
        texts += ["a." + "é" * k + "." * r + t for r in (1, 2, 5) for t in ("", "b", "b.")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    t = F.col("t")
    for count in (1, 2, 3):
        found = F.regexp_extract(t, f"(?:{SENTENCE}){{1,{count}}}", 0)
        whole = F.when(t.rlike(SENTENCE_END), trimmed(found)).otherwise(F.substring(t, 1, 200))
        wrong = rows.where(~first_sentences(t, count).eqNullSafe(whole)).collect()
        assert not wrong, (count, wrong[:3])


def test_diffs_of_older_commits_do_not_move(spark):
    import datetime as dt
    import re

    from logsieve.operators import history as H

    changes = spark.createDataFrame(
        [("/repo/p1", f"{c:04}", dt.datetime(2026, 1, 1 + c // 9), f"s{c}", f"f{k}", k, f"diff {c} {k}") for c in range(90) for k in range(3)],
        "project_root string, commit_hash string, commit_ts timestamp, subject string, path string, change_no int, diff string",
    )
    # Ties on the newest day: the smallest hash is the newest commit.
    assert H.diff_for_project(changes).first().diff == "diff 81 0\ndiff 81 1\ndiff 81 2"
    assert [r.hash for r in H.recent_commits(changes, 3).orderBy("rk").collect()] == ["0081", "0082", "0083"]
    assert {(r.path, r.changes) for r in H.hot_files(changes).collect()} == {("f0", 30), ("f1", 30), ("f2", 30)}
    for rows in (H.diff_for_project(changes), H.recent_commits(changes), H.hot_files(changes)):
        assert "hashpartitioning(project_root" in plan(rows) and not re.search(r"hashpartitioning\(project_root#\d+, commit_hash", plan(rows))


def test_staging_leaves_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = files()
    assert sinks.stage(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()).count() == 10
    # The count's own shuffle has two files for its one task at most.
    assert files() <= before + 3
    assert spark.conf.get(sinks.SHUFFLE_CLEANUP, "false") == "false"


@pytest.mark.parametrize("build", [A.agent_prompts, A.enhancement_prompts])
def test_causes_in_the_row_are_not_placed_by_run(spark, runs_of, build):
    analysed = sinks.stage(analyse_runs(runs_of("Error: heap\n    at f (a.ts:1:2)", "", "TypeError: x is not a function")).select("run_id", "project_root", "format", "failures", "top"))
    snippets = C.collect_snippets(C.failure_locations(analysed), source(spark, a="let a"))
    apart, inside = build(analysed, P.explain_top(analysed), snippets), build(P.with_explained(analysed), None, snippets)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, inside.collect()))
    assert exchanges(inside) < exchanges(apart)


def test_packets_of_large_projects_are_not_moved_to_be_written(spark, tmp_path):
    runs = spark.range(4000).select(F.col("id").alias("run_id"), F.concat(F.lit("/repo/p"), F.col("id") % 3).alias("project_root"))
    bad = F.when(F.col("run_id") % 100 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = sinks.stage(runs.repartition(8, "run_id").select("*", F.lit("p").alias("packet"), bad.alias("reasons")))
    for name, given in (("few", runs.where("run_id < 1000")), ("many", runs), ("none", None)):
        assert sinks.write_packets(rows, str(tmp_path / name), "parquet", runs=given) == {"accepted": 3960, "quarantined": 40}
        back = spark.read.parquet(str(tmp_path / name))
        assert back.count() == 4000 and back.where("status = 'quarantined'").count() == 40
    files = {name: len(list((tmp_path / name).rglob("part-*"))) for name in ("few", "many", "none")}
    # Gathered by side and project, or a file for each of them and each task.
    assert files["few"] == files["none"] == 6 < files["many"] <= 6 * 8


def test_contents_are_joined_last_to_condensed_rows(spark, runs_of):
    texts = ["Error: heap\n    at f (a.ts:1:2)", "", "Error: b\n    at f (b.ts:2:2)", "Error: no\n    at g (none.ts:1:2)", "Error: far\n    at f (a.ts:99:1)"]
    lines = source(spark, a="let a\nf(a)", b="x\ny\nz")
    digests = sinks.stage(A.digest(analyse_runs(runs_of(*texts, *texts))))
    found = C.locations_of_keys(digests)
    whole = A.condense(digests, C.collect_snippets(found, lines, k=1))
    places, contents = C.collect_snippets(found, lines, k=1, apart=True)
    last = A.condense(digests, places, contents=contents)
    assert "content" not in places.columns and last.columns == whole.columns
    assert sorted(map(str, last.collect())) == sorted(map(str, whole.collect()))
    assert sum(r.code_context is not None and r.code_context.endswith("f(a)") for r in last.collect()) == 2
    # The outermost join is that of the contents.
    first = next(line for line in plan(condense_runs(runs_of(*texts), lines)).split("\n") if "Join " in line)
    assert "_line" in first and "run_id" not in first


def test_listed_snippets_are_the_rows_in_order(spark):
    """Windows that overlap, touch, lie apart or behind the end, files with holes and lines that come twice."""
    where = [(r, i, f"/repo/p1/{f}.ts", n) for r, spots in enumerate([
        [("a", 3), ("a", 5), ("b", 1), ("a", 40)], [("a", 50), ("a", 3), ("gone", 1), ("c", 9)], [("a", 99)], [("b", 3), ("b", 2), ("a", 8), ("c", 1)],
        [("a", 1), ("a", 6)], [("h", 3), ("h", 6), ("b", 99), ("b", 1)], [("gone", 2)],
    ]) for i, (f, n) in enumerate(spots, 1)]
    found = spark.createDataFrame(where, "run_id bigint, loc_idx int, file string, line int")
    odd = [("/repo/p1", "/repo/p1/h.ts", n, t) for n, t in ((1, "1"), (3, "x\ny"), (3, "again"), (5, None), (6, "6"), (9, "9"))]
    lines = source(spark, a="\n".join(f"line {i}" for i in range(1, 51)), b="x\ny\nz", c="only").union(spark.createDataFrame(odd, LINES))
    for radius, k in ((2, 10), (1, 3), (15, 2), (0, 10)):
        rows = C.collect_snippets(found, lines, radius, k)
        fields = ("snippet_idx", "file", "start_line", "end_line", "content", "language")
        want = sorted((r.run_id, *[r[c] for c in fields]) for r in rows.collect())
        listed = C.collect_snippets(found, lines, radius, k, listed=True).collect()
        got = [(r.run_id, *[s[c] for c in fields]) for r in sorted(listed) for s in r.snippets]
        assert got == want and len(listed) == len({w[0] for w in want})
    # A run's overlapping windows are one interval: its lines move to the run once.
    assert "texts" in plan(C.collect_snippets(found, lines, listed=True))
