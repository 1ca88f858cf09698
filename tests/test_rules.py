"""Each rule: a message it matches and a near miss, in both forms of the inference."""

import re

import pytest

from logsieve.operators import infer as I
from logsieve.operators import parse as P
from logsieve.operators.rules import RULES, Rule, Text

FAILURES = (
    "run_id bigint, failure_idx int, test_name string, test_file string, error_message string, "
    "error_type string, raw_output string"
)

# rank -> (matching (message, type, raw), near miss)
CASES = {
    1: (("Cannot read properties of undefined (reading 'a')", "TypeError", ""), ("cannot read a file", "E", "")),
    2: (("x is not a function", None, ""), ("x is a function", None, "")),
    3: (("X is not a constructor", None, ""), ("X is a constructor", None, "")),
    4: (("x is not iterable", None, ""), ("x is iterable", None, "")),
    5: (("ERR_MODULE_NOT_FOUND", None, ""), ("module found", None, "")),
    6: (("require() of ES Module /a.js not ok", None, ""), ("require of es module", None, "")),
    7: (("Cannot use import statement outside a module", None, ""), ("import statement", None, "")),
    8: (("a.default is not a function", None, ""), ("a_default is no function", None, "")),
    9: (("bad", "SyntaxError", ""), ("bad", "Syntaxerror", "")),
    10: (("Maximum call stack size exceeded", None, ""), ("call stack size", None, "")),
    11: (("Assignment to constant variable.", None, ""), ("Assignment to variable", None, "")),
    12: (("x", "ReferenceError", ""), ("x is not defined", "Error", "")),
    13: (("exceeded the time", None, ""), ("time exceeded", None, "")),
    14: (("connect ECONNREFUSED", None, ""), ("connect refused", None, "")),
    15: (("EACCES: no", None, ""), ("permission granted", None, "")),
    16: (("relation \"x\" does not exist", None, ""), ("the relation exists", None, "")),
    17: (("env FOO not set", None, ""), ("set FOO", None, "")),
    18: (("TS2322: Type 'a' is not assignable to type 'b'", "TypeError", ""), ("TS2322: other", "TypeError", "")),
    19: (("TS2345: not assignable to parameter", None, ""), ("TS2345: not assignable", None, "")),
    20: (("TS2307: Cannot find module 'x'", None, ""), ("TS2307: module", None, "")),
    21: (("TS2339: Property 'a' does not exist on type 'B'", None, ""), ("TS2339: Property", None, "")),
    22: (("TS2554: Expected 2 arguments, but got 1", None, ""), ("TS2554: Expected two", None, "")),
    23: (("TS1005: x", None, ""), ("ts1005: x", None, "")),
    24: (("package x not found", None, ""), ("not found package", None, "")),
    25: (("ERESOLVE", None, ""), ("RESOLVE", None, "")),
    26: (("cannot find symbol", "CompilerError", ""), ("cannot find symbol", "Error", "")),
    27: (("m", "ESLintError", ""), ("m", "ESLintWarning", "")),
    28: (("heap limit", None, ""), ("cheat limit", None, "")),
    29: (("No module named 'x'", None, ""), ("module named x", None, "")),
    30: (("x", "IndentationError", ""), ("Indentation", None, "")),
    31: (("x", "KeyError", ""), ("Key", None, "")),
    32: (("x", "AttributeError", ""), ("Attribute", None, "")),
    33: (("nil pointer dereference", None, ""), ("nil pointer", None, "")),
    34: (("index out of range [1]", "panic", ""), ("index in range", "panic", "")),
    35: (("undefined: x", "CompilerError", ""), ("is undefined: x", "CompilerError", "")),
    36: (("E0308: mismatched types", None, ""), ("mismatched types", None, "")),
    37: (("E0502: cannot borrow", None, ""), ("E0502: borrow", None, "")),
    38: (("E0425: cannot find value", None, ""), ("cannot find value", None, "")),
    39: (("x", "a.NullPointerException", ""), ("null pointer", None, "")),
    40: (("x", "a.NoClassDefFoundError", ""), ("NoClassDefFoundError", None, "")),
    41: (("x", "ArrayIndexOutOfBoundsException", ""), ("ArrayIndexOutOfBoundsException", None, "")),
    42: (("x", "ClassCastException", ""), ("ClassCastException", None, "")),
    43: (("x", "StackOverflowError", ""), ("StackOverflowError", None, "")),
    44: (("expected 1 but got 2", None, ""), ("got 2", None, "")),
    45: (("Snapshot differs", None, ""), ("snap shot", None, "")),
    46: (("x", None, "Unhandled promise Error"), ("x", None, "handled error")),
    47: (("beforeEach is not defined", None, ""), ("beforeEach is defined", None, "")),
    48: (("no such property", None, ""), ("such a property", None, "")),
    49: (("cannot iterate", None, ""), ("can iterate", None, "")),
    50: (("index is out of all bounds", None, ""), ("out of bounds", None, "")),
    51: (("x is undefined", None, ""), ("x is undefined.", None, "")),
}


@pytest.fixture(scope="module")
def matched(spark):
    rows = []
    for rank, pair in CASES.items():
        for side, (message, kind, raw) in enumerate(pair):
            rows.append((rank * 2 + side, 0, None, None, message, kind, raw))
    found = I.match_rules(spark.createDataFrame(rows, FAILURES)).collect()
    return {(r.run_id, r.rule_rank) for r in found}


@pytest.mark.parametrize("rank", sorted(CASES))
def test_rule(matched, rank):
    assert (rank * 2, rank) in matched
    assert (rank * 2 + 1, rank) not in matched


def test_all_rules_have_a_case():
    assert sorted(CASES) == [r.rank for r in RULES] == list(range(1, 52))


def causes(runs_of, text, **kwargs):
    rows = P.hypotheses_of(P.parse_runs(runs_of(text), **kwargs)).orderBy("hyp_idx").collect()
    return [(r.rule_rank, r.category, r.confidence) for r in rows]


def test_later_copy_of_a_category_is_dropped(runs_of):
    # The module rule comes first with the same category, so the compiler's never shows.
    text = "a.ts(1,1): error TS2307: Cannot find module './x'"
    assert causes(runs_of, text) == [(5, "import_or_module", "high")]


def test_order_and_cap(runs_of):
    text = "\n".join(
        ["go", "Error: expected an array", "Error: Timeout", "Error: EACCES", "Error: heap",
         "Error: x is not a function", "Error: no such table", "Error: fetch failed"]
    )
    got = causes(runs_of, text, dispatch=False)
    assert [c[1] for c in got] == [
        "timeout", "permission_error", "resource_limit", "type_mismatch", "database_error",
    ]


def test_unknown_only_without_any_match(runs_of):
    assert causes(runs_of, "start\nError: odd\nError: even") == [(99, "unknown", "low")]
    assert causes(runs_of, "start\nError: odd\nError: Timeout") == [(13, "timeout", "high")]
    assert causes(runs_of, "") == []


def test_dedupe_uses_the_first_fifty_characters(runs_of):
    long = "the very same beginning of a message that is quite long is not a function"
    got = causes(runs_of, f"s\nError: {long} 1\nError: {long} 2\nError: other is not a function")
    assert got == [(2, "type_mismatch", "high")] * 2


def test_texts(runs_of):
    text = "TypeError: Cannot read properties of null (reading 'id')\n    at f (src/a.ts:4:1)"
    row = P.hypotheses_of(P.parse_runs(runs_of(text))).first()
    assert row.explanation == (
        "Attempted to access '.id' on null at src/a.ts:4. "
        "The variable is null when it should be initialized."
    )
    assert row.evidence == ["Cannot read properties of null (reading 'id')", "at src/a.ts:4"]
    text = "Error: connect ECONNREFUSED 127.0.0.1:5432"
    row = P.hypotheses_of(P.parse_runs(runs_of(text))).first()
    assert row.explanation.endswith("failed (PostgreSQL on port 5432).")
    text = "Traceback (most recent call last):\n  File \"a.py\", line 1\nKeyError: 'k'"
    row = P.hypotheses_of(P.parse_runs(runs_of(text))).first()
    assert row.explanation == "Python KeyError: key 'unknown' not found in dictionary."


def test_both_forms_agree_and_order_does_not_matter(spark):
    from logsieve.sources import bridge as B

    runs = B.runs(spark, "/root/testdata/sf0.001")
    inside = P.hypotheses_of(P.parse_runs(runs))
    shuffled = P.parse_runs(runs.orderBy("duration_ms").repartition(3, "command"))
    tables = I.infer_root_causes(P.failures_of(shuffled), P.frames_of(shuffled))
    assert inside.exceptAll(tables.select(inside.columns)).count() == 0
    assert tables.select(inside.columns).exceptAll(inside).count() == 0


def test_invariants(spark):
    from logsieve.sources import bridge as B

    rows = P.hypotheses_of(P.parse_runs(B.runs(spark, "/root/testdata/sf0.001"))).collect()
    order = {"high": 3, "medium": 2, "low": 1}
    by_run = {}
    for r in rows:
        by_run.setdefault(r.run_id, []).append((r.hyp_idx, order[r.confidence]))
    for found in by_run.values():
        found.sort()
        assert [i for i, _ in found] == list(range(1, len(found) + 1)) and len(found) <= 5
        assert [c for _, c in found] == sorted((c for _, c in found), reverse=True)


def test_extra_rule(spark, runs_of):
    extra = Rule(60, "timeout", "high", [[("m", "took (\\d+)s")]],
                 Text("Took {n} seconds", {"n": ("took (\\d+)s", 1, "?")}), Text("Wait"))
    parsed = P.parse_runs(runs_of("Error: it took 9s"))
    row = P.hypotheses_of(parsed, [extra]).first()
    assert (row.category, row.explanation, row.suggested_fix) == ("timeout", "Took 9 seconds", "Wait")
    table = I.infer_root_causes(P.failures_of(parsed), P.frames_of(parsed), [extra]).first()
    assert table.explanation == "Took 9 seconds"
    with pytest.raises(ValueError):
        P.hypotheses_of(parsed, [Rule(5, "timeout", "high", [], Text(""), Text(""))])


def test_hot_run(spark, runs_of):
    """One run with far more failures than all others keeps its exact result."""
    many = "start\n" + "\n".join(f"Error: x{i % 7} is not a function {i}" for i in range(4000))
    rows = P.hypotheses_of(P.parse_runs(runs_of(many, "Error: Timeout"))).collect()
    hot = sorted((r.hyp_idx, r.failure_idx) for r in rows if r.run_id == 0)
    assert hot == [(i + 1, i) for i in range(5)]
    parsed = P.parse_runs(runs_of(many))
    table = I.infer_root_causes(P.failures_of(parsed), P.frames_of(parsed)).collect()
    assert sorted((r.hyp_idx, r.failure_idx) for r in table) == hot


def test_needles_are_necessary():
    """A message that a rule matches always holds one of the rule's needles."""
    for rank, ((message, _, _), _) in CASES.items():
        for alternative in RULES[rank - 1].test:
            for name, pattern in alternative:
                if name == "m" and re.search(pattern.replace(r"\z", r"\Z"), message):
                    assert any(n in message.lower() for n in I.needles(pattern)), pattern
    assert I.needles("(?i)a+|b") == ()
    assert I.needles("(?i)colou?r is gray") == ("r is gray",)


def test_outcomes_of_tables(runs_of):
    from logsieve.operators import metrics as M
    from logsieve.plans.analysis import analyse_runs

    runs = runs_of("s\nError: Timeout\nError: odd", "", "s\nError: odd")
    rows = analyse_runs(runs)
    tables = M.outcome_counts_of_tables(runs, P.failures_of(rows), P.explain_top(rows))
    inside = M.outcome_counts(rows)
    expected = [(0, 2, 1, 1), (1, 0, 0, 0), (2, 1, 1, 1)]
    assert sorted(map(tuple, tables.collect())) == sorted(map(tuple, inside.collect())) == expected


def test_unknown_rows_in_the_row_and_over_tables(spark):
    from logsieve.operators import infer as I
    from logsieve.operators import parse as P
    from logsieve.sources import bridge as B
    from logsieve.sources.sinks import stage

    parsed = P.parse_runs(B.runs(spark, "/root/testdata/sf0.001"))
    failures = stage(P.failures_of(parsed, keep_raw=False))
    tables = I.unknown_fallback(failures, I.rank_hypotheses(I.dedupe_hypotheses(I.match_rules(failures))))
    inside = P.ranked_or_unknown(parsed)
    rows = lambda t: sorted(tuple(r[c] for c in sorted(t.columns)) for r in t.collect())
    assert rows(inside) == rows(tables.select(*inside.columns))
    assert inside.where("category = 'unknown'").count() > 0
