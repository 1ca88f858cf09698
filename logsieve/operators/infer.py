"""Root-cause inference over failures.

Two forms share the rule table. Inside a run's row (:func:`ranked_causes`) the whole of match,
dedupe and top five is array work without a shuffle; this is what the run-level plans and the
streams use. Over a ``failures`` table the same steps are DataFrame operators whose windows
filter on ``row_number``, so Spark prunes each task's rows before the exchange.
"""

from __future__ import annotations

import functools
import re

try:
    from re import _constants, _parser
except ImportError:  # before Python 3.11
    import sre_constants as _constants
    import sre_parse as _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.text import has, let, reusable
from logsieve.operators.rules import (
    CATEGORIES,
    CONFIDENCE,
    KEY_LENGTH,
    MAX_HYPOTHESES,
    PORTS,
    RULES,
    UNKNOWN,
    UNKNOWN_RANK,
    Rule,
    Text,
)

NO_FILE = "the source file"
MIN_NEEDLE = 4
# The rule whose evidence lists project frames.
FRAMES_RULE = next(r.rank for r in RULES if r.evidence == "frames")
# Words the raw-output patterns cannot match without; looked for before the regex runs.
RAW_GATES = {
    next(p for alt in r.test for f, p in alt if f == "raw"): gate
    for r, gate in ((RULES[8], "but found"), (RULES[45], "unhandled"))
}
SYNTAX_RAW, UNHANDLED_RAW = RAW_GATES


def raw_test(raw: Column, pattern: str) -> Column:
    return has(F.lower(raw), RAW_GATES[pattern]) & raw.rlike(pattern)


def text_hints(text: Column) -> list[Column]:
    """What the rules need from a whole text, computed once per run and not once per failure."""
    return [
        raw_test(text, SYNTAX_RAW).alias("text_syntax"),
        raw_test(text, UNHANDLED_RAW).alias("text_unhandled"),
    ]


@functools.cache
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which a matching text holds at least one; empty if unknown.

    Read off the parsed pattern: the longest run of plain characters of a sequence, or one for
    each branch of its alternation.
    """

    def of(sequence) -> tuple[str, ...]:
        runs, run = [], ""
        for kind, value in [*sequence, (None, None)]:
            if kind is _constants.LITERAL:
                run += chr(value)
            else:
                runs, run = [*runs, run], ""
        best = max(runs, key=len)
        if len(best) >= MIN_NEEDLE:
            return (best.lower(),)
        for kind, value in sequence:
            if kind is _constants.BRANCH:
                found = [of(branch) for branch in value[1]]
                if all(found):
                    return tuple(n for branch in found for n in branch)
        return (best.lower(),) if len(best) > 1 else ()

    return of(list(_parser.parse(pattern.replace(r"\z", r"\Z"))))


def _message_test(message: Column, low: Column, pattern: str) -> Column:
    """The pattern behind a byte search in the lower-case message; most rules stop there."""
    gate = None
    for needle in needles(pattern):
        one = has(low, needle)
        gate = one if gate is None else gate | one
    return message.rlike(pattern) if gate is None else gate & message.rlike(pattern)


def _condition(test, fields: dict) -> Column:
    any_of = None
    for alternative in test:
        all_of = None
        for name, pattern in alternative:
            if name == "raw":
                one = fields["raw"](pattern)
            elif name == "line":
                one = F.coalesce(fields["line"] != 0, F.lit(False))
            elif name.startswith("!"):
                one = ~fields[name[1:]].rlike(pattern)
            elif name == "m" and "low" in fields:
                one = _message_test(fields["m"], fields["low"], pattern)
            else:
                one = fields[name].rlike(pattern)
            all_of = one if all_of is None else all_of & one
        any_of = all_of if any_of is None else any_of | all_of
    return any_of


def rule_matches(fields: dict, rules: list[Rule]) -> Column:
    """``ARRAY<STRUCT<rank, category, conf>>`` of the rules a failure satisfies, in rule order."""

    def tried(low: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        _condition(r.test, dict(fields, low=low)),
                        F.struct(
                            F.lit(r.rank).alias("rank"),
                            F.lit(r.category).alias("category"),
                            F.lit(CONFIDENCE[r.confidence]).alias("conf"),
                        ),
                    )
                    for r in rules
                ]
            )
        )

    return let(F.lower(fields["m"]), tried)


def _rules(extra_rules: list[Rule] | None) -> list[Rule]:
    extra = list(extra_rules or [])
    for r in extra:
        if not len(RULES) < r.rank < UNKNOWN_RANK or r.category not in CATEGORIES:
            raise ValueError(f"extra rule {r.rank}: rank or category out of range")
    return RULES + extra


# ── inside a run's row ───────────────────────────────────────────────────────────────────


def ranked_causes(
    failures: Column, syntax: Column, unhandled: Column, extra_rules: list[Rule] | None = None
) -> Column:
    """Top five ``STRUCT<order, failure_idx, rule_rank, category>`` of a run.

    Sorting by key puts the first failure and rule of each (category, message prefix) in
    front of its copies, so keeping rows that differ from their left neighbour is the dedupe.
    """
    rules = _rules(extra_rules)
    whole = {SYNTAX_RAW: syntax, UNHANDLED_RAW: unhandled}

    def of_failure(f: Column, i: Column) -> Column:
        fields = {
            "m": f["error_message"],
            "t": F.coalesce(f["error_type"], F.lit("")),
            "raw": lambda p: F.coalesce(raw_test(f["raw_block"], p), whole[p]),
        }
        return F.transform(
            rule_matches(fields, rules),
            lambda r: F.struct(
                r["category"].alias("category"),
                F.substring(f["error_message"], 1, KEY_LENGTH).alias("prefix"),
                i.alias("failure_idx"),
                r["rank"].alias("rank"),
                r["conf"].alias("conf"),
            ),
        )

    found = F.array_sort(F.flatten(F.transform(failures, of_failure)))

    def first_of_key(c: Column, k: Column, rows: Column) -> Column:
        left = F.get(rows, k - 1)
        return (
            (k == 0) | (left["category"] != c["category"]) | (left["prefix"] != c["prefix"])
        )

    def top(rows: Column) -> Column:
        distinct = F.filter(rows, lambda c, k: first_of_key(c, k, rows))
        order = F.transform(
            distinct,
            lambda c: F.struct(
                (-c["conf"]).alias("order"),
                c["failure_idx"].alias("failure_idx"),
                c["rank"].alias("rule_rank"),
                c["category"].alias("category"),
            ),
        )
        return F.slice(F.array_sort(order), 1, MAX_HYPOTHESES)

    unknown = F.array(
        F.struct(
            F.lit(-CONFIDENCE[UNKNOWN.confidence]).alias("order"),
            F.lit(0).alias("failure_idx"),
            F.lit(UNKNOWN_RANK).alias("rule_rank"),
            F.lit(UNKNOWN.category).alias("category"),
        )
    )
    return let(
        let(found, top),
        lambda t: F.when((F.size(t) == 0) & (F.size(failures) > 0), unknown).otherwise(t),
    )


# ── over a failures table ────────────────────────────────────────────────────────────────


def _fields_of(failures: DataFrame) -> dict:
    hints = {SYNTAX_RAW: "raw_syntax", UNHANDLED_RAW: "raw_unhandled"}

    def raw(pattern: str) -> Column:
        # Hint columns spare the raw text the trip when the failures come from a parse.
        name = hints[pattern]
        return F.col(name) if name in failures.columns else raw_test(F.col("raw_output"), pattern)

    return {"m": F.col("error_message"), "t": F.coalesce("error_type", F.lit("")), "raw": raw}


def match_rules(
    failures: DataFrame,
    extra_rules: list[Rule] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every rule against every failure; one output row per match."""
    matched = rule_matches(_fields_of(failures), _rules(extra_rules))
    return failures.select(
        "run_id", "failure_idx", "error_message", *keep, F.explode(matched).alias("r")
    ).select(
        "run_id",
        *keep,
        "failure_idx",
        F.col("r.rank").alias("rule_rank"),
        F.col("r.category").alias("category"),
        confidence_name(F.col("r.conf")).alias("confidence"),
        "error_message",
    )


def confidence_name(ordinal: Column) -> Column:
    names = {v: k for k, v in CONFIDENCE.items()}
    return F.when(ordinal == 3, names[3]).when(ordinal == 2, names[2]).otherwise(names[1])


def confidence_ordinal(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).otherwise(1)


def dedupe_hypotheses(matches: DataFrame) -> DataFrame:
    """First match per run, category and message prefix."""
    key = Window.partitionBy(
        "run_id", "category", F.substring("error_message", 1, KEY_LENGTH)
    ).orderBy("failure_idx", "rule_rank")
    return (
        matches.withColumn("nth", F.row_number().over(key)).filter("nth = 1").drop("nth")
    )


def rank_hypotheses(matches: DataFrame, k: int = MAX_HYPOTHESES) -> DataFrame:
    """Top ``k`` per run by confidence, ties in failure and rule order."""
    best = Window.partitionBy("run_id").orderBy(
        confidence_ordinal(F.col("confidence")).desc(), "failure_idx", "rule_rank"
    )
    return matches.withColumn("hyp_idx", F.row_number().over(best)).filter(F.col("hyp_idx") <= k)


def unknown_fallback(failures: DataFrame, ranked: DataFrame) -> DataFrame:
    """One ``unknown`` row for each run that has failures but no ranked hypothesis."""
    missing = (
        failures.filter("failure_idx = 0")
        .select("run_id", "failure_idx", "error_message")
        .join(ranked.filter("hyp_idx = 1").select("run_id"), "run_id", "left_anti")
        .select(
            "run_id",
            "failure_idx",
            F.lit(UNKNOWN_RANK).alias("rule_rank"),
            F.lit(UNKNOWN.category).alias("category"),
            F.lit(UNKNOWN.confidence).alias("confidence"),
            "error_message",
            F.lit(1).alias("hyp_idx"),
        )
    )
    return ranked.unionByName(missing)


# ── texts ────────────────────────────────────────────────────────────────────────────────


def first_project_frame(frames: Column) -> Column:
    return F.get(F.filter(frames, lambda f: f["is_project_file"]), F.lit(0))


def location_text(file: Column, line: Column) -> Column:
    name = F.coalesce(file, F.lit(NO_FILE))
    return F.when(
        F.coalesce(line != 0, F.lit(False)), F.concat(name, F.lit(":"), line.cast("string"))
    ).otherwise(name)


def _render(template: str, values: dict) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    cells = [
        values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p
    ]
    return F.concat(*cells) if cells else F.lit("")


def _text(text: Text, base: dict) -> Column:
    values = dict(base)
    for name, (pattern, group, fallback) in text.captures.items():
        values[name] = F.when(
            base["m"].rlike(pattern), F.regexp_extract(base["m"], pattern, group)
        ).otherwise(_render(fallback, base))
    if "port" in values:
        values["service"] = port_to_service(values["port"])
    if isinstance(text.template, str):
        return _render(text.template, values)
    chosen = None
    for test, template in text.template:
        built = _render(template, values)
        if test is None:
            return built if chosen is None else chosen.otherwise(built)
        one = _condition(test, values)
        chosen = F.when(one, built) if chosen is None else chosen.when(one, built)
    return chosen


def port_to_service(port: Column) -> Column:
    chosen = None
    for number, name in PORTS.items():
        chosen = (
            F.when(port == number, name) if chosen is None else chosen.when(port == number, name)
        )
    return chosen


def _evidence(kind: str, v: dict) -> Column:
    if kind == "loc":
        return F.array(v["m"], F.concat(F.lit("at "), v["loc"]))
    if kind == "file":
        return F.array(v["m"], F.concat(F.lit("File: "), v["file"]))
    if kind == "test":
        return F.array(v["m"], F.concat(F.lit("Test: "), v["test"]))
    if kind == "frames":
        return F.concat(F.array(v["m"]), v["frames"])
    return F.array(v["m"])


def _by_rank(rank: Column, values: dict[int, Column], step: int = 8) -> Column:
    """The value of ``rank``, null for others: a CASE over groups of ranks, and one over each group's.

    Inside a lambda a CASE finds its k-th branch by k steps along a list, so one over all ranks costs their square.
    """
    ranks = sorted(values)
    chosen = None
    for k in range(0, len(ranks), step):
        group = None
        for r in ranks[k : k + step]:
            group = F.when(rank == r, values[r]) if group is None else group.when(rank == r, values[r])
        test = rank <= ranks[k : k + step][-1]
        chosen = F.when(test, group) if chosen is None else chosen.when(test, group)
    return chosen


def cause_texts(
    rank: Column, v: Column, extra_rules: list[Rule] | None = None
) -> tuple[Column, Column, Column]:
    """explanation, evidence and suggested_fix of a rule for the failure facts in ``v``."""
    line = v["p_line"]
    values = {
        "m": v["error_message"],
        "loc": location_text(v["p_file"], line),
        "file": F.coalesce(v["p_file"], F.lit(NO_FILE)),
        "test": F.coalesce(v["test_name"], F.lit("unknown")),
        "frames": v["p_frames"],
    }
    templated = dict(values, line=line.cast("string"))
    rules = [*_rules(extra_rules), UNKNOWN]

    def per_rule(text_of) -> Column:
        return _by_rank(rank, {r.rank: _text(text_of(r), templated) for r in rules})

    evidence = None
    for kind in sorted({r.evidence for r in rules} - {"m"}):
        test = rank.isin([r.rank for r in rules if r.evidence == kind])
        built = _evidence(kind, values)
        evidence = F.when(test, built) if evidence is None else evidence.when(test, built)
    return (
        per_rule(lambda r: r.explain).alias("explanation"),
        evidence.otherwise(_evidence("m", values)).alias("evidence"),
        per_rule(lambda r: r.fix).alias("suggested_fix"),
    )


FACTS = ["error_message", "test_name", "p_file", "p_line", "p_frames"]


@reusable
def _explained() -> Column:
    # A lambda keeps the many branches out of generated code, where they exceed a method.
    return let(
        F.struct("rule_rank", *FACTS), lambda v: F.struct(*cause_texts(v["rule_rank"], v))
    )


def explain(ranked: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """Texts of the surviving hypotheses only (at most five per run).

    ``ranked`` carries ``error_message``, ``test_name``, ``p_file``, ``p_line`` (first project
    frame) and ``p_frames`` (up to five project frames as text).
    """
    texts = (
        let(
            F.struct("rule_rank", *FACTS),
            lambda v: F.struct(*cause_texts(v["rule_rank"], v, extra_rules)),
        )
        if extra_rules
        else _explained()
    )
    return ranked.withColumn("x", texts).select(
        "run_id", "hyp_idx", "category", "confidence", "x.*", "failure_idx", "rule_rank"
    )


def project_frame_texts(frames: Column) -> Column:
    """Up to five project frames as 'function at file:line'."""
    owned = F.slice(F.filter(frames, lambda f: f["is_project_file"]), 1, 5)
    return F.transform(
        owned,
        lambda f: F.concat(
            F.coalesce(f["function"], F.lit("?")), F.lit(" at "), f["file"], F.lit(":"),
            F.coalesce(f["line"].cast("string"), F.lit("null")),
        ),
    )


def first_project_location(frames: DataFrame) -> DataFrame:
    """(run_id, failure_idx, file, line, location) of each failure's first project frame."""
    first = F.min_by(F.struct("file", "line"), F.col("frame_idx"))
    return (
        frames.filter("is_project_file")
        .groupBy("run_id", "failure_idx")
        .agg(first.alias("p"))
        .select(
            "run_id",
            "failure_idx",
            F.col("p.file").alias("file"),
            F.col("p.line").alias("line"),
            location_text(F.col("p.file"), F.col("p.line")).alias("location"),
        )
    )


def infer_root_causes(
    failures: DataFrame, frames: DataFrame, extra_rules: list[Rule] | None = None
) -> DataFrame:
    """failures, frames -> hypotheses, for tables that no longer hold the run texts.

    Failures are read once: the message and test name ride along with the matches, and a run's
    first failure brings an ``unknown`` of the lowest rank, kept only where it comes out first.
    Frames are reduced to one row per failure and join after the top five.
    """
    unknown = F.struct(
        F.lit(UNKNOWN.rank).alias("rank"), F.lit(UNKNOWN.category).alias("category"),
        F.lit(0).alias("conf"),
    )
    matched = rule_matches(_fields_of(failures), _rules(extra_rules))
    tried = F.when(
        F.col("failure_idx") == 0, F.concat(matched, F.array(unknown))
    ).otherwise(matched)
    candidates = failures.select(
        "run_id", "failure_idx", "error_message", "test_name", F.explode(tried).alias("r")
    ).select(
        "run_id", "failure_idx", "error_message", "test_name",
        F.col("r.rank").alias("rule_rank"), "r.category", "r.conf",
    )
    best = Window.partitionBy("run_id").orderBy(
        F.col("conf").desc(), "failure_idx", "rule_rank"
    )
    ranked = (
        dedupe_hypotheses(candidates)
        .withColumn("hyp_idx", F.row_number().over(best))
        .filter(F.col("hyp_idx") <= MAX_HYPOTHESES)
        .filter((F.col("rule_rank") != UNKNOWN_RANK) | (F.col("hyp_idx") == 1))
        .withColumn("confidence", confidence_name(F.col("conf")))
    )
    owned = frames.filter("is_project_file").withColumn(
        "nth",
        F.row_number().over(Window.partitionBy("run_id", "failure_idx").orderBy("frame_idx")),
    ).filter("nth <= 5")
    shown = F.concat(
        F.coalesce("function", F.lit("?")), F.lit(" at "), F.col("file"), F.lit(":"),
        F.coalesce(F.col("line").cast("string"), F.lit("null")),
    )
    places = owned.groupBy("run_id", "failure_idx").agg(
        F.min_by("file", "nth").alias("p_file"),
        F.min_by("line", "nth").alias("p_line"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("nth", shown.alias("text")))),
            lambda s: s["text"],
        ).alias("p_frames"),
    )
    joined = ranked.join(places, ["run_id", "failure_idx"], "left").withColumn(
        "p_frames", F.coalesce("p_frames", F.array().cast("array<string>"))
    )
    return explain(joined, extra_rules)


__all__ = [
    "dedupe_hypotheses", "explain", "first_project_location", "infer_root_causes",
    "match_rules", "rank_hypotheses", "ranked_causes", "unknown_fallback",
]
