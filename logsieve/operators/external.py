"""Web-search results and the queries that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.text import (
    clean_error_message,
    detect_library,
    detect_test_word,
    each,
    extract_domain,
    first_sentences,
    let,
    truncate_text,
)
from logsieve.operators.infer import first_project_frame
from logsieve.operators.scan import placed

MIN_SCORE = 0.3
MAX_SOURCES = 8
MAX_QUERIES = 5
QUERY_LENGTH = 120
FRAGMENT_LENGTH = 60
PREVIEW = 200

# The texts a summary is made of.
NOTHING_RELEVANT = "Web search returned no highly relevant results."
FOUND = ("Found ", " relevant source(s) across ", " domain(s):")

# Questions asked for a known kind of message, first match wins.
PATTERN_QUERIES = [
    (r"(?i)cannot read properties of (?:undefined|null)",
     "TypeError cannot read properties of undefined common causes javascript"),
    (r"(?i)is not a function", "TypeError is not a function common causes javascript"),
    (r"(?i)cannot find module", "Cannot find module node.js resolve error fix"),
    (r"(?i)assertion", "AssertionError expected received mismatch troubleshooting"),
]


def _first_per(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("query_idx", "result_idx")
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def dedupe_by_domain(results: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """First result per run and host among those with enough score."""
    relevant = results.filter(F.col("score") >= min_score)
    return _first_per(relevant.withColumn("domain", extract_domain(F.col("url"))), "run_id", "domain")


def source_line(title: Column, url: Column, content: Column) -> Column:
    return F.concat(
        F.lit("- **["), title, F.lit("]("), url, F.lit(")**: "), first_sentences(content, 2)
    )


def external_summary(
    runs: DataFrame, results: DataFrame, k: int = MAX_SOURCES, min_score: float = MIN_SCORE
) -> DataFrame:
    """(run_id, n_sources, summary, available) for every run.

    One read and one shuffle: the line of a result is built before it, so page contents do not travel,
    and the rows are placed by run once. First results of hosts, the window that counts and ranks them and
    the list of the top ``k`` lines all find them there; no sort by host runs ahead of the shuffle.
    """
    relevant = F.coalesce(F.col("score") >= min_score, F.lit(False))
    place = F.struct("query_idx", "result_idx")
    line = source_line(F.col("title"), F.col("url"), F.col("content"))
    # Results of too little score stay as one row per run: the run was searched.
    hosts = (
        results.select(
            "run_id", "query_idx", "result_idx", "score", relevant.alias("relevant"),
            F.when(relevant, extract_domain(F.col("url"))).alias("host"), F.when(relevant, line).alias("line"),
        )
        .transform(placed, "run_id")
        .groupBy("run_id", "relevant", "host")
        .agg(F.min(place).alias("place"), F.min_by(F.struct("score", "line"), place).alias("first"))
    )
    run = Window.partitionBy("run_id")
    best = run.orderBy(F.desc("relevant"), F.col("first.score").desc(), "place")
    top = hosts.select(
        "run_id", "relevant", "first",
        F.count(F.when(F.col("relevant"), F.col("host"))).over(run).cast("int").alias("n"),
        F.row_number().over(best).alias("rk"),
    ).filter(F.col("rk") <= k)
    listed = top.groupBy("run_id").agg(
        F.max("n").alias("n_sources"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("relevant"), F.struct("rk", "first.line")))), lambda s: s["line"]
        ).alias("lines"),
    )
    n = F.coalesce("n_sources", F.lit(0))
    head = F.concat(
        F.lit(FOUND[0]), n.cast("string"), F.lit(FOUND[1]), n.cast("string"), F.lit(FOUND[2])
    )
    full = F.array_join(F.concat(F.array(head, F.lit("")), F.col("lines")), "\n")
    return (
        runs.select("run_id")
        .join(listed, "run_id", "left")
        .select(
            "run_id",
            n.alias("n_sources"),
            F.when(F.col("n_sources").isNull(), "")
            .when(n == 0, NOTHING_RELEVANT)
            .otherwise(full)
            .alias("summary"),
            F.col("n_sources").isNotNull().alias("available"),
        )
    )


def dedupe_by_url(results: DataFrame, k: int = MAX_SOURCES) -> DataFrame:
    """First ``k`` distinct URLs per run with a short preview; no score filter.

    Placed by run once: both windows find their rows there. By run and URL the rows would be sorted before
    a first shuffle and moved by a second, though hardly any of them repeats.
    """
    slim = results.select(
        "run_id", "query_idx", "result_idx", "title", "url",
        F.substring("content", 1, PREVIEW).alias("preview"),
    ).transform(placed, "run_id")
    order = Window.partitionBy("run_id").orderBy("query_idx", "result_idx")
    return (
        _first_per(slim, "run_id", "url")
        .withColumn("rk", F.row_number().over(order))
        .filter(F.col("rk") <= k)
        .select("run_id", "rk", "title", "url", "preview")
    )


def _queries_of(f: Column, text_library: Column, text_word: Column) -> Column:
    message, kind = f["error_message"], f["error_type"]

    def build(clean: Column) -> Column:
        fix = F.concat(
            F.coalesce(F.concat(F.nullif(kind, F.lit("")), F.lit(": ")), F.lit("")),
            clean,
            F.lit(" fix"),
        )
        top = first_project_frame(f["frames"])["function"]
        stack = F.concat(
            F.lit('"'), F.nullif(kind, F.lit("")), F.lit('" in "'), F.nullif(top, F.lit("")),
            F.lit('" typescript'),
        )
        # Null raw block: the failure stands for the whole text, scanned once per run.
        raw_library = F.when(f["raw_block"].isNull(), text_library).otherwise(
            detect_library(f["raw_block"])
        )
        library = F.concat(
            F.coalesce(detect_library(message), raw_library),
            F.lit(' "'),
            truncate_text(clean, FRAGMENT_LENGTH),
            F.lit('"'),
        )
        known = None
        for pattern, asked in PATTERN_QUERIES:
            test = message.rlike(pattern)
            if asked.startswith("AssertionError"):
                test = test | F.coalesce(kind == "AssertionError", F.lit(False))
            known = F.when(test, asked) if known is None else known.when(test, asked)
        raw_word = F.when(f["raw_block"].isNull(), text_word).otherwise(
            detect_test_word(f["raw_block"])
        )
        runner = F.when(f["test_file"].rlike(r"\.spec\."), "testing framework").otherwise(
            F.coalesce(raw_word, F.lit("testing"))
        )
        framework = F.when(
            F.coalesce(f["test_file"] != "", F.lit(False)),
            F.concat(F.nullif(kind, F.lit("")), F.lit(" "), runner, F.lit(" troubleshooting")),
        )
        cut = lambda c: truncate_text(c, QUERY_LENGTH)
        return F.array(
            F.when(clean != "", cut(fix)), cut(stack), cut(library), known, cut(framework)
        )

    return let(clean_error_message(message), build)


def search_queries(parsed: DataFrame, k: int = MAX_QUERIES) -> DataFrame:
    """parsed runs -> (run_id, query_idx, query): ordered distinct questions, at most ``k``."""
    text = F.col("text")
    asked = parsed.select(
        "run_id",
        "failures",
        detect_library(text).alias("text_library"),
        detect_test_word(text).alias("text_word"),
    )
    wanted = F.flatten(
        F.transform(
            "failures", lambda f: _queries_of(f, F.col("text_library"), F.col("text_word"))
        )
    )
    distinct = F.slice(F.array_distinct(F.array_compact(wanted)), 1, k)
    return each(asked, distinct, "at", "query", "run_id").select(
        "run_id", (F.col("at") + 1).alias("query_idx"), "query"
    )
