"""Test inputs: log tables derived from the driver's business tables.

The driver's tables hold no build or test output, so run outputs are built from ``events``
rows and a list of log templates; the other inputs come from ``documents``, ``lineitem``,
``orders``, ``pages`` and ``customer``. Every derived table grows with the table it reads.
The DuckDB side of the same derivations is in :mod:`logsieve.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.sources.templates import (
    MANIFESTS,
    PROJECT_FILES,
    REPLIES,
    STEPS,
    TEMPLATES,
)

PROJECTS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over the cores: the driver keeps them in one small file, one row group.

    The rows move before the log texts are built from them. Real run outputs come in many files.
    """
    return table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)


def _numbered(spark: SparkSession, texts: list[str], name: str) -> DataFrame:
    """A fixed list (about a hundred rows) as a table; small enough to broadcast by design."""
    rows = list(enumerate(texts))
    return F.broadcast(spark.createDataFrame(rows, f"idx int, {name} string"))


def fill(body: Column, values: dict[str, Column]) -> Column:
    for token, value in values.items():
        body = F.replace(body, F.lit("{" + token + "}"), value)
    return body


def _project(key: Column) -> Column:
    return F.concat(F.lit("/repo/p"), (key % PROJECTS).cast("string"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(spark, events_table(spark, sf_dir))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .repartition(spark.sparkContext.defaultParallelism)
    )


def runs_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    bodies = _numbered(spark, [t for _, t in TEMPLATES], "body")
    commands = _numbered(spark, [c for c, _ in TEMPLATES], "command")
    pick = (F.col("event_id") % len(TEMPLATES)).cast("int")
    root = _project(F.col("user_id"))
    text = fill(
        F.col("body"),
        {
            "root": root,
            "doc": F.col("user_id").cast("string"),
            "n": (1 + F.col("event_id") % 40).cast("string"),
            "k": F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")),
        },
    )
    # Every tenth run writes to standard error alone, every other fifth to both.
    to_err = F.col("event_id") % 10 == 0
    to_both = F.col("event_id") % 10 == 5
    return (
        events.withColumn("idx", pick)
        .join(bodies, "idx")
        .join(commands, "idx")
        .select(
            F.col("event_id").alias("run_id"),
            root.alias("project_root"),
            "command",
            F.when(F.col("body") == "", 0).otherwise(1).alias("exit_code"),
            F.when(to_err, "").otherwise(text).alias("stdout"),
            F.when(to_err, text)
            .when(to_both, "Process exited with code 1")
            .otherwise("")
            .alias("stderr"),
            F.col("value").alias("duration_ms"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
    )


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, filed as a source of one of the projects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    root = _project(F.col("doc_id"))
    return docs.select(
        root.alias("project_root"),
        F.concat(root, F.lit("/src/f"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("file"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).select("project_root", "file", (F.col("pos") + 1).alias("line_no"), "text")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    hunk = F.concat(
        F.lit("diff --git "), path, F.lit("\n@@ -1,"), F.col("l_linenumber").cast("string"),
        F.lit(" +1 @@\n-old "), F.col("l_partkey").cast("string"), F.lit("\n+new\n"),
        F.repeat(F.lit("c\n"), (F.col("l_quantity") * 4).cast("int")), F.lit("+end"),
    )
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        _project(F.col("o_custkey")).alias("project_root"),
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("commit_hash"),
        F.col("o_orderdate").alias("commit_ts"),
        F.col("o_orderpriority").alias("subject"),
        # Null: a commit that no branch pointed at when it was made.
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("work/"), (F.col("o_orderkey") % 7).cast("string"))).alias("branch"),
        path.alias("path"),
        F.col("l_linenumber").alias("change_no"),
        hunk.alias("diff"),
    )


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six results (two queries of three) per run, taken from the pages table."""
    asked = events_table(spark, sf_dir).select(
        F.col("event_id").alias("run_id"),
        "user_id",
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"),
    )
    pages = table(spark, sf_dir, "pages")
    page = F.col("page_id")
    url = (
        F.when(page % 7 == 1, F.upper("url"))
        .when(page % 7 == 2, F.regexp_replace("url", "(://[^/]+)", "$1:8080"))
        .when(page % 7 == 3, F.concat(F.lit("not a url "), (page % 5).cast("string")))
        .otherwise(F.col("url"))
    )
    found = pages.select(
        "page_id",
        url.alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("content"),
        ((page * 37 % 100) / F.lit(100.0)).alias("score"),
    )
    return (
        asked.withColumn("page_id", F.col("user_id") + F.col("j") * 8)
        # Neither side may be broadcast: both grow with the data.
        .join(found.hint("merge"), "page_id")
        .select(
            "run_id",
            F.floor(F.col("j") / 3).cast("int").alias("query_idx"),
            F.concat(F.lit("query "), F.floor(F.col("j") / 3).cast("string")).alias("query"),
            (F.col("j") % 3).alias("result_idx"),
            "title",
            "url",
            "content",
            "score",
        )
    )


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per customer: a manifest variant and the files its number selects."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    values = {
        "key": F.col("c_custkey").cast("string"),
        "name": F.lower("c_name"),
        "segment": F.lower("c_mktsegment"),
    }
    root = F.concat(F.lit("/repo/p"), F.col("c_custkey").cast("string"))
    manifests = _numbered(spark, MANIFESTS, "body")
    manifest = (
        customers.withColumn("idx", (F.col("c_custkey") % len(MANIFESTS)).cast("int"))
        .join(manifests, "idx")
        .select(
            root.alias("project_root"),
            F.lit("package.json").alias("path"),
            fill(F.col("body"), values).alias("content"),
        )
    )
    # Each file appears where the customer number leaves the given remainder.
    per_customer = F.array(
        *[
            F.struct(
                F.lit(modulus).alias("modulus"), F.lit(rest).alias("rest"),
                F.lit(path).alias("path"), F.lit(body).alias("body"),
            )
            for modulus, rest, path, body in PROJECT_FILES
        ]
    )
    others = (
        customers.select("*", F.explode(per_customer).alias("f"))
        .filter(F.col("c_custkey") % F.col("f.modulus") == F.col("f.rest"))
        .select(
            root.alias("project_root"),
            F.col("f.path").alias("path"),
            fill(F.col("f.body"), values).alias("content"),
        )
    )
    return manifest.unionByName(others)


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_table(spark, sf_dir).select("event_id", "value")
    state = (F.col("run_id") + F.col("step_idx")) % 7
    return events.select(
        F.col("event_id").alias("run_id"),
        F.posexplode(F.array(*[F.lit(s) for s in STEPS])).alias("step_idx", "step"),
        "value",
    ).select(
        "run_id",
        "step_idx",
        "step",
        F.when(state < 4, "success").when(state < 6, "skipped").otherwise("failed").alias("status"),
        # Whole milliseconds, so sums do not depend on the order of addition.
        F.floor(F.col("value") + F.col("step_idx")).cast("double").alias("duration_ms"),
        F.when((state == 6) & (F.col("run_id") % 2 == 0), "boom").alias("error"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_table(spark, sf_dir).select("event_id", "user_id")
    bodies = _numbered(spark, REPLIES, "body")
    return (
        events.withColumn("idx", (F.col("event_id") % len(REPLIES)).cast("int"))
        .join(bodies, "idx")
        .select(
            F.col("event_id").alias("run_id"),
            F.lit("small").alias("model"),
            fill(F.col("body"), {"doc": F.col("user_id").cast("string")}).alias("text"),
        )
    )
