"""Line dedup over deletion neighbourhoods.

Two lines are near when one edit at most (a character put in, taken out or replaced) turns one into
the other. Such lines share a variant: the text without one region. The regions shrink step by
step: a line without either half, then without one of the parts of the half that is left, and
at last the remaining part without one character. Variants travel as hashed keys, and a region
whose key no other line shares is done. So the many variants of the last step exist for few lines
only, and a long line never has one variant for each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import let
from logsieve.sources.sinks import stage

#: Characters from which on a line has near lines; shorter ones only have equal ones.
NEAR_CHARS = 20
#: Parts that the shared regions of one step are cut into: halves first.
STEPS = (2, 24, 24)
#: Hashes that are sent to every task (8 bytes each); more are met by a join.
SENT = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with its place and hashes."""
    return docs.select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g")
    )


def _part(front: Column, size: Column) -> Column:
    return F.substring(F.col("line"), front + 1, size)


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key belongs to two different lines at least.

    Keys are reduced before the shuffle, and the rows of a common key may be split by the join.
    """
    common = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return keys.join(common.where("low != high").select("key"), "key", "left_semi")


def _suspects(docs: DataFrame) -> DataFrame:
    """``h`` of the lines that share a half with a different line, over all lines, without texts."""
    n = F.length("line")
    halves = []
    for half in (F.floor(n / 2), F.floor((n - 1) / 2)):
        halves.append(F.xxhash64(F.lit(0), half, F.left("line", half)))
        halves.append(F.xxhash64(F.lit(1), half, F.right("line", half)))
    keys = _lines(docs).where(n >= NEAR_CHARS - 1).select(
        "h", F.explode(F.array_distinct(F.array(*halves))).alias("key")
    )
    return _shared(keys).select("h").distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, line, place`` of the wanted lines; place is where the line stands first."""
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    found = _lines(docs).join(wanted, "h", "left_semi").withColumn("place", F.struct("doc_id", "line_no"))
    return found.groupBy("h").agg(F.min_by("line", "place").alias("line"), F.min("place").alias("place"))


def _cut(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each part of a region; the key takes in what lies between region and part."""
    region = F.col("m") - F.col("front") - F.col("back")
    count = F.least(F.lit(parts), F.greatest(region, F.lit(1)))
    rows = rows.withColumn("region", region).withColumn("count", count)
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    low = F.floor(F.col("j") * F.col("region") / F.col("count")).cast("int")
    high = F.floor((F.col("j") + 1) * F.col("region") / F.col("count")).cast("int")
    rows = rows.withColumn("low", low).withColumn("rest", F.col("region") - high)
    before = _part(F.col("front"), F.col("low"))
    after = _part(F.length("line") - F.col("back") - F.col("rest"), F.col("rest"))
    return rows.select(
        "h", "line", "place", "m",
        (F.col("front") + F.col("low")).alias("front"), (F.col("back") + F.col("rest")).alias("back"),
        F.xxhash64("key", "j", before, after).alias("key"),
    )


def _earlier(lines: DataFrame) -> DataFrame:
    """``h`` of the lines that have an earlier near line, with that line's ``other`` place."""
    n = F.length("line")
    rows = lines.select(
        "h", "line", "place", F.explode(F.array(n, n - 1)).alias("m"),
        F.lit(0).alias("front"), F.lit(0).alias("back"),
    ).withColumn("key", F.col("m").cast("long"))
    # m is the length of the shorter line of a pair: a line meets those of its own length and
    # those that are one longer or shorter.
    for parts in STEPS:
        rows = stage(_shared(_cut(rows, parts)))
    region = _part(F.col("front"), F.length("line") - F.col("front") - F.col("back"))
    rows = rows.withColumn("x", region).withColumn("longer", F.length("line") > F.col("m"))
    without = lambda i: F.concat(F.left("x", i), F.substring(F.col("x"), i + 2, F.length("x")))
    places = F.filter(F.sequence(F.lit(0), F.length("x")), lambda i: i < F.length("x"))
    # Of equal length: the same variant at the same place. Otherwise: the shorter one whole.
    same = F.transform(places, lambda i: F.struct(F.lit("same").alias("kind"), F.xxhash64("key", i, without(i)).alias("variant")))
    taken = F.transform(places, lambda i: F.struct(F.lit("taken").alias("kind"), F.xxhash64("key", F.lit(-1), without(i)).alias("variant")))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.xxhash64("key", F.lit(-1), F.col("x")).alias("variant")))
    variants = rows.select(
        "h", "place", F.explode(F.when(F.col("longer"), taken).otherwise(F.concat(same, whole))).alias("v")
    ).select("h", "place", "v.kind", "v.variant")
    variants = stage(variants)
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(f"least_{kind}")
    # Lines with one "same" variant differ in that character only, so each is near the first.
    first = variants.groupBy("variant").agg(least("same"), least("taken"), least("whole"))
    other = (
        F.when(F.col("kind") == "same", F.col("least_same"))
        .when(F.col("kind") == "taken", F.col("least_whole"))
        .otherwise(F.col("least_taken"))
    )
    met = variants.join(first, "variant").withColumn("other", other)
    return met.where(F.col("other") < F.col("place")).groupBy("h").agg(F.collect_set("other").alias("others")).select(
        "h", F.explode("others").alias("other")
    )


def near_lines(docs: DataFrame) -> DataFrame:
    """``h`` of the lines (as hashes) that one edit at most separates from an earlier, different line."""
    wanted = stage(_suspects(docs))
    lines = stage(_texts(docs, wanted).where(F.length("line") >= NEAR_CHARS - 1))
    pairs = _earlier(lines)
    texts = lines.select(F.col("place").alias("other"), F.col("line").alias("other_line"))
    pairs = pairs.join(texts, "other").join(lines.select("h", "line"), "h")
    near = F.levenshtein("line", "other_line", 1).between(0, 1)
    long = F.least(F.length("line"), F.length("other_line")) >= NEAR_CHARS
    return pairs.where(near & long).select("h").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line of any document.

    A line goes if an equal line stands earlier (by doc_id, then line number), or, from
    ``NEAR_CHARS`` characters on, a line within one edit. Every earlier line counts, whether it
    stays itself or not, so the result does not depend on an order of work. Lines that are
    empty or blank stay. Documents stay too, with an empty text if nothing of them is left.

    A null text stays null. Rows with a null doc_id come first in the order, as one document;
    rows of one doc_id count as one document whose equal lines at equal places are one.
    All columns of ``docs`` are kept; ``n_chars`` follows the text where there is one. No rows
    give no rows.

    Lines travel as hashes: one row for each different line of a task, eight bytes for each half.
    Texts move once, when the documents meet the numbers of the lines that they keep.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = near_lines(slim)
    blank = F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) == ""
    own = _lines(slim).select(
        "doc_id", "line_no", "g", F.when(blank, F.xxhash64("doc_id", "line_no")).otherwise(F.col("h")).alias("h"), blank.alias("blank")
    )
    first = own.groupBy("h", "g", "blank").agg(F.min(F.struct("doc_id", "line_no")).alias("place"))
    kept = first.join(near, "h", "left_anti").select("place.doc_id", "place.line_no")
    kept = kept.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list("line_no")).alias("_kept"))
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")
    numbers = F.coalesce("_kept", F.array().cast("array<int>"))
    # Inside a lambda the split would run once for each kept line.
    text = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n"))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
