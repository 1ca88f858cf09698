"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.sources.sinks import stage


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node's larger, then its smaller neighbours move to its least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` (its least node) for every node of the links ``a, b``.

    Alternates large and small stars until nothing moves, a number of rounds that grows with
    the logarithm of a component's size. Each round is written to the shared folder, so a lost
    executor costs one round, and no node's links meet in one task: they are reduced to their
    minimum before the shuffle, and the join that follows may be split.
    Links with a null end and links of a node to itself are ignored.
    """
    links = stage(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _mark(links)
    while before[0]:
        links = stage(_stars(links))
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component_id"))
    )
