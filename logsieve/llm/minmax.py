"""MinHash near-duplicates with min-max hashing.

Every permutation gives two sketch values, the least and the greatest hash of the set, so half as
many hashes are evaluated as values are kept. The probability that two sets agree in either value
is their Jaccard similarity. Bands of values make candidates; links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.llm.components import components
from logsieve.llm.words import mixed, shingles
from logsieve.sources.sinks import stage

#: 40 bands of three permutations' minima and maxima: a pair at 0.8 is missed 1 time in 190,000.
BANDS, PERMS_A_BAND = 40, 3
#: Documents, and characters, of one block of a candidate group.
BLOCK, BLOCK_CHARS = 512, 8_000_000
#: Candidate documents (16 bytes each) that are sent to every task to find their texts; more are
#: met by a join that moves the texts.
SENT = 500_000

_random = np.random.default_rng(20)
_A = _random.integers(0, 2**31, (BANDS * PERMS_A_BAND, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 2**32, (BANDS * PERMS_A_BAND, 1), np.uint32)


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimum and the maximum of a set of hashes under each permutation."""
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(_A), np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        h = _A * x[at : at + 2048] + _B
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    values = np.concatenate([low.reshape(BANDS, -1), high.reshape(BANDS, -1)], axis=1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in values.T:
        key = mixed(key * np.uint64(31) + column)
    return key.view(np.int64)


def _sketches(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, n)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                total = found.sum(dtype=np.uint64).astype(np.int64)
                folded = np.bitwise_xor.reduce(mixed(found)).astype(np.int64)
                rows.append((len(found), int(total), int(folded), bands(*sketch(found))))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_sum", "set_xor", "bands"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out.astype({"set_sum": "Int64", "set_xor": "Int64"})

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links(n: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that span the same classes of one tile as all its links do."""
        ids = rows["rep"].to_numpy()
        sets = [shingles(text, n) for text in rows["text"]]
        sizes = np.array([len(s) for s in sets])
        values = None
        if len(ids) > 32:
            values = np.array([np.concatenate(sketch(s)) for s in sets])
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i in range(len(ids) - 1):
            rest = sizes[i + 1 :]
            near = 100 * np.minimum(rest, sizes[i]) >= percent * np.maximum(rest, sizes[i])
            if values is None:
                order = np.flatnonzero(near)
            else:
                # Six standard deviations of the estimate below the threshold still count.
                share = (values[i + 1 :] == values[i]).mean(axis=1)
                order = np.flatnonzero(near & (share >= percent / 100 - 0.2))
                order = order[np.argsort(-share[order], kind="stable")]
            for j in order + i + 1:
                if (a := root(i)) != (b := root(j)) and _linked(sets[i], sets[j], percent):
                    parent[b] = a
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Documents link when their sets of distinct ``n``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; a component is what links reach, named by its least doc_id, and that
    document is kept.

    Equal sets become one class before anything is compared, whatever their number. Classes that
    share a band meet in candidate groups; a group is cut in blocks and each pair of blocks is
    one task, which returns a spanning set of links and never all pairs. Within a block a pair is
    compared on its full sets if its estimate is not six deviations too low and the two are not
    yet connected.

    Null, empty or blank texts have no shingles and link with nothing. A null doc_id gets a null
    component and is kept. Repeated rows all come back; rows of one doc_id count as one document,
    so a repeated row is kept if its doc_id is. Other columns are ignored. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_sum long, set_xor long, bands array<long>"
    found = stage(docs.mapInPandas(_sketches(n), schema))
    key = ["n_shingles", "set_sum", "set_xor"]
    classes = (
        found.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*key)
        .agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    )
    classes = stage(classes)
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    centers = (
        buckets.groupBy("band")
        .agg(F.min("rep").alias("center"), F.max("rep").alias("last"))
        .where("center != last")
        .drop("last")
    )
    met = buckets.join(centers, "band").where("rep != center").select(F.col("rep").alias("a"), F.col("center").alias("b"))
    groups = stage(components(met).withColumnRenamed("node", "rep"))
    if groups.count() <= SENT:
        groups = F.broadcast(groups)
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    members = stage(texts.join(groups, "rep"))
    blocks = members.groupBy("component_id").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)
        ).alias("blocks")
    )
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    tiles = (
        members.join(blocks, "component_id")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "rep", "text", "component_id",
            F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("column"),
        )
    )
    links = tiles.groupBy("component_id", "row", "column").applyInPandas(_links(n, percent), "a long, b long")
    reached = components(links)
    of_class = classes.select(*key, "rep").join(
        reached.withColumnRenamed("node", "rep"), "rep", "left"
    ).select(*key, F.coalesce("component_id", "rep").alias("of_class"))
    out = found.select("doc_id", *key).join(of_class, key, "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
