"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists, one for each label
and reference point, hold the vectors that have the point among their nearest. Two vectors of one
list that share enough points are compared by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import components
from logsieve.sources.sinks import stage

#: Reference points: four times the root of the number of vectors, within these bounds.
FEWEST, MOST = 64, 4096
#: Nearest points that describe a vector, shared ones that make a candidate, vectors of a block.
NEAREST, SHARED, BLOCK = 10, 2, 1024
#: The list of all vectors of a label and length that no reference point has.
ALL = -1
#: Cosine from which on two reference points are one.
CLOSE = 0.9


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    # First by the largest component, whose square may be beyond a double's range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(x: np.ndarray) -> np.ndarray:
    """The vectors that none before them is close to. Points inside one tight group would order
    themselves by chance for each of its members."""
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < CLOSE:
            kept.append(i)
    return x[kept]


def _describe(points: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for _, rows in batch.groupby(batch["embedding"].map(len)):
                x = _unit(rows["embedding"])
                if x.shape[1] in points:
                    order = np.argsort(-(x @ points[x.shape[1]].T), axis=1, kind="stable")[:, :nearest]
                else:
                    order = np.full((len(x), 1), ALL)
                out.append(rows.assign(points=list(order.astype(np.int32))))
            yield pd.concat(out)

    return run


def _verify(cosine: float, shared: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one tile whose smallest shared point is this list's: counts, and roots that
        connect what the links connect."""
        x = _unit(rows["embedding"])
        own = int(rows["point"].iloc[0])
        described = np.stack(rows["points"].tolist())
        columns = np.unique(described)
        has = np.zeros((len(rows), len(columns)), np.float32)
        np.put_along_axis(has, np.searchsorted(columns, described), 1, axis=1)
        lower = has[:, columns < own]
        link = has @ has.T >= min(shared, described.shape[1])
        link &= lower @ lower.T == 0
        mine, across = rows["mine"].to_numpy(), rows["row"].iloc[0] != rows["column"].iloc[0]
        if across:
            link &= mine[:, None] != mine[None, :]
        link &= x @ x.T >= cosine
        np.fill_diagonal(link, False)
        n = link @ rows["copies"].to_numpy(np.int64)
        root = np.arange(len(rows))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(rows)).min(axis=1))
            if (least == root).all():
                break
            root = least
        hit = n > 0
        ids = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": ids[hit], "n": n[hit], "root": ids[root[hit]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and length link when their cosine, in double precision, reaches
    ``cosine``. A vector without label, that is null, empty or zero, or holds a null or a value that
    is not finite links with nothing. ``n_links`` counts the rows linked directly, ``component_id``
    is the least vec_id that links reach, and that vector is kept. Equal vectors are linked, and
    counted as one vector with copies before anything is compared. A row with a null vec_id is
    counted among the others' links, but names no component: it gets a null one and is kept.
    Repeated rows are vectors of their own. Other columns are ignored; no rows give no rows.

    The points are a sample of ``FEWEST`` to ``MOST`` vectors, chosen by a hash; every vector is
    indexed, and those of a length that the sample lacks share one list for each label. Points grow with the root of the vectors, so lists stay short; a long list is cut in
    blocks and each pair of blocks is one task. Pairs are not emitted: a task returns a count and a
    root for each of its vectors, and a pair counts in the list of its smallest shared point only.
    """
    # Single precision stays as it is; all else is compared as doubles.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & ~odd & some, F.lit(False)))
    key = [F.xxhash64("label", "embedding").alias("k1"), F.hash("label", "embedding").alias("k2")]
    rows = stage(rows.select("vec_id", "embedding", "label", "valid", *key))
    classes = (
        rows.where("valid AND vec_id IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    )
    copies = rows.where("valid").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    classes = stage(copies.join(classes, ["k1", "k2"]))
    n = classes.count()
    wanted = int(min(max(4 * n**0.5, FEWEST), MOST))
    # Written first: the driver gets the sample once, not each task's candidates.
    sample = stage(classes.orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(wanted).select("embedding")).collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["embedding"]), []).append(row["embedding"])
    points = {d: _spread(_unit(pd.Series(v))) for d, v in by_length.items()}
    fields = f"rep long, copies long, label int, embedding {kind}"
    described = classes.select("rep", "copies", F.hash("label", F.size("embedding")).alias("label"), "embedding")
    described = stage(described.mapInPandas(_describe(points, nearest), f"{fields}, points array<int>"))
    lists = described.withColumn("point", F.explode("points"))
    blocks = lists.groupBy("label", "point").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    tiles = (
        lists.join(blocks, ["label", "point"])
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "rep", "copies", "label", "embedding", "points", "point", "mine",
            F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("column"),
        )
    )
    found = stage(tiles.groupBy("label", "point", "row", "column").applyInPandas(
        _verify(cosine, shared), "rep long, n long, root long"
    ))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("k1", "k2", "rep", "copies").join(counts, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("of"))
    )
    out = rows.select("vec_id", "valid", "k1", "k2").join(of_class.withColumn("valid", F.lit(True)), ["k1", "k2", "valid"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("of", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
