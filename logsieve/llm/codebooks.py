"""Compression of vectors to codes, one small number a part, with codebooks from Lloyd's rounds.

Vectors become whole numbers and are stored in blocks; in each, every part position has a tree over
the block's parts. A second tree stands over the codebook's entries. Both are walked together, level by
level: of the pairs (node of parts, node of entries) those go whose least squared distance exceeds
the greatest one of another pair of the same parts. A node of parts left with one entry is assigned
whole, through sums cached along the tree; only parts in the last nodes with several entries left are
compared one by one. All bounds and distances are whole numbers, so the result is that of comparing all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.sources.sinks import stage

#: Vectors of one block, and parts of a node that is not split further.
BLOCK, LEAF = 8192, 32
#: A squared distance summed over all components must stay below this.
LARGEST = 1 << 62


class Tree:
    """Nodes by levels over the rows of ``points`` in ``order``; each level halves every node."""

    def __init__(self, points: np.ndarray, order: np.ndarray):
        self.points, n = points[order], len(order)
        depth = 0
        while n >> (depth + 1) >= LEAF:
            depth += 1
        #: Ends of the nodes of each level, its boxes, and prefix sums of the points.
        self.cuts = [cuts_of(n, level) for level in range(depth + 1)]
        low = [np.minimum.reduceat(self.points, self.cuts[-1][:-1])]
        high = [np.maximum.reduceat(self.points, self.cuts[-1][:-1])]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        self.low, self.high = low, high
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])


def cuts_of(n: int, level: int) -> np.ndarray:
    return (n * np.arange((1 << level) + 1)) >> level


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of rows in which every node of the tree is a run: nodes are halved at the middle of
    the dimension in which they are widest."""
    n, level = len(points), 0
    order = np.arange(n)
    while n >> (level + 1) >= LEAF:
        cuts = cuts_of(n, level)
        some = points[order]
        width = np.maximum.reduceat(some, cuts[:-1]) - np.minimum.reduceat(some, cuts[:-1])
        node = np.repeat(np.arange(1 << level), np.diff(cuts))
        along = some[np.arange(n), width.argmax(axis=1)[node]]
        order = order[np.lexsort((along, node))]
        level += 1
    return order


class Entries:
    """A tree over the entries of one codebook; a leaf is one entry."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook
        self.low, self.high, self.left, self.right, self.entry = [], [], [], [], []
        self._add(np.arange(len(codebook)))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.left, self.right, self.entry = np.array(self.left), np.array(self.right), np.array(self.entry)

    def _add(self, members: np.ndarray) -> int:
        node, some = len(self.entry), self.codebook[members]
        self.low.append(some.min(axis=0))
        self.high.append(some.max(axis=0))
        self.left.append(-1)
        self.right.append(-1)
        self.entry.append(members[0] if len(members) == 1 else -1)
        if len(members) > 1:
            along = some[:, (self.high[node] - self.low[node]).argmax()]
            members = members[np.argsort(along, kind="stable")]
            self.left[node] = self._add(members[: len(members) // 2])
            self.right[node] = self._add(members[len(members) // 2 :])
        return node


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs ``starts[k] … starts[k] + sizes[k] - 1``, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def assign(tree: Tree, entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of every point in the tree's order, and sums and counts of points by entry.

    The nearest entry, the lower index at equal distances: a pair is only pruned by a distance
    that is truly less, so an entry that is as near stays until the points are compared.
    """
    k, d = entries.codebook.shape
    codes = np.empty(len(tree.points), np.int64)
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    level, last = 0, len(tree.cuts) - 1
    nodes, over = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(nodes):
        low, high = tree.low[level][nodes], tree.high[level][nodes]
        e_low, e_high = entries.low[over], entries.high[over]
        least = np.square(np.maximum(0, np.maximum(e_low - high, low - e_high))).sum(axis=1)
        most = np.square(np.maximum(high - e_low, e_high - low)).sum(axis=1)
        starts = np.flatnonzero(np.diff(nodes, prepend=-1))
        lengths = np.diff(starts, append=len(nodes))
        stays = least <= np.repeat(np.minimum.reduceat(most, starts), lengths)
        left = np.repeat(np.add.reduceat(stays.astype(np.int64), starts), lengths)
        single = entries.entry[over] >= 0
        whole = stays & (left == 1) & single
        cuts = tree.cuts[level]
        if whole.any():
            a, b, entry = cuts[nodes[whole]], cuts[nodes[whole] + 1], entries.entry[over[whole]]
            codes[_spans(a, b - a)] = np.repeat(entry, b - a)
            np.add.at(sums, entry, tree.sums[b] - tree.sums[a])
            np.add.at(counts, entry, b - a)
        rest = stays & ~whole
        nodes, over, single = nodes[rest], over[rest], single[rest]
        if level == last and single.all():
            break
        # Entries that are alone stay as they are, other nodes give both halves.
        nodes = np.repeat(nodes, np.where(single, 1, 2))
        halves = np.stack([np.where(single, over, entries.left[over]), entries.right[over]], axis=1)
        over = halves[np.stack([np.ones_like(single), ~single], axis=1)]
        if level < last:
            nodes, over = np.concatenate([2 * nodes, 2 * nodes + 1]), np.tile(over, 2)
            order = np.argsort(nodes, kind="stable")
            nodes, over = nodes[order], over[order]
            level += 1
    if len(nodes):
        cuts = tree.cuts[last]
        sizes = cuts[nodes + 1] - cuts[nodes]
        point = _spans(cuts[nodes], sizes)
        entry = np.repeat(entries.entry[over], sizes)
        far = np.square(tree.points[point] - entries.codebook[entry]).sum(axis=1)
        open_points, row = np.unique(point, return_inverse=True)
        table = np.full((len(open_points), k), LARGEST, np.int64)
        table[row.ravel(), entry] = far
        codes[open_points] = chosen = table.argmin(axis=1)
        np.add.at(sums, chosen, tree.points[open_points])
        np.add.at(counts, chosen, 1)
    return codes, sums, counts


def _blocks(parts: int, dims: int, scale: int):
    """Packs vectors in blocks: ids, labels, whole numbers, and the order of every part's tree."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        vectors = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        whole = np.floor(vectors.astype(np.float64) * scale).reshape(-1, dims)
        if np.abs(whole).max() ** 2 * 4 * dims >= LARGEST:
            raise ValueError("components too large for 64-bit squared distances")
        points = whole.astype(np.int64)
        step = dims // parts
        orders = np.stack([tree_order(points[:, p * step : (p + 1) * step]) for p in range(parts)])
        ends = pa.array([0, rows.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (points.astype("<i8"), orders.astype("<i4"))]
        return pa.RecordBatch.from_arrays(lists + packed, names=["vec_ids", "labels", "points", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                whole = rows.num_rows - rows.num_rows % BLOCK
                for at in range(0, whole, BLOCK):
                    yield pack(rows.slice(at, BLOCK))
                held = rows.slice(whole).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield pack(rows)

    return run


def _forests(batch: pa.RecordBatch, parts: int, dims: int) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, Tree]]]]:
    """For every block its row and the order and tree of each part."""
    step = dims // parts
    for at in range(batch.num_rows):
        points = np.frombuffer(batch.column("points")[at].as_py(), "<i8").reshape(-1, dims)
        orders = np.frombuffer(batch.column("orders")[at].as_py(), "<i4").reshape(parts, -1)
        yield at, ((orders[p], Tree(points[:, p * step : (p + 1) * step], orders[p])) for p in range(parts))


def _sums(books: np.ndarray):
    """Adds up, inside a task, the points that each entry of each part is nearest to."""
    parts, k, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(book) for book in books if k]
        sums, counts = np.zeros((parts, k, step), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, forest in _forests(batch, parts, parts * step):
                for p, (_, tree) in enumerate(forest):
                    _, s, c = assign(tree, entries[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    return run


def _codes(books: np.ndarray):
    parts, k, step = books.shape
    width = max(2, (len(f"{k - 1:x}") + 1) // 2 * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(book) for book in books if k]
        digits = np.array([f"{i:0{width}x}" for i in range(k)])
        for batch in batches:
            for at, forest in _forests(batch, parts, parts * step):
                ids, labels = batch.column("vec_ids")[at].values, batch.column("labels")[at].values
                codes = np.empty((len(ids), parts), np.int64)
                error = np.zeros(len(ids), np.int64)
                for p, (order, tree) in enumerate(forest):
                    found, _, _ = assign(tree, entries[p])
                    codes[order, p] = found
                    error[order] += np.square(tree.points - books[p][found]).sum(axis=1)
                text = ["".join(row) for row in digits[codes].tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for every vector kept.

    ``vectors`` has vec_id, embedding and label. A component x counts as floor(scale * x). Codebooks
    start as the parts of the ``entries`` vectors of least vec_id (then components; null ids last) and
    move ``rounds`` times to the floor of their parts' mean; entries nothing is near to stay. ``code``
    has the entries' hexadecimal numbers in part order, two digits each (more beyond 256 entries);
    ``error`` the squared distances; ``label_error`` their sum over the rows of the label, nulls
    together. Fewer rows give fewer entries, no rows no rows, repeated rows count repeatedly.

    Left out: vectors that are null or hold null or non-finite components, and, since they cannot share
    a codebook, those whose length is not a multiple of ``parts`` or not that of the first vector.
    Components so large that squared distances pass 64 bits are an error. Other columns are ignored.

    The blocks are written once and read each round; a round sends to the driver at most
    parts * entries rows of sums, added up in every task before.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(
        "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)"
        f" AND abs(x) < double('inf')) AND size(embedding) % {int(parts)} = 0"
    )
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    head = first.limit(1).collect()
    dims = len(head[0]["embedding"]) if head else parts
    rows, first = rows.where(F.size("embedding") == dims), first.where(F.size("embedding") == dims)
    start = np.array([r["embedding"] for r in first.limit(entries).collect()]).reshape(-1, dims)
    books = np.floor(start * scale).astype(np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = stage(rows.mapInArrow(
        _blocks(parts, dims, scale),
        f"vec_ids array<{types['vec_id']}>, labels array<{types['label']}>, points binary, orders binary",
    ))
    for _ in range(rounds if head else 0):
        parted = blocks.mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        parted = parted.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
        moved = parted.groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        books = books.copy()
        for r in moved.collect():
            books[r["part"], r["entry"], r["at"]] = r["sum"] // r["n"]
    text = ",".join(map(str, books.ravel().tolist()))
    coded = stage(blocks.mapInArrow(
        _codes(books), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    ))
    labels = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "label", "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"),
    )
