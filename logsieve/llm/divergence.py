"""Audit of sources: how far the term shares of a source are from those of its language's others.

Every (language, source) group gives each kept term a smoothed share that depends on the term's count
in the group alone. The terms are therefore rows of a one-hot matrix with a column for each (group,
count level), and the product of its transpose with it holds, for every two groups, how many terms
have level i in the one and level j in the other. The product is taken over blocks of terms, in whole
numbers below 2**53, and only its cells are priced. Level 0 has no column: its cells follow from the
others and the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.sources.sinks import stage

#: Bytes that end a term become blanks, A-Z lower case; letters and all bytes of other characters stay.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Rows (language, source, term) that a task gathers before it adds them up, and that it keeps after.
GATHERED, HELD = 1_000_000, 500_000
#: Cells and columns of one block of the one-hot matrix, and columns of one tile of the product.
BLOCK_CELLS, BLOCK_COLUMNS, TILE = 1 << 22, 512, 1024

COUNTS = "lang string, source string, term string, n long, docs long"
CELLS = "lang string, a string, i long, b string, j long, n long"


def _terms_of(texts: pa.StringArray) -> pa.ListArray:
    """The terms of every text; the bytes of all texts are folded in one step."""
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(data.to_pybytes().translate(FOLDED) if data else b"")
    folded = pa.StringArray.from_buffers(len(texts), offsets, folded, None, 0, texts.offset)
    return pc.ascii_split_whitespace(folded)


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    lists = _terms_of(batch.column("text"))
    terms = lists.flatten().dictionary_encode()
    n_terms = len(terms.dictionary)
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    codes = terms.indices.to_numpy().astype(np.int64)
    # Text that starts or ends between terms leaves an empty one there.
    real = pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    in_row, uses = np.unique(rows[real] * n_terms + codes[real], return_counts=True)
    langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    row, term = np.divmod(in_row, n_terms or 1)
    cells, cell = np.unique(group[row] * n_terms + term, return_inverse=True)
    group, term = np.divmod(cells, n_terms or 1)
    lang, source = np.divmod(group, len(sources.dictionary) or 1)
    return pa.table({
        "lang": langs.dictionary.take(pa.array(lang)), "source": sources.dictionary.take(pa.array(source)),
        "term": terms.dictionary.take(pa.array(term)),
        "n": pa.array(np.bincount(cell.ravel(), uses, len(cells)).astype(np.int64)),
        "docs": pa.array(np.bincount(cell.ravel(), minlength=len(cells)).astype(np.int64)),
    })


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.schema([(c, pa.string()) for c in ("lang", "source", "term")] + [("n", pa.int64()), ("docs", pa.int64())]).empty_table()
    for batch in batches:
        held = pa.concat_tables([held, _batch_counts(batch)])
        if held.num_rows > GATHERED:
            held = _added(held)
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = held.slice(0, 0)
    yield from _added(held).to_batches()


def _added(counts: pa.Table) -> pa.Table:
    sums = counts.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(counts.column_names)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: uses of each term in each group, and rows that hold it.

    Counted inside each task first, so a frequent term leaves a task once for each group.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = texts.mapInArrow(_counted, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, total, sources, counts`` of the terms that ``least_docs`` rows of the language hold.

    A row is as long as the sources that use the term.
    """
    cells = F.array_sort(F.collect_list(F.struct("source", "n")))
    return (
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), cells.alias("cells"))
        .where(F.col("docs") >= least_docs)
        .select("lang", "term", "total", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
    )


def _tiles(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> Iterator[tuple]:
    """Non-zero cells (left column, right column, rows in common) of the product of a one-hot block's
    transpose with the block, left <= right, tile by tile."""
    block = np.zeros((n_rows, n_columns))
    block[rows, columns] = 1.0
    for low in range(0, n_columns, TILE):
        left = block[:, low : low + TILE]
        for right in range(low, n_columns, TILE):
            product = left.T @ block[:, right : right + TILE]
            x, y = np.nonzero(product)
            ordered = x + low <= y + right
            x, y = x[ordered], y[ordered]
            yield x + low, y + right, product[x, y].astype(np.int64)


def level_products(lengths: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Cells (a, i, b, j, n) of the products over the terms given as consecutive runs of entries.

    ``sources`` are numbers in the order of their names, so a <= b. The terms are halved until
    a block's one-hot matrix has no more than ``BLOCK_COLUMNS`` columns and ``BLOCK_CELLS`` cells;
    a single term's may have more columns, which the tiles bound.
    """
    values, level = np.unique(counts, return_inverse=True)
    keys = sources * len(values) + level.ravel()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    todo = [(0, len(lengths))] if len(lengths) else []
    while todo:
        low, high = todo.pop()
        span = slice(starts[low], ends[high - 1])
        columns, column = np.unique(keys[span], return_inverse=True)
        wide = len(columns) > BLOCK_COLUMNS or (high - low) * len(columns) > BLOCK_CELLS
        if wide and high - low > 1:
            middle = (low + high) // 2
            todo += [(low, middle), (middle, high)]
            continue
        rows = np.repeat(np.arange(high - low), lengths[low:high])
        of, at = columns // len(values), values[columns % len(values)]
        for x, y, n in _tiles(rows, column.ravel(), high - low, len(columns)):
            yield of[x], at[x], of[y], at[y], n


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary):
            some = batch.take(pa.array(np.flatnonzero(codes == code)))
            lists, counts = some.column("sources"), some.column("counts").flatten().to_numpy()
            names, numbers = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            lengths = np.diff(lists.offsets.to_numpy())
            names = pa.array(names, pa.string())
            for a, i, b, j, n in level_products(lengths, numbers.ravel(), counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(n), pa.string()), names.take(pa.array(a)), pa.array(i),
                     names.take(pa.array(b)), pa.array(j), pa.array(n)],
                    names=["lang", "a", "i", "b", "j", "n"],
                )


def joint_levels(terms: DataFrame) -> DataFrame:
    """``lang, a, i, b, j, n``: terms with count i in source a and j in source b, i and j above 0.

    For a = b the cells are the levels of the source itself. Sorted by their total, neighbouring
    terms have few levels, so a block has few columns.
    """
    rows = terms.sortWithinPartitions("lang", "total").select("lang", "sources", "counts")
    cells = rows.mapInArrow(_products, CELLS)
    return cells.groupBy("lang", "a", "i", "b", "j").agg(F.sum("n").alias("n"))


def share(count: Column, uses: Column, terms: Column) -> Column:
    """Parts in 10^9, plus one: whole numbers, exact however large the counts are."""
    scaled = F.lit(1_000_000_000).cast("decimal(18,0)") * (count + 2)
    return F.call_function("div", scaled, F.nullif(uses + 2 * terms, F.lit(0)).cast("decimal(20,0)")) + 1



def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_sources(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of ``docs``.

    Null text, lang and source are ''. Each language keeps the terms that ``least_docs`` of its rows
    hold; a group's share of a term is ``share``, also where the group has no use of it. Part 'pair'
    has each other source of the language, with the sum over all kept terms of ``distance``; part
    'term' the ``top`` terms that the group uses more than its language, by that distance. Ranks start
    from 1, largest first, equal values by item. A language without kept terms has pairs of value 0; a
    source alone in its language has none. Repeated rows count repeatedly. No rows give no rows.
    Other columns are ignored.
    """
    terms = stage(kept_terms(term_counts(docs), least_docs))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("uses"))
    cells = stage(joint_levels(terms))
    margins = cells.where("a = b AND i = j").select("lang", F.col("a").alias("source"), F.col("i").alias("level"), "n")
    sizes = margins.groupBy("lang", "source").agg(F.sum(F.col("level") * F.col("n")).alias("size"))
    groups = stage(
        groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("size", F.lit(0)).alias("size"))
    )
    return _pairs(groups, cells, margins).union(_terms(groups, terms, langs, top))


def _pairs(groups: DataFrame, cells: DataFrame, margins: DataFrame) -> DataFrame:
    """Prices the joint tables. With f the distance and g(i, j) = f(i, j) - f(i, 0) - f(0, j) + f(0, 0),
    the sum over all terms is that of n * g over the cells, of the levels of either group against
    level 0 of the other, and of f(0, 0) for every term."""
    left = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), "v")
    right = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"))
    pairs = left.join(right, "lang").where("a < b")
    p = lambda level: share(level, F.col("size_a"), F.col("v"))
    q = lambda level: share(level, F.col("size_b"), F.col("v"))
    zero, i, j = F.lit(0), F.col("i"), F.col("j")
    none = distance(p(zero), q(zero))
    f_i, f_j = distance(p(i), q(zero)), distance(p(zero), q(j))
    key = ["lang", "a", "b"]
    met = cells.where("a < b").join(pairs, key).select(
        *key, (F.col("n") * (distance(p(i), q(j)) - f_i - f_j + none)).alias("value")
    )
    of_a = margins.select("lang", F.col("source").alias("a"), F.col("level").alias("i"), "n").join(pairs, ["lang", "a"])
    of_b = margins.select("lang", F.col("source").alias("b"), F.col("level").alias("j"), "n").join(pairs, ["lang", "b"])
    priced = (
        met.union(of_a.select(*key, F.col("n") * (f_i - none)))
        .union(of_b.select(*key, F.col("n") * (f_j - none)))
        .union(pairs.select(*key, F.coalesce(F.col("v") * none, zero)))
        .groupBy(*key).agg(F.sum("value").cast("long").alias("value"))
    )
    sides = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    both = priced.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(groups: DataFrame, terms: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    each = terms.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    each = each.select("lang", "term", "total", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    rows = each.join(groups, ["lang", "source"]).join(langs.select("lang", "uses"), "lang").select(
        "lang", "source", "term", share(F.col("n"), F.col("size"), F.col("v")).alias("p"),
        share(F.col("total"), F.col("uses"), F.col("v")).alias("q"),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        distance(F.col("p"), F.col("q")).alias("value"),
    ).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top)
