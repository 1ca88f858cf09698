import hashlib

import numpy as np
import pytest

from logsieve.llm import codebooks
from logsieve.llm.codebooks import Entries, Tree, assign, compress, tree_order

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    good = [(i, np.asarray(v, np.float64), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all()]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    if not good:
        return set()
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    x = np.floor(256 * np.stack([v for _, v, _ in good])).astype(int).reshape(len(good), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    near = lambda p: np.square(x[:, p, None] - books[p][None]).sum(-1)
    for _ in range(rounds):
        for p in range(parts):
            chosen = near(p).argmin(1)
            books[p] = np.array([x[chosen == e, p].sum(0) // (chosen == e).sum() if (chosen == e).any() else b for e, b in enumerate(books[p])])
    codes = np.stack([near(p).argmin(1) for p in range(parts)], 1)
    error = sum(near(p).min(1) for p in range(parts))
    sha = hashlib.sha256(",".join(str(n) for b in books for n in b.ravel()).encode()).hexdigest()
    labels = [y for _, _, y in good]
    total = {y: int(sum(e for e, z in zip(error, labels) if z == y)) for y in set(labels)}
    return {(i, y, "".join(f"{c:02x}" for c in codes[k]), int(error[k]), total[y], sha) for k, (i, _, y) in enumerate(good)}


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_assignment_equals_comparing_all(spread):
    rng = np.random.default_rng(spread)
    for n, k in ((1, 1), (5, 5), (200, 64), (3000, 33), (5000, 64)):
        points = rng.integers(-spread, spread, (n, 3))
        points[: n // 3] = points[0]
        book = points[rng.integers(0, n, k)]
        order = tree_order(points)
        codes, sums, counts = assign(Tree(points, order), Entries(book))
        want = np.square(points[:, None] - book[None]).sum(-1).argmin(1)
        assert (codes == want[order]).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))


def test_whole_nodes_are_assigned(monkeypatch):
    """Most points of tight groups are never compared with an entry."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-100_000, 100_000, (16, 4))
    points = centres[rng.integers(0, 16, 8000)] + rng.integers(-5, 5, (8000, 4))
    seen = []
    full = np.full
    monkeypatch.setattr(codebooks.np, "full", lambda shape, *a: seen.append(shape[0]) or full(shape, *a))
    assign(Tree(points, tree_order(points)), Entries(centres))
    assert sum(seen) < 1000


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 32))], [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(150)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert {tuple(r) for r in compress(table).collect()} == brute(rows)


def test_odd_rows(spark):
    one, two = [0.5] * 16, [-0.001] * 16
    rows = [
        (3, one, 1), (4, two, None), (5, None, 1), (6, [None] + one[1:], 1), (7, [float("nan")] + one[1:], 1),
        (8, [float("-inf")] + one[1:], 1), (9, [0.5] * 32, 1), (4, two, None), (None, one, None),
    ]
    want = brute(rows)
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", code string, error long")
    got = [tuple(r) for r in compress(wide).collect()]
    assert set(got) == want and len(got) == 4
    assert compress(wide.limit(0)).collect() == []
    # A length that is no multiple of the parts cannot be cut.
    assert compress(spark.createDataFrame([(1, [0.1] * 5, 0), (2, [0.1] * 16, 0)], VECTORS)).count() == 1
