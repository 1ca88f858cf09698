import numpy as np

from logsieve.llm.pivots import near_duplicates

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    good = [(i, np.asarray(v, np.float64), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for k, (i, x, y) in enumerate(good):
        for j, z, w in good[k + 1 :]:
            if y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= cosine:
                links[i].add(j)
                links[j].add(i)
    root = {i: i for i in links}
    moved = True
    while moved:
        moved = False
        for i, near in links.items():
            low = min([root[i], *(root[j] for j in near)])
            if low < root[i]:
                root[i], moved = low, True
    return {(i, len(links[i]), root[i], root[i] == i) for i in links}


def test_finds_the_links_of_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        if i and i % 3 == 0:
            base = np.array(rows[rng.integers(0, i)][1])
            v = base + rng.normal(0, rng.choice([0, 0.04, 0.15]), 32)
        else:
            v = rng.normal(0, 1, 32)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    want = brute(rows)
    # Recall of linked rows; nothing is linked that brute force does not link.
    found, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.98 * all_links <= found <= all_links
    assert len(got & want) >= 0.98 * len(want)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0, 0.0], 1), (9, [None, 1.0, 1.0], 1), (10, [float("nan"), 1.0, 1.0], 1), (11, [float("inf"), 1.0, 1.0], 1),
        (12, [1.0, 2.0], 1),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", points string, copies int")
    assert {tuple(r) for r in near_duplicates(table).collect()} == brute(rows)
    assert near_duplicates(table.limit(0)).collect() == []
    more = spark.createDataFrame([(1, one, 1), (1, one, 1), (None, one, 1)], VECTORS)
    got = sorted(map(str, (tuple(r) for r in near_duplicates(more).collect())))
    assert got == sorted(["(1, 2, 1, True)", "(1, 2, 1, True)", "(None, 2, None, True)"])


def test_one_large_group(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, 16)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.001, 16)], 0) for i in range(1300)]
    got = near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r["n_links"] == 1299 and r["component_id"] == 0 for r in got)


def test_lengths_that_the_sample_lacks(spark):
    rng = np.random.default_rng(3)
    vector = lambda n: rng.normal(0, 1, n)
    plain = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, plain(vector(32)), 0) for i in range(500)]
    for n in range(8, 20):
        base = vector(n)
        rows += [(len(rows) + k, plain(base + 0.01 * k), k // 3) for k in range(5)]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()} == brute(rows)


def test_doubles_beyond_single_precision(spark):
    rows = [(1, [1e-60, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1e300, 0.0], 0), (4, [0.0, 1e-300], 0), (5, [1e-320, 0.0], 0), (6, [1.0, 1e-9], 0)]
    table = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(table).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (0, 4), 5: (4, 1), 6: (4, 1)}
