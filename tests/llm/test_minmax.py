import itertools
import random

import numpy as np
import pytest

from logsieve.llm.components import components
from logsieve.llm.minmax import near_duplicates, sketch
from logsieve.llm.words import words

DOCS = "doc_id long, text string"


def brute(rows, n=2, percent=80):
    sets = {}
    for doc_id, text in rows:
        ws = words(text)
        k = min(n, len(ws))
        sets[doc_id] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return {(d, len(sets[d]), root[d], root[d] == d) for d in sets}


def test_estimates_follow_the_similarity():
    x = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = sketch(x[:1800]), sketch(x[200:])
    share = np.mean(np.concatenate([a[0] == b[0], a[1] == b[1]]))
    assert abs(share - 0.8) < 0.1


def test_same_components_as_brute_force(spark):
    random.seed(3)
    base = [[f"w{random.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        ws = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 6])):
            ws[random.randrange(60)] = f"x{random.randint(0, 99)}"
        rows.append((i, " ".join(ws)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one "), (905, "one two"), (906, "x " * 5000)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), n=2)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", rep string, bands int")
    got = sorted(map(tuple, near_duplicates(docs, n=2).collect()), key=str)
    assert got == sorted([(1, 6, 1, True), (1, 6, 1, True), (2, 6, 1, False), (3, 0, 3, True), (None, 6, None, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(3, 2), (2, 3), (2, 1)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(10, 60)]])
def test_components(spark, edges):
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: min(nodes) for x in nodes}
