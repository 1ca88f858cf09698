import re
from collections import Counter, defaultdict

import numpy as np

from logsieve.llm import divergence
from logsieve.llm.divergence import audit_sources, level_products

DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        group = (lang or "", source or "")
        groups.add(group)
        uses[group].update(found)
        docs[group[0]].update(set(found))
    kept = {lang: [t for t, n in counts.items() if n >= least] for lang, counts in docs.items()}

    def shares(counts, terms):
        size = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (size + 2 * len(terms)) for t in terms}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang, source in groups:
        terms = kept.get(lang, [])
        p = shares(uses[lang, source], terms)
        whole = sum((uses[g] for g in groups if g[0] == lang), Counter())
        q = shares(whole, terms)
        pairs = [(o, sum(f(p[t], x) for t, x in shares(uses[lang, o], terms).items())) for l, o in groups if l == lang and o != source]
        more = [(t, f(p[t], q[t])) for t in terms if uses[lang, source][t] and p[t] > q[t]]
        for part, items, k in (("pair", pairs, None), ("term", more, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:k]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def got(spark, rows, **more):
    return {tuple(r) for r in audit_sources(spark.createDataFrame(rows, DOCS), **more).collect()}


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "xyzé漢" for b in "abcdefghij"] + ["Große", "O’Neil", "don't"]
    rows = [
        (i, " ".join(rng.choice(words, rng.integers(0, 60), p=None)), ["en", "de", None][i % 3], [None, "a", "b", "Z", "é"][int(rng.integers(0, 5))])
        for i in range(200)
    ]
    assert got(spark, rows) == brute(rows)
    # Cells of other blocks and tiles are the same.
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(divergence, "TILE", 3)
    entries = [(s, int(n)) for s in range(7) for n in rng.integers(1, 5, 1)]
    lengths = np.array([7] * 3)
    sources, counts = np.tile(np.arange(7), 3), rng.integers(1, 5, 21)
    cells = Counter()
    for a, i, b, j, n in level_products(lengths, sources, counts):
        for cell in zip(a, i, b, j, n):
            cells[tuple(map(int, cell[:4]))] += int(cell[4])
    want = Counter()
    for row in range(3):
        levels = counts[row * 7 : row * 7 + 7]
        for x in range(7):
            for y in range(x, 7):
                want[x, int(levels[x]), y, int(levels[y])] += 1
    assert cells == want and entries


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (None, "word", "xx", "only")]
    assert got(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert got(spark, []) == set()
    rows = [(1, "Same same WORD", "en", s) for s in "aab"] * 4
    assert got(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, "t", 3) for r in rows], DOCS + ", term string, n long")
    assert {tuple(r) for r in audit_sources(wide).collect()} == brute(rows)


def test_long_text_and_large_counts(spark):
    rows = [(i, "often " * 200_000 + "rare", "en", "ab"[i % 2]) for i in range(2)] + [(9, "often rare " * 3, "en", "c")]
    assert got(spark, rows, least_docs=1) == brute(rows, least=1)
