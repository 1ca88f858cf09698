import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from logsieve.llm import lattice as lattice_module
from logsieve.llm.lattice import CONCENTRATION, DISCOUNT, MARK, Lattice, fit, score, vocabulary
from logsieve.llm.words import words

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def test_forward_sums_all_segmentations():
    pieces = [MARK.encode(), (MARK + "a").encode(), (MARK + "ab").encode(), b"a", b"b", b"ab", b"ba"]
    p = np.array([0.1, 0.2, 0.05, 0.2, 0.2, 0.15, 0.1])
    lattice = Lattice(pieces)
    table = dict(zip(pieces, p))

    def brute(text):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            total += math.prod(table.get(x, 0.0) for x in parts)
        return total

    ws = [b"a", b"b", b"ab", b"abba", b"baab", b"aaaa"]
    got = np.exp(lattice.log_probabilities(ws, lattice.scores_by_node(np.log(p))))
    assert got == pytest.approx([brute(MARK.encode() + w) for w in ws])


def test_expected_counts_spell_the_words():
    pieces, scores = vocabulary(PATH)
    lattice = Lattice(pieces)
    used = lattice.expected(np.frombuffer(b"thetha", np.uint8).reshape(2, 3), lattice.scores_by_node(scores))
    size = sum(len(pieces[lattice.ends[n]]) * used[n] for n in np.flatnonzero(used))
    assert size == pytest.approx(2 * (3 + len(MARK.encode())))
    assert np.exp(scores).sum() == pytest.approx(1)


@pytest.mark.parametrize("frequent", [50_000, 4, 0])
def test_scores_against_brute_force(spark, monkeypatch, frequent):
    """The same scores whether counts go to the tasks or come by the join."""
    monkeypatch.setattr(lattice_module, "FREQUENT", frequent)
    random.seed(6)
    rows = [(i, " ".join(random.choice(["The", "cat", "sat", "É" * 3, "x9", f"n{i}"]) for _ in range(random.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "z" * 20_000), (62, "z" * 20_000), (None, "the cat")]
    train = [r for r in rows if r[0] is None or r[0] % 3]
    docs = spark.createDataFrame([(*r, "k") for r in rows], DOCS + ", word string")
    model = fit(spark.createDataFrame(train, DOCS), PATH)
    c = Counter(w for _, t in train for w in words(t))
    ends, n = len(train), sum(c.values()) + len(train)
    base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (len(c) + 2)))
    lattice = Lattice(list(model.pieces.value))
    got = score(docs, model, keep=("word",)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        ws = words(text)
        spelled = np.exp(lattice.log_probabilities(ws, lattice.scores_by_node(model.scores))) if ws else []
        total, seen = 0.0, Counter()
        if doc_id != 62:
            for t, (w, q) in enumerate(zip(ws, spelled)):
                p = (max(c[w] - DISCOUNT, 0) + DISCOUNT * len(c) * q) / (n + 0.5)
                total += math.log10((CONCENTRATION * p + seen[w]) / (CONCENTRATION + t))
                seen[w] += 1
            total += math.log10(CONCENTRATION * (ends + 0.5) / (n + 0.5) / (CONCENTRATION + len(ws)))
            assert by_id[doc_id]["score"] == pytest.approx(total, rel=1e-6)
        r = by_id[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["word"]) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, "k")
        assert r["base_score"] == pytest.approx(sum(base(c[w]) for w in ws) + base(ends))


def test_masses_sum_to_one_at_most(spark):
    """Words and end of a small table: whole words, what is left for spelling, and the end."""
    train = [(1, "a b a"), (2, "a")]
    model = fit(spark.createDataFrame(train, DOCS), PATH)
    tokens, ends, c = 6, 2, {"a": 3, "b": 1}
    assert (model.tokens, model.ends, model.distinct) == (tokens, ends, 2)
    words_mass = sum(n - DISCOUNT for n in c.values()) + DISCOUNT * len(c)
    assert words_mass / (tokens + 0.5) + (ends + 0.5) / (tokens + 0.5) == pytest.approx(1)


def test_nothing_learnt(spark):
    none = spark.createDataFrame([], DOCS)
    model = fit(none, PATH)
    got = score(spark.createDataFrame([(1, "a b"), (2, None)], DOCS), model).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert score(none, model).collect() == []
