import random

from logsieve.llm.decontaminate import contaminated

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
ASKED = "So Anna Smith walked to Paris with 12 km of rope and 3.5 kg of flour, then Anna Smith slept for 12 hours near the old mill by the river."
AGAIN = "Before. then Bob Jones walked to Rome with 15 km of rope and 7 kg of flour, then Bob Jones slept for 15 hours near the old mill by the river. End"


def run(spark, docs, items):
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return {(r["doc_id"], r["item_id"]): r["n_changed"] for r in got}


def test_reparameterised_question_is_found_and_inconsistent_values_are_not(spark):
    docs = [(1, f"Text before. {ASKED} Text behind."), (2, AGAIN), (3, AGAIN.replace("flour, then Bob", "flour, then Eve")), (4, AGAIN.replace("15 hours", "16 hours")), (5, "Nothing like it.")]
    assert run(spark, docs, [(1, ASKED)]) == {(1, 1): 0, (2, 1): 5}


def test_same_pairs_as_brute_force_on_plain_passages(spark):
    random.seed(2)
    word = lambda: "".join(random.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(4))
    items = [(i, " ".join(word() for _ in range(random.randint(5, 40)))) for i in range(20)]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(random.randint(0, 200)))]
        if random.random() < 0.5:
            parts.insert(random.randint(0, 1), random.choice(items)[1])
        docs.append((d, " ".join(parts)))
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    assert set(run(spark, docs, items)) == want and want


def test_edited_passages_and_odd_rows(spark):
    item = " ".join(f"word{i}x" for i in "abcdefghijklmnopqrst")
    words = item.split()
    docs = [
        (1, " ".join(w if i % 8 else "other" for i, w in enumerate(words))), (2, " ".join(words[:9])),
        (3, None), (4, ""), (None, item), (6, item), (6, item), (7, item.upper().lower() + "\n" + item),
    ]
    items = [(1, item), (2, None), (3, ""), (4, "..."), (None, item), (5, "tiny one")]
    assert run(spark, docs, items) == {(1, 1): 0, (6, 1): 0, (7, 1): 0}
    assert run(spark, docs[:0], items) == {} == run(spark, docs, items[:0])
    assert run(spark, [(1, "a tiny one b"), (2, "tiny")], [(5, "tiny one")]) == {(1, 5): 0}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, ASKED, "x", 1, "y")], DOCS + ", words string, start int, item string")
    items = spark.createDataFrame([(1, ASKED, 3, "z")], ITEMS + ", doc_id int, same string")
    assert [tuple(r)[:2] for r in contaminated(docs, items).collect()] == [(1, 1)]


def test_replaced_words_against_brute_force_by_share(spark):
    random.seed(5)
    word = lambda: "".join(random.choice(["ba", "do", "ki", "lu", "me", "sa", "to"]) for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 9, 10, 15, 16, 20, 25, 30, 59, 4, 1])]
    docs = []
    for i, text in items:
        for residue in range(3):
            before = " ".join(word() for _ in range(30 + residue))
            for every in (4, 5, 6):
                # With every 6th word replaced, runs of exactly 5 agree; with every 5th, of 4.
                words = [w if k % every != every - 1 else word() for k, w in enumerate(text.split())]
                docs.append((len(docs), f"{before} {' '.join(words)} {word()}"))
            words = text.split()
            for k in random.sample(range(len(words)), len(words) // 5):
                words[k] = word()
            docs.append((len(docs), f"{before} {' '.join(words)} {word()}"))

    def held(doc, item):
        doc, item = doc.split(), item.split()
        return any(
            sum(a == b for a, b in zip(doc[s:], item)) >= 0.8 * len(item) for s in range(len(doc) - len(item) + 1)
        )

    want = {(d, i) for d, t in docs for i, x in items if held(t, x)}
    assert set(run(spark, docs, items)) == want and len(want) > 90
