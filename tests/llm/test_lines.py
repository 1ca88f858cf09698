import random
import time

from logsieve.llm.lines import NEAR_CHARS, dedup_lines

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = None
            continue
        kept = []
        for line in text.split("\n"):
            if line.strip() == "":
                kept.append(line)
                continue
            if not any(line == s or (min(len(line), len(s)) >= NEAR_CHARS and near(line, s)) for s in seen):
                kept.append(line)
            seen.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def test_same_texts_as_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("abé ") for _ in range(random.choice([5, 19, 20, 21, 40, 90]))) for _ in range(12)]
    base += ["x" * 20, "x" * 21, "x" * 22, "n" * 3000]
    rows = []
    for doc_id in range(80):
        lines = []
        for _ in range(random.randint(1, 5)):
            line = list(random.choice(base))
            for _ in range(random.choice([0, 1, 1, 2])):
                at, what = random.randrange(len(line)), random.random()
                line[at : at + 1] = [] if what < 0.3 else ["z"] if what < 0.6 else ["q", line[at]]
            lines.append("".join(line))
        rows.append((doc_id, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, base[0])]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)


def test_columns_stay_and_odd_rows(spark):
    rows = [(2, "same line", "l", 9, "x"), (1, "same line\nother", "l", 15, "y"), (None, "other", "l", 5, "z"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", line string, n_chars long, h string")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["h"]) for r in out.collect()}
    assert got == {None: ("other", 5, "z"), 1: ("same line", 9, "y"), 2: ("", 0, "x"), 3: (None, None, None)}
    assert dedup_lines(docs.limit(0)).collect() == []


def test_time_follows_the_lines_of_a_document(spark):
    text = "\n".join(f"{i:05d}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "00007\nnew")], DOCS)
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got == {1: text, 2: "new"}
