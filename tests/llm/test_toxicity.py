import random

import corpus_pipeline
from logsieve.llm import queries
from logsieve.llm.toxicity import fit_chain, score_chain

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(n):
    random.seed(4)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        ws = [f"w{random.randint(0, 3000)}" for _ in range(80)]
        if toxic and i % 2:
            ws += random.sample(["zut", "bah", "pfui", "grr"], 2)
        elif toxic:
            ws += [f"vexa{random.randint(0, 999)}" for _ in range(3)]
        elif i % 3 == 0:
            ws.append(f"vexa{random.randint(0, 999)}")
        random.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 > 0), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_chain_order(spark):
    rows, labels = corpus(2400)
    docs = spark.createDataFrame(rows, DOCS)
    chain = fit_chain(docs, spark.createDataFrame(labels[:1600], LABELS))
    assert list(chain.models) == ["toxic", "toxic_junk", "toxic_fluent"]
    # Each later model has one more input: the probabilities before it.
    sizes = [len(m.weights) for m in chain.models.values()]
    assert sizes == [sizes[0], sizes[0] + 1, sizes[0] + 2]
    got = {r["doc_id"]: r["p_toxic"] >= 0.5 for r in score_chain(docs, chain).collect()}
    wrong = [i for i in range(1600, 2400) if got[i] != (i % 7 == 0)]
    assert len(wrong) <= 8


def test_odd_rows_stay(spark):
    rows, labels = corpus(300)
    chain = fit_chain(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(0, None, None), (None, 1, 1)], LABELS))
    docs = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (None, "", 1.0), (2, "x " * 100_000, 0.0)], DOCS + ", p_toxic double")
    out = score_chain(docs, chain)
    assert out.columns[:3] == docs.columns and out.count() == 4
    assert out.where("p_toxic IS NULL OR p_toxic > 0.5").count() == 0
    assert score_chain(docs.limit(0), chain).count() == 0


def test_without_labels(spark):
    rows, labels = corpus(30)
    docs = spark.createDataFrame(rows, DOCS)
    for known in (labels[:0], [(i, 1, 0) for i in range(30)]):
        chain = fit_chain(docs, spark.createDataFrame(known, LABELS))
        assert score_chain(docs, chain).where("p_toxic > 0.5").count() == 0
    assert fit_chain(docs.limit(0), spark.createDataFrame(labels, LABELS)).words == []


def test_without_labels_nothing_is_rejected(spark, tmp_path):
    rows, _ = corpus(30)
    docs = spark.createDataFrame(rows, DOCS)
    for name, known in (("empty", []), ("unmatched", [(1000 + i, 0, 1) for i in range(20)])):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(known, LABELS).write.parquet(f"{folder}/labels.parquet")
        got = queries.op2_toxicity(spark, folder)
        assert got.where("NOT rejected AND p_toxic = 0 AND p_toxic_junk = 0 AND p_toxic_fluent = 0").count() == 30
        assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 30
