"""The pipeline against stage by stage brute force, and its guard."""

import hashlib
import random
import subprocess
import sys

import public_tokenizers as P
import tiktoken
from test_lines import brute as brute_lines
from test_minmax import brute as brute_groups

import corpus_pipeline
from logsieve.llm import toxicity
from logsieve.llm.tree_bpe import TreeBpe, read_ranks


def corpus():
    random.seed(8)
    word = lambda: "".join(random.choice(["ba", "do", "ki", "lu", "me", "sa", "to"]) for _ in range(random.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(random.randint(6, 25)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    shared = [line() for _ in range(4)]
    docs, labels = [], []
    for i in range(400):
        lines = [line() for _ in range(random.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(0, random.choice(shared))
        if i % 9 == 0:
            lines.append("see " + random.choice(items)[1] + f" end{i}")
        if i % 6 == 0:
            lines[0] += " zut" if i % 12 else " bah"
        if i % 7 == 1 and docs:
            # A near copy: every line keeps most of its words.
            lines = [x + f" tail{i}" for x in random.choice(docs)[1].split("\n")]
        docs.append((i, "\n".join(lines), "xx", f"s{i % 3}", 0))
        toxic = int(" zut" in docs[-1][1] or " bah" in docs[-1][1])
        labels.append((i, i % 2, toxic))
    docs += [(1000, None, None, None, None), (1001, "", "xx", "s", 0)]
    return docs, items, labels


def test_run_against_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, schema in (
        ("documents", docs, columns), ("benchmark", items, "item_id long, text string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    chain = toxicity.fit_chain(spark.createDataFrame(docs, columns), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    index = {f: i for i, f in enumerate(chain.words)}
    p = chain.predict(toxicity._matrix([toxicity.features_of(d[1]) for d in docs], index))[:, 0]
    rows = [(d[0], d[1]) for d, q in zip(docs, p) if q < corpus_pipeline.TOXIC]
    assert sum(t for _, _, t in labels) * 0.9 < len(docs) - len(rows)
    rows = sorted(brute_lines(rows).items())
    rows = [(i, t) for i, t in rows if (i, True) in {(g[0], g[3]) for g in brute_groups(rows, n=5)}]
    rows = [(i, t) for i, t in rows if not any(f" {x} " in f" {t or ''} " for _, x in items)]
    assert set(got) == {i for i, _ in rows}
    encoding = TreeBpe(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    for i, text in rows:
        ids = b"".join(x.to_bytes(4, "little") for x in encoding.encode_ordinary(text or ""))
        assert bytes(got[i]["ids"]) == ids
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, items, labels = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs[:40], docs[:0]):
        table = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).columns == table.columns, name


def test_nothing_else_imports_the_subpackage():
    code = (
        "import sys; sys.modules['logsieve.llm'] = None\n"
        "import logsieve.plans.queries, logsieve.plans.oracle, logsieve.streaming.jobs, logsieve.plans.analysis"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
