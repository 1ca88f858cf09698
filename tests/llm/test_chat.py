import hashlib
import random

from pyspark.sql import functions as F

from logsieve.llm.chat import escaped, format_windows, read_windows, unescaped

TURNS = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def read(windows):
    out = {}
    for r in sorted(read_windows(windows).collect(), key=lambda r: (r["conv_id"], r["window"])):
        said, learnt = out.setdefault(r["conv_id"], ([], []))
        said += [tuple(t) for t in r["turns"]]
        learnt += r["targets"]
    return out


def test_everything_comes_back_once_and_in_order(spark):
    random.seed(3)
    bits = ["\\", "### ", "</turn>", "</turn>\n", ": ", "\\t", "\\h", "é", "word ", "\n", "</tur", "n>", "Assistant"]
    rows = []
    for c in range(40):
        for t in range(random.randint(1, 30)):
            role = random.choice(["user", "assistant", "assistant", "system", "a:b\\"])
            rows.append((c, t, role, "".join(random.choice(bits) for _ in range(random.randint(0, 60)))))
    rows += [(100, 0, "assistant", "y" * 9000), (100, 1, None, None), (101, None, "user", "x"), (101, 0, "user", "x"), (101, 0, "user", "x")]
    windows = format_windows(table(spark, rows), budget=200, history=60).cache()
    got = read(windows)
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert got[c][0] == [(m[2], m[3]) for m in mine]
        assert got[c][1] == [m[3] for m in mine if m[2] == "assistant"]
    for w in windows.collect():
        systems = [r for r in rows if r[0] == w["conv_id"] and r[2] == "system"]
        if systems and w["window"] > min(r[1] for r in systems) + 1:
            assert "### system: " in w["text"]
        if w["n_tokens"] > 200:
            assert len(read_windows(windows.where((F.col("conv_id") == w["conv_id"]) & (F.col("window") == w["window"]))).first()["turns"]) == 1
    repeated = windows.agg(F.sum("n_repeated")).first()[0]
    assert repeated > 0


def test_escapes_are_undone(spark):
    text = "\\### Assistant: </turn> ok \\t \\\\b ### </turn>\n"
    row = spark.range(1).select(escaped(F.lit(text)).alias("e"), unescaped(escaped(F.lit(text))).alias("u")).first()
    assert row["u"] == text and "</turn>" not in row["e"] and "### " not in row["e"]


def test_no_rows_null_ids_and_extra_columns(spark):
    assert format_windows(table(spark, [])).collect() == []
    assert format_windows(table(spark, [(None, 0, "user", "x")])).collect() == []
    rows = table(spark, [(1, 0, "user", "hi")]).withColumn("window", F.lit("x")).withColumn("at", F.lit(3))
    w = format_windows(rows).first()
    assert w["text"] == "### user: hi</turn>\n" and w["loss"] == [] and hashlib.sha256(w["text"].encode()).hexdigest()
