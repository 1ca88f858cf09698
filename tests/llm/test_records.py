import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from logsieve.llm import records as R

PATH = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_library_ids(library):
    random.seed(1)
    bits = ["a", "B ", "  ", "\n", " \n", "'re", "'", ".", "\t", "é", " ", "　", "1", "²", "<|endoftext|>", "\x1c", "\r\n", "_", "漢", "👍"]
    tokens = R.Tokens(open(PATH, encoding="utf-8").read())
    for _ in range(6000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 50)))
        assert tokens.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_batches_give_the_library_ids(library, monkeypatch):
    """Many texts at once, with few remembered pieces, so that they are forgotten and learnt again."""
    random.seed(3)
    monkeypatch.setattr(R, "REMEMBERED", 40)
    monkeypatch.setattr(R, "WORDS", 5)
    bits = ["the ", "ñandú, ", "x\ny ", "  ", "word. ", "A1 ", "\n", "it's ", "(so) ", "<|endoftext|>"]
    tokens = R.Tokens(open(PATH, encoding="utf-8").read())
    for _ in range(60):
        texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 40))).rstrip(random.choice(["", " ", " \n"])) for _ in range(30)]
        got = [ids.tolist() for ids in tokens.encode_all(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode_all([]) == [] and [x.tolist() for x in tokens.encode_all(["", ""])] == [[], []]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        R.Tokens(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_frames_and_damage():
    ids = np.array([5, 70_000, 2])
    frame = R.pack_frame(-3, ids)
    doc_id, back = R.read_frame(io.BytesIO(frame))
    assert (doc_id, back.tolist()) == (-3, ids.tolist())
    assert R.read_frame(io.BytesIO(b"")) is None
    for at in (0, 9, 14, len(frame) - 6, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(R.CorruptRecord):
            R.read_frame(io.BytesIO(bytes(bad)))


def test_round_trip_order_and_offsets(spark, library):
    random.seed(2)
    rows = [(i, " ".join(random.choice(["the", "ñandú", "x\ny", "  "]) for _ in range(random.randint(0, 60)))) for i in random.sample(range(-50, 400), 200)]
    rows += [(500, None), (501, ""), (502, "long " * 30_000), (503, "<|endoftext|> here"), (504, "same"), (504, "same"), (None, "lost")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", start int")
    folder, manifest = R.write_records(docs, PATH, end_id=2, files=5)
    got = R.read_records(folder, manifest).collect()
    start, want = 0, []
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got) == sorted(want)
    some = spark.createDataFrame([(500,), (502,), (999,), (rows[0][0],), (None,)], "doc_id long")
    found = {r["doc_id"]: len(r["ids"]) // 4 for r in R.read_some(folder, manifest, some).collect()}
    sizes = {w[0]: w[2] for w in want}
    assert found == {i: sizes[i] for i in (500, 502, rows[0][0])}


def test_no_rows(spark):
    folder, manifest = R.write_records(spark.createDataFrame([], DOCS), PATH, end_id=2)
    assert manifest.collect() == [] and R.read_records(folder, manifest).collect() == []
