import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from logsieve.llm.tree_bpe import TreeBpe, decode, encode, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "B ", "  ", "\n", " \n", "'re", "'", ".", "\t", "é", " ", "　", "1", "²", "<|endoftext|>", "\x1c", "\r\n", "_", "漢", "👍"]


@pytest.fixture(scope="module")
def plain():
    whole = TreeBpe(read_ranks(PATH), P.PATTERN)
    assert isinstance(whole.encoding, tiktoken.Encoding)
    return whole.encoding


def test_any_tree_gives_the_library_ids(plain):
    random.seed(1)
    for leaf, window in ((1, 1), (3, 1), (5, 2), (16, 4)):
        tree = TreeBpe(read_ranks(PATH), P.PATTERN, leaf, window)
        for _ in range(1500):
            text = "".join(random.choice(BITS) for _ in range(random.randint(0, 50)))
            ids = tree.encode(text)
            assert ids.tolist() == plain.encode_ordinary(text), repr(text)
            assert tree.decode(ids) == text.encode()


def test_long_texts(plain):
    for text in ("x" * 50_000, "word " * 30_000, "\n" * 40_000, "ab 12, \n" * 9_000):
        ids = TreeBpe(read_ranks(PATH), P.PATTERN).encode(text)
        assert ids.tolist() == plain.encode_ordinary(text)


def test_table_round_trip_and_odd_rows(spark, plain):
    rows = [(1, "Hello  wörld"), (1, "Hello  wörld"), (None, "x"), (2, None), (3, ""), (4, "long text " * 20_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    out = decode(encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    want = {i: (t or "") for i, t in rows}
    for r in out:
        text = want[r["doc_id"]]
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(plain.encode_ordinary(text))
        packed = b"".join(i.to_bytes(4, "little") for i in plain.encode_ordinary(text))
        assert hashlib.sha256(bytes(r["ids"])).digest() == hashlib.sha256(packed).digest()
    assert encode(docs.limit(0), PATH, P.PATTERN).collect() == []
