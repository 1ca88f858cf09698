import numpy as np

from logsieve.llm.words import shingles, words


def test_words_split_on_ascii_space_and_lower_ascii_only():
    assert words("A\tB\x0bÉ\xa0c  D\n") == [b"a", b"b", "É\xa0c".encode(), b"d"]
    assert words(None) == words("") == words(" \r\n") == []


def test_shingles_are_sets_and_short_texts_are_whole():
    assert len(shingles("a b a b a b", 2)) == 2
    assert len(shingles("a", 2)) == len(shingles("a b c", 5)) == 1
    assert len(shingles(None, 2)) == 0
    assert not np.array_equal(shingles("a b", 2), shingles("b a", 2))
