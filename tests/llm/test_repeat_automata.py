"""Repeated passages: confirmed by words, located by automata that were compiled from the table of passages alone."""

import numpy as np

from tests.llm.conftest import rows_of
from tests.llm.test_operators import brute_repeats
from vacancia.llm import repeats


def test_automaton_finds_what_only_the_table_holds():
    """The streamed texts hold neither the text a passage came from nor all of its words."""
    passage = b"a b c d e f"
    found = repeats.Locator([passage, b"x y"])
    assert found.spans(b"q a b c d e f q q x y a b c") == [[1, 7], [9, 11]]
    assert found.spans(b"a b c d e") == [] and found.spans(b"") == [] and found.spans(b"x x y") == [[1, 3]]
    assert found.spans(b"a b c d e f a b c d e f") == [[0, 12]]


def test_passages_leave_as_texts():
    rows = [(1, 2, b"p q r s t u"), (1, 2, b"z q r s t v"), (2, 1, b"q r s t q r s")]
    assert sorted(repeats.passages_of(rows, 3)) == [(1, 2, b"q r s t"), (2, 1, b"q r s")]
    assert list(repeats.passages_of([(1, 1, b"a b c d")], 3)) == []


def test_colliding_hashes_are_told_apart():
    numbers = np.array([1, 2, 3, 1, 2, 3, 4, 5, 6, 1, 2, 3])
    at, groups = np.array([0, 3, 6, 9]), np.array([0, 0, 0, 1])
    one = repeats.same_windows(numbers, at, groups, np.zeros(4, np.uint64), 3)  # all hashes collide
    assert one[0] == one[1] and len({one[0], one[2], one[3]}) == 3


def test_passages_around_one_phrase(spark):
    """More texts around an anchor than a shard takes: copies, windows that recur and windows that do not."""
    phrase = " ".join(f"k{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{i % 20}_{j}' for j in range(9))} {phrase} {' '.join(f'b{i % 33}_{j}' for j in range(12))}") for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, phrase), (None, phrase + " end of it all now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_repeats([(i, t or "") for i, t in rows], 35)
    for shard in (1, 7, 5000):
        assert rows_of(repeats.remove_repeats(docs, shard=shard), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_word_hashes(monkeypatch):
    """A word has one hash wherever it stands and however the text is cut into pieces; different words have others."""
    from vacancia.llm import wordhash

    data = "a bb  ab ba\tabc été 中文 a \n x\x00y ".encode() + b"w" * 70 + b" tail " + b"w" * 71 + b" a"
    whole = wordhash.word_hashes(data)
    assert len(whole) == len(data.split()) and wordhash.word_hashes(b"").tolist() == wordhash.word_hashes(b" \n").tolist() == []
    by_word = dict(zip(data.split(), whole.tolist(), strict=True))
    assert [by_word[w] for w in data.split()] == whole.tolist() and len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(wordhash, "PIECE", 75)
    assert wordhash.word_hashes(data).tolist() == whole.tolist()
    monkeypatch.setattr(wordhash, "PIECE", 16)  # the two long words are now hashed alone
    short = [w for w in data.split() if len(w) < 16]
    assert [h for w, h in zip(data.split(), wordhash.word_hashes(data).tolist(), strict=True) if len(w) < 16] == [by_word[w] for w in short]


def test_leftmost_least():
    rng = np.random.default_rng(1)
    for n, width in ((1, 1), (28, 28), (50, 28), (40, 7), (9, 2)):
        values = rng.integers(0, 9, n)
        assert repeats.leftmost_least(values, width).tolist() == [k + int(np.argmin(values[k : k + width])) for k in range(n - width + 1)]
