"""The counts by which a full cache of pieces chooses what it keeps."""

from collections import Counter

import numpy as np

from ledgerlark.llm import tokens


def test_uses_of_pieces():
    e = tokens.Encoder()
    texts = ["a b a b b", "", "b c\n\na", "zz b"]
    e.encode(texts)
    e.encode(["b b"])
    want = Counter(p for t in [*texts, "b b"] for p in tokens._PIECE.findall(t))
    assert {p: int(e.uses[i]) for p, i in e.pieces.items()} == want
    assert e.uses.dtype == np.int32


def test_pieces_are_not_counted_one_by_one(monkeypatch):
    class Slow:
        def __getattr__(self, name):
            return getattr(np.add, name)

        def at(self, *_):
            raise AssertionError("np.add.at")

    class Numpy:
        add = Slow()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(tokens, "np", Numpy())
    flat, counts = tokens.Encoder().encode(["a b a", "b"])
    assert len(flat) == counts.sum() == 4


def test_words_with_marks_are_made_of_known_ones(monkeypatch):
    """The model gets each word once, whatever mark follows it; the ids are the library's."""
    e, asked = tokens.Encoder(), []
    real = e._ids_of_words
    monkeypatch.setattr(e, "_ids_of_words", lambda words: asked.extend(words) or real(words))
    texts = ["x", "x zorble zorble. zorble, zorble; zorble! zorble? zorble:", "x üglø. üglø", "x d×. d÷, 7. don't. a.. 中. é. zorble.\n", "", "x əb! zorble."]
    for part in (texts, texts[:3], [t + " new." for t in texts]):
        flat, counts = e.encode(part)
        want = [x.ids for x in e.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert flat.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert [w for w in asked if "zorble" in w] == [" zorble"]
    assert len(e.pieces) == len(e.starts) == len(e.counts) == len(e.uses)
