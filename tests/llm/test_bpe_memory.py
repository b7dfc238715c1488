"""Words that come again are not merged again."""

import public_tokenizers

from paperlode.llm import bpe


def test_words_are_remembered_over_a_long_stretch():
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    merged = []
    merge = own.merge
    own.merge = lambda body: merged.append(1) or merge(body)
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklmnpqrstvwxz" for b in "aeioubcdfghjklmnpqrst" for c in "aeioubcdfghjklmnpqrst" for d in ("xq", "zv", *"qvwxyzjkbdfghmnprstlc")]
    words = [w + e for w in words for e in ("q", "x")]
    words = words[::2][:200_000]  # one generation was 120,000
    assert len(set(words)) == 200_000
    text = " ".join(words)
    first = own.encode(text)
    before = len(merged)
    assert own.encode(text) == first and len(merged) == before
