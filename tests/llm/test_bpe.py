"""Pretokens at the ends of chunks, and long ones, against the tokenizers library."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerfold.llm import bpe
from ledgerfold.llm.queries import tokenizer_path
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(tokenizer_path())
CODER = bpe.Encoder(tokenizer_path())
ENDS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'r", "'l", "'v", "'x", "<|endoftext|>", "<|endoftext", " ", "\n", "1", "é"]


def check(texts):
    """The texts as one chunk."""
    ids, offs = CODER.encode(bpe.texts_of(texts))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t[:80]
        assert CODER.decode(ids[offs[k] : offs[k + 1]]) == t


def test_contractions_and_specials_at_each_end_of_a_chunk():
    for end in ENDS:
        for start in ["", "it", " ", "'", "a1", "\n", "we  ", *ENDS]:
            for texts in ([start + end], ["we'll go", start + end], [start + end, ""], ["", end + start, "x"], [start + end + "e", end + "l"]):
                check(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ENDS, "word", " and", "S", "re", "ll", "\t", "　", "日本", "½", "🙂", "́", "퟿"]), max_size=8).map("".join), min_size=1, max_size=4))
def test_any_texts_equal_the_library(texts):
    check(texts)


def test_long_pretokens():
    rng = random.Random(5)
    for n in (511, 512, 513, 600, 1025, 5000, 20_000):
        for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "theaniousr", "日本é", "=-", "0123456789"):
            check(["".join(rng.choice(alphabet) for _ in range(n)), "end'll"])
