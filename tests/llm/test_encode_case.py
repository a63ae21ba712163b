"""Capitals that compose with a mark only after case folding, against the tokenizers library."""

import random

from tokenizers import Tokenizer

from rillgraph.llm import encode


def test_case_is_folded_after_composition():
    library = Tokenizer.from_file(encode.vocabulary())
    given = ["H̱ello WORLD", "J̌x", "T̈ ẗ", "W̊W̊ abc", "Y̊", "HELLO hello ẖello", "É é É"]
    ids, lens = encode.Encoder(encode.vocabulary()).encode(given)
    want = [library.encode(t, add_special_tokens=False).ids for t in given]
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_latin_words_and_the_memos():
    library = Tokenizer.from_file(encode.vocabulary())
    chance = random.Random(4)
    latin = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100), 0x85, 0xA0, 0x1C, 0x301, 0x130, 0x3A3, 0x2019)]
    given = ["".join(chance.choices(latin + list("abcdefgéÀ'") * 9 + [" ", "\n"] * 20, k=chance.randint(0, 400))) for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in given]
    made = encode.Encoder(encode.vocabulary())
    assert made.merges is not None
    remembered, encode.REMEMBERED, encode.KEPT = (encode.REMEMBERED, encode.KEPT), 150, 40
    try:
        for k in range(0, 400, 7):  # the memos shrink again and again
            ids, lens = made.encode(given[k : k + 7])
            assert lens.tolist() == [len(x) for x in want[k : k + 7]] and ids.tolist() == [i for x in want[k : k + 7] for i in x]
            assert len(made.words.known) == made.words.many.n == made.words.first.n
            if k % 3 == 0:
                made.rest()
                assert made.words.held is not None
    finally:
        encode.REMEMBERED, encode.KEPT = remembered
