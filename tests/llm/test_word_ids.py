"""Ids of the word vocabulary, by columns of parts."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sextant.llm.bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "a", "Plain words, (with) signs -- and 'quotes' don't, it's; x_y a|b <b> 12,5 §5 3.",
    "ÉTÉ École Größe ÀÉÎ naïve µm 1ª 2º ÿ × ÷ æØå", "été ÉCOLE à", "İstanbul ΣΟΦΟΣ œuvre ŒUVRE “quoted” — dash…",
    "a\u0085b c d　e​f᠎g", "a\x1cb C\x1dD", "<|endoftext|> Up <|ENDOFTEXT|> (<|startoftext|>),", "x<|endoftext|>y Word",
    "語 한국어 Привет मानक 🙂👍🏽", "é" * 70 + ", " + "w" * 90 + "... " + "w" * 90, "!!! ??? ...", "ﬁne ǅ ß ẞ STRASSE", "\x00 a\x00b �",
]


def test_odd_texts_like_the_library_in_any_company():
    lib, bpe = Tokenizer.from_file(PATH), WordBpe(PATH)
    want = [lib.encode(t, add_special_tokens=False).ids for t in ODD]
    for texts in (ODD, ODD[::-1], *([t] for t in ODD)):
        found = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
        assert found == (want if texts is ODD else want[::-1] if len(texts) > 1 else [want[ODD.index(texts[0])]])


@pytest.mark.parametrize("copies", [2, 50])
def test_each_different_part_is_looked_up_once(copies):
    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    bpe = WordBpe(PATH)
    text = " ".join(f"{a}{b}o" for a in "bcdfghjklm" for b in "aeiouy")
    first = bpe.encode([text])
    bpe.parts = Counting(bpe.parts)
    assert bpe.encode([text] * copies) == first * copies
    assert Counting.asked == 60
