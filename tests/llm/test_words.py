"""The word encoder gives the tokenizer's own ids, whatever its memory holds."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from granthi.llm import packing

LETTERS = list("abcİIſKΣςßéÉÅ'stredvlmn.,!$&*<>|019٣ \n\t\r\x0b\x0c\x85\xa0​́̇ﬁ中文ｱ가가की👍🏽ǅ`^~\"")
ODD = ["", "İ. x", "it's o'clock' 's 't", "<|endoftext|>a <|startoftext|>", "dog's''s cat'S 'll'LL", "abc...'s", "Ǆ. K, É!", "é. e ́"]


@pytest.mark.parametrize("remembered", [50, packing.REMEMBERED])
def test_words_as_whole_texts(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    whole = Tokenizer.from_file(packing.TOKENIZER)
    own = packing.WordEncoder(packing.TOKENIZER)
    dice = random.Random(1)
    texts = ODD + ["".join(dice.choices(LETTERS, k=dice.randint(0, 30))) for _ in range(3000)]
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        expected = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
        assert own.encode_many(part) == expected
