"""The packing encoder against the tokenizer alone, on marks, letters of many scripts and special tokens in any case."""

import random

import numpy as np

from meshlark.llm import packing
from meshlark.llm.queries import tokenizer_path


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    tokenizer, dice = Tokenizer.from_file(tokenizer_path()), random.Random(1)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    parts = [*"abzABZéÉÈñßſİıΣσςǅ 019.,;:!?'’\"()-_\n\t́̇ ​K中\U0001f600", "'s", "'LL", *special, *(x.upper() for x in special), " ", " "]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(60))) for _ in range(8000)]
    got = packing._encoder(tokenizer_path(), 1)([t.encode() for t in texts])
    for text, mine, own in zip(texts, got, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert mine == np.array([*own.ids, 1], "<u4").tobytes(), text
