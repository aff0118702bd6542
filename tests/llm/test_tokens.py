"""Ids of chunks put together against the library's ids of whole texts."""

import random

import public_tokenizers
import pytest

from tapewatch.llm.tokens import Encoder

PIECES = ["word", "Été", "ab", ".", " ", "  ", "\n", "\n\n", ",", "x.", "1.", "\t", "<|endoftext|>", " a", " ", "don't", "...", "ñ,", "Z", "#", " \n", "\n ", "\x00", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(25))) for _ in range(3000)] + ["", None, " ", "\n", "a ", " a", "a,", "a.\n\n\nb", "a \n\n b"]
    encoder = Encoder(public_tokenizers.path(name), name.startswith("word"))
    for _ in range(2):  # also from the table
        ids, borders = encoder(texts)
        got = [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]
        assert got == [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
