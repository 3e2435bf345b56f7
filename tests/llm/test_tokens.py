"""Token ids of texts that meet in one batch, against the encoder of the vocabulary file."""

import random

import numpy as np
import pyarrow as pa
import pytest

from formlode.llm import tokens


@pytest.mark.parametrize("space", ["\n", " ", "\t", "\r\n", "\u00a0", "\u2028"])
def test_ids_of_texts_that_end_in_white_space(space):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    words = [f"{draw.choice(['foo', 'é', 'Bar', '12', '!?', '’'])}{draw.randrange(99)}" for _ in range(300)]
    ends = [space * (i % 20 + 1) + draw.choice(["", " ", "\n", "\n\n"]) for i in range(len(words))]
    texts = [w + e for w, e in zip(words, ends, strict=True)] + [draw.choice(["\n\n", "  ", "\n  ", "\t\t", "   \n "]) + w for w in words] + [" ".join(words), *ends]
    tokens._cache.cache_clear()
    for _ in range(2):  # then from the cache
        ids, bounds = tokens.token_ids(pa.array(texts))
        for i, t in enumerate(texts):
            assert np.array_equal(ids[bounds[i] : bounds[i + 1]], encoder.encode(t, add_special_tokens=False).ids), repr(t)


def test_texts_that_each_fill_the_pool(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from formlode.llm import tokens

    monkeypatch.setattr(tokens._Cache, "MOST_IDS", 3)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two three four five six seven", "eight nine ten eleven twelve two\n", "eight thirteen fourteen fifteen sixteen one"):
        ids, bounds = tokens.token_ids(pa.array([text, None, text]))
        assert ids[: bounds[1]].tolist() == ids[bounds[2] :].tolist() == slow.encode(text, add_special_tokens=False).ids
