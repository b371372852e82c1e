"""Piece encoding of texts without spaces: equal to the library, in time that grows with the text."""

import random
import time

import pytest

from daygrain.llm import sentencepiece_codec


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.load_vocabulary(sentencepiece_codec.MODEL_PATH))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "etaoin", "漢字仮名交じり文", "aé漢 ▁", "ABCabc012+/", ["tion", "ing", "the", "ation", "x"], "ሀሁሂ🎉"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_long_units_equal_the_library(codec, library, alphabet):
    rng = random.Random(str(alphabet))
    texts = ["".join(rng.choices(alphabet, k=n)) for n in (47, 48, 49, 50, 257, 1000, 5000)]
    texts += [" " * k + texts[4] + "\n" + texts[3] for k in (1, 2, 3, 60)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids.tolist()) == text.replace("▁", " ")


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "漢字仮名交じり文の長い", "ABCabc012+/"])
def test_long_units_take_time_in_proportion(codec, alphabet):
    text = "".join(random.Random(2).choices(alphabet, k=300_000))
    codec.clear()
    began = time.time()
    ids = codec.encode([text])[0]
    assert time.time() - began < 10  # about half a second on an idle machine
    assert codec.decode(ids.tolist()) == text


def test_the_cache_is_bounded_by_characters(codec):
    codec.clear()
    codec.encode(["a" * (sentencepiece_codec.CACHED_CHARS + 1)])
    codec.encode(["b"])
    assert codec.cached_chars <= 2 and len(codec.unit_of) == 1
