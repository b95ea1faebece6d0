import difflib
import random
import time

import pytest

from quarrylight.functions.matching import Runs, overlap


def blocks(quote, text):
    return [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, quote, text).get_matching_blocks() if m.size]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz0123456789", "aé😀z"])
def test_runs_equal_the_standard_library(letters):
    rng = random.Random(len(letters))
    skewed = lambda n: "".join(letters[int(len(letters) * rng.random() ** 2)] for _ in range(n))
    for _ in range(150):
        text = skewed(rng.choice([0, 3, 50, 199, 200, 201, 350, 900]))
        cut = rng.randrange(len(text) + 1)
        quote = rng.choice([skewed(rng.randrange(60)), text[cut : cut + 30] + skewed(5) + text[cut + 33 : cut + 70], ""])
        assert Runs(quote, text).all() == blocks(quote, text)


def test_a_text_of_a_megabyte():
    rng = random.Random(1)
    text = "".join(rng.choice("qjxz0123456789") if rng.random() < 0.08 else rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    quote = text[500_000:500_100] + "zzz" + text[700_000:700_090]
    began = time.process_time()
    share = overlap(quote, text)
    took = time.process_time() - began
    assert took < 1 and share == sum(n for *_, n in blocks(quote, text) if n >= 3) / len(quote)
    assert overlap("", "abc") == 0 and overlap("abcd", "") == 0 and overlap("abcd", "xabcdx") == 1
