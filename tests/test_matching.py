"""The matching blocks' share against difflib itself, and on a text that difflib walks again for each of its blocks."""

import difflib
import random
import time

from pyspark.sql import functions as F

from millrace.functions import matching
from millrace.operators.versions import text_similarity

ALPHABETS = ("ab", "abcdefgh \n", "abcdefghijklmnopqrstuvwxyz ABCDEFG.,0123456789", "e" * 40 + "a" * 20 + "t" * 10 + "xyzqjkXYZ019.,", "".join(map(chr, range(0x4E00, 0x4E00 + 150))) + "\U0001f600\ud800")


def _changed(dice, text, alphabet):
    out = list(text)
    for _ in range(dice.randrange(8)):
        at = dice.randrange(len(out) + 1)
        out[at : at + dice.randrange(6)] = [dice.choice(alphabet) for _ in range(dice.randrange(6))]
    if dice.random() < 0.3:
        at, to = dice.randrange(len(out) + 1), dice.randrange(len(out) + 1)
        out = out[to:] + out[:at]
    return "".join(out)


def test_equals_difflib(monkeypatch):
    dice = random.Random(11)
    for most in (matching.MOST_PAIRS, 50):  # the second sends many of them to difflib
        monkeypatch.setattr(matching, "MOST_PAIRS", most)
        for _ in range(800):
            alphabet, n = dice.choice(ALPHABETS), dice.choice((0, 1, 3, 20, 150, 199, 200, 201, 250, 600, 1200))
            a = "".join(dice.choice(alphabet) for _ in range(n))
            b = _changed(dice, a, alphabet) if dice.random() < 0.7 else "".join(dice.choice(alphabet) for _ in range(dice.choice((0, 1, 50, 200, 400))))
            for x, y in ((a, b), (b, a)):
                assert matching.block_ratio(x, y) == difflib.SequenceMatcher(None, x, y).ratio(), (x, y)


def test_long_texts(spark):
    """1,000 changed words in a text of about 136,000 characters: difflib had not ended after 100 seconds."""
    dice = random.Random(3)
    names = ["".join(dice.choice("aeionrst") for _ in range(dice.randrange(2, 9))) + dice.choice(("", "", "k", "X", "7", ", Q")) for _ in range(3000)]
    text = " ".join("the" if i % 20 == 0 else dice.choice(names) for i in range(20_000))
    start = time.monotonic()
    got = spark.createDataFrame([(text, text.replace(" the ", " that "))], "a string, b string").select(text_similarity(F.col("a"), F.col("b")).alias("s")).first().s
    assert 0.9 < got < 1 and time.monotonic() - start < 30
