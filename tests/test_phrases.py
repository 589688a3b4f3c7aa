"""Counts of phrases against a slow version; long texts take time in proportion to their length."""

import random
import time
from collections import Counter

import pytest

from flowlens.functions import text as X
from flowlens.operators import phrasing
from pyspark.sql import functions as F


@pytest.mark.parametrize("sizes", [{}, {"block": 300, "share": 200}, {"block": 2000, "share": 500, "bits": 6}])
def test_same_as_slow_version(spark, sizes):
    """Small blocks and shares, hashes of six bits that nearly all meet, a pair far more often than all others, short texts."""
    draw = random.Random(4)
    rows = [(" ".join(draw.choice("Lieferung spät é 漢字 a b_c 7 the of".split()) for _ in range(draw.randrange(9))),) for _ in range(200)]
    rows += [("hot pair, " * 300,), (None,), ("",), ("...",), ("one",), ("two words",)]
    want = Counter()
    for (text,) in rows:
        words = split_words(text)
        want.update(" ".join(words[i : i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1))
    df = spark.createDataFrame(rows, "text string").repartition(3)
    got = {r["phrase"]: r["n"] for r in phrasing.phrase_counts(df, **sizes).collect()}
    assert got == {p: n for p, n in want.items() if n >= 5} and got["hot pair"] == 300
    assert phrasing.phrase_counts(df.limit(0), **sizes).collect() == []


def split_words(text):
    return [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split(" ") if w]


def test_long_text_is_tokenised_once(spark):
    df = spark.createDataFrame([(" ".join(f"w{i % 977}" for i in range(20_000)),)], "text string")
    began = time.time()
    assert df.select(F.size(X.phrases(X.tokenize(F.col("text")))).alias("n")).first()["n"] == 3 * 20_000 - 6
    assert time.time() - began < 20
