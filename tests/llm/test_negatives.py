"""Operator 11 against a plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector string, anchor string"


def plain(rows, anchor, k=5, n=3):
    whole = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in (r for r in whole if anchor(r[0])):
        met = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in whole if i != a and len(v) == len(av))
        for s, p, _ in [m for m in met if m[2] == al][:k]:
            near = [m for m in met if m[2] != al and 50 * -s <= 100 * -m[0] <= 95 * -s][:n]
            out += [(a, p, r, m[1], -s, -m[0]) for r, m in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 8 * 3)
    monkeypatch.setattr(negatives, "CANDIDATES", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 2)


def test_as_a_plain_search(spark, small):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-2, 4) / 256 for _ in range(8)], rng.randrange(3)) for i in range(70)]  # many ties
    rows += [(100, None, 1), (110, [1.0] * 8, None), (120, [float("nan")] + [1.0] * 7, 1), (130, [math.inf] * 8, 2), (140, [None] * 8, 0), (None, [0.01] * 8, 1)]
    rows += [(150, [0.5, 0.25], 1), (151, [0.5, 0.25], 1), (152, [0.4, 0.2], 2), (160, [], 1), (161, [], 1), (162, [], 0)]
    rows += [(3, [0.01] * 8, 2), (20, [0.02] * 8, 1), (30, [0.01] * 8, 0), (30, [0.01] * 8, 0)]  # ids again
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 40 and any(w[0] == 160 for w in want) and any(w[0] == 150 for w in want)
    assert mined(spark, rows) == want


def test_products_beyond_float64_are_exact(spark):
    big = 2.0**20
    rows = [(i, [big + i / 256, 1 / 256, i / 256], i % 2) for i in range(0, 40, 5)] + [(11, [big * 0.8, 0.5, 3.0], 1), (13, [big * 0.8, 0.5, 3.0 + 1 / 256], 1), (14, [big * 0.6, 0.5, 1.0], 0)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and max(w[4] for w in want) > 2**53
    assert mined(spark, rows) == want
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2)])


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [1.0], 1), (2, [0.9], 2)]) == []  # no positive
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 58880)]
