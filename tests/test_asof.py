"""Joins in time against plain search, with one frequent key, a key that is null, and stretches of several lengths."""

import bisect
import random

import pytest

from pluvia.operators import asof


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(3)
    keys = [1] * 60 + [2] * 5 + [3, None]
    samples = {(rng.choice(keys), rng.randrange(-2000, 2000)): float(rng.randrange(100)) for _ in range(300)}
    left = [(i, rng.choice([*keys, 9]), rng.randrange(-2500, 2500)) for i in range(400)]
    return left, [(k, t, v) for (k, t), v in samples.items()]


def _plain(left, right):
    """For each row of the left the samples at or before and at or after it."""
    by = {}
    for k, t, v in sorted(right, key=lambda x: x[1]):
        by.setdefault(k, []).append((t, v))
    for i, k, t in left:
        have = by.get(k, [])
        at, upto = bisect.bisect_right(have, (t, float("inf"))), bisect.bisect_left(have, (t, float("-inf")))
        yield i, t, have[at - 1] if at else None, have[upto] if upto < len(have) else None


@pytest.mark.parametrize("stretch", [1, 90, 5000, 10**7])
def test_linear_and_nearest(spark, sides, stretch):
    left, right = sides
    a, b = spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, t long, v double")
    lines = {r.i: r.v for r in asof.linear(a, b, "k", "t", "v", stretch).collect()}
    close = {r.i: r.v for r in asof.nearest(a, b, "k", "t", "v", stretch).collect()}
    assert len(lines) == len(close) == len(left)
    for i, t, lo, hi in _plain(left, right):
        if lo is None or hi is None:
            assert lines[i] is None
        else:
            assert lines[i] == pytest.approx(lo[1] if lo[0] == hi[0] else lo[1] + (hi[1] - lo[1]) * (t - lo[0]) / (hi[0] - lo[0]))
        want = hi if lo is None or hi is not None and hi[0] - t < t - lo[0] else lo
        assert close[i] == (want[1] if want else None)


def test_without_samples(spark):
    a, b = spark.createDataFrame([(1, 1, 5)], "i long, k long, t long"), spark.createDataFrame([], "k long, t long, v double")
    assert [tuple(r) for r in asof.nearest(a, b, "k", "t", "v").collect()] == [(1, 1, 5, None)]
    assert asof.linear(a.limit(0), b, "k", "t", "v").count() == 0
