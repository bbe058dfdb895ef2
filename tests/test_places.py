"""Masks that carry their shape, and tracks near stations."""

import random

import numpy as np
import pytest

from pluvia.operators import geometry, pool
from pluvia.spec import TRIAL, GridSpec


def test_a_mask_is_for_one_grid(spark):
    cells = spark.createDataFrame([(0, 0), (31, 47), (3, 5), (3, 5)], "r int, c int")
    mask = geometry.packed_mask(cells, TRIAL)
    assert sorted(tuple(r) for r in geometry.mask_cells(mask, TRIAL).collect()) == [(0, 0), (3, 5), (31, 47)]
    with pytest.raises(Exception, match="32 x 48"):
        geometry.mask_cells(mask, GridSpec(16, 24)).collect()
    with pytest.raises(Exception, match="not for 2 x 2"):
        geometry.mask_cells(geometry.packed_mask(cells, GridSpec(2, 2)), GridSpec(2, 2)).count()
    assert geometry.mask_cells(geometry.packed_mask(cells.limit(0), TRIAL), TRIAL).count() == 0


def test_near_means_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    stations = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(12)] + [(12, None, 1.0), (13, 500.0, 500.0)]
    tracks = [(rng.randrange(3), rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(120)]
    got = geometry.near_means(spark.createDataFrame([(f, *s) for f in range(4) for s in stations], "f int, id int, x double, y double"), spark.createDataFrame(tracks, "f int, x double, y double, u double, v double"), 15.0)
    made = {(r.f, r.id): (r.n, r.u, r.v) for r in got.collect()}
    want = {}
    for i, x, y in stations:
        for f in range(3):
            near = [(u, v) for g, a, b, u, v in tracks if g == f and x is not None and (a - x) ** 2 + (b - y) ** 2 <= 225]
            if len(near) >= 3:
                want[f, i] = (len(near), sum(u for u, _ in near) / len(near), sum(v for _, v in near) / len(near))
    assert len(want) > 5 and made.keys() == want.keys()
    assert all(made[k] == pytest.approx(want[k]) for k in want)


def test_near_means_of_places_with_many_points(spark):
    """Stations and tracks that share their places are summed there: a thousand of each are no million of rows, and NULLs count as tracks without a part in a mean."""
    stations = spark.range(1000).selectExpr("1 AS f", "CAST(id AS int) AS id", "CAST(id % 2 AS double) AS x", "0.0D AS y")
    tracks = spark.range(1000).selectExpr("1 AS f", "CAST(id % 4 AS double) AS x", "0.0D AS y", "CASE WHEN id % 8 <> 0 THEN CAST(id % 4 AS double) END AS u", "1.0D AS v")
    made = geometry.near_means(stations, tracks, 1.0)
    assert {(r.id % 2, r.n, round(r.u, 9), r.v) for r in made.collect()} == {(0, 500, round(250 / 375, 9), 1.0), (1, 750, round(750 / 625, 9), 1.0)}
    assert made.count() == 1000 and "sum" in made._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[-1]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    for values in ([], [3.0], [1.0, 2.0], [5.0, 1.0, 2.0], rng.integers(0, 4, 3000).astype(float).tolist(), rng.normal(size=30_000).tolist()):
        rows = spark.createDataFrame([(v,) for v in [None, *values]], "x double").persist()
        got = pool.quantiles(rows, "x", (0.25, 0.5, 0.75))
        assert got == ([None] * 3 if not values else pytest.approx(np.quantile(values, (0.25, 0.5, 0.75)).tolist()))
