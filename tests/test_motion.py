"""Motion kernels against joins written out, and known shifts."""

import numpy as np
import pytest

from pluvia.operators import motion
from pluvia.spec import BOX, GRIDS, TRIAL, GridSpec


CENTRES = [(20, 30), (50, 45), (70, 20), (35, 70), (75, 75)]


def hills(h, w, dx=0.0, dy=0.0, sigma=6.0):
    y, x = np.mgrid[0:h, 0:w]
    return sum(5 * np.exp(-((x - a * w / 96 - dx) ** 2 + (y - b * h / 96 - dy) ** 2) / (2 * sigma**2)) for a, b in CENTRES)


def test_match_is_the_plain_search():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (2, 21, 19)).astype(float)
    field, best = motion.match_blocks(a, b, 8, 2)
    for br in range(3):
        for bc in range(3):
            cells = [(r, c) for r in range(br * 8, min(21, br * 8 + 8)) for c in range(bc * 8, min(19, bc * 8 + 8))]
            error = lambda dy, dx: sum((a[r, c] - b[min(20, max(0, r + dy)), min(18, max(0, c + dx))]) ** 2 for r, c in cells)  # noqa: B023, E731
            zero = error(0, 0)
            top = min(((error(dy, dx), (dy, dx) != (0, 0), dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)))
            assert (field.dy[br, bc], field.dx[br, bc], best[br, bc]) == (top[2], top[3], top[0])
            assert np.isclose(field.conf[br, bc], (zero - top[0]) / zero)


def test_dry_blocks_do_not_move_and_ties_stay():
    a = np.zeros((16, 16))
    a[3, 3] = 2
    field, _ = motion.match_blocks(a, np.roll(a, 1, axis=1), 8, 2)
    assert not field.conf.any() and not field.dx.any()
    flat = np.ones((16, 16))
    assert not motion.match_blocks(flat, flat, 8, 2)[0].dx.any()


@pytest.mark.parametrize(("dx", "dy", "mode"), [(1.4, -0.7, "moved"), (0.4, 0.0, "all")])
def test_fractional_shifts(dx, dy, mode):
    a, b = hills(96, 96), hills(96, 96, dx, dy)
    field, _ = motion.match_blocks(a, b, 16, 4, mode)
    live = field.conf > 0.2
    assert abs(np.median(field.dx[live]) - dx) < 0.1 and abs(np.median(field.dy[live]) - dy) < 0.1
    whole, _ = motion.match_blocks(a, b, 16, 4)
    far = lambda f: np.hypot(f.dx[live] - dx, f.dy[live] - dy).mean()
    assert far(field) < 0.6 * far(whole)


def test_smooth_reads_the_old_field_and_fill_spreads():
    conf = np.zeros((3, 5))
    conf[1, 1] = 0.9
    field = motion.Field(np.where(conf > 0, 2.0, 0), np.where(conf > 0, -1.0, 0), conf)
    soft = motion.smooth(field, 2)
    assert soft.dx[1, 3] == 2 and soft.conf[1, 3] == 0.6 and soft.conf[1, 4] == 0
    full = motion.fill(field)
    assert (full.dx == 2).all() and (full.dy == -1).all() and full.conf[1, 2] == 0.6 and np.isclose(full.conf[1, 3], 0.57)


def test_walk_moves_rain_without_blur():
    a, b = hills(64, 64, sigma=4), hills(64, 64, 2, 1, sigma=4)
    field = motion.fill(motion.smooth(motion.match_blocks(a, b, 8, 4)[0]))
    out = motion.walk(b, field, 8, 3)
    still = ((b - hills(64, 64, 8, 4, sigma=4)) ** 2).sum()
    assert ((out[2] - hills(64, 64, 8, 4, sigma=4)) ** 2).sum() < 0.5 * still and (out >= 0).all()
    assert motion.walk(b, motion.Field(*np.zeros((3, 8, 8))), 8, 2)[1] == pytest.approx(b)


def test_grids():
    assert [g.cells(25.6) for g in GRIDS.values()] == [8, 13, 26] and [g.cells(19.2) for g in GRIDS.values()] == [6, 10, 19]
    assert [g.odd_cells(28.8) for g in GRIDS.values()] == [9, 15, 29] and [g.odd_cells(9.6) for g in GRIDS.values()] == [3, 5, 9]
    g: GridSpec = GRIDS["3.2km"]
    west, east, south, north = BOX
    lon = g.west + (np.arange(g.cols) + 0.5) * (g.east - g.west) / g.cols
    lat = g.north - (np.arange(g.rows) + 0.5) * (g.north - g.south) / g.rows
    assert ((lon >= west) & (lon < east)).sum() * ((lat >= south) & (lat < north)).sum() == 18447
    assert TRIAL.rows * TRIAL.cols == 1536


def test_city_cells(spark):
    from pyspark.sql import functions as F

    from pluvia.operators.geometry import cell_of

    towns = spark.createDataFrame([(55.676, 12.568), (56.157, 10.211)], "lat double, lon double")
    assert [tuple(r) for r in towns.select(*cell_of(GRIDS["3.2km"], F.col("lat"), F.col("lon"))).collect()] == [(98, 147), (81, 101)]


def test_draws_are_the_same_each_time(spark):
    from pluvia.operators.pool import draws

    units = spark.range(7).selectExpr("id AS unit")
    a, b = (sorted(map(tuple, draws(units, 5, 0).collect())) for _ in range(2))
    assert a == b and sum(w for *_, w in a) == 35
