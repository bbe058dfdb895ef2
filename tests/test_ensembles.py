"""Flow, cascades and frames between scans: known shifts and invariants."""

import numpy as np
import pytest

from pluvia.operators import ensembles
from tests.test_motion import hills


def test_flow_recovers_a_shift():
    frames = [hills(64, 80, 1.2 * k, -0.6 * k) for k in range(3)]
    u, v = ensembles.optical_flow(frames)
    wet = frames[-1] > 1
    assert abs(np.median(u[wet]) - 1.2) < 0.3 and abs(np.median(v[wet]) + 0.6) < 0.3


def test_bands_add_up():
    assert np.allclose(ensembles.bands((32, 48), 4).sum(axis=0), 1)


def test_cascade_invariants():
    frames = [hills(32, 48, k, 0, sigma=4) for k in range(3)]
    smooth, many, again = ensembles.cascade(frames, 2), ensembles.cascade(frames, 2, 4, seed=9), ensembles.cascade(frames, 2, 4, seed=9)
    assert smooth.shape == (1, 2, 32, 48) and many.shape == (4, 2, 32, 48)
    assert (many >= 0).all() and np.array_equal(many, again) and not np.array_equal(many[0], many[1])
    assert many.max() <= frames[-1].max() + 1e-4
    with pytest.raises(ValueError):
        ensembles.cascade([np.zeros((8, 8))] * 3, 1)


def test_between_follows_the_motion():
    a, b = hills(64, 64, sigma=4), hills(64, 64, 4, 0, sigma=4)
    middle = ensembles.between(a, b, 1)[0]
    error = lambda x: ((x - hills(64, 64, 2, 0, sigma=4)) ** 2).sum()
    assert error(middle) < error((a + b) / 2) and (middle >= 0).all()
    assert len(ensembles.between(a, b, 3)) == 3


def test_draws_follow_their_distributions(spark):
    import math

    from pyspark.sql import functions as F

    issues = spark.range(400).select(F.col("id").alias("f"))
    drawn = ensembles.draws(issues, 50, z=ensembles.normal, e=ensembles.laplace).select("f", F.explode("draws").alias("d")).select("f", "d.*")
    z, e = (np.array(x) for x in zip(*((r.z, r.e) for r in drawn.collect()), strict=True))
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.mean(np.abs(z) < 1) - 0.683) < 0.01
    assert abs(e.mean()) < 0.03 and abs(e.std() - 1) < 0.03 and abs(np.mean(np.abs(e) > math.log(2) / math.sqrt(2)) - 0.5) < 0.01
    assert {tuple(r) for r in drawn.where("f = 7").collect()} == {tuple(r) for r in ensembles.draws(issues.where("f = 7"), 50, z=ensembles.normal, e=ensembles.laplace).select("f", F.explode("draws").alias("d")).select("f", "d.*").collect()}


def test_members_spread_by_the_law_of_growth(spark):
    """The spread along the motion and across it grows with the lead as a t^b + c summed over the steps."""
    from pyspark.sql import functions as F

    grid = ensembles.TRIAL
    vectors = spark.range(300).select(F.col("id").alias("f"), F.lit(3.0).alias("dx"), F.lit(4.0).alias("dy")).union(spark.createDataFrame([(1000, 0.0, 0.0), (1001, None, None)], "f long, dx double, dy double"))
    rows = ensembles.displacements(vectors, 40, 4, 10, grid).collect()
    assert {r.f for r in rows if r.f >= 1000} == {1000} and all(r.dx == r.dy == 0 for r in rows if r.f == 1000)
    for lead in range(1, 5):
        off = np.array([(r.dx - 3 * lead, r.dy - 4 * lead) for r in rows if r.lead == lead and r.f < 1000])
        along, across = off @ (0.6, 0.8), off @ (-0.8, 0.6)
        km = lambda a, b, c: sum((a * (10 * k) ** b + c) / 6 for k in range(1, lead + 1))  # noqa: B023, E731
        assert abs(along.std() * grid.km / km(10.88, 0.23, -7.68) - 1) < 0.04 and abs(across.std() * grid.km / km(5.76, 0.31, -2.72) - 1) < 0.04
        assert abs(np.corrcoef(along, across)[0, 1]) < 0.04
    one = {(r.member, r.lead): r.dx for r in rows if r.f == 5}
    grown = [ensembles.growth(ensembles.ALONG, k, 10, grid.km) for k in (1, 4)]
    assert len({r.dx for r in rows if r.f == 5 and r.lead == 1}) == 40 and grown[1] > 4 * grown[0] and len(one) == 160


def test_cascade_members_run_ahead_and_to_the_side():
    frames = [hills(48, 64, k, 0, sigma=4) for k in range(3)]
    pushed = np.zeros((4, 2, 2))
    pushed[1, 1], pushed[2, 1], pushed[3, 1] = (5, 0), (0, 5), (-5, 0)
    plain, made = ensembles.cascade(frames, 2, 4, seed=1), ensembles.cascade(frames, 2, 4, seed=1, pushed=pushed)
    assert np.array_equal(plain[:, 0], made[:, 0]) and np.array_equal(plain[0], made[0])
    centre = lambda x: np.array([(x * k).sum() / x.sum() for k in np.mgrid[: x.shape[0], : x.shape[1]][::-1]])
    moved = [centre(made[m, 1]) - centre(plain[m, 1]) for m in range(4)]
    assert moved[1][0] > 2 and moved[3][0] < -2 and moved[2][1] > 2 and abs(moved[2][0]) < 2 and abs(moved[1][1]) < 2


def test_perturbed_names_are_in_the_registry():
    from pluvia.operators import registry

    assert {"steps-bps-mean", "steps-bps-member", "steps-default-mean"} <= set(registry.NAMES) and registry.CASCADES["steps-default-member"] == 24 and registry.CASCADES["steps-bps-mean"] == 8
