"""Nearest neighbours and Gaussian windows against plain versions."""

import math
import random

from pyspark.sql import functions as F

from pluvia.operators import ensembles, geometry
from pluvia.plans.analyses import stored
from pluvia.spec import TRIAL


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    points = [(a, 100 * a + i, rng.choice([rng.uniform(0, 50), float(rng.randrange(8))]), float(rng.randrange(12))) for a, n in ((1, 60), (2, 3), (3, 1)) for i in range(n)]
    points += [(4, 400 + i, 1.0, 1.0) for i in range(9)] + [(4, 450, 900.0, 1.0)]  # one place, and one far from it
    missing = [(1, 999, None, 3.0)]
    df = spark.createDataFrame(points + missing, "area int, id int, x double, y double")
    got = {}
    for r in geometry.nearest(df, 3, stored(spark), 0.5).collect():
        got.setdefault(r.id, {})[r.k] = r.other
    want = {}
    for a, i, x, y in points:
        near = sorted((math.pow((x - u) * 0.5, 2) + math.pow(y - v, 2), j) for b, j, u, v in points if b == a and j != i)[:3]
        if near:
            want[i] = {k + 1: j for k, (_, j) in enumerate(near)}
    assert got == want


def test_nearest_of_an_empty_table(spark):
    assert geometry.nearest(spark.createDataFrame([], "area int, id int, x double, y double"), 3, stored(spark)).count() == 0


def test_round_kernel_is_the_stretched_one_of_ratio_one(spark):
    rng = random.Random(7)
    rows, cols = TRIAL.rows, TRIAL.cols
    cells = spark.createDataFrame([(f, r, c, rng.choice([None, 0, 0, 3])) for f in range(2) for r in range(rows) for c in range(cols)], "f int, r int, c int, v int")
    fast = {(x.f, x.r, x.c): x.chance for x in ensembles.gauss_window(cells, F.col("v") >= 2, 1.2).collect()}
    slow = {(x.f, x.r, x.c): x.chance for x in ensembles.gauss_window(cells, F.col("v") >= 2, 1.2, ratio=1 + 1e-15).collect()}
    assert fast.keys() == slow.keys()
    assert max(abs(fast[k] - slow[k]) for k in fast) < 1e-9


def test_near_pairs_list_the_points_of_a_place(spark):
    """All pairs within the distance, as many as the points of a place give; only places are compared."""
    rng = random.Random(11)
    a = [(i, rng.uniform(0, 60), rng.uniform(-30, 30)) for i in range(50)] + [(100 + i, 20.0, 0.0) for i in range(700)] + [(999, None, 1.0)]
    b = [(i, rng.uniform(0, 60), rng.uniform(-30, 30)) for i in range(40)] + [(500 + i, 29.0, 0.0) for i in range(3)] + [(998, 20.0, 10.0), (997, None, 1.0)]
    schema = "id int, x double, y double"
    found = geometry.near_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 10.0)
    got = {(r.id, r.other): r.d for r in found.collect()}
    want = {(i, j): math.hypot(x - u, y - v) for i, x, y in a for j, u, v in b if x is not None and u is not None and math.hypot(x - u, y - v) <= 10}
    assert found.count() == len(want) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    lists = geometry._listed(spark.createDataFrame(a, schema).where("x = 20")).select(F.size("ids").alias("n")).collect()
    assert sum(r.n for r in lists) == 700 and len(lists) <= 2 * geometry.SHARES and max(r.n for r in lists) <= geometry.LISTED


def test_nearest_looks_for_places_once(spark):
    """Points of a place share their list but for themselves, so what is stored between rounds grows with the places."""
    points = [(1, i, float(i % 4), float(i % 2)) for i in range(800)] + [(1, None, 0.0, 0.0)]
    write, sizes = stored(spark), []

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    found = geometry.nearest(spark.createDataFrame(points, "area int, id int, x double, y double"), 3, counted)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.k] = (r.other, r.d)
    # 200 points a place: the neighbours are the three smallest others there
    assert got == {i: {k + 1: (j, 0.0) for k, j in enumerate([j for j in range(i % 4, 20, 4) if j != i][:3])} for i in range(800)}
    assert max(sizes) <= 4 * 4
