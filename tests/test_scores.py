"""Scores made on whole frames against those of cells."""

import numpy as np
from pyspark.sql import functions as F

from pluvia.operators import forecast, motion, score
from pluvia.plans import movement
from pluvia.sources import raster
from pluvia.spec import GridSpec


def test_vector_scores_on_frames_are_those_of_cells(spark):
    grid, rng = GridSpec(9, 13), np.random.default_rng(3)
    cells = spark.createDataFrame([(f, int(r), int(c), int(v)) for f in (1, 2, 3, 5, 8) for r, c, v in {(a, b): (a, b, x) for a, b, x in zip(rng.integers(0, 9, 60), rng.integers(0, 13, 60), rng.integers(1, 6, 60), strict=True)}.values()], "f long, r int, c int, v long")
    moving = spark.createDataFrame([(1, 0.4, -1.3), (2, -7.0, 2.5), (3, 0.0, 0.0), (8, 1.0, 1.0)], "f long, dx double, dy double")
    frames, issues = raster.frames(cells, grid), moving.select("f")
    for outside in (False, True):
        slow = forecast.moved(moving.withColumn("model", F.lit("m")), cells, 3, grid, outside)
        want = movement._scores(slow, cells, issues, 1, "m", 3).orderBy("lead").collect()
        got = movement._pooled(motion.vector_counts(moving, frames, 3, grid, outside), movement._wet(frames), issues, 1, "m", 3).orderBy("lead").collect()
        assert got == want and len(got) == 3


def test_block_scores_on_frames_are_those_of_cells(spark):
    grid = GridSpec(16, 24)
    y, x = np.mgrid[0:16, 0:24]
    data = [(f, int(r), int(c), int(v)) for f in range(6) if f != 4 for r, c, v in zip(*(z.ravel() for z in (y, x, np.maximum(0, 6 - abs(y - 7) - abs(x - 6 - 2 * f)))), strict=True) if v]
    cells = spark.createDataFrame(data, "f long, r int, c int, v long")
    frames, issues = raster.frames(cells, grid), spark.createDataFrame([(1,), (2,), (3,), (5,)], "f long")
    for name in ("block", "block-smooth", "bw4"):
        scans = motion.BLOCK_MODELS[name][0]
        want = movement._scores(motion.block_forecasts(frames, issues, name, 2, grid, 8, 3), cells, issues, scans, name).orderBy("lead").collect()
        got = movement._pooled(motion.block_counts(frames, issues, name, 2, grid, 8, 3), movement._wet(frames), issues, scans, name).orderBy("lead").collect()
        assert got == want and len(got) == 2


def test_few_gives_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(150))})
    assert [p.num_rows for p in score.few([batch, batch.slice(0, 0), batch.slice(5, 64)])] == [64, 64, 22, 64]


def test_window_hours_are_those_of_cells(spark):
    """Means around centres at the edge and inside, of frames with gaps: an issue needs a truth at every lead."""
    grid, rng = GridSpec(6, 8), np.random.default_rng(5)
    frames = {f: np.where(rng.random((6, 8)) < 0.1, np.nan, rng.integers(0, 6, (6, 8)).astype(float)) for f in range(12) if f != 8}
    frames[3][0:3, 0:3] = np.nan
    packed = spark.createDataFrame([(f, v.ravel().tolist()) for f, v in frames.items()], "f long, v array<double>")
    windows, models = {"edge": (1, 1), "inside": (3, 5)}, {"stays": (0, 0), "moves": (2, -1)}
    made = score.window_hours(spark.createDataFrame([(7, f) for f in frames], "event long, f long"), packed, windows, models, 3, 1, grid)
    want = {}
    for f in frames:
        for city, (r, c) in windows.items():
            own = [frames[f + k][r - 1 : r + 2, c - 1 : c + 2] if f + k in frames else np.full(9, np.nan) for k in (1, 2, 3)]
            if all((~np.isnan(x)).any() for x in own):
                for m, (dx, dy) in models.items():
                    p = [np.mean([np.nan_to_num(frames[f][min(5, max(0, r + i - k * dy)), min(7, max(0, c + j - k * dx))]) for i in (-1, 0, 1) for j in (-1, 0, 1)]) for k in (1, 2, 3)]
                    want[7, f, city, m] = (round(sum(p), 9), round(sum(np.nanmean(x) for x in own), 9))
    rows = made.collect()
    assert {(r.event, r.f, r.city, r.model): (round(r.mm, 9), round(r.obs, 9)) for r in rows} == want and len(rows) == len(want)
    assert {r.f for r in rows if r.city == "inside"} == {0, 1, 2, 3, 4} and {r.f for r in rows if r.city == "edge"} == {3, 4}


def test_coarsened_frames_are_means_of_what_is_covered(spark):
    frame = np.arange(24, dtype=float).reshape(4, 6)
    frame[0, 0] = frame[2:4, 4:6] = np.nan
    made = raster.coarsened(spark.createDataFrame([(5, frame.ravel().tolist())], "f long, v array<double>"), 2, GridSpec(4, 6)).collect()
    assert len(made) == 1 and made[0].f == 5 and np.array_equal(np.array(made[0].v), [14 / 3, 5.5, 7.5, 15.5, 17.5, np.nan], equal_nan=True)


def test_cities_on_two_grids_join_no_cells(spark):
    """Forecasts and truths of cities meet as frames: cells are never matched with cells."""
    import __spark_entry__ as entry

    for name in ("grid_cities", "city_hours"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert joins and not [line for line in joins if " r#" in line or "(r#" in line or "[r#" in line or ", r#" in line]


def test_the_cells_of_a_long_axis_are_made_by_many_tasks(spark):
    """An axis is one row of the first and last frame: its frames are dealt out before each gets its cells."""
    cells = spark.createDataFrame([(0, 0, 0, 3), (3000, 1, 1, 4)], "f long, r int, c int, v long")
    seen = raster.observed(cells)
    plan = seen._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [line.split("#")[0].strip(" :+-") for line in plan if "Generate explode" in line or "RepartitionByExpression" in line]
    assert [x.split()[0] for x in made] == ["Generate", "Generate", "RepartitionByExpression", "Generate"]
    assert seen.count() == sum(f % 29 != 0 for f in range(3001)) * 32 * 48 and seen.where("v > 0").collect() == [(3000, 1, 1, 4)]
