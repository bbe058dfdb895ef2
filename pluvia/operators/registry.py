"""All forecast models by name: forecasts(name, cells, issues, steps) -> (f, model, lead, r, c, p) of cells that are not zero.

Names of cascades and flows are those of their kinds; their ensembles give the mean with the share
of members as probability, and the first member, as models of their own. Motion is perturbed in
the -bps- and -default- ensembles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import ensembles, forecast, motion
from pluvia.sources import raster
from pluvia.spec import TRIAL, GridSpec

HALF_LIVES = {"gwx3": 3.0, "gwx6": 6.0}
SIZED = {f"{kind}-{km}km": (kind, km) for kind in ("block", "block-smooth") for km in (13, 26, 51, 102)}
FLOWS = {"lk": 4, "lk2": 2, "lk7": 7, "lk8": 8, "lk13": 13}
CASCADES = {"sprog": 0, **{f"{kind}-{what}": n for kind, n in (("steps", 8), ("steps-bps", 8), ("steps-default", 24)) for what in ("mean", "member")}}
NAMES = ("persistence", *motion.BLOCK_MODELS, *motion.VECTOR_MODELS, *HALF_LIVES, *SIZED, *FLOWS, *CASCADES)


def _flow_forecasts(frames: DataFrame, issues: DataFrame, name: str, steps: int, grid: GridSpec) -> DataFrame:
    scans = FLOWS[name]
    history = issues.select("f").distinct().withColumn("g", F.explode(F.array(*(F.col("f") - k for k in range(scans)))))
    rows = history.join(frames.select(F.col("f").alias("g"), "at", "v"), "g").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("g", "at", "v"))).alias("x")).where(F.size("x") == scans)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grids = [motion.unpack(x["at"], x["v"], grid) for x in row["x"]]
                u, v = ensembles.optical_flow(grids)
                y, x = np.mgrid[0 : grid.rows, 0 : grid.cols].astype(float)
                for s in range(1, steps + 1):
                    px, py = x - s * u, y - s * v
                    made = motion.sample(grids[-1], px, py) * ((px >= 0) & (px <= grid.cols - 1) & (py >= 0) & (py <= grid.rows - 1))
                    r, c = np.nonzero(made > 0)
                    n = len(r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["f"]), pa.int64()), pa.array([name] * n, pa.string()), pa.array(np.full(n, s), pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(made[r, c])], ["f", "model", "lead", "r", "c", "p"])

    return rows.mapInArrow(run, motion.FORECAST)


def history(name: str) -> int:
    """Frames up to the issue that a model needs; without them it gives no forecast."""
    if name in FLOWS:
        return FLOWS[name]
    if name in CASCADES:
        return 3
    if name in SIZED or name in HALF_LIVES:
        return 2
    return 1 if name == "persistence" else (motion.BLOCK_MODELS.get(name) or motion.VECTOR_MODELS[name])[0]


def forecasts(name: str, cells: DataFrame, issues: DataFrame, steps: int, grid: GridSpec = TRIAL, block: int = 8, radius: int = 2) -> DataFrame:
    """Forecasts of one model at the issue frames (f); issues without the model's whole history give none."""
    frames, when = raster.frames(cells, grid), issues.select("f").distinct()
    columns = ("f", "model", "lead", "r", "c", "p")
    if name == "persistence":
        last = cells.select("f", "r", "c", F.col("v").cast("double").alias("p"))
        return forecast.leads(when, steps).join(last, "f").withColumn("model", F.lit(name)).select(*columns)
    if name in motion.BLOCK_MODELS:
        return motion.block_forecasts(frames, when, name, steps, grid, block, radius)
    if name in SIZED:
        kind, km = SIZED[name]
        return motion.block_forecasts(frames, when, kind, steps, grid, grid.cells(km), radius).withColumn("model", F.lit(name))
    if name in FLOWS:
        return _flow_forecasts(frames, when, name, steps, grid)
    if name in CASCADES:
        made = ensembles.cascade_forecasts(frames, when, steps, CASCADES[name], grid, perturbed="-bps-" in name or "-default-" in name)
        if name.endswith("mean"):
            made = made.groupBy("f", "lead", "r", "c").agg((F.sum("p") / CASCADES[name]).alias("p"))
        elif name.endswith("member"):
            made = made.where("member = 0")
        return made.withColumn("model", F.lit(name)).select(*columns)
    if name in HALF_LIVES:
        mean, factor, outside = motion.half_life_mean(motion.pair_vectors(motion.block_motion(frames, grid, block, radius)), 13, HALF_LIVES[name]), 1.0, False
    elif name in motion.VECTOR_MODELS:
        scans, sub, shrunk, factor, outside = motion.VECTOR_MODELS[name]
        vectors = motion.pair_vectors(motion.block_motion(frames, grid, block, radius, sub, shrunk, shrunk), shrunk)
        mean = motion.window_mean(vectors, scans).where(F.col("have") == scans - 1)
    else:
        raise KeyError(f"no model {name!r}; there are {', '.join(NAMES)}")
    moving = when.join(mean, "f").select("f", F.lit(name).alias("model"), (F.col("dx") * factor).alias("dx"), (F.col("dy") * factor).alias("dy"))
    return forecast.moved(moving, cells, steps, grid, outside).where("p > 0").select(*columns)
