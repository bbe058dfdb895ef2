"""Chances of rain, frames between scans, optical flow, and stochastic cascades.

The cascades are seeded, algorithm-level equivalents after the published descriptions (Seed 2003;
Bowler et al. 2006; Pulkkinen et al. 2019), with numpy only: other implementations' digits are not
reproduced. An issue whose cascade cannot be fitted gives persistence and says so (``fallback``).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators import motion
from pluvia.spec import TRIAL, GridSpec

TRACE = 0.1  # rain below it is dry in decibels
DRY_DB = -15.0


def gauss_window(cells: DataFrame, wet: Column, sigma: float, grid: GridSpec = TRIAL, ratio: float = 1.0, angle: float = 0.0) -> DataFrame:
    """(f, r, c, chance) of dense cells (f, r, c, v): Gaussian mean of wet over what is covered, along an angle and across it.

    A round kernel is the product of two lines of weights: two windows on one partitioning by frame.
    With a ratio, only wet cells and those without coverage spread; the kernel's weight inside the grid is a table of its own.
    """
    reach = math.ceil(3 * sigma)
    if ratio == 1.0:
        line = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
        across, down = Window.partitionBy("f", "r").orderBy("c"), Window.partitionBy("f", "c").orderBy("r")
        mean = lambda name, over: sum(F.coalesce(F.lag(name, -k).over(over), F.lit(0.0)) * (w / sum(line)) for k, w in zip(range(-reach, reach + 1), line, strict=True))
        marked = cells.repartition("f").select("f", "r", "c", F.when(F.col("v").isNotNull() & wet, 1.0).otherwise(0.0).alias("a"), F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0).alias("b"))
        lines = marked.select("f", "r", "c", mean("a", across).alias("a"), mean("b", across).alias("b"))
        box = lines.select("f", "r", "c", mean("a", down).alias("a"), mean("b", down).alias("b"))
        return box.select("f", "r", "c", F.when(F.col("b") > 1e-6, F.least(F.lit(1.0), F.col("a") / F.col("b"))).otherwise(0.0).alias("chance"))
    offsets = [(i, j, x * math.cos(angle) + i * math.sin(angle), -x * math.sin(angle) + i * math.cos(angle)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for x in (j,)]
    raw = [(i, j, math.exp(-0.5 * ((a / sigma) ** 2 + (c / (ratio * sigma)) ** 2))) for i, j, a, c in offsets]
    total = sum(w for *_, w in raw)
    kernel = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w / total).alias("w")) for i, j, w in raw))

    def spread(some: DataFrame, keys: list[str], name: str) -> DataFrame:
        each = some.withColumn("k", F.explode(kernel)).select(*(k for k in keys if k == "f"), (F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c"), F.col("k.w").alias("w"))
        return each.where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1)).groupBy(*keys).agg(F.sum("w").alias(name))

    inside = spread(cells.sparkSession.range(grid.rows * grid.cols).select(F.expr(f"cast(id div {grid.cols} as int)").alias("r"), (F.col("id") % grid.cols).cast("int").alias("c")), ["r", "c"], "whole")
    top = spread(cells.where(F.col("v").isNotNull() & wet), ["f", "r", "c"], "top")
    gone = spread(cells.where(F.col("v").isNull()), ["f", "r", "c"], "gone")
    met = cells.select("f", "r", "c").join(top, ["f", "r", "c"], "left").join(gone, ["f", "r", "c"], "left").join(inside, ["r", "c"])
    below = F.col("whole") - F.coalesce("gone", F.lit(0.0))
    return met.select("f", "r", "c", F.when(below > 1e-6, F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0)) / below)).otherwise(0.0).alias("chance"))


#: The inverse of the normal distribution at the middles of equal shares: a draw is a place in it, so every engine has the same digits.
NORMAL = [NormalDist().inv_cdf((k + 0.5) / 1000) for k in range(1000)]
#: Growth of the perturbations of motion along it and across it, g(t) = a t^b + c in km/h, t in minutes (Bowler et al. 2006).
ALONG, ACROSS = (10.88, 0.23, -7.68), (5.76, 0.31, -2.72)


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 by hash of the parts: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def normal(*parts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NORMAL)), (F.floor(uniform(*parts) * len(NORMAL)) + 1).cast("int"))


def laplace(*parts: Column) -> Column:
    """A draw of the Laplace distribution of variance one."""
    off = uniform(*parts) - 0.5
    return -F.signum(off) * F.log(1 - 2 * F.abs(off)) / math.sqrt(2)


def draws(issues: DataFrame, members: int, **made) -> DataFrame:
    """(f, draws): an array with a struct for each member; made gives each field's column from the issue's and the member's number."""
    each = issues.select("f").distinct().withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    fields = [draw(F.col("f").cast("string"), F.col("member").cast("string"), F.lit(name)).alias(name) for name, draw in made.items()]
    return each.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("member", *fields))).alias("draws"))


def shift_ensemble(forecasts: DataFrame, wet: Column, members: int = 40, spread: float = 0.5, grid: GridSpec = TRIAL) -> DataFrame:
    """(f, lead, r, c, chance): share of members, each one the whole forecast moved; dry outside.

    A member of an issue has two normal draws; they hold for all its leads, over which the offset grows.
    """
    wet_cells = forecasts.where(wet).select("f", "lead", "r", "c")
    made = wet_cells.join(draws(wet_cells, members, y=normal, x=normal), "f").withColumn("draw", F.explode("draws"))
    step = lambda name: F.floor(F.col(f"draw.{name}") * spread * F.col("lead") + 0.5)
    moved = made.select("f", "lead", (F.col("r") + step("y")).cast("int").alias("r"), (F.col("c") + step("x")).cast("int").alias("c"))
    return moved.where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1)).groupBy("f", "lead", "r", "c").agg((F.count("*") / members).alias("chance"))


def growth(law: tuple[float, float, float], lead: int, minutes: float, km: float) -> float:
    """Cells by which a perturbation of strength one has moved rain after so many steps."""
    a, b, c = law
    return sum((a * (minutes * k) ** b + c) * minutes / 60 / km for k in range(1, lead + 1))


def displacements(vectors: DataFrame, members: int, steps: int, minutes: float = 60, grid: GridSpec = TRIAL) -> DataFrame:
    """(f, member, lead, dx, dy): where each member carries rain along a vector (f, dx, dy), in cells; one without motion is not perturbed."""
    speed = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    ux, uy = (F.when(speed > 0, F.col(k) / speed).otherwise(0.0) for k in ("dx", "dy"))
    moving = vectors.where("dx IS NOT NULL").select("f", "dx", "dy", ux.alias("ux"), uy.alias("uy"))
    leads = F.array(*(F.struct(F.lit(k).alias("lead"), *(F.lit(growth(law, k, minutes, grid.km)).alias(n) for n, law in (("p", ALONG), ("q", ACROSS)))) for k in range(1, steps + 1)))
    each = moving.join(draws(moving, members, along=laplace, across=laplace), "f").withColumn("d", F.explode("draws")).withColumn("l", F.explode(leads))
    p, q = F.col("d.along") * F.col("l.p"), F.col("d.across") * F.col("l.q")
    lead = F.col("l.lead")
    return each.select("f", "d.member", lead.alias("lead"), (lead * F.col("dx") + p * F.col("ux") - q * F.col("uy")).alias("dx"), (lead * F.col("dy") + p * F.col("uy") + q * F.col("ux")).alias("dy"))


def between(a: np.ndarray, b: np.ndarray, count: int, block: int = 8, radius: int = 4) -> list[np.ndarray]:
    """Frames evenly spaced between two: along the blocks' motion as far as it is trusted, a plain blend otherwise."""
    field = motion.smooth(motion.match_blocks(a, b, block, radius)[0])
    grow = lambda x: np.kron(x, np.ones((block, block)))[: a.shape[0], : a.shape[1]]
    dx, dy, conf = grow(field.dx), grow(field.dy), grow(field.conf)
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(float)
    out = []
    for k in range(1, count + 1):
        t = k / (count + 1)
        along = (1 - t) * motion.sample(a, x - t * dx, y - t * dy) + t * motion.sample(b, x + (1 - t) * dx, y + (1 - t) * dy)
        out.append(np.maximum(0, conf * along + (1 - conf) * ((1 - t) * a + t * b)))
    return out


def decibels(rain: np.ndarray) -> np.ndarray:
    return np.where(rain >= TRACE, 10 * np.log10(np.maximum(rain, TRACE)), DRY_DB)


def box_mean(x: np.ndarray, half: int) -> np.ndarray:
    total = np.pad(x, half + 1).cumsum(0).cumsum(1)
    n = 2 * half + 1
    h, w = x.shape
    return (total[n : n + h, n : n + w] - total[:h, n : n + w] - total[n : n + h, :w] + total[:h, :w]) / n**2


def optical_flow(frames: list[np.ndarray], half: int = 5, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Dense Lucas-Kanade flow (dx, dy) of the last frames, in decibels: least squares in windows, refined by warping."""
    h, w = frames[-1].shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u, v = np.zeros((h, w)), np.zeros((h, w))
    smooth = [box_mean(decibels(f) - DRY_DB, 1) for f in frames]
    for _ in range(rounds):
        axx = axy = ayy = bx = by = 0.0
        for a, b in zip(smooth, smooth[1:], strict=False):
            back = motion.sample(b, x + u, y + v)
            gy, gx = np.gradient((a + back) / 2)
            gt = back - a
            axx, axy, ayy = axx + box_mean(gx * gx, half), axy + box_mean(gx * gy, half), ayy + box_mean(gy * gy, half)
            bx, by = bx + box_mean(gx * gt, half), by + box_mean(gy * gt, half)
        ridge = 0.02 * (axx + ayy).max() + 1e-9
        det = (axx + ridge) * (ayy + ridge) - axy**2
        u = np.clip(u - ((ayy + ridge) * bx - axy * by) / det, -6, 6)
        v = np.clip(v - ((axx + ridge) * by - axy * bx) / det, -6, 6)
        weight = box_mean(axx + ayy, half) + 1e-9
        u, v = box_mean(u * weight, half) / box_mean(weight, half), box_mean(v * weight, half) / box_mean(weight, half)
    return u, v


def bands(shape: tuple[int, int], levels: int) -> np.ndarray:
    """Weights of each level for each wave number; they add up to one."""
    ky, kx = np.fft.fftfreq(shape[0])[:, None] * max(shape), np.fft.rfftfreq(shape[1])[None] * max(shape)
    scale = np.log2(np.maximum(np.hypot(ky, kx), 0.5))
    centres = np.linspace(-1, np.log2(max(shape) / 2), levels)
    out = np.exp(-0.5 * ((scale - centres[:, None, None]) / (centres[1] - centres[0] if levels > 1 else 1)) ** 2)
    return out / out.sum(axis=0)


def cascade(frames: list[np.ndarray], steps: int, members: int = 0, levels: int = 4, seed: int = 0, pushed: np.ndarray | None = None) -> np.ndarray:
    """[max(members, 1), steps, h, w]: each scale follows an autoregression of second order along the flow, with noise if members are asked for.

    pushed: for each member and step the cells by which it runs ahead of the flow, and to its side.
    """
    if len(frames) < 3 or not all((f >= TRACE).any() for f in frames):
        raise ValueError("three frames with rain are needed")
    h, w = frames[-1].shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u, v = optical_flow(frames[-3:])
    speed = np.hypot(u, v)
    ux, uy = (np.divide(z, speed, out=np.zeros((h, w)), where=speed > 0) for z in (u, v))
    back = lambda f, k, p=0.0, q=0.0: motion.sample(f, x - k * u - p * ux + q * uy, y - k * v - p * uy - q * ux)
    aligned = [decibels(np.maximum(0, back(f, k))) for f, k in zip(frames[-3:], (2, 1, 0), strict=True)]
    mean, masks = aligned[-1].mean(), bands((h, w), levels)
    split = lambda z: np.stack([np.fft.irfft2(np.fft.rfft2(z - mean) * m, s=(h, w)) for m in masks])
    past = [split(z) for z in aligned]
    sd = past[-1].reshape(levels, -1).std(axis=1)[:, None, None] + 1e-6
    corr = lambda a, b: np.array([np.corrcoef(p.ravel(), q.ravel())[0, 1] if p.std() > 0 and q.std() > 0 else 0.0 for p, q in zip(a, b, strict=True)])
    r1, r2 = np.clip(corr(past[-1], past[-2]), -0.99, 0.99), np.clip(corr(past[-1], past[-3]), -0.99, 0.99)
    r2 = np.maximum(r2, 2 * r1**2 - 1 + 1e-3)  # stationarity
    phi1, phi2 = r1 * (1 - r2) / (1 - r1**2), (r2 - r1**2) / (1 - r1**2)
    noise = np.sqrt(np.clip(1 - phi1 * r1 - phi2 * r2, 0, 1))[:, None, None]
    p1, p2 = phi1[:, None, None], phi2[:, None, None]
    shape = np.abs(np.fft.rfft2(aligned[-1] - mean)) + 1e-9
    ordered = np.sort(np.where(aligned[-1] > DRY_DB, frames[-1], 0).ravel())
    out = np.empty((max(members, 1), steps, h, w), np.float32)
    for m in range(max(members, 1)):
        rng = np.random.default_rng((seed, m))
        a, b = past[-2] / sd, past[-1] / sd
        for s in range(steps):
            step = p1 * b + p2 * a
            if members:
                field = np.fft.irfft2(np.fft.rfft2(rng.standard_normal((h, w))) * shape, s=(h, w))
                parts = np.stack([np.fft.irfft2(np.fft.rfft2(field) * k, s=(h, w)) for k in masks])
                step = step + noise * parts / (parts.reshape(levels, -1).std(axis=1)[:, None, None] + 1e-9)
            a, b = b, step
            total = (b * sd).sum(axis=0)
            ranked = np.empty(h * w)
            ranked[np.argsort(total.ravel(), kind="stable")] = ordered  # keeps the distribution of the last frame
            out[m, s] = np.maximum(0, back(ranked.reshape(h, w), s + 1, *(() if pushed is None else pushed[m, s])))
    return out


ENSEMBLE = "f long, model string, member int, lead int, r int, c int, p double, fallback boolean"


def cascade_forecasts(frames: DataFrame, issues: DataFrame, steps: int, members: int = 0, grid: GridSpec = TRIAL, perturbed: bool = False, minutes: float = 60) -> DataFrame:
    """(f, model, member, lead, r, c, p, fallback) at the issues whose last three frames are there; the seed is the issue.

    perturbed: each member's motion is perturbed along the flow and across it, by draws of its issue and its own.
    """
    history = issues.select("f").distinct().withColumn("g", F.explode(F.array(*(F.col("f") - k for k in range(3)))))
    rows = history.join(frames.select(F.col("f").alias("g"), "at", "v"), "g").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("g", "at", "v"))).alias("x")).where(F.size("x") == 3)
    name = ("steps-bps" if perturbed else "steps") if members else "sprog"
    if perturbed:
        rows = rows.join(draws(rows, members, along=laplace, across=laplace), "f")
    laws = np.array([[growth(law, s, minutes, grid.km) for law in (ALONG, ACROSS)] for s in range(1, steps + 1)])

    def run(batches):
        for batch in batches:
            for i, f in enumerate(batch.column("f").to_pylist()):
                x = batch.column("x")[i].values
                grids = [motion.unpack(x.field("at")[j].values.to_numpy(), x.field("v")[j].values.to_numpy(), grid) for j in range(3)]
                pushed = np.array([[d["along"], d["across"]] for d in batch.column("draws")[i].as_py()])[:, None] * laws if perturbed else None
                try:
                    made, fell = cascade(grids, steps, members, seed=f, pushed=pushed), False
                except (ValueError, np.linalg.LinAlgError):
                    made, fell = np.broadcast_to(grids[-1].astype(np.float32), (max(members, 1), steps, grid.rows, grid.cols)), True
                m, s, r, c = np.nonzero(made > 0)
                full = lambda v, k: pa.array([v] * len(r), k)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([full(f, pa.int64()), full(name, pa.string()), pa.array(m, pa.int32()), pa.array(s + 1, pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(made[m, s, r, c].astype(float)), full(fell, pa.bool_())], ["f", "model", "member", "lead", "r", "c", "p", "fallback"])

    return rows.mapInArrow(run, ENSEMBLE)
