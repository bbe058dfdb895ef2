"""Queries on windows, ensembles, flow and frames between scans."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import functions as F

from pluvia.operators import ensembles, motion
from pluvia.plans import movement, trial
from pluvia.plans.trial import sql
from pluvia.sources import raster
from pluvia.spec import TRIAL

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def r6(c):
    return F.round(c, 6)


_KERNEL = {
    "kern": "SELECT i, j, w / sum(w) OVER () AS w FROM (SELECT i, j, exp(-0.5 * (i * i + j * j) / 1.44) AS w FROM range(-4, 5) a(i), range(-4, 5) b(j))",
    "chance": "SELECT f, r, c, sum(CASE WHEN v >= 2 THEN w ELSE 0 END) AS top, sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) AS below FROM (SELECT f, r + i AS r, c + j AS c, w, v FROM obs, kern) WHERE r BETWEEN 0 AND 31 AND c BETWEEN 0 AND 47 GROUP BY f, r, c",
}


@query(sql("SELECT f, r, round(sum(x), 5) AS expected, round(max(x), 5) AS peak FROM (SELECT f, r, CASE WHEN below > 1e-6 THEN least(1.0, top / below) ELSE 0.0 END AS x FROM chance) GROUP BY f, r", "obs", **_KERNEL))
def gauss_window(spark, sf_dir):
    """Chances of rain on every frame, summed up for each line of cells."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    chance = ensembles.gauss_window(seen, F.col("v") >= 2, 1.2)
    return chance.groupBy("f", "r").agg(F.round(F.sum("chance"), 5).alias("expected"), F.round(F.max("chance"), 5).alias("peak"))


#: Draws by hash of issue, member and name, as in ensembles.
def _uniform(name):
    return f"((CAST('0x' || substr(md5(f || '|' || m || '|{name}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def _offset(name):
    return f"floor({name} * 0.5::DOUBLE * lead + 0.5::DOUBLE)"


_DRAWS = {"z": f"SELECT [{', '.join(f'{x!r}::DOUBLE' for x in ensembles.NORMAL)}] AS z", "drawn": f"SELECT f, m, z[CAST(floor({_uniform('y')} * 1000) AS BIGINT) + 1] AS y, z[CAST(floor({_uniform('x')} * 1000) AS BIGINT) + 1] AS x FROM (SELECT DISTINCT f FROM fc), range(40) t(m), z"}


@query(sql(f"SELECT f, lead, r, c, round(count(*) / 40.0::DOUBLE, 6) AS chance FROM (SELECT f, lead, CAST(r + {_offset('y')} AS INTEGER) AS r, CAST(c + {_offset('x')} AS INTEGER) AS c FROM (SELECT DISTINCT f, lead, r, c FROM fc WHERE model = 'shift' AND p >= 2) JOIN drawn USING (f)) WHERE r BETWEEN 0 AND 31 AND c BETWEEN 0 AND 47 GROUP BY ALL", "fc", **_DRAWS))
def shift_ensemble(spark, sf_dir):
    made = trial.pairs(spark, sf_dir).where("model = 'shift'").select("f", "lead", "r", "c", "p").distinct()
    return ensembles.shift_ensemble(made, F.col("p") >= 2).withColumn("chance", r6("chance"))


def _laplace(name):
    return f"(-sign({_uniform(name)} - 0.5::DOUBLE) * ln(1 - 2 * abs({_uniform(name)} - 0.5::DOUBLE)) / sqrt(2::DOUBLE))"


def _grown(law):
    return "CASE lead " + " ".join(f"WHEN {k} THEN {ensembles.growth(law, k, 60, TRIAL.km)!r}::DOUBLE" for k in (1, 2, 3)) + " END"


@query(sql(f"SELECT f, m AS member, lead, round(lead * dx + p * dx / s - q * dy / s, 6) AS dx, round(lead * dy + p * dy / s + q * dx / s, 6) AS dy FROM (SELECT f, dx, dy, sqrt(dx * dx + dy * dy) AS s, CAST(m AS INTEGER) AS m, CAST(lead AS INTEGER) AS lead, {_laplace('along')} * {_grown(ensembles.ALONG)} AS p, {_laplace('across')} * {_grown(ensembles.ACROSS)} AS q FROM vec, range(8) a(m), range(1, 4) b(lead) WHERE dx * dx + dy * dy > 0)", "dense", **movement._match("vec")))
def perturbed_motion(spark, sf_dir):
    """Where the members of an ensemble with perturbed motion carry rain, in cells."""
    vectors = motion.pair_vectors(movement._blocks(spark, sf_dir)).where("dx * dx + dy * dy > 0")
    return ensembles.displacements(vectors, 8, 3).withColumns({k: r6(k) for k in ("dx", "dy")})


@query()
def frame_interpolation(spark, sf_dir):
    """One frame between each pair: (f, total, wet, peak)."""
    pairs = motion.pairs(raster.frames(trial.cells(spark, sf_dir)))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [ensembles.between(motion.unpack(r["a_at"], r["a_v"], TRIAL), motion.unpack(r["b_at"], r["b_v"], TRIAL), 1)[0] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["f"] for r in rows], pa.int64()), pa.array([round(float(m.sum()), 4) for m in made]), pa.array([int((m >= 2).sum()) for m in made], pa.int64()), pa.array([round(float(m.max()), 4) for m in made])], ["f", "total", "wet", "peak"])

    return pairs.mapInArrow(run, "f long, total double, wet long, peak double")


@query()
def lk_flow(spark, sf_dir):
    """Mean optical flow over the wet cells of each pair: (f, dx, dy, wet)."""
    pairs = motion.pairs(raster.frames(trial.cells(spark, sf_dir)))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = motion.unpack(r["a_at"], r["a_v"], TRIAL), motion.unpack(r["b_at"], r["b_v"], TRIAL)
                u, v = ensembles.optical_flow([a, b])
                wet = b >= 1
                n = int(wet.sum())
                out.append((r["f"], round(float(u[wet].mean()), 4) if n else None, round(float(v[wet].mean()), 4) if n else None, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["f", "dx", "dy", "wet"])

    return pairs.mapInArrow(run, "f long, dx double, dy double, wet long")


def _cascade(spark, sf_dir, members, perturbed=False):
    cells = trial.cells(spark, sf_dir)
    made = ensembles.cascade_forecasts(raster.frames(cells), trial.issues(spark, sf_dir), 2, members, perturbed=perturbed)
    return made.groupBy("f", "model", "lead").agg(F.count_distinct("member").alias("members"), F.round(F.sum("p"), 3).alias("total"), F.count_if(F.col("p") >= 2).alias("wet"), F.max("fallback").alias("fallback"))


@query()
def sprog(spark, sf_dir):
    return _cascade(spark, sf_dir, 0)


@query()
def steps(spark, sf_dir):
    return _cascade(spark, sf_dir, 8)


@query()
def steps_bps(spark, sf_dir):
    """The ensemble with perturbed motion."""
    return _cascade(spark, sf_dir, 8, perturbed=True)
