"""Queries on motion and the models that follow it, with their SQL where the work is relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import forecast, motion, score, structure
from pluvia.operators.registry import HALF_LIVES
from pluvia.plans import trial
from pluvia.plans.trial import sql
from pluvia.sources import raster
from pluvia.sources.shared import stored
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


#: The furthest offset that block matching looks at: the trial's showers move three cells a frame at most.
RADIUS = 3
BLOCK = 8
ROWS, COLS = TRIAL.rows, TRIAL.cols


def _blocks(spark, sf_dir, frames=None, **more):
    return motion.block_motion(raster.frames(trial.cells(spark, sf_dir)) if frames is None else frames, radius=RADIUS, **more)


def _frames(spark, sf_dir):
    """The packed frames as a table: matching, forecasts and truths read it, so it is not made for each of them."""
    return stored(spark)(raster.frames(trial.cells(spark, sf_dir)))


def _soft(raw: str) -> dict[str, str]:
    """Blocks of little confidence take their neighbours' mean."""
    return {
        "near": f"SELECT a.f, a.br, a.bc, sum(b.dx * b.conf) / sum(b.conf) AS mx, sum(b.dy * b.conf) / sum(b.conf) AS my, max(b.conf) AS top FROM {raw} a JOIN {raw} b ON a.f = b.f AND abs(a.br - b.br) <= 2 AND abs(a.bc - b.bc) <= 2 AND (a.br <> b.br OR a.bc <> b.bc) AND b.conf > 0 GROUP BY ALL",
        "soft": f"SELECT f, br, bc, CASE WHEN conf < 0.5 AND top IS NOT NULL THEN mx ELSE dx END AS dx, CASE WHEN conf < 0.5 AND top IS NOT NULL THEN my ELSE dy END AS dy, CASE WHEN conf < 0.5 AND top IS NOT NULL THEN greatest(conf, least(0.6, 0.8 * top)) ELSE conf END AS conf FROM {raw} LEFT JOIN near USING (f, br, bc)",
    }


#: Block matching as joins: every cell with the clamped cell of the next frame at each offset.
_MATCH = {
    "look": f"SELECT f + 1 AS f, r, c, v, dy, dx, greatest(0, least({ROWS - 1}, r + dy)) AS rr, greatest(0, least({COLS - 1}, c + dx)) AS cc FROM dense, range({-RADIUS}, {RADIUS + 1}) i(dy), range({-RADIUS}, {RADIUS + 1}) j(dx)",
    "err": f"SELECT k.f, k.r // {BLOCK} AS br, k.c // {BLOCK} AS bc, dy, dx, CAST(sum((k.v - b.v) * (k.v - b.v)) AS BIGINT) AS ssd FROM look k JOIN dense b ON b.f = k.f AND b.r = k.rr AND b.c = k.cc GROUP BY ALL",
    "wet": f"SELECT f + 1 AS f, r // {BLOCK} AS br, c // {BLOCK} AS bc, CAST(sum(v) AS BIGINT) AS s FROM dense GROUP BY ALL",
    "best": "SELECT * FROM (SELECT *, max(CASE WHEN dy = 0 AND dx = 0 THEN ssd END) OVER (PARTITION BY f, br, bc) AS base, row_number() OVER (PARTITION BY f, br, bc ORDER BY ssd, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE 1 END, dy, dx) AS k FROM err) WHERE k = 1",
    "raw": f"SELECT f, br, bc, CASE WHEN s * 20 < {BLOCK * BLOCK} THEN 0 ELSE dx END AS dx, CASE WHEN s * 20 < {BLOCK * BLOCK} THEN 0 ELSE dy END AS dy, CASE WHEN s * 20 < {BLOCK * BLOCK} OR base = 0 THEN 0.0 ELSE CAST(base - ssd AS DOUBLE) / base END AS conf, ssd FROM best JOIN wet USING (f, br, bc)",
    "vec": "SELECT f, CASE WHEN sum(conf) > 0 THEN sum(dx * conf) / sum(conf) END AS dx, CASE WHEN sum(conf) > 0 THEN sum(dy * conf) / sum(conf) END AS dy FROM raw GROUP BY f",
    **_soft("raw"),
    "shrunk": "SELECT f, CASE WHEN sum(conf) > 0 THEN sum(dx * least(1.0, conf / 0.3) * conf) / sum(conf) END AS dx, CASE WHEN sum(conf) > 0 THEN sum(dy * least(1.0, conf / 0.3) * conf) / sum(conf) END AS dy FROM soft GROUP BY f",
}


def _match(*names):
    upto = max(list(_MATCH).index(n) for n in names)
    return {k: v for k, v in list(_MATCH.items())[: upto + 1]}


def _vertex_sql(before: str, after: str) -> tuple[str, str]:
    """Place and depth of the lowest point of the parabola through three errors; 0 at the search's edge."""
    bend = f"({before} + {after} - 2 * ssd)"
    place = f"(CASE WHEN {bend} > 0 THEN greatest(-0.5, least(0.5, -(({after} - {before}) / 2.0::DOUBLE) / {bend})) ELSE 0 END)"
    return place, f"(CASE WHEN {bend} > 0 THEN greatest(0, -{place} * (({after} - {before}) / 2.0::DOUBLE + {place} * {bend} / 2.0::DOUBLE)) ELSE 0 END)"


def _sub(kind: str) -> dict[str, str]:
    """raw with offsets refined by parabolas around the first smallest error."""
    (px, qx), (py, qy) = _vertex_sql("xl", "xr"), _vertex_sql("yu", "yd")
    takes = "(ssd < base OR base > 0)" if kind == "all" else "ssd < base"
    late = "(CASE WHEN ssd >= base AND base > 0 THEN qx + qy ELSE 0 END)" if kind == "all" else "0"
    return {
        **_match("best"),
        "choice": "SELECT * FROM (SELECT *, max(CASE WHEN dy = 0 AND dx = 0 THEN ssd END) OVER (PARTITION BY f, br, bc) AS base, row_number() OVER (PARTITION BY f, br, bc ORDER BY ssd, dy, dx) AS k FROM err) WHERE k = 1",
        "sides": "SELECT c.*, max(e.ssd) FILTER (WHERE e.dy = c.dy AND e.dx = c.dx - 1) AS xl, max(e.ssd) FILTER (WHERE e.dy = c.dy AND e.dx = c.dx + 1) AS xr, max(e.ssd) FILTER (WHERE e.dx = c.dx AND e.dy = c.dy - 1) AS yu, max(e.ssd) FILTER (WHERE e.dx = c.dx AND e.dy = c.dy + 1) AS yd FROM choice c JOIN err e USING (f, br, bc) GROUP BY ALL",
        "drawn_": f"SELECT *, {px} AS px, {qx} AS qx, {py} AS py, {qy} AS qy FROM sides",
        "refined": f"SELECT f, br, bc, base, (CASE WHEN ssd < base THEN dx ELSE 0 END) + (CASE WHEN {takes} THEN px ELSE 0 END) AS dx, (CASE WHEN ssd < base THEN dy ELSE 0 END) + (CASE WHEN {takes} THEN py ELSE 0 END) AS dy, greatest(0, ssd - {late}) AS ssd, ssd < base OR {late} > 0 AS moved FROM drawn_",
        "sub": f"SELECT f, br, bc, CASE WHEN s * 20 < {BLOCK * BLOCK} THEN 0 ELSE dx END AS dx, CASE WHEN s * 20 < {BLOCK * BLOCK} THEN 0 ELSE dy END AS dy, CASE WHEN s * 20 < {BLOCK * BLOCK} OR base = 0 OR NOT moved THEN 0.0 ELSE 1 - ssd / CAST(base AS DOUBLE) END AS conf FROM refined JOIN wet USING (f, br, bc)",
    }


def _mean_blocks(raw: str, scans: int) -> dict[str, str]:
    return {"mean": f"SELECT f, br, bc, coalesce(sum(dx * conf) / nullif(sum(conf), 0), 0) AS dx, coalesce(sum(dy * conf) / nullif(sum(conf), 0), 0) AS dy, avg(conf) AS conf FROM (SELECT a.f, a.br, a.bc, b.dx, b.dy, b.conf FROM {raw} a JOIN {raw} b ON a.br = b.br AND a.bc = b.bc AND b.f BETWEEN a.f - {scans - 2} AND a.f) GROUP BY ALL HAVING count(*) = {scans - 1}"}


def _filled(start: str) -> dict[str, str]:
    """Motion spreads to empty blocks, a ring a pass; as many passes as the map has blocks across."""
    out, before = {}, start
    for k in range(max(ROWS, COLS) // BLOCK):
        out[f"ring{k}"] = f"SELECT a.f, a.br, a.bc, sum(b.dx * b.conf) / sum(b.conf) AS mx, sum(b.dy * b.conf) / sum(b.conf) AS my, max(b.conf) AS top FROM {before} a JOIN {before} b ON a.f = b.f AND abs(a.br - b.br) <= 1 AND abs(a.bc - b.bc) <= 1 AND (a.br <> b.br OR a.bc <> b.bc) AND b.conf > 0 WHERE a.conf <= 0 GROUP BY ALL"
        out[f"fill{k}"] = f"SELECT f, br, bc, coalesce(mx, dx) AS dx, coalesce(my, dy) AS dy, CASE WHEN top IS NOT NULL THEN least(0.6, 0.95 * top) ELSE conf END AS conf FROM {before} LEFT JOIN ring{k} USING (f, br, bc)"
        before = f"fill{k}"
    return out | {"filled": f"SELECT * FROM {before}"}


@query(sql("SELECT f, br, bc, CAST(ssd AS DOUBLE) AS ssd FROM best", "dense", **_match("best")))
def block_ssd(spark, sf_dir):
    return _blocks(spark, sf_dir).select("f", "br", "bc", "ssd")


@query(sql("SELECT f, br, bc, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, round(conf, 6) AS conf FROM raw", "dense", **_match("raw")))
def block_motion_raw(spark, sf_dir):
    return _blocks(spark, sf_dir).select("f", "br", "bc", F.col("dx").cast("long"), F.col("dy").cast("long"), r6("conf").alias("conf"))


@query(sql("SELECT f, br, bc, round(dx, 6) AS dx, round(dy, 6) AS dy, round(conf, 6) AS conf FROM soft", "dense", **_match("soft")))
def block_motion_smoothed(spark, sf_dir):
    return _blocks(spark, sf_dir, smoothed=True).select("f", "br", "bc", *(r6(c).alias(c) for c in ("dx", "dy", "conf")))


@query(sql("SELECT f, br, bc, round(dx, 6) AS dx, round(dy, 6) AS dy, round(conf, 6) AS conf FROM filled", "dense", **_match("soft"), **_filled("soft")))
def motion_fill(spark, sf_dir):
    """Smoothed fields, spread over empty blocks until nothing changes."""
    return _blocks(spark, sf_dir, smoothed=True, filled=True).select("f", "br", "bc", *(r6(c).alias(c) for c in ("dx", "dy", "conf")))


@query(sql("SELECT f, br, bc, round(dx, 6) AS dx, round(dy, 6) AS dy, round(conf, 6) AS conf FROM sub", "dense", **_sub("all")))
def subcell(spark, sf_dir):
    """Offsets refined by parabolas, also those of blocks without a whole-cell match."""
    return _blocks(spark, sf_dir, subcell="all").select("f", "br", "bc", *(r6(c).alias(c) for c in ("dx", "dy", "conf")))


@query(sql("SELECT f, round(dx, 6) AS dx, round(dy, 6) AS dy FROM vec", "dense", **_match("vec")))
def pair_vectors(spark, sf_dir):
    return motion.pair_vectors(_blocks(spark, sf_dir)).select("f", r6("dx").alias("dx"), r6("dy").alias("dy"))


@query(sql("SELECT f, round(dx, 6) AS dx, round(dy, 6) AS dy FROM shrunk", "dense", **_match("shrunk")))
def global_vector(spark, sf_dir):
    return motion.pair_vectors(_blocks(spark, sf_dir, smoothed=True), shrunk=True).select("f", r6("dx").alias("dx"), r6("dy").alias("dy"))


@query(sql("SELECT f, scans, round(coalesce(avg(dx), 0), 6) AS dx, round(coalesce(avg(dy), 0), 6) AS dy FROM (SELECT a.f, scans, b.dx, b.dy FROM vec a, (VALUES (2), (4), (7)) s(scans), vec b WHERE b.f BETWEEN a.f - scans + 2 AND a.f) GROUP BY f, scans HAVING count(*) = scans - 1", "dense", **_match("vec")))
def gw_windows(spark, sf_dir):
    """Mean vectors over the last 2, 4 and 7 scans, where the history is whole."""
    vectors = motion.pair_vectors(_blocks(spark, sf_dir))
    parts = [motion.window_mean(vectors, n).where(F.col("have") == n - 1).select("f", F.lit(n).alias("scans"), r6("dx").alias("dx"), r6("dy").alias("dy")) for n in (2, 4, 7)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("SELECT a.f, round(coalesce(sum(b.dx * pow(0.5, (a.f - b.f) / 3.0)) / sum(CASE WHEN b.dx IS NOT NULL THEN pow(0.5, (a.f - b.f) / 3.0) END), 0), 6) AS dx, round(coalesce(sum(b.dy * pow(0.5, (a.f - b.f) / 3.0)) / sum(CASE WHEN b.dy IS NOT NULL THEN pow(0.5, (a.f - b.f) / 3.0) END), 0), 6) AS dy FROM vec a JOIN vec b ON b.f BETWEEN a.f - 5 AND a.f GROUP BY a.f", "dense", **_match("vec")))
def gw_halflife(spark, sf_dir):
    return motion.half_life_mean(motion.pair_vectors(_blocks(spark, sf_dir)), 7, 3.0).select("f", r6("dx").alias("dx"), r6("dy").alias("dy"))


@query(sql("SELECT f, br, bc, round(sum(dx * conf) / nullif(sum(conf), 0), 6) AS dx, round(sum(dy * conf) / nullif(sum(conf), 0), 6) AS dy, round(avg(conf), 6) AS conf FROM (SELECT a.f, a.br, a.bc, b.dx, b.dy, b.conf FROM raw a JOIN raw b ON a.br = b.br AND a.bc = b.bc AND b.f BETWEEN a.f - 2 AND a.f) GROUP BY ALL HAVING count(*) = 3", "dense", **_match("raw")))
def block_windows(spark, sf_dir):
    """Each block's vector over three pairs, before borrowing and filling."""
    raw = _blocks(spark, sf_dir)
    later = raw.withColumn("f", F.explode(F.array(*(F.col("f") + k for k in range(3)))))
    whole = raw.select("f", "br", "bc").join(later, ["f", "br", "bc"]).groupBy("f", "br", "bc").agg(F.count("*").alias("n"), *(F.try_divide(F.sum(F.col(d) * F.col("conf")), F.sum("conf")).alias(d) for d in ("dx", "dy")), F.avg("conf").alias("conf"))
    return whole.where("n = 3").select("f", "br", "bc", *(r6(c).alias(c) for c in ("dx", "dy", "conf")))


@query(sql(f"SELECT p.event_id, round(coalesce(sum((1 - abs(x - c)) * (1 - abs(y - r)) * v), 0), 6) AS v FROM (SELECT event_id, f0 AS f, least({COLS - 1}.0, c0 + (event_id % 7) / 8.0) AS x, least({ROWS - 1}.0, r0 + (event_id % 5) / 8.0) AS y FROM showers) p LEFT JOIN cells k ON k.f = p.f AND abs(x - c) < 1 AND abs(y - r) < 1 GROUP BY p.event_id", "cells"))
def bilinear_sample(spark, sf_dir):
    some = raster.showers(raster.table(spark, sf_dir, "events"))
    points = some.select("event_id", F.col("f0").alias("f"), (F.col("c0") + F.col("event_id") % 7 / 8).alias("x"), (F.col("r0") + F.col("event_id") % 5 / 8).alias("y"))
    return forecast.bilinear(points, trial.cells(spark, sf_dir), F.col("x"), F.col("y"), ["event_id"], name="v").withColumn("v", r6("v"))


def _scores(forecasts, truth, issues, scans, name, steps=2):
    """_pooled() of a sparse forecast (f, lead, r, c, p)."""
    wet = truth.select(F.col("f").alias("__valid"), "r", "c", "v").where("v >= 2")
    met = forecasts.where("p > 0").withColumn("__valid", F.col("f") + F.col("lead")).join(wet, ["__valid", "r", "c"], "left")
    by = met.withColumn("wet", F.round("p", 6) >= 2).groupBy("f", "lead").agg(F.sum("p").alias("sum_f"), F.count_if(F.col("wet") & F.col("v").isNotNull()).alias("hit"), F.count_if(F.col("wet") & F.col("v").isNull()).alias("fa"))
    return _pooled(by, truth.groupBy("f").agg(F.count_if(F.col("v") >= 2).alias("wet")), issues, scans, name, steps)


def _pooled(by, index, issues, scans, name, steps=2):
    """Counts of forecasts by issue and lead (f, lead, sum_f, hit, fa): (model, lead, cases, sum_f, hit, miss, fa). index: (f, wet), the frames with rain.

    A case is an issue whose last scans frames are there, and a lead whose frame lies in the archive: forecasts
    without a wet cell and frames without one count too.
    """
    there = index.select(F.col("f").alias("g"))
    history = issues.withColumn("g", F.explode(F.array(*(F.col("f") - k for k in range(scans))))).join(there, "g").groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") == scans)
    end = index.agg(F.max("f").alias("end"))
    cases = forecast.leads(history.select("f"), steps).withColumn("__valid", F.col("f") + F.col("lead")).join(F.broadcast(end)).where("__valid <= end").drop("end")  # one row
    all_ = cases.join(by, ["f", "lead"], "left").join(index.withColumnRenamed("f", "__valid"), "__valid", "left").na.fill(0, ["sum_f", "hit", "fa", "wet"])
    return all_.groupBy(F.lit(name).alias("model"), "lead").agg(F.count("*").alias("cases"), F.round(F.sum("sum_f"), 4).alias("sum_f"), F.sum("hit").alias("hit"), F.sum(F.col("wet") - F.col("hit")).alias("miss"), F.sum("fa").alias("fa"))


def _wet(frames):
    """(f, wet): wet cells of packed frames."""
    return frames.select("f", F.size(F.filter("v", lambda x: x >= 2)).cast("long").alias("wet"))


def _issues(spark, sf_dir):
    """The issue frames as a table: episodes are found once, however often a model's plan asks for them."""
    return stored(spark)(trial.issues(spark, sf_dir).select("f").distinct())


def _vector_model(spark, sf_dir, name, steps=2):
    scans, sub, shrunk, factor, outside = motion.VECTOR_MODELS[name]
    issues, frames = _issues(spark, sf_dir), _frames(spark, sf_dir)
    vectors = motion.pair_vectors(_blocks(spark, sf_dir, frames, subcell=sub, smoothed=shrunk), shrunk)
    mean = motion.window_mean(vectors, scans).where(F.col("have") == scans - 1)
    when = issues.join(mean, "f").select("f", (F.col("dx") * factor).alias("dx"), (F.col("dy") * factor).alias("dy"))
    return _pooled(motion.vector_counts(when, frames, steps, zero_outside=outside), _wet(frames), issues, scans, name, steps)


def _score_sql(name: str) -> dict[str, str]:
    """Counts of made (f, lead, r, c, p > 0) over the cases (f, lead)."""
    return {
        "inside": "SELECT f, lead FROM cases WHERE f + lead <= (SELECT max(f) FROM cells)",
        "hits": "SELECT made.f, lead, sum(p) AS sum_f, count(*) FILTER (WHERE round(p, 6) >= 2 AND s.v >= 2) AS hit, count(*) FILTER (WHERE round(p, 6) >= 2 AND (s.v IS NULL OR s.v < 2)) AS fa FROM made LEFT JOIN cells s ON s.f = made.f + lead AND s.r = made.r AND s.c = made.c GROUP BY ALL",
        "wets": "SELECT f, count(*) AS wet FROM cells WHERE v >= 2 GROUP BY f",
        "result": f"SELECT '{name}' AS model, lead, count(*) AS cases, round(CAST(sum(coalesce(sum_f, 0)) AS DOUBLE), 4) AS sum_f, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS hit, CAST(sum(coalesce(wet, 0) - coalesce(hit, 0)) AS BIGINT) AS miss, CAST(sum(coalesce(fa, 0)) AS BIGINT) AS fa FROM inside LEFT JOIN hits USING (f, lead) LEFT JOIN wets ON wets.f = inside.f + lead GROUP BY lead",
    }


#: Bilinear corners of (x, y) in points (f, lead, r, c, x, y), clamped to the map.
_CORNER = f"SELECT f, lead, r, c, least({ROWS - 1}, CAST(floor(y) AS BIGINT) + i) AS yr, least({COLS - 1}, CAST(floor(x) AS BIGINT) + j) AS xc, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM placed, range(2) p(i), range(2) q(j)"


def _walk_sql(name, vectors, factor=1.0, outside=False):
    """A constant vector's forecast: bilinear values at (c - s dx, r - s dy)."""
    inside = f"AND c - sx BETWEEN 0 AND {COLS - 1} AND r - sy BETWEEN 0 AND {ROWS - 1}" if outside else ""
    return {
        "cases": f"SELECT DISTINCT i.f, lead, lead * dx * {factor} AS sx, lead * dy * {factor} AS sy FROM issues i JOIN ({vectors}) v ON v.f = i.f, range(1, 3) l(lead)",
        "placed": f"SELECT f, lead, r, c, greatest(0.0, least({COLS - 1}.0, c - sx)) AS x, greatest(0.0, least({ROWS - 1}.0, r - sy)) AS y FROM cases, range({ROWS}) a(r), range({COLS}) b(c) WHERE true {inside}",
        "corner": _CORNER,
        "made": "SELECT k.f, lead, k.r, k.c, sum(w * v) AS p FROM corner k JOIN cells s ON s.f = k.f AND s.r = yr AND s.c = xc GROUP BY ALL HAVING sum(w * v) > 0",
    } | _score_sql(name)


def _trace_sql(name, steps=2, smooth_edges=False):
    """Backward tracing along the blocks of filled; positions are single precision between steps."""
    out = {"field": "SELECT f, br, bc, CASE WHEN conf > 0 THEN dx * least(1.0, conf / 0.3) ELSE 0 END AS vx, CASE WHEN conf > 0 THEN dy * least(1.0, conf / 0.3) ELSE 0 END AS vy FROM filled WHERE f IN (SELECT f FROM issues)",
           "cases": f"SELECT DISTINCT f, lead FROM field, range(1, {steps + 1}) l(lead)",
           "at0": f"SELECT f, r, c, CAST(c AS REAL) AS x, CAST(r AS REAL) AS y FROM (SELECT DISTINCT f FROM field), range({ROWS}) a(r), range({COLS}) b(c)"}
    last_r, last_c = ROWS // BLOCK - 1, COLS // BLOCK - 1
    for s in range(1, steps + 1):
        x, y = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)"
        if smooth_edges:
            out[f"mid{s}"] = f"SELECT f, r, c, x, y, greatest(0.0, least({last_c}.0, {x} / {BLOCK}.0::DOUBLE - 0.5)) AS u, greatest(0.0, least({last_r}.0, {y} / {BLOCK}.0::DOUBLE - 0.5)) AS w FROM at{s - 1}"
            out[f"came{s}"] = f"SELECT m.f, m.r, m.c, any_value({x}) - sum(vx * k) AS x, any_value({y}) - sum(vy * k) AS y FROM (SELECT *, least({last_r}, CAST(floor(w) AS BIGINT) + i) AS br, least({last_c}, CAST(floor(u) AS BIGINT) + j) AS bc, (CASE WHEN i = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS k FROM mid{s}, range(2) p(i), range(2) q(j)) m JOIN field USING (f, br, bc) GROUP BY m.f, m.r, m.c"
        else:
            out[f"came{s}"] = f"SELECT a.f, r, c, {x} - vx AS x, {y} - vy AS y FROM at{s - 1} a JOIN field b ON a.f = b.f AND b.br = CAST(greatest(0, least({ROWS - 1}, floor({y} + 0.5))) AS BIGINT) // {BLOCK} AND b.bc = CAST(greatest(0, least({COLS - 1}, floor({x} + 0.5))) AS BIGINT) // {BLOCK}"
        out[f"at{s}"] = f"SELECT f, r, c, CAST(x AS REAL) AS x, CAST(y AS REAL) AS y FROM came{s}"
    out["placed"] = " UNION ALL ".join(f"SELECT f, {s} AS lead, r, c, greatest(0.0, least({COLS - 1}.0, x)) AS x, greatest(0.0, least({ROWS - 1}.0, y)) AS y FROM came{s}" for s in range(1, steps + 1))
    out["corner"] = _CORNER
    out["made"] = "SELECT f, lead, r, c, p FROM (SELECT k.f, lead, k.r, k.c, CAST(CAST(sum(w * v) AS REAL) AS DOUBLE) AS p FROM corner k JOIN cells s ON s.f = k.f AND s.r = yr AND s.c = xc GROUP BY ALL) WHERE p > 0"
    return out | _score_sql(name)


def _mean_sql(scans, table="vec"):
    return f"SELECT f, coalesce(avg(dx), 0) AS dx, coalesce(avg(dy), 0) AS dy FROM (SELECT a.f, b.dx, b.dy FROM {table} a JOIN {table} b ON b.f BETWEEN a.f - {scans - 2} AND a.f) GROUP BY f HAVING count(*) = {scans - 1}"


@query(sql("SELECT * FROM result", "dense", "issues", **_walk_sql("persistence", "SELECT f, 0.0 AS dx, 0.0 AS dy FROM idx")))
def model_persistence(spark, sf_dir):
    issues, cells = _issues(spark, sf_dir), trial.cells(spark, sf_dir)
    when = issues.select("f", F.lit("persistence").alias("model"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return _scores(forecast.moved(when, cells, 2), cells, issues, 1, "persistence")


def _vector_sql(name):
    scans, sub, shrunk, factor, outside = motion.VECTOR_MODELS[name]
    if sub:
        vec = {"vec": _MATCH["vec"].replace("FROM raw", "FROM sub")}
        return sql("SELECT * FROM result", "dense", "issues", **_sub(sub), **vec, **_walk_sql(name, _mean_sql(scans), factor, outside))
    source = "shrunk" if shrunk else "vec"
    return sql("SELECT * FROM result", "dense", "issues", **_match(source), **_walk_sql(name, _mean_sql(scans, source), factor, outside))


def _half_life_sql(name):
    """A vector model of thirteen scans whose weights halve with the pairs' age."""
    weight = f"pow(0.5::DOUBLE, (a.f - b.f) / {HALF_LIVES[name]}::DOUBLE)"
    mean = ", ".join(f"coalesce(sum(b.{d} * {weight}) / nullif(sum(CASE WHEN b.{d} IS NOT NULL THEN {weight} END), 0), 0) AS {d}" for d in ("dx", "dy"))
    return sql("SELECT * FROM result", "dense", "issues", **_match("vec"), **_walk_sql(name, f"SELECT a.f, {mean} FROM vec a JOIN vec b ON b.f BETWEEN a.f - 11 AND a.f GROUP BY a.f"))


def _block_sql(name, as_name=None):
    """A block model: fields of the last pairs, averaged, smoothed, filled, then traced."""
    scans, sub, soft = motion.BLOCK_MODELS[name]
    raw, parts = ("sub", _sub(sub)) if sub else ("raw", _match("raw"))
    if scans > 2:
        parts, raw = parts | _mean_blocks(raw, scans), "mean"
    return sql("SELECT * FROM result", "dense", "issues", **parts, **_soft(raw), **_filled("soft"), **_trace_sql(as_name or name, smooth_edges=soft))


def _add_models():
    for name in ("gw2", "gw4", "gw4s110", "gw2z", "gw4sub", "gw4suba", "gw4f", "global", "global4"):

        def run(spark, sf_dir, name=name):
            return _vector_model(spark, sf_dir, name)

        run.__name__ = f"model_{name}"
        query(_vector_sql(name))(run)
    for name in ("block", "bw4", "block-smooth", "block-sub-all"):

        def run(spark, sf_dir, name=name):
            issues, frames = _issues(spark, sf_dir), _frames(spark, sf_dir)
            return _pooled(motion.block_counts(frames, issues, name, 2, radius=RADIUS), _wet(frames), issues, motion.BLOCK_MODELS[name][0], name)

        run.__name__ = f"model_{name.replace('-', '_')}"
        query(_block_sql(name))(run)


_add_models()


@query(sql("SELECT count(*) AS pairs, " + ", ".join(f"round(quantile_cont(s, {q}), 6) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + ", " + ", ".join(f"count(*) FILTER (WHERE k = {k}) AS s{k}" for k in range(8)) + " FROM (SELECT sqrt(dx * dx + dy * dy) AS s, (CAST(floor((degrees(atan2(dx, -dy)) + 360 + 22.5) / 45) AS BIGINT)) % 8 AS k FROM vec WHERE dx IS NOT NULL AND dx * dx + dy * dy > 0)", "dense", **_match("vec")))
def motion_stats(spark, sf_dir):
    """Speeds in cells a frame and the sectors that the rain moves to."""
    vectors = motion.pair_vectors(_blocks(spark, sf_dir)).where("dx IS NOT NULL AND dx * dx + dy * dy > 0")
    speed = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    sector = (F.floor((F.degrees(F.atan2("dx", -F.col("dy"))) + 360 + 22.5) / 45) % 8)
    each = vectors.select(speed.alias("s"), sector.alias("k"))
    return each.agg(F.count("*").alias("pairs"), *(r6(F.percentile("s", F.lit(q))).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)), *(F.count_if(F.col("k") == k).alias(f"s{k}") for k in range(8)))


@query(sql("SELECT count(*) AS n, round(quantile_cont(sqrt((b.dx - a.dx) * (b.dx - a.dx) + (b.dy - a.dy) * (b.dy - a.dy)), 0.5), 6) AS change, round(avg(CASE WHEN abs(degrees(atan2(a.dx * b.dy - a.dy * b.dx, a.dx * b.dx + a.dy * b.dy))) <= 30 THEN 1.0 ELSE 0.0 END), 6) AS within_30 FROM vec a JOIN vec b ON b.f = a.f + 3 WHERE a.dx IS NOT NULL AND b.dx IS NOT NULL AND a.dx * a.dx + a.dy * a.dy > 0 AND b.dx * b.dx + b.dy * b.dy > 0", "dense", **_match("vec")))
def wind_compare(spark, sf_dir):
    """Two vector series at a lag: change, and the share that turned by no more than 30 degrees."""
    v = motion.pair_vectors(_blocks(spark, sf_dir)).where("dx * dx + dy * dy > 0")
    both = v.select("f", F.col("dx").alias("ax"), F.col("dy").alias("ay")).join(v.select((F.col("f") - 3).alias("f"), F.col("dx").alias("bx"), F.col("dy").alias("by")), "f")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    turn = F.abs(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))
    return both.agg(F.count("*").alias("n"), r6(F.percentile(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.5))).alias("change"), r6(F.avg((turn <= 30).cast("double"))).alias("within_30"))


@query(sql("SELECT f, br, bc, CAST(dx2 - dx1 - (dy2 - dy1) AS DOUBLE) AS curl FROM (SELECT f, br, bc, lead(dy, 1, dy) OVER c AS dx2, lag(dy, 1, dy) OVER c AS dx1, lead(dx, 1, dx) OVER r AS dy2, lag(dx, 1, dx) OVER r AS dy1 FROM raw WINDOW c AS (PARTITION BY f, br ORDER BY bc), r AS (PARTITION BY f, bc ORDER BY br))", "dense", **_match("raw")))
def vorticity(spark, sf_dir):
    """Differences of the vectors across each block, one-sided at the edges."""
    from pyspark.sql.window import Window

    across, down = Window.partitionBy("f", "br").orderBy("bc"), Window.partitionBy("f", "bc").orderBy("br")
    raw = _blocks(spark, sf_dir).repartition("f")
    step = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    return raw.select("f", "br", "bc", r6(step("dy", across) - step("dx", down)).alias("curl"))


@query(sql("SELECT bin, count(*) AS n, round(avg(d), 6) AS d FROM (SELECT CAST(floor(sqrt(CAST((a.br - b.br) * (a.br - b.br) + (a.bc - b.bc) * (a.bc - b.bc) AS DOUBLE))) AS BIGINT) AS bin, (a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) AS d FROM raw a JOIN raw b ON a.f = b.f AND (a.br * 6 + a.bc) < (b.br * 6 + b.bc) WHERE a.conf > 0 AND b.conf > 0) GROUP BY bin", "dense", **_match("raw")))
def structure_function(spark, sf_dir):
    """Mean squared difference of two blocks' vectors by their distance in blocks."""
    known = _blocks(spark, sf_dir).where("conf > 0")
    cols = -(-TRIAL.cols // BLOCK)
    frames = known.groupBy("f").agg(F.array_sort(F.collect_list(F.struct((F.col("br") * cols + F.col("bc")).cast("int").alias("at"), "dx", "dy"))).alias("x")).select(F.col("x.at").alias("at"), F.col("x.dx").alias("u"), F.col("x.dy").alias("v"))
    return structure.by_distance(structure.offset_sums(frames, -(-TRIAL.rows // BLOCK), cols)).withColumn("d", r6("d"))
