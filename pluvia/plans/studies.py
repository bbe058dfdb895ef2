"""Queries of the comparison studies: intervals of every metric, grids, cities, windows, chances, winds, gauges, known shifts; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.functions import named, text
from pluvia.operators import ensembles, motion, pool, score
from pluvia.operators import geometry as G
from pluvia.plans import analyses, movement, trial
from pluvia.plans.analyses import _ST, stations
from pluvia.plans.movement import BLOCK, COLS, RADIUS, ROWS, _match, _sub
from pluvia.plans.trial import sql
from pluvia.plans.verification import DRAWS, _draws_sql
from pluvia.sources import raster
from pluvia.sources.raster import table
from pluvia.sources.shared import stored
from pluvia.spec import TRIAL, GridSpec

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


def _quartiles(column, names):
    return [r6(F.percentile(column, F.lit(q))).alias(n) for n, q in zip(names, (0.25, 0.5, 0.75), strict=True)]


def _quartiles_sql(column, names):
    return ", ".join(f"round(quantile_cont({column}, {q}), 6) AS {n}" for n, q in zip(names, (0.25, 0.5, 0.75), strict=True))


# --- intervals

SUMS = ("fss_e", "fss_r", "hit_1", "miss_1", "fa_1", "hit_2", "miss_2", "fa_2", "brier", "n")
#: Metric -> its value from sums; {0} is the suffix of the sums' names.
VALUES = {"fss": "1 - try_divide(fss_e{0}, fss_r{0})", "csi_1": "try_divide(hit_1{0}, hit_1{0} + miss_1{0} + fa_1{0})", "csi_2": "try_divide(hit_2{0}, hit_2{0} + miss_2{0} + fa_2{0})", "brier": "try_divide(brier{0}, n{0})"}


def _gains(suffix=""):
    """A struct array (metric, d): each metric's difference from the baseline."""
    return F.array(*(F.struct(F.lit(m).alias("metric"), (F.expr(v.format("")) - F.expr(v.format("0"))).alias("d")) for m, v in VALUES.items()))


def _value_sql(v, suffix):
    v = v.format(suffix)
    for m in ("fss_e", "hit_1", "hit_2", "brier"):
        if f"try_divide({m}" in v:
            top, below = v[v.index("try_divide(") + 11 : -1].split(", ", 1)
            return v[: v.index("try_divide(")] + f"CAST({top} AS DOUBLE) / nullif({below}, 0)"
    return v


_DIFFS = " UNION ALL ".join(f"SELECT model, lead, draw, '{m}' AS metric, {_value_sql(v, '')} - ({_value_sql(v, '0')}) AS d FROM sums" for m, v in VALUES.items())


@query(sql("SELECT model, lead, metric, round(max(d) FILTER (WHERE draw = -1), 6) AS delta, round(quantile_cont(d, 0.025) FILTER (WHERE draw >= 0), 6) AS low, round(quantile_cont(d, 0.975) FILTER (WHERE draw >= 0), 6) AS high FROM diffs GROUP BY model, lead, metric", "rows",
    unit_all="SELECT event AS unit, model, lead, " + ", ".join(f"sum({c}) AS {c}" for c in SUMS) + " FROM rows GROUP BY ALL",
    vs="SELECT a.*, " + ", ".join(f"b.{c} AS {c}0" for c in SUMS) + " FROM unit_all a JOIN unit_all b ON a.unit = b.unit AND a.lead = b.lead AND b.model = 'persistence' AND a.model <> 'persistence'",
    **{k: v for k, v in _draws_sql("vs", DRAWS, 4).items() if k != "each"},
    weights="SELECT draw, unit, w FROM drawn JOIN numbered USING (k) UNION ALL SELECT -1, unit, 1 FROM numbered",
    sums="SELECT model, lead, draw, " + ", ".join(f"sum(w * {c}{s}) AS {c}{s}" for s in ("", "0") for c in SUMS) + " FROM weights JOIN vs USING (unit) GROUP BY ALL",
    diffs=_DIFFS))
def summary_intervals(spark, sf_dir):
    """Every metric's difference from the baseline with its interval: 2,000 draws of episodes, the same for all metrics; draw -1 is the sample itself."""
    unit = trial.score_rows(spark, sf_dir).groupBy(F.col("event").alias("unit"), "model", "lead").agg(*(F.sum(c).alias(c) for c in SUMS))
    base = unit.where(F.col("model") == pool.BASELINE).select("unit", "lead", *(F.col(c).alias(f"{c}0") for c in SUMS))
    pairs = stored(spark)(unit.where(F.col("model") != pool.BASELINE).join(base, ["unit", "lead"]))
    weights = pool.draws(pairs, DRAWS, 4).unionByName(pairs.select("unit").distinct().select(F.lit(-1).alias("draw"), "unit", F.lit(1).cast("long").alias("w")))
    both = [f"{c}{s}" for s in ("", "0") for c in SUMS]
    sums = pairs.join(weights, "unit").groupBy("model", "lead", "draw").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in both))
    each = sums.select("model", "lead", "draw", F.explode(_gains()).alias("g")).select("model", "lead", "draw", "g.metric", "g.d")
    drawn = F.when(F.col("draw") >= 0, F.col("d"))
    return each.groupBy("model", "lead", "metric").agg(r6(F.max(F.when(F.col("draw") == -1, F.col("d")))).alias("delta"), r6(F.percentile(drawn, F.lit(0.025))).alias("low"), r6(F.percentile(drawn, F.lit(0.975))).alias("high"))


@query(sql("SELECT model, lead, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT model, lead, CAST(1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r) AS DOUBLE) AS fss, CAST(sum(hit_2) AS DOUBLE) / sum(hit_2 + miss_2 + fa_2) AS csi_2, CAST(sum(sum_f) AS DOUBLE) / sum(sum_t) AS rain_ratio, CAST(sum(brier) AS DOUBLE) / sum(n) AS brier FROM rows GROUP BY model, lead) ON fss, csi_2, rain_ratio, brier INTO NAME metric VALUE value)", "rows"))
def report_scalars(spark, sf_dir):
    """The report's scalars as rows: metrics are picked by name."""
    names = ("fss", "csi_2", "rain_ratio", "brier")
    wide = trial.score_rows(spark, sf_dir).groupBy("model", "lead").agg(*named.metrics(*names))
    return wide.unpivot(["model", "lead"], list(names), "metric", "value").withColumn("value", r6("value"))


@query(sql("SELECT a.stride, a.lead, round(b.s - a.s, 6) AS gain, a.n FROM cadence a JOIN cadence b USING (stride, lead) WHERE a.model = 'persistence' AND b.model = 'shift'", "rows",
    cadence="SELECT stride, lead, model, count(*) AS n, 1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r) AS s FROM rows, (VALUES (1), (2), (3)) t(stride) WHERE f % stride = 0 GROUP BY ALL"))
def cadence_gains(spark, sf_dir):
    """The gain over persistence when only every second or third frame is issued on."""
    rows = trial.score_rows(spark, sf_dir).withColumn("stride", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("f % stride = 0")
    each = rows.groupBy("stride", "lead").pivot("model", ["persistence", "shift"]).agg(F.count("n").alias("n"), score.fss().alias("s"))
    return each.select("stride", "lead", r6(F.col("shift_s") - F.col("persistence_s")).alias("gain"), F.col("persistence_n").alias("n"))


_COARSE = {
    "obs2": "SELECT f, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM obs GROUP BY ALL",
    "met2": "SELECT event, a.f, model, lead, o.r, o.c, greatest(0, o.c - lead * dx // 2) AS pc, v AS t FROM asked a JOIN obs2 o ON o.f = a.g",
    "wet2": "SELECT event, m.f, model, lead, m.r, m.c, CASE WHEN t IS NOT NULL AND coalesce(v, 0) >= 2 THEN 1 ELSE 0 END AS wp, CASE WHEN t >= 2 THEN 1 ELSE 0 END AS wt FROM met2 m JOIN obs2 o ON o.f = m.f AND o.r = m.r AND o.c = m.pc",
    "rowbox2": "SELECT *, sum(wp) OVER w AS xp, sum(wt) OVER w AS xt FROM wet2 WINDOW w AS (PARTITION BY event, f, model, lead, r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "box2": "SELECT *, CAST(sum(xp) OVER w AS BIGINT) AS np, CAST(sum(xt) OVER w AS BIGINT) AS nt FROM rowbox2 WINDOW w AS (PARTITION BY event, f, model, lead, c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "units2": "SELECT event AS unit, model, lead, CAST(sum((np - nt) * (np - nt)) AS BIGINT) AS e, CAST(sum(np * np + nt * nt) AS BIGINT) AS r FROM box2 GROUP BY ALL",
    "both2": "SELECT a.unit, a.lead, a.e, a.r, b.e AS e0, b.r AS r0, c.e AS ce, c.r AS cr, d.e AS ce0, d.r AS cr0 FROM units a JOIN units b ON a.unit = b.unit AND a.lead = b.lead JOIN units2 c ON a.unit = c.unit AND a.lead = c.lead JOIN units2 d ON a.unit = d.unit AND a.lead = d.lead WHERE a.model = 'shift' AND b.model = 'persistence' AND c.model = 'shift' AND d.model = 'persistence'",
}
COARSE = GridSpec(ROWS // 2, COLS // 2)


@query(sql("SELECT lead, round(max(fine) FILTER (WHERE draw = -1), 6) AS fine, round(max(coarse) FILTER (WHERE draw = -1), 6) AS coarse, round(quantile_cont(fine - coarse, 0.025) FILTER (WHERE draw >= 0), 6) AS low, round(quantile_cont(fine - coarse, 0.975) FILTER (WHERE draw >= 0), 6) AS high FROM gains GROUP BY lead", "obs", "asked", "units", **_COARSE,
    **{k: v for k, v in _draws_sql("both2", DRAWS, 5).items() if k != "each"}, weights="SELECT draw, unit, w FROM drawn JOIN numbered USING (k) UNION ALL SELECT -1, unit, 1 FROM numbered",
    gains="SELECT lead, draw, CAST(sum(w * e0) AS DOUBLE) / sum(w * r0) - CAST(sum(w * e) AS DOUBLE) / sum(w * r) AS fine, CAST(sum(w * ce0) AS DOUBLE) / sum(w * cr0) - CAST(sum(w * ce) AS DOUBLE) / sum(w * cr) AS coarse FROM weights JOIN both2 USING (unit) GROUP BY lead, draw"))
def grid_gain_difference(spark, sf_dir):
    """Gains on the trial grid and on one of half its resolution, and the interval of their difference from the same draws."""
    fine = pool.against(pool.unit_sums(trial.score_rows(spark, sf_dir))).drop("model")
    rows = score.shift_rows(trial.issues(spark, sf_dir), raster.coarsened(trial.packed(spark, sf_dir), 2), {"persistence": (0, 0), "shift": (1, 0)}, trial.LEADS, 2, COARSE)
    coarse = pool.against(pool.unit_sums(rows)).select("unit", "lead", *(F.col(c).alias(f"c{c}") for c in ("e", "r", "e0", "r0")))
    both = stored(spark)(fine.join(coarse, ["unit", "lead"]))
    weights = pool.draws(both, DRAWS, 5).unionByName(both.select("unit").distinct().select(F.lit(-1).alias("draw"), "unit", F.lit(1).cast("long").alias("w")))
    ratio = lambda e, r: F.sum(F.col("w") * F.col(e)).cast("double") / F.sum(F.col("w") * F.col(r))
    gains = both.join(weights, "unit").groupBy("lead", "draw").agg((ratio("e0", "r0") - ratio("e", "r")).alias("fine"), (ratio("ce0", "cr0") - ratio("ce", "cr")).alias("coarse"))
    whole, d = F.col("draw") == -1, F.when(F.col("draw") >= 0, F.col("fine") - F.col("coarse"))
    return gains.groupBy("lead").agg(r6(F.max(F.when(whole, F.col("fine")))).alias("fine"), r6(F.max(F.when(whole, F.col("coarse")))).alias("coarse"), r6(F.percentile(d, F.lit(0.025))).alias("low"), r6(F.percentile(d, F.lit(0.975))).alias("high"))


_COUNTED = "SELECT event AS unit, model, city, count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS hit, count(*) FILTER (WHERE mm >= 3 OR obs >= 3) AS any_wet FROM hours GROUP BY ALL"


@query(sql("SELECT city, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM each GROUP BY city", "fc", **analyses._CITY, counted=_COUNTED,
    vs="SELECT a.unit, a.city, a.hit, a.any_wet, b.hit AS hit0, b.any_wet AS any0 FROM counted a JOIN counted b ON a.unit = b.unit AND a.city = b.city AND a.model = 'shift' AND b.model = 'persistence'",
    **{k: v for k, v in _draws_sql("vs", DRAWS, 6).items() if k != "each"},
    each="SELECT city, draw, CAST(sum(w * hit) AS DOUBLE) / nullif(sum(w * any_wet), 0) - CAST(sum(w * hit0) AS DOUBLE) / nullif(sum(w * any0), 0) AS d FROM drawn JOIN numbered USING (k) JOIN vs USING (unit) GROUP BY city, draw"))
def city_csi_ci(spark, sf_dir):
    """Interval of the difference in CSI for each city, from 2,000 draws of episodes; draws without an event of the city are left out."""
    p, t = F.col("mm") >= 3, F.col("obs") >= 3
    each = analyses._city_hours(spark, sf_dir).groupBy(F.col("event").alias("unit"), "model", "city").agg(F.count_if(p & t).alias("hit"), F.count_if(p | t).alias("any"))
    base = each.where("model = 'persistence'").select("unit", "city", F.col("hit").alias("hit0"), F.col("any").alias("any0"))
    pairs = stored(spark)(each.where("model = 'shift'").join(base, ["unit", "city"]))
    ratio = lambda a, b: F.try_divide(F.sum(F.col("w") * F.col(a)).cast("double"), F.sum(F.col("w") * F.col(b)).cast("double"))
    drawn = pairs.join(pool.draws(pairs, DRAWS, 6), "unit").groupBy("city", "draw").agg((ratio("hit", "any") - ratio("hit0", "any0")).alias("d"))
    return drawn.groupBy("city").agg(r6(F.percentile("d", F.lit(0.025))).alias("low"), r6(F.percentile("d", F.lit(0.975))).alias("high"))


def _near_sql(h):
    return {
        f"na{h}": f"SELECT *, sum(wp) OVER w AS a, sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER w AS b FROM wetfc WHERE model = 'shift' WINDOW w AS (PARTITION BY event, f, lead, r ORDER BY c RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)",
        f"nb{h}": f"SELECT event, lead, {h} AS half, sum((pn - wt) * (pn - wt)) AS b, count(*) AS n FROM (SELECT *, CAST(sum(a) OVER w AS DOUBLE) / sum(b) OVER w AS pn FROM na{h} WINDOW w AS (PARTITION BY event, f, lead, c ORDER BY r RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)) WHERE t IS NOT NULL GROUP BY event, lead",
    }


@query(sql("SELECT lead, half, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM each GROUP BY lead, half", "wetfc", **_near_sql(1), **_near_sql(2), **_near_sql(4),
    vs="SELECT x.event AS unit, x.lead, x.half, x.b, x.n, y.b AS b0, y.n AS n0 FROM (SELECT * FROM nb2 UNION ALL SELECT * FROM nb4) x JOIN nb1 y ON x.event = y.event AND x.lead = y.lead",
    **{k: v for k, v in _draws_sql("vs", DRAWS, 7).items() if k != "each"},
    each="SELECT lead, half, draw, sum(w * b0) / sum(w * n0) - sum(w * b) / sum(w * n) AS d FROM drawn JOIN numbered USING (k) JOIN vs USING (unit) GROUP BY lead, half, draw"))
def brier_windows_ci(spark, sf_dir):
    """How much wider windows improve the neighbourhood Brier score over the narrowest: intervals of all from one table of draws."""
    pairs = trial.pairs(spark, sf_dir).where("model = 'shift'")
    miss = (F.col("pn") - (F.col("t") >= 2).cast("double")) ** 2
    each = [score.neighbourhood(pairs, h).where("t IS NOT NULL").groupBy(F.col("event").alias("unit"), "lead").agg(F.sum(miss).alias("b"), F.count("*").alias("n")).withColumn("half", F.lit(h)) for h in (1, 2, 4)]
    base = each[0].select("unit", "lead", F.col("b").alias("b0"), F.col("n").alias("n0"))
    both = stored(spark)(each[1].unionByName(each[2]).join(base, ["unit", "lead"]))
    mean = lambda b, n: F.sum(F.col("w") * F.col(b)) / F.sum(F.col("w") * F.col(n))
    drawn = both.join(pool.draws(both, DRAWS, 7), "unit").groupBy("lead", "half", "draw").agg((mean("b0", "n0") - mean("b", "n")).alias("d"))
    return drawn.groupBy("lead", "half").agg(r6(F.percentile("d", F.lit(0.025))).alias("low"), r6(F.percentile("d", F.lit(0.975))).alias("high"))


#: Kernels of the local chances by number, a round one and a stretched one: sigma, stretch, angle.
COMBOS = {1: (1.0, 1.0, 0.0), 2: (0.8, 2.0, 0.5)}


@query()
def local_chances(spark, sf_dir):
    """Chances from the last frame by threshold, kernel (round and stretched) and lead: cells, events and Brier sums. A test holds it against numpy."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    last = stored(spark)(seen.join(trial.issues(spark, sf_dir).select("f").distinct(), "f", "left_semi"))
    made = None
    for thr in (1, 2, 4):
        for name, (sigma, ratio, angle) in COMBOS.items():
            one = ensembles.gauss_window(last, F.col("v") >= thr, sigma, ratio=ratio, angle=angle).withColumns({"thr": F.lit(thr), "combo": F.lit(name)})
            made = one if made is None else made.unionByName(one)
    ahead = made.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(trial.LEADS)))).withColumn("g", F.col("f") + F.col("lead"))
    met = ahead.join(seen.where("v IS NOT NULL").select(F.col("f").alias("g"), "r", "c", "v"), ["g", "r", "c"])
    was = (F.col("v") >= F.col("thr")).cast("int")
    return met.groupBy("thr", "combo", "lead").agg(F.count("*").alias("n"), F.sum(was).cast("long").alias("o"), F.round(F.sum((F.col("chance") - was) ** 2), 4).alias("brier"))


# --- motion against what is known

_WIND = {"wind": "SELECT f0 AS f, avg(vc) AS wx, avg(vr) AS wy FROM showers GROUP BY f0"}


def _wind(spark, sf_dir):
    """The mean motion that an hour's showers set out with: a wind that is not read off the rain."""
    return raster.showers(table(spark, sf_dir, "events")).groupBy(F.col("f0").alias("f")).agg(F.avg("vc").alias("wx"), F.avg("vr").alias("wy"))


_TURN = "degrees(atan2(wx * dy - wy * dx, wx * dx + wy * dy))"


@query(sql(f"SELECT count(*) AS n, {_quartiles_sql('ratio', ('ratio25', 'ratio50', 'ratio75'))}, {_quartiles_sql('turn', ('turn25', 'turn50', 'turn75'))}, round(quantile_cont(diff, 0.5), 6) AS diff50, round(avg(CASE WHEN abs(turn) <= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS within_30 FROM (SELECT sqrt(dx * dx + dy * dy) / sqrt(wx * wx + wy * wy) AS ratio, {_TURN} AS turn, sqrt(pow(dx - wx, 2) + pow(dy - wy, 2)) AS diff FROM vec JOIN wind USING (f) WHERE dx * dx + dy * dy > 0)", "showers", "dense", **_match("vec"), **_WIND))
def wind_rain(spark, sf_dir):
    """Rain motion against the wind: speed ratio, turn, difference, and the share within 30 degrees."""
    both = motion.pair_vectors(movement._blocks(spark, sf_dir)).where("dx * dx + dy * dy > 0").join(_wind(spark, sf_dir), "f")
    dx, dy, wx, wy = (F.col(c) for c in ("dx", "dy", "wx", "wy"))
    each = both.select((F.sqrt(dx * dx + dy * dy) / F.sqrt(wx * wx + wy * wy)).alias("ratio"), F.degrees(F.atan2(wx * dy - wy * dx, wx * dx + wy * dy)).alias("turn"), F.sqrt((dx - wx) ** 2 + (dy - wy) ** 2).alias("diff"))
    return each.agg(F.count("*").alias("n"), *_quartiles("ratio", ("ratio25", "ratio50", "ratio75")), *_quartiles("turn", ("turn25", "turn50", "turn75")), r6(F.percentile("diff", F.lit(0.5))).alias("diff50"), r6(F.avg((F.abs("turn") <= 30).cast("double"))).alias("within_30"))


_VARIANTS = {
    "raw": "SELECT 'raw' AS variant, f, dx, dy FROM vec",
    "smoothed": "SELECT 'smoothed', f, sum(dx * conf) / nullif(sum(conf), 0), sum(dy * conf) / nullif(sum(conf), 0) FROM soft GROUP BY f",
    "shrunk": "SELECT 'shrunk', f, dx, dy FROM shrunk",
    "subcell": "SELECT 'subcell', f, sum(dx * conf) / nullif(sum(conf), 0), sum(dy * conf) / nullif(sum(conf), 0) FROM sub GROUP BY f",
    "inner": f"SELECT 'inner', f, sum(dx * conf) / nullif(sum(conf), 0), sum(dy * conf) / nullif(sum(conf), 0) FROM raw WHERE br BETWEEN 1 AND {ROWS // BLOCK - 2} AND bc BETWEEN 1 AND {COLS // BLOCK - 2} GROUP BY f",
}


@query(sql("SELECT variant, count(*) AS n, round(avg(along), 6) AS mean, round(quantile_cont(along, 0.5), 6) AS median FROM (SELECT variant, (dx * wx + dy * wy) / (wx * wx + wy * wy) AS along FROM variants JOIN wind USING (f) WHERE dx IS NOT NULL) GROUP BY variant", "showers", "dense", **_match("shrunk"), **{k: v for k, v in _sub("moved").items() if k not in _match("best")}, **_WIND, variants=" UNION ALL ".join(_VARIANTS.values())))
def vector_variants(spark, sf_dir):
    """The speed study: how much of the wind each way to average blocks finds, along the wind."""
    raw = movement._blocks(spark, sf_dir)
    soft = movement._blocks(spark, sf_dir, smoothed=True)
    inner = F.col("br").between(1, ROWS // BLOCK - 2) & F.col("bc").between(1, COLS // BLOCK - 2)
    made = {"raw": motion.pair_vectors(raw), "smoothed": motion.pair_vectors(soft), "shrunk": motion.pair_vectors(soft, True), "subcell": motion.pair_vectors(movement._blocks(spark, sf_dir, subcell="moved")), "inner": motion.pair_vectors(raw.where(inner))}
    all_ = None
    for name, one in made.items():
        one = one.select(F.lit(name).alias("variant"), "f", "dx", "dy")
        all_ = one if all_ is None else all_.unionByName(one)
    along = (F.col("dx") * F.col("wx") + F.col("dy") * F.col("wy")) / (F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy"))
    return all_.where("dx IS NOT NULL").join(_wind(spark, sf_dir), "f").withColumn("along", along).groupBy("variant").agg(F.count("*").alias("n"), r6(F.avg("along")).alias("mean"), r6(F.percentile("along", F.lit(0.5))).alias("median"))


@query(sql(f"SELECT count(*) AS blocks, count(*) FILTER (WHERE dx = 2 AND dy = 1) AS exact FROM (SELECT f, br, bc, dx, dy FROM (SELECT *, max(CASE WHEN dy = 0 AND dx = 0 THEN ssd END) OVER (PARTITION BY f, br, bc) AS base, row_number() OVER (PARTITION BY f, br, bc ORDER BY ssd, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE 1 END, dy, dx) AS k FROM err2) JOIN wet2 USING (f, br, bc) WHERE k = 1 AND ssd < base AND s * 20 >= {BLOCK * BLOCK})", "dense",
    moved2="SELECT s.f, s.r, s.c, coalesce(k.v, 0) AS v FROM dense s LEFT JOIN cells k ON k.f = s.f AND k.r = s.r - 1 AND k.c = s.c - 2",
    look2=_match("look")["look"].replace("SELECT f + 1 AS f", "SELECT f"), err2=_match("err")["err"].replace("FROM look k JOIN dense b", "FROM look2 k JOIN moved2 b"), wet2=_match("wet")["wet"].replace("SELECT f + 1 AS f", "SELECT f")))
def known_shift(spark, sf_dir):
    """Frames against themselves moved by (2, 1): moving blocks, and those that find just that."""
    cells = trial.cells(spark, sf_dir)
    moved = cells.select("f", (F.col("r") + 1).alias("r"), (F.col("c") + 2).alias("c"), "v").where((F.col("r") < ROWS) & (F.col("c") < COLS))
    pairs = raster.frames(cells).select("f", F.col("at").alias("a_at"), F.col("v").alias("a_v")).join(raster.frames(moved).select("f", F.col("at").alias("b_at"), F.col("v").alias("b_v")), "f")
    blocks = motion.block_motion_rows(pairs, TRIAL, BLOCK, RADIUS, "").select(F.explode(F.arrays_zip("dx", "dy", "conf")).alias("b")).where("b.conf > 0")
    return blocks.agg(F.count("*").alias("blocks"), F.count_if((F.col("b.dx") == 2) & (F.col("b.dy") == 1)).alias("exact"))


@query(sql(f"SELECT f, round(sum(dx * conf * s) / sum(conf * s), 6) AS dx, round(sum(dy * conf * s) / sum(conf * s), 6) AS dy, count(*) AS blocks FROM raw JOIN wet USING (f, br, bc) WHERE conf > 0.35 AND s > 0.3 * {BLOCK * BLOCK} GROUP BY f", "dense", **_match("raw")))
def observed_motion(spark, sf_dir):
    """Mean motion of the blocks that are sure and wet, weighted by both."""
    rain = trial.cells(spark, sf_dir).groupBy((F.col("f") + 1).alias("f"), F.expr(f"r div {BLOCK}").cast("int").alias("br"), F.expr(f"c div {BLOCK}").cast("int").alias("bc")).agg(F.sum("v").alias("s"))
    sure = movement._blocks(spark, sf_dir).join(rain, ["f", "br", "bc"]).where((F.col("conf") > 0.35) & (F.col("s") > 0.3 * BLOCK * BLOCK))
    weight = F.col("conf") * F.col("s")
    return sure.groupBy("f").agg(*(r6(F.sum(F.col(d) * weight) / F.sum(weight)).alias(d) for d in ("dx", "dy")), F.count("*").alias("blocks"))


@query(sql("SELECT count(*) AS n, round(quantile_cont(m / s, 0.5), 6) AS ratio, round(quantile_cont(change, 0.5), 6) AS p50, round(quantile_cont(change, 0.9), 6) AS p90 FROM (SELECT sqrt(a.dx * a.dx + a.dy * a.dy) AS s, sqrt(b.dx * b.dx + b.dy * b.dy) AS m, sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2)) AS change FROM vec a JOIN vec_m b USING (f) WHERE a.dx * a.dx + a.dy * a.dy > 0 AND b.dx IS NOT NULL)", "dense", "core", **_match("vec"),
    masked=f"SELECT DISTINCT r // {BLOCK} AS br, c // {BLOCK} AS bc FROM ({analyses._MASK})",
    vec_m="SELECT f, CASE WHEN sum(conf) > 0 THEN sum(dx * conf) / sum(conf) END AS dx, CASE WHEN sum(conf) > 0 THEN sum(dy * conf) / sum(conf) END AS dy FROM raw LEFT JOIN masked m USING (br, bc) WHERE m.br IS NULL GROUP BY f"))
def mask_effect(spark, sf_dir):
    """Vectors with and without the blocks of the fixed echo mask: speed ratio, and how far vectors change."""
    raw = movement._blocks(spark, sf_dir)
    masked = G.dilate(analyses._core(spark, sf_dir), TRIAL).select(F.expr(f"cast(r div {BLOCK} as int)").alias("br"), F.expr(f"cast(c div {BLOCK} as int)").alias("bc")).distinct()
    a = motion.pair_vectors(raw).where("dx * dx + dy * dy > 0")
    b = motion.pair_vectors(raw.join(masked, ["br", "bc"], "left_anti")).where("dx IS NOT NULL").select("f", F.col("dx").alias("mx"), F.col("dy").alias("my"))
    each = a.join(b, "f").select((F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2) / F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("ratio"), F.sqrt((F.col("dx") - F.col("mx")) ** 2 + (F.col("dy") - F.col("my")) ** 2).alias("change"))
    return each.agg(F.count("*").alias("n"), r6(F.percentile("ratio", F.lit(0.5))).alias("ratio"), r6(F.percentile("change", F.lit(0.5))).alias("p50"), r6(F.percentile("change", F.lit(0.9))).alias("p90"))


@query(sql("SELECT f, lead, round(sum(p), 6) AS raw, round(sum(p * (1 - 0.7 * (lead - 1) / 2)), 6) AS value, round(any_value(1 - 0.7 * (lead - 1) / 2), 6) AS confidence FROM (SELECT DISTINCT f, lead, r, c, p FROM fc WHERE model = 'shift') GROUP BY f, lead", "fc"))
def display_bundle(spark, sf_dir):
    """What a viewer gets of a forecast: raw amounts, faded ones, and the confidence that fades them."""
    from pluvia.operators import forecast

    made = trial.pairs(spark, sf_dir).where("model = 'shift'").select("f", "lead", "r", "c", "p").distinct()
    weight = forecast.fade(F.col("lead"), trial.LEADS, 0.3)
    return made.groupBy("f", "lead").agg(r6(F.sum("p").cast("double")).alias("raw"), r6(F.sum(F.col("p") * weight)).alias("value"), r6(F.first(weight)).alias("confidence"))


@query(sql("SELECT f, round(sum(p), 4) AS total, count(*) FILTER (WHERE round(p, 6) >= 2) AS wet FROM made GROUP BY f", "dense", **_match("raw"),
    placed=f"SELECT k.f, 1 AS lead, r, c, greatest(0.0, least({COLS - 1}.0, c - dx * conf)) AS x, greatest(0.0, least({ROWS - 1}.0, r - dy * conf)) AS y FROM raw k, range({ROWS}) a(r), range({COLS}) b(c) WHERE br = r // {BLOCK} AND bc = c // {BLOCK}",
    corner=movement._CORNER, made="SELECT k.f, k.r, k.c, sum(w * v) AS p FROM corner k JOIN cells s ON s.f = k.f AND s.r = yr AND s.c = xc GROUP BY ALL"))
def extrapolate_step(spark, sf_dir):
    """One step ahead of each frame: every cell looks back along its block's motion, as far as the block is sure."""
    cells = trial.cells(spark, sf_dir)
    blocks = movement._blocks(spark, sf_dir).select("f", "br", "bc", (F.col("dx") * F.col("conf")).alias("sx"), (F.col("dy") * F.col("conf")).alias("sy"))
    inside = F.sequence(F.lit(0), F.lit(BLOCK - 1))
    places = blocks.withColumn("i", F.explode(inside)).withColumn("j", F.explode(inside)).select("f", (F.col("br") * BLOCK + F.col("i")).alias("r"), (F.col("bc") * BLOCK + F.col("j")).alias("c"), "sx", "sy").where((F.col("r") < ROWS) & (F.col("c") < COLS))
    from pluvia.operators import forecast

    made = forecast.bilinear(places, cells, F.col("c") - F.col("sx"), F.col("r") - F.col("sy"), ["f", "r", "c"]).where("p > 0")
    return made.groupBy("f").agg(F.round(F.sum("p"), 4).alias("total"), F.count_if(F.round("p", 6) >= 2).alias("wet"))


# --- gauges and stations


@query(sql(f"SELECT id, count(*) AS hours, round(sum(m), 4) AS cell_sum, round(sum(m9), 4) AS box_sum FROM (SELECT id, CAST(trunc((58.5 - lat) / (58.5::DOUBLE - 53.9::DOUBLE) * {ROWS}) AS INTEGER) AS r, CAST(trunc((lon - 5.0) / (16.5::DOUBLE - 5.0::DOUBLE) * {COLS}) AS INTEGER) AS c FROM st) p JOIN six USING (r, c) GROUP BY id", "obs", **_ST,
    xs3="SELECT f, r, c, v, sum(coalesce(v, 0)) OVER w AS a, sum(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER w AS b FROM obs WINDOW w AS (PARTITION BY f, r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    ys3="SELECT f, r, c, v, sum(a) OVER w AS s, sum(b) OVER w AS n FROM xs3 WINDOW w AS (PARTITION BY f, c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    six="SELECT r, c, m, m9 FROM (SELECT r, c, avg(v) OVER w AS m, count(v) OVER w AS k, avg(s / 9.0::DOUBLE) OVER w AS m9, sum(CASE WHEN n = 9 THEN 1 ELSE 0 END) OVER w AS k9 FROM ys3 WINDOW w AS (PARTITION BY r, c ORDER BY f RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE k = 6 AND k9 = 6"))
def radar_at_gauges(spark, sf_dir):
    """Radar hours at the stations: means of the six scans that end at a stamp, of the cell and of the 3 x 3 cells around it, where all are covered."""
    r, c = G.cell_of(TRIAL, F.col("lat"), F.col("lon"))
    points = stations(spark, sf_dir).select("id", r.alias("r"), c.alias("c"))
    seen = raster.observed(trial.cells(spark, sf_dir)).repartition("f")
    boxes = score.box_sums(seen, {"s": F.coalesce("v", F.lit(0)), "n": F.col("v").isNotNull().cast("int")}, 1, ("f",))
    six = Window.partitionBy("r", "c").orderBy("f").rangeBetween(-5, 0)
    hours = boxes.select("r", "c", F.avg("v").over(six).alias("m"), F.count("v").over(six).alias("k"), F.avg(F.col("s") / 9).over(six).alias("m9"), F.sum((F.col("n") == 9).cast("int")).over(six).alias("k9")).where("k = 6 AND k9 = 6")
    sums = hours.groupBy("r", "c").agg(F.count("*").alias("hours"), F.sum("m").alias("a"), F.sum("m9").alias("b"))
    return points.join(sums, ["r", "c"]).select("id", "hours", F.round("a", 4).alias("cell_sum"), F.round("b", 4).alias("box_sum"))


_T = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"SELECT day, slot, max(event_id) AS event_id FROM (SELECT event_id, t // 86400 AS day, t % 86400 // 600 AS slot FROM (SELECT event_id, {_T} AS t FROM events) WHERE t // 60 % 10 = 0) GROUP BY day, slot")
def fine_archive(spark, sf_dir):
    """The fine archive's slots: scans of every tenth minute on 144 slots a day, the last one written stays."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    some = table(spark, sf_dir, "events").select("event_id", t.alias("t")).where("t div 60 % 10 = 0")
    return some.groupBy(F.expr("t div 86400").alias("day"), F.expr("t % 86400 div 600").alias("slot")).agg(F.max("event_id").alias("event_id"))


@query(f"SELECT id, hour, count(*) AS n, round(max(value), 2) AS value FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS id, {_T} // 60 AS m, {_T} // 3600 AS hour, value FROM events WHERE value IS NOT NULL) WHERE starts_with(id, '0000') AND m % 60 < 20 GROUP BY id, hour")
def gauge_fetch(spark, sf_dir):
    """Readings of the stations of one prefix, those of the first twenty minutes of an hour, by station and hour."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("id"), t.alias("t"), "value")
    return e.where(F.col("id").startswith("0000") & F.expr("t div 60 % 60 < 20")).groupBy("id", F.expr("t div 3600").alias("hour")).agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("value"))


@query(f"WITH e AS (SELECT user_id, event_type, value, {_T} // 86400 AS day FROM events), w AS (SELECT DISTINCT day FROM e WHERE event_type = 'error') SELECT user_id, day, speed, direction FROM (SELECT user_id, day, round(max(value) FILTER (WHERE event_type = 'click'), 2) AS speed, round(max(value) FILTER (WHERE event_type = 'view'), 2) AS direction FROM e WHERE day IN (SELECT day FROM w) GROUP BY ALL) WHERE speed IS NOT NULL AND direction IS NOT NULL")
def station_wind_pairs(spark, sf_dir):
    """Two parameters of a station as a pair, on the wanted days only; incomplete pairs are dropped."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("day"))
    wanted = e.where("event_type = 'error'").select("day").distinct()
    both = e.join(wanted, "day", "left_semi").groupBy("user_id", "day").pivot("event_type", ["click", "view"]).agg(F.round(F.max("value"), 2))
    return both.withColumnsRenamed({"click": "speed", "view": "direction"}).na.drop()


# --- functions


@query("SELECT event_id, CASE WHEN mm < 10 THEN printf('%.1f mm/h', mm) ELSE printf('%d mm/h', CAST(floor(mm + 0.5) AS BIGINT)) END AS amount, CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS lead, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][1 + CAST(floor((degrees(atan2(dx, -dy)) + 360 + 22.5) / 45) AS BIGINT) % 8] AS heading FROM (SELECT event_id, CAST(event_id % 200 AS DOUBLE) / 7 AS mm, event_id % 181 AS m, CAST(event_id % 7 - 3 AS DOUBLE) AS dx, CAST(event_id % 5 - 2 AS DOUBLE) + 0.25 AS dy FROM events)")
def formatted_points(spark, sf_dir):
    """Amounts, leads and headings as text."""
    k = F.col("event_id")
    amount, minutes = (k % 200).cast("double") / 7, k % 181
    return table(spark, sf_dir, "events").select("event_id", text.format_mm(amount).alias("amount"), text.format_lead(minutes).alias("lead"), text.compass((k % 7 - 3).cast("double"), (k % 5 - 2).cast("double") + 0.25).alias("heading"))


@query(sql(f"SELECT f, round(avg(v) FILTER (WHERE r * 2 < {ROWS}), 6) AS north, round(avg(v) FILTER (WHERE c * 2 >= {COLS}), 6) AS east, round(avg(v) FILTER (WHERE abs(2 * r - {ROWS} + 1) * 2 < {ROWS} AND abs(2 * c - {COLS} + 1) * 2 < {COLS}), 6) AS middle FROM obs GROUP BY f", "obs"))
def region_means(spark, sf_dir):
    """Means of regions that are picked by name."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    return seen.groupBy("f").agg(*(r6(F.avg(F.when(named.region(n, F.col("r"), F.col("c")), F.col("v")))).alias(n) for n in ("north", "east", "middle")))


@query("SELECT hour, count(*) AS stations, round(max(v) FILTER (WHERE user_id = first), 2) AS first_value FROM (SELECT hour, user_id, v, min(user_id) OVER (PARTITION BY hour) AS first FROM (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, user_id, max(value) AS v FROM events GROUP BY ALL)) GROUP BY hour")
def station_maps(spark, sf_dir):
    """An hour's readings as a map from station to value, and a lookup in it."""
    each = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "user_id").agg(F.max("value").alias("v"))
    maps = each.groupBy("hour").agg(F.map_from_entries(F.collect_list(F.struct("user_id", "v"))).alias("m"))
    return maps.select("hour", F.size("m").cast("long").alias("stations"), F.round(F.element_at("m", F.array_min(F.map_keys("m"))), 2).alias("first_value"))


@query("SELECT event_id, CAST(regexp_extract(name, '^scan[.]([a-z]+)[.]([0-9]{8})([0-9]{4})', 2) AS BIGINT) AS day, CAST(regexp_extract(name, '[.][0-9]{8}([0-9]{4})[.]', 1) AS BIGINT) AS time, regexp_extract(name, '^scan[.]([a-z]+)', 1) AS kind FROM (SELECT event_id, 'scan.' || event_type || '.' || strftime(ts, '%Y%m%d%H%M') || '.h5' AS name FROM events)")
def file_names(spark, sf_dir):
    """Kind, day and time of a scan from its file name."""
    name = F.concat(F.lit("scan."), "event_type", F.lit("."), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmm"), F.lit(".h5"))
    e = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return e.select("event_id", F.regexp_extract("name", r"^scan[.]([a-z]+)[.]([0-9]{8})([0-9]{4})", 2).cast("long").alias("day"), F.regexp_extract("name", r"[.][0-9]{8}([0-9]{4})[.]", 1).cast("long").alias("time"), F.regexp_extract("name", r"^scan[.]([a-z]+)", 1).alias("kind"))
