"""Queries that complete others: change of motion, choice of cases, turning, reliability of timing, fallbacks, chosen rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators import motion, pool, score
from pluvia.plans import movement, trial, verification
from pluvia.plans.trial import sql

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


_CHANGE = "SELECT step, a.dx AS x1, a.dy AS y1, b.dx AS x2, b.dy AS y2 FROM (VALUES (1), (3)) t(step), vec a JOIN vec b ON b.f = a.f + step WHERE a.dx IS NOT NULL AND b.dx IS NOT NULL"


@query(sql("SELECT step, count(*) AS n, " + ", ".join(f"round(quantile_cont(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), {q}), 6) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + f" FROM ({_CHANGE}) GROUP BY step", "dense", **movement._match("vec")))
def motion_change(spark, sf_dir):
    """How much the rain's motion changes in one frame and in three."""
    v = motion.pair_vectors(movement._blocks(spark, sf_dir)).where("dx IS NOT NULL").select("f", "dx", "dy")
    before = v.select(F.explode(F.array(F.lit(1), F.lit(3))).alias("step"), (F.col("f") + F.col("step")).alias("f"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    change = F.sqrt((F.col("dx") - F.col("ax")) ** 2 + (F.col("dy") - F.col("ay")) ** 2)
    return before.join(v, "f").groupBy("step").agg(F.count("*").alias("n"), *(r6(F.percentile(change, F.lit(q))).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)))


_CASES = verification.ORACLE["case_selection"]


@query(sql(f"SELECT week, f, round(wet, 6) AS wet, round(speed, 6) AS speed FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY wet * least(speed, 6.0) DESC, f) AS place FROM (SELECT c.f // 168 AS week, c.f, c.wet, sqrt(v.dx * v.dx + v.dy * v.dy) AS speed FROM cases c JOIN vec v ON v.f = c.f + 1 WHERE v.dx IS NOT NULL)) WHERE place = 1", "dense", "idx", **movement._match("vec"),
    cases="SELECT f, wet FROM (SELECT f, wet, row_number() OVER (PARTITION BY f // 168 ORDER BY wet DESC, f) AS rank FROM idx WHERE NOT missing AND wet IS NOT NULL AND f IN (SELECT f FROM idx a WHERE (SELECT count(*) FROM idx b WHERE b.f BETWEEN a.f - 1 AND a.f + 3 AND NOT b.missing) = 5)) WHERE rank <= 30"))
def case_choice(spark, sf_dir):
    """Each week's case: of its 30 wettest whole frames the one with the largest wet share times the speed that follows, of which six cells count at most."""
    around = Window.orderBy("f").rowsBetween(-1, 3)  # one row a frame
    whole = trial.index(spark, sf_dir).withColumn("have", F.sum((~F.col("missing")).cast("int")).over(around)).where("have = 5 AND wet IS NOT NULL AND NOT missing").withColumn("week", F.floor(F.col("f") / 168))
    wettest = whole.withColumn("rank", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("wet"), "f"))).where("rank <= 30")
    speed = motion.pair_vectors(movement._blocks(spark, sf_dir)).where("dx IS NOT NULL").select((F.col("f") - 1).alias("f"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("speed"))
    best = Window.partitionBy("week").orderBy(F.desc(F.col("wet") * F.least("speed", F.lit(6.0))), "f")
    return wettest.join(speed, "f").withColumn("place", F.row_number().over(best)).where("place = 1").select("week", "f", r6("wet").alias("wet"), r6("speed").alias("speed"))


@query(f"SELECT f, count(*) AS n, round(avg(abs(curl)), 6) AS turning FROM ({movement.ORACLE['vorticity']}) WHERE br >= 1 AND bc >= 1 GROUP BY f")
def turning(spark, sf_dir):
    """Mean absolute vorticity of the blocks behind the first row and column, for each frame."""
    return movement.vorticity(spark, sf_dir).where("br >= 1 AND bc >= 1").groupBy("f").agg(F.count("*").alias("n"), r6(F.avg(F.abs("curl"))).alias("turning"))


@query(sql("SELECT model, horizon, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n, CAST(sum(o) AS BIGINT) AS o, round(avg(p), 6) AS said FROM (SELECT event, f, model, r, c, horizon, max(pn) AS p, max(CASE WHEN t >= 2 THEN 1 ELSE 0 END) AS o FROM nb2, range(1, 4) h(horizon) WHERE lead <= horizon GROUP BY ALL HAVING count(t) = horizon) GROUP BY ALL", "wetfc", **verification._NB))
def timing_reliability(spark, sf_dir):
    """Chances of rain within a horizon, the highest of its steps, against what came, in 20 bins; cells with all truth frames."""
    chance = score.neighbourhood(trial.pairs(spark, sf_dir), 2).withColumn("horizon", F.explode(F.sequence(F.col("lead"), F.lit(trial.LEADS))))
    cells = chance.groupBy("event", "f", "model", "r", "c", "horizon").agg(F.max("pn").alias("p"), F.max((F.coalesce(F.col("t"), F.lit(0)) >= 2).cast("int")).alias("o"), F.count("t").alias("have")).where("have = horizon")
    return cells.groupBy("model", "horizon", F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("o").alias("o"), r6(F.avg("p")).alias("said"))


@query(sql("SELECT model, lead, count(*) AS cases, round(avg(CASE WHEN model = 'shift' AND h.f IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fallback FROM counts LEFT JOIN hist h USING (f) GROUP BY model, lead", "counts",
    hist="SELECT a.f FROM idx a JOIN idx b ON b.f BETWEEN a.f - 3 AND a.f AND NOT b.missing GROUP BY a.f HAVING count(*) = 4"))
def fallbacks(spark, sf_dir):
    """Share of cases in which a model that needs four frames would have to fall back on persistence."""
    back = Window.orderBy("f").rowsBetween(-3, 0)  # one row a frame
    whole = trial.index(spark, sf_dir).withColumn("have", F.sum((~F.col("missing")).cast("int")).over(back)).where("have = 4").select("f", F.lit(True).alias("whole"))
    rows = trial.score_rows(spark, sf_dir).join(whole, "f", "left").withColumn("fallback", (F.col("model") == "shift") & F.col("whole").isNull())
    return rows.groupBy("model", "lead").agg(F.count("*").alias("cases"), r6(pool.fallback_share()).alias("fallback"))


@query(sql("SELECT lead, count(*) AS n, round(1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r), 6) AS fss FROM rows WHERE model IN ('shift') AND lead IN (1, 3) AND corr IS NOT NULL GROUP BY lead", "rows"))
def chosen_rows(spark, sf_dir):
    """Pooled scores of a list of models and leads, of rows with a correlation only."""
    rows = pool.chosen(trial.score_rows(spark, sf_dir), models=["shift"], leads=[1, 3], present=["corr"])
    return rows.groupBy("lead").agg(F.count("*").alias("n"), r6(score.fss()).alias("fss"))
