"""Queries on frames, episodes, scores, pooling and bootstraps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators import episodes as E
from pluvia.operators import forecast, pool, score
from pluvia.plans import trial
from pluvia.plans.trial import LEADS, sql
from pluvia.sources import raster
from pluvia.sources.shared import stored
from pluvia.spec import TRIAL

QUERIES, ORACLE = {}, {}
DRAWS = 2000


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def r6(c):
    return F.round(c, 6)


@query(sql("""SELECT lead, count(DISTINCT f) AS n, CAST(sum((np - nt) * (np - nt)) AS BIGINT) AS err, CAST(sum(np * np + nt * nt) AS BIGINT) AS ref,
round(1 - CAST(sum((np - nt) * (np - nt)) AS DOUBLE) / sum(np * np + nt * nt), 6) AS fss,
count(*) FILTER (WHERE p >= 2 AND t >= 2) AS hit, count(*) FILTER (WHERE p < 2 AND t >= 2) AS miss, count(*) FILTER (WHERE p >= 2 AND t < 2) AS fa,
round(CAST(count(*) FILTER (WHERE p >= 2 AND t >= 2) AS DOUBLE) / count(*) FILTER (WHERE p >= 2 OR t >= 2), 6) AS csi
FROM (SELECT a.f, lead, a.r, a.c, a.v AS p, b.v AS t, a.n AS np, b.n AS nt FROM boxes a, range(1, 4) l(lead), boxes b WHERE b.f = a.f + lead AND b.r = a.r AND b.c = a.c) GROUP BY lead""",
    "dense",
    rowed="SELECT *, sum(CASE WHEN v >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY f, r ORDER BY c RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x FROM dense",
    boxes="SELECT f, r, c, v, CAST(sum(x) OVER (PARTITION BY f, c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS BIGINT) AS n FROM rowed"))
def fss_by_lead(spark, sf_dir):
    """Persistence on all frames with full coverage: frames are rows, and each meets the one that a lead later is true."""
    packed = raster.unpacked(raster.frames(trial.cells(spark, sf_dir)))
    rows = score.shift_rows(packed.select(F.lit(0).cast("long").alias("event"), "f"), packed, {"persistence": (0, 0)}, LEADS)
    sums = rows.groupBy("lead").agg(F.count("*").alias("n"), F.sum("fss_e").alias("err"), F.sum("fss_r").alias("ref"), *(F.sum(f"{k}_2").alias(k) for k in ("hit", "miss", "fa")))
    return sums.select("*", r6(1 - F.col("err") / F.col("ref")).alias("fss"), r6(F.col("hit") / (F.col("hit") + F.col("miss") + F.col("fa"))).alias("csi"))


@query(sql("SELECT f, covered, round(wet, 6) AS wet, missing FROM idx", "idx"))
def frame_index(spark, sf_dir):
    return trial.index(spark, sf_dir).withColumn("wet", r6("wet"))


@query(sql("SELECT * FROM fine", "fine"))
def episodes_fine(spark, sf_dir):
    return trial.fine_events(spark, sf_dir)


@query(sql("SELECT * FROM coarse", "coarse"))
def episodes_coarse(spark, sf_dir):
    return E.episodes(trial.index(spark, sf_dir), E.EpisodeSpec(0.05, 3, None, 1, 0.10))


@query(sql("SELECT * FROM issues", "issues"))
def issue_times(spark, sf_dir):
    return trial.issues(spark, sf_dir)


@query(sql("SELECT f FROM (SELECT f, sum(CASE WHEN missing THEN 0 ELSE 1 END) OVER (ORDER BY f ROWS 6 PRECEDING) AS n FROM idx) WHERE n = 7", "idx"))
def history_complete(spark, sf_dir):
    return E.complete_history(trial.index(spark, sf_dir), 7)


@query(sql("SELECT n.event, f FROM kept JOIN (SELECT event AS e, row_number() OVER (ORDER BY min(f), event) - 1 AS event FROM kept GROUP BY event) n ON n.e = kept.event", "issues", "idx",
    h7="SELECT f FROM (SELECT f, sum(CASE WHEN missing THEN 0 ELSE 1 END) OVER (ORDER BY f ROWS 6 PRECEDING) AS n FROM idx) WHERE n = 7",
    kept="SELECT DISTINCT event, f FROM issues WHERE f IN (SELECT f FROM h7)"))
def issues_reused(spark, sf_dir):
    index = trial.index(spark, sf_dir)
    return E.reused_issues(E.issue_times(index, E.episodes(index)), E.complete_history(index, 7))


@query(sql("SELECT event, CAST(spell AS BIGINT) AS spell FROM spell", "spell"))
def spells(spark, sf_dir):
    return E.spells(trial.fine_events(spark, sf_dir)).select("event", F.col("spell").cast("long"))


@query(sql("SELECT model, lead, CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"CAST(sum({k}_{x}) AS BIGINT) AS {k}_{x}" for x in (1, 2, 4) for k in ("hit", "miss", "fa")) + ", round(CAST(sum(hit_2) AS DOUBLE) / sum(hit_2 + miss_2 + fa_2), 6) AS csi FROM counts GROUP BY model, lead", "counts"))
def contingency_by_lead(spark, sf_dir):
    rows = trial.score_rows(spark, sf_dir)
    return rows.groupBy("model", "lead").agg(F.sum("n").alias("n"), *(F.sum(f"{k}_{x}").alias(f"{k}_{x}") for x in (1, 2, 4) for k in ("hit", "miss", "fa")), r6(score.csi(2)).alias("csi"))


@query(sql("SELECT model, lead, round(CAST(sum(sum_f) AS DOUBLE) / sum(sum_t), 6) AS ratio, round(CAST(sum(sse) AS DOUBLE) / sum(n), 6) AS mse FROM counts GROUP BY model, lead", "counts"))
def rain_ratio_by_lead(spark, sf_dir):
    rows = trial.score_rows(spark, sf_dir)
    return rows.groupBy("model", "lead").agg(r6(F.sum("sum_f") / F.sum("sum_t")).alias("ratio"), r6(F.sum("sse") / F.sum("n")).alias("mse"))


@query(sql("SELECT event, f, model, lead, round(corr, 6) AS corr FROM counts", "counts"))
def pearson_by_case(spark, sf_dir):
    return trial.score_rows(spark, sf_dir).select("event", "f", "model", "lead", r6("corr").alias("corr"))


@query(sql("SELECT model, lead, CAST(sum(brier) AS BIGINT) AS brier_sum, round(sum(brier) / sum(n), 6) AS brier FROM counts GROUP BY model, lead", "counts"))
def brier_by_lead(spark, sf_dir):
    rows = trial.score_rows(spark, sf_dir)
    return rows.groupBy("model", "lead").agg(F.sum("brier").cast("long").alias("brier_sum"), r6(F.sum("brier") / F.sum("n")).alias("brier"))


@query(sql("SELECT model, lead, CASE WHEN c < 16 THEN 'near' WHEN c < 32 THEN 'mid' ELSE 'far' END AS band, CAST(sum((np - nt) * (np - nt)) AS BIGINT) AS fss_e, CAST(sum(np * np + nt * nt) AS BIGINT) AS fss_r FROM box WHERE t IS NOT NULL GROUP BY ALL", "box"))
def fss_by_band(spark, sf_dir):
    band = F.when(F.col("c") < 16, "near").when(F.col("c") < 32, "mid").otherwise("far")
    each = score.fss_bands(trial.pairs(spark, sf_dir).withColumn("band", band), 4, score.KEYS)
    return each.groupBy("model", "lead", "band").agg(F.sum("fss_e").cast("long").alias("fss_e"), F.sum("fss_r").cast("long").alias("fss_r"))


_NB = {
    "nb1": "SELECT *, sum(wp) OVER w AS a, sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER w AS b FROM wetfc WINDOW w AS (PARTITION BY event, f, model, lead, r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "nb2": "SELECT *, CAST(sum(a) OVER w AS DOUBLE) / sum(b) OVER w AS pn FROM nb1 WINDOW w AS (PARTITION BY event, f, model, lead, c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
}


@query(sql("SELECT model, lead, count(*) AS n, round(sum((pn - wt) * (pn - wt)) / count(*), 6) AS brier FROM nb2 WHERE t IS NOT NULL GROUP BY model, lead", "wetfc", **_NB))
def neighbourhood_brier(spark, sf_dir):
    chance = score.neighbourhood(trial.pairs(spark, sf_dir), 2).where("t IS NOT NULL")
    miss = F.col("pn") - (F.col("t") >= 2).cast("double")
    return chance.groupBy("model", "lead").agg(F.count("*").alias("n"), r6(F.sum(miss * miss) / F.count("*")).alias("brier"))


@query(sql("SELECT model, lead, CAST(least(floor(pn * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(sum(pn), 4) AS p_sum, CAST(sum(wt) AS BIGINT) AS o_sum FROM nb2 WHERE t IS NOT NULL GROUP BY ALL", "wetfc", **_NB))
def reliability_bins(spark, sf_dir):
    chance = score.neighbourhood(trial.pairs(spark, sf_dir), 2).where("t IS NOT NULL")
    return score.reliability(chance, F.col("pn"), F.col("t") >= 2, ("model", "lead")).select("model", "lead", "bin", "n", F.round("p_sum", 4).alias("p_sum"), F.col("o_sum").cast("long"))


@query(sql("""SELECT model, lead, count(DISTINCT event) AS events, count(*) AS cases,
round(stddev_pop(CASE WHEN sum_f > 0 AND sum_t > 0 THEN ln(sum_f / CAST(sum_t AS DOUBLE)) END), 6) AS sd_log_ratio, round(avg(corr), 6) AS corr,
round(1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r), 6) AS fss, round(CAST(sum(sum_f) AS DOUBLE) / sum(sum_t), 6) AS rain_ratio, round(sum(brier) / sum(n), 6) AS brier,
""" + ", ".join(f"round(CAST(sum(hit_{x}) AS DOUBLE) / sum(hit_{x} + miss_{x} + fa_{x}), 6) AS csi_{x}" for x in (1, 2, 4)) + " FROM rows GROUP BY model, lead", "rows"))  # fmt: skip
def summary_full(spark, sf_dir):
    found = pool.summary(trial.score_rows(spark, sf_dir))
    return found.select(*(r6(c).alias(c) if k == "double" else c for c, k in found.dtypes))


@query(sql("SELECT unit, model, lead, CAST(e AS BIGINT) AS e, CAST(r AS BIGINT) AS r FROM units", "units"))
def unit_sums(spark, sf_dir):
    return pool.unit_sums(trial.score_rows(spark, sf_dir))


def _versus(spark, sf_dir):
    """A row for each episode, model and lead: stored, as draws and sums both read it and plan on from it."""
    return stored(spark)(pool.against(pool.unit_sums(trial.score_rows(spark, sf_dir))))


@query(sql("SELECT model, lead, count(*) AS units, round(CAST(sum(e0) AS DOUBLE) / sum(r0) - CAST(sum(e) AS DOUBLE) / sum(r), 6) AS gain FROM versus GROUP BY model, lead", "versus"))
def gain_vs_persistence(spark, sf_dir):
    return _versus(spark, sf_dir).groupBy("model", "lead").agg(F.count("*").alias("units"), r6(pool.gain()).alias("gain"))


@query(sql("SELECT model, lead, round(avg(CASE WHEN CAST(e AS DOUBLE) / r < CAST(e0 AS DOUBLE) / r0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM versus WHERE r > 0 AND r0 > 0 GROUP BY model, lead", "versus"))
def wins_share(spark, sf_dir):
    return pool.wins(_versus(spark, sf_dir)).withColumn("share", r6("share"))


def _draws_sql(unit_table: str, n: int, seed: int) -> dict[str, str]:
    return {
        "numbered": f"SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS k FROM (SELECT DISTINCT unit FROM {unit_table})",
        "drawn": f"SELECT draw, k, count(*) AS w FROM (SELECT draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM numbered) AS k FROM range({n}) d(draw), (SELECT k AS slot FROM numbered)) GROUP BY draw, k",
        "each": "SELECT model, lead, draw, CAST(sum(w * e0) AS DOUBLE) / sum(w * r0) AS s0, CAST(sum(w * e) AS DOUBLE) / sum(w * r) AS s FROM drawn JOIN numbered USING (k) JOIN vs USING (unit) GROUP BY ALL",
    }


_CI = "SELECT model, lead, round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high FROM each GROUP BY model, lead"


def _ci(df):
    return df.select("model", "lead", r6("low").alias("low"), r6("high").alias("high"))


@query(sql(_CI.format("s0 - s"), "versus", vs="SELECT * FROM versus", **_draws_sql("versus", DRAWS, 0)))
def boot_gain_ci(spark, sf_dir):
    pairs = _versus(spark, sf_dir)
    return _ci(pool.interval(pairs, pool.draws(pairs, DRAWS, 0), pool.gain(), ["model", "lead"]))


@query(sql(_CI.format("(1 - s) / (1 - s0) - 1"), "versus", vs="SELECT * FROM versus", **_draws_sql("versus", DRAWS, 1)))
def boot_paired_ci(spark, sf_dir):
    pairs = _versus(spark, sf_dir)
    relative = (1 - F.sum("e").cast("double") / F.sum("r")) / (1 - F.sum("e0").cast("double") / F.sum("r0")) - 1
    return _ci(pool.interval(pairs, pool.draws(pairs, DRAWS, 1), relative, ["model", "lead"]))


def _by_spell(spark, sf_dir):
    rows = trial.score_rows(spark, sf_dir).join(E.spells(trial.fine_events(spark, sf_dir)), "event")
    return stored(spark)(pool.against(pool.unit_sums(rows, "spell")))


_SPELL_UNITS = {
    "su": "SELECT spell AS unit, model, lead, sum(fss_e) AS e, sum(fss_r) AS r FROM rows JOIN spell USING (event) GROUP BY ALL",
    "vs": "SELECT a.unit, a.model, a.lead, a.e, a.r, b.e AS e0, b.r AS r0 FROM su a JOIN su b ON a.unit = b.unit AND a.lead = b.lead AND b.model = 'persistence' WHERE a.model <> 'persistence'",
}


@query(sql(_CI.format("s0 - s"), "rows", "spell", **_SPELL_UNITS, **_draws_sql("vs", DRAWS, 2)))
def boot_units(spark, sf_dir):
    """The same interval with spells as the units that are drawn."""
    pairs = _by_spell(spark, sf_dir)
    return _ci(pool.interval(pairs, pool.draws(pairs, DRAWS, 2), pool.gain(), ["model", "lead"]))


_HALVES = {"vh": "SELECT *, unit % 2 AS half FROM versus"}


@query(sql("SELECT lead, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM dd GROUP BY lead", "versus", **_HALVES, vs="SELECT * FROM versus", **{k: v for k, v in _draws_sql("versus", DRAWS, 3).items() if k != "each"},
    halves="SELECT lead, draw, half, CAST(sum(w * e0) AS DOUBLE) / sum(w * r0) - CAST(sum(w * e) AS DOUBLE) / sum(w * r) AS g FROM drawn JOIN numbered USING (k) JOIN vh USING (unit) GROUP BY ALL",
    dd="SELECT a.lead, a.draw, a.g - b.g AS d FROM halves a JOIN halves b ON a.lead = b.lead AND a.draw = b.draw AND a.half = 1 AND b.half = 0"))
def boot_did(spark, sf_dir):
    """Difference of two groups' gains, both from the same draws."""
    pairs = _versus(spark, sf_dir).withColumn("half", F.col("unit") % 2)
    weights = pool.draws(pairs, DRAWS, 3)
    w = F.col("w")
    each = pairs.join(weights, "unit").groupBy("lead", "draw", "half").agg((F.sum(w * F.col("e0")) / F.sum(w * F.col("r0")) - F.sum(w * F.col("e")) / F.sum(w * F.col("r"))).alias("g"))
    both = each.where("half = 1").alias("a").join(each.where("half = 0").alias("b"), ["lead", "draw"]).select("lead", (F.col("a.g") - F.col("b.g")).alias("d"))
    return both.groupBy("lead").agg(r6(F.percentile("d", F.lit(0.025))).alias("low"), r6(F.percentile("d", F.lit(0.975))).alias("high"))


@query(sql("""SELECT lead, half, arg_min(model, (1 - fss_train, model)) AS chosen, round(max(fss_train), 6) AS train_fss, round(arg_min(fss_test, (1 - fss_train, model)), 6) AS test_fss, round(max(fss_test) - arg_min(fss_test, (1 - fss_train, model)), 6) AS regret
FROM (SELECT a.lead, a.half, a.model, a.s AS fss_train, b.s AS fss_test FROM hs a JOIN hs b ON a.model = b.model AND a.lead = b.lead AND a.half <> b.half) GROUP BY lead, half""", "rows",
    hs="SELECT event % 2 AS half, model, lead, 1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r) AS s FROM rows GROUP BY ALL"))
def heldout_choice(spark, sf_dir):
    """The best model on one half of the episodes, and what it gives on the other; ties go to the first name."""
    half = trial.score_rows(spark, sf_dir).groupBy((F.col("event") % 2).alias("half"), "model", "lead").agg(score.fss().alias("s"))
    other = half.select((1 - F.col("half")).alias("half"), "model", "lead", F.col("s").alias("test"))
    both = half.join(other, ["half", "model", "lead"])
    best = F.struct((1 - F.col("s")).alias("a"), F.col("model").alias("b"))
    got = F.min_by("test", best)
    return both.groupBy("lead", "half").agg(F.min_by("model", best).alias("chosen"), r6(F.max("s")).alias("train_fss"), r6(got).alias("test_fss"), r6(F.max("test") - got).alias("regret"))


_DAY = "strftime(to_timestamp(f * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d')"


@query(sql(f"SELECT week, model, lead, round(CAST(sum(e0) AS DOUBLE) / sum(r0) - CAST(sum(e) AS DOUBLE) / sum(r), 6) AS gain FROM (SELECT a.week, a.model, a.lead, a.e, a.r, b.e AS e0, b.r AS r0 FROM m a JOIN m b ON a.f = b.f AND a.lead = b.lead AND a.event = b.event AND b.model = 'persistence' AND a.model <> 'persistence') GROUP BY ALL", "rows",
    m="SELECT strftime(date_trunc('week', to_timestamp(f * 3600) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week, event, f, model, lead, fss_e AS e, fss_r AS r FROM rows"))
def monthly_gain(spark, sf_dir):
    """Gain by calendar period; the trial tables span one month, so periods are weeks."""
    rows = trial.score_rows(spark, sf_dir).withColumn("week", F.date_format(F.date_trunc("week", F.timestamp_seconds(F.col("f") * 3600)), "yyyy-MM-dd"))
    unit = F.struct("week", "event", "f")
    pairs = pool.against(pool.unit_sums(rows.withColumn("unit", unit), "unit"))
    return pairs.groupBy(F.col("unit.week").alias("week"), "model", "lead").agg(r6(pool.gain()).alias("gain"))


@query(sql("SELECT model, lead, count(*) AS units, round(quantile_cont(q, 0.25), 6) AS p25, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.75), 6) AS p75, round(avg(CASE WHEN q > 1 THEN 1.0 ELSE 0.0 END), 6) AS above FROM (SELECT event, model, lead, CAST(sum(sum_f) AS DOUBLE) / sum(sum_t) AS q FROM counts GROUP BY ALL HAVING sum(sum_t) > 0) GROUP BY model, lead", "counts"))
def unit_ratio_quantiles(spark, sf_dir):
    each = trial.score_rows(spark, sf_dir).groupBy("event", "model", "lead").agg(F.try_divide(F.sum("sum_f").cast("double"), F.sum("sum_t").cast("double")).alias("q")).where("q IS NOT NULL")
    return each.groupBy("model", "lead").agg(F.count("*").alias("units"), *(r6(F.percentile("q", F.lit(x))).alias(n) for n, x in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))), r6(F.avg((F.col("q") > 1).cast("double"))).alias("above"))


@query(sql("SELECT event, model, lead, tercile, round(1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r), 6) AS fss FROM (SELECT rows.*, CASE WHEN wet <= q[1] THEN 0 WHEN wet > q[2] THEN 2 ELSE 1 END AS tercile FROM rows JOIN idx USING (f), (SELECT quantile_cont(wet, [1.0 / 3, 2.0 / 3]) AS q FROM idx WHERE f IN (SELECT f FROM issues))) GROUP BY ALL", "rows", "idx").replace("SELECT event, model, lead, tercile", "SELECT model, lead, tercile"))
def tertiles(spark, sf_dir):
    """Scores by third of the issue frames' wet shares, cut at percentiles."""
    index = trial.index(spark, sf_dir)
    when = E.issue_times(index, E.episodes(index)).select("f").distinct()
    cuts = index.join(when, "f", "left_semi").agg(F.percentile("wet", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    third = index.join(when, "f", "left_semi").join(F.broadcast(cuts)).select("f", F.when(F.col("wet") <= F.col("q")[0], 0).when(F.col("wet") > F.col("q")[1], 2).otherwise(1).alias("tercile"))  # cuts is one row
    return trial.score_rows(spark, sf_dir).join(third, "f").groupBy("model", "lead", "tercile").agg(r6(score.fss()).alias("fss"))


@query(sql("SELECT f, round(wet, 6) AS wet, rank FROM (SELECT f, wet, week, row_number() OVER (PARTITION BY week ORDER BY wet DESC, f) AS rank FROM (SELECT f, wet, f // 168 AS week FROM idx WHERE NOT missing AND wet IS NOT NULL AND f IN (SELECT f FROM idx a WHERE (SELECT count(*) FROM idx b WHERE b.f BETWEEN a.f - 1 AND a.f + 3 AND NOT b.missing) = 5))) WHERE rank <= 30", "idx"))
def case_selection(spark, sf_dir):
    """The 30 wettest frames of each week whose neighbours from one before to three after are all there."""
    index = trial.index(spark, sf_dir)
    around = Window.orderBy("f").rowsBetween(-1, 3)
    whole = index.withColumn("have", F.sum((~F.col("missing")).cast("int")).over(around)).where("have = 5 AND wet IS NOT NULL AND NOT missing")
    best = Window.partitionBy(F.floor(F.col("f") / 168)).orderBy(F.desc("wet"), "f")
    return whole.withColumn("rank", F.row_number().over(best)).where("rank <= 30").select("f", r6("wet").alias("wet"), "rank")


@query(sql("SELECT f, class, count(*) AS n FROM (SELECT f, CASE WHEN v < 1 THEN 0 WHEN v < 3 THEN 1 WHEN v < 6 THEN 2 ELSE 3 END AS class FROM dense) GROUP BY ALL", "dense"))
def heavy_light_classes(spark, sf_dir):
    """Intensity classes: dry, light, moderate, heavy."""
    return raster.dense(trial.cells(spark, sf_dir)).groupBy("f", F.expr("CASE WHEN v < 1 THEN 0 WHEN v < 3 THEN 1 WHEN v < 6 THEN 2 ELSE 3 END").alias("class")).agg(F.count("*").alias("n"))


@query(sql("SELECT valid, r, c, round(avg(CASE WHEN v >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS chance, count(*) AS members FROM (SELECT g.f + lead AS valid, r, least(47, c + 2 * lead) AS c, lead, v, c AS c0 FROM obs g, range(1, 4) l(lead) WHERE c + 2 * lead <= 47) GROUP BY valid, r, c HAVING count(*) > 1 AND avg(CASE WHEN v >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0", "obs"))
def lagged_ensemble(spark, sf_dir):
    """Chance of rain from the forecasts of up to three earlier frames for one valid time: each lead moves cells by twice its length; cells without inflow have fewer members."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    made = seen.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(LEADS)))).select((F.col("f") + F.col("lead")).alias("valid"), "r", (F.col("c") + 2 * F.col("lead")).alias("c"), "v").where(F.col("c") < TRIAL.cols)
    share = F.avg(F.when(F.col("v") >= 2, 1.0).otherwise(0.0))
    return made.groupBy("valid", "r", "c").agg(share.alias("chance"), F.count("*").alias("members")).where("members > 1 AND chance > 0").withColumn("chance", r6("chance"))


@query(sql("SELECT model, n, o, bin, round(CAST(o AS DOUBLE) / n, 6) AS rate FROM (SELECT model, CAST(least(floor(pn * 20), 19) AS INTEGER) AS bin, count(*) AS n, CAST(sum(wt) AS BIGINT) AS o FROM nb2 WHERE t IS NOT NULL GROUP BY ALL) WHERE n >= 50", "wetfc", **_NB))
def calibration_curve(spark, sf_dir):
    """Observed share by bin of the chance, for bins of 50 cells or more."""
    chance = score.neighbourhood(trial.pairs(spark, sf_dir), 2).where("t IS NOT NULL")
    bins = score.reliability(chance, F.col("pn"), F.col("t") >= 2, ("model",), 20).where("n >= 50")
    return bins.select("model", "bin", "n", F.col("o_sum").cast("long").alias("o"), r6(F.col("o_sum") / F.col("n")).alias("rate"))


_CAL = {
    "half": "SELECT model, event % 2 AS half, CAST(least(floor(pn * 20), 19) AS INTEGER) AS bin, count(*) AS n, CAST(sum(wt) AS BIGINT) AS o FROM nb2 WHERE t IS NOT NULL GROUP BY ALL",
    "cal": "SELECT model, half, bin, CASE WHEN n >= 50 THEN CAST(o AS DOUBLE) / n ELSE (bin + 0.5) / 20 END AS c FROM half",
}


@query(sql("SELECT h.model, h.half, CAST(sum(n) AS BIGINT) AS n, round(sum(n * v * v - 2 * v * o + o) / sum(n), 6) AS brier FROM (SELECT half.model, half.half, n, o, coalesce(c, (half.bin + 0.5) / 20) AS v FROM half LEFT JOIN cal ON cal.model = half.model AND cal.bin = half.bin AND cal.half <> half.half) h GROUP BY ALL", "wetfc", **_NB, **_CAL))
def calibrated_brier(spark, sf_dir):
    """Brier score of chances calibrated on the other half of the episodes, from the histogram alone."""
    chance = score.neighbourhood(trial.pairs(spark, sf_dir), 2).where("t IS NOT NULL").withColumn("half", F.col("event") % 2)
    bins = score.reliability(chance, F.col("pn"), F.col("t") >= 2, ("model", "half"), 20)
    centre = (F.col("bin") + 0.5) / 20
    curve = bins.select("model", (1 - F.col("half")).alias("half"), "bin", F.when(F.col("n") >= 50, F.col("o_sum") / F.col("n")).otherwise(centre).alias("c"))
    v, n, o = F.coalesce("c", centre), F.col("n"), F.col("o_sum")
    return bins.join(curve, ["model", "half", "bin"], "left").groupBy("model", "half").agg(F.sum("n").alias("n"), r6(F.sum(n * v * v - 2 * v * o + o) / F.sum("n")).alias("brier"))


@query(sql("SELECT lead, round(1 - 0.7 * (lead - 1) / 2, 6) AS weight, round(sum(p * (1 - 0.7 * (lead - 1) / 2)), 6) AS total FROM fc WHERE model = 'shift' GROUP BY lead", "fc"))
def fade(spark, sf_dir):
    weight = forecast.fade(F.col("lead"), LEADS, 0.3)
    return trial.pairs(spark, sf_dir).where("model = 'shift'").groupBy("lead").agg(r6(F.first(weight)).alias("weight"), r6(F.sum(F.col("p") * weight)).alias("total"))


@query(sql("""SELECT model, horizon, event_kind, count(*) AS n, CAST(sum(said) AS BIGINT) AS said, CAST(sum(was) AS BIGINT) AS was, CAST(sum((said - was) * (said - was)) AS BIGINT) AS brier FROM kinds WHERE said IS NOT NULL GROUP BY ALL""", "fc",
    now="SELECT f, r, c, v >= 2 AS wet FROM obs WHERE v IS NOT NULL",
    hz="SELECT event, f, model, r, c, horizon, max(CASE WHEN lead <= horizon AND p >= 2 THEN 1 ELSE 0 END) AS any_p, max(CASE WHEN lead <= horizon AND t >= 2 THEN 1 ELSE 0 END) AS any_t, max(CASE WHEN lead >= horizon AND p >= 2 THEN 1 ELSE 0 END) AS late_p, max(CASE WHEN lead >= horizon AND t >= 2 THEN 1 ELSE 0 END) AS late_t FROM fc, range(1, 4) h(horizon) GROUP BY ALL HAVING count(t) = 3",
    kinds="SELECT model, horizon, 'any' AS event_kind, any_p AS said, any_t AS was FROM hz UNION ALL SELECT model, horizon, 'start', any_p, any_t FROM hz JOIN now USING (f, r, c) WHERE NOT wet UNION ALL SELECT model, horizon, 'stop', 1 - late_p, 1 - late_t FROM hz JOIN now USING (f, r, c) WHERE wet"))
def timing_events(spark, sf_dir):
    """Rain within a horizon, its start where it is dry, its stop where it is wet; only cells with all truth frames."""
    whole = trial.pairs(spark, sf_dir).groupBy("event", "f", "model", "r", "c").agg(F.collect_list(F.struct("lead", (F.col("p") >= 2).cast("int").alias("p"), (F.col("t") >= 2).cast("int").alias("t"))).alias("x"), F.count("t").alias("have")).where(F.col("have") == LEADS)
    spread = whole.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(LEADS))))

    def some(column, when):
        return F.exists("x", lambda e: when(e["lead"]) & (e[column] == 1)).cast("int")

    early, late = (lambda lead: lead <= F.col("horizon")), (lambda lead: lead >= F.col("horizon"))
    each = spread.select("f", "r", "c", "model", "horizon", some("p", early).alias("ap"), some("t", early).alias("at"), some("p", late).alias("lp"), some("t", late).alias("lt"))
    now = raster.observed(trial.cells(spark, sf_dir)).where("v IS NOT NULL").select("f", "r", "c", (F.col("v") >= 2).alias("wet"))
    kinds = F.array(F.struct(F.lit("any").alias("event_kind"), F.col("ap").alias("said"), F.col("at").alias("was")), F.when(F.col("wet"), F.struct(F.lit("stop").alias("event_kind"), (1 - F.col("lp")).alias("said"), (1 - F.col("lt")).alias("was"))).when(~F.col("wet"), F.struct(F.lit("start").alias("event_kind"), F.col("ap").alias("said"), F.col("at").alias("was"))))
    long = each.join(now, ["f", "r", "c"], "left").select("model", "horizon", F.explode(kinds).alias("k")).where("k IS NOT NULL").select("model", "horizon", "k.*")
    return long.groupBy("model", "horizon", "event_kind").agg(F.count("*").alias("n"), F.sum("said").alias("said"), F.sum("was").alias("was"), F.sum((F.col("said") - F.col("was")) * (F.col("said") - F.col("was"))).alias("brier"))
