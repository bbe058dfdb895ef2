"""Queries behind report tables: unions of runs, classes, tables as text, files in other formats."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators import geometry as G
from pluvia.operators import pool, registry, score
from pluvia.plans import analyses, movement, trial, verification
from pluvia.plans.analyses import _ST, MAIN, stations
from pluvia.plans.trial import sql
from pluvia.sources import raster, shared
from pluvia.sources.raster import table

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


@query("SELECT id, v, round(median3, 6) AS median3 FROM (SELECT x.id, max(x.v) AS v, median(b.v) AS median3 FROM (SELECT a.id, a.v, b.id AS nid, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2), b.id) AS k FROM st a JOIN st b ON a.area = b.area AND a.id <> b.id) x JOIN st b ON b.id = x.nid WHERE k <= 3 GROUP BY x.id) WHERE v < 0.5 * median3".replace("SELECT id, v, round", "WITH st AS (SELECT s_suppkey AS id, s_nationkey AS area, s_acctbal AS v, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS lon, CAST(s_suppkey * 61 % 1000 AS DOUBLE) AS lat FROM supplier) SELECT id, v, round", 1))
def gauge_faulty(spark, sf_dir):
    """Stations whose total is under half the median of their three nearest neighbours'."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("area"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") * 37 % 1000).cast("double").alias("lon"), (F.col("s_suppkey") * 61 % 1000).cast("double").alias("lat"))
    near = G.nearest(s.select("area", "id", F.col("lon").alias("x"), F.col("lat").alias("y")), 3, shared.stored(spark))
    near = near.join(s.select("id", "v"), "id").join(s.select(F.col("id").alias("other"), F.col("v").alias("nv")), "other")
    return near.groupBy("id").agg(F.max("v").alias("v"), r6(F.percentile("nv", F.lit(0.5))).alias("median3")).where("v < 0.5 * median3")


@query(sql("SELECT CASE WHEN c < 16 THEN 'near' WHEN c < 32 THEN 'mid' ELSE 'far' END AS band, count(*) AS cells, round(CAST(sum(wet) AS DOUBLE) / sum(n), 6) AS frequency, round(CAST(sum(total) AS DOUBLE) / sum(n), 6) AS mean FROM clim GROUP BY ALL", "clim"))
def band_summary(spark, sf_dir):
    """Wet frequency and mean by band."""
    clim = G.climatology(raster.observed(trial.cells(spark, sf_dir)), trial.index(spark, sf_dir), 2, 0.05)
    band = F.when(F.col("c") < 16, "near").when(F.col("c") < 32, "mid").otherwise("far")
    return clim.groupBy(band.alias("band")).agg(F.count("*").alias("cells"), r6(F.sum("wet") / F.sum("n")).alias("frequency"), r6(F.sum("total") / F.sum("n")).alias("mean"))


@query(sql("SELECT class, count(*) AS pairs, round(quantile_cont(s, 0.5), 6) AS speed FROM (SELECT sqrt(dx * dx + dy * dy) AS s, CASE WHEN sqrt(dx * dx + dy * dy) < 0.5 THEN 0 WHEN sqrt(dx * dx + dy * dy) < 1 THEN 1 WHEN sqrt(dx * dx + dy * dy) < 2 THEN 2 ELSE 3 END AS class FROM vec WHERE dx IS NOT NULL) GROUP BY class", "dense", **movement._match("vec")))
def speed_classes(spark, sf_dir):
    from pluvia.operators import motion

    v = motion.pair_vectors(movement._blocks(spark, sf_dir)).where("dx IS NOT NULL").select(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("s"))
    return v.groupBy(F.when(F.col("s") < 0.5, 0).when(F.col("s") < 1, 1).when(F.col("s") < 2, 2).otherwise(3).alias("class")).agg(F.count("*").alias("pairs"), r6(F.percentile("s", F.lit(0.5))).alias("speed"))


@query(sql("SELECT f, round(avg(v) FILTER (WHERE greatest(abs(r - 16), abs(c - 24)) <= 1), 6) AS core, round(avg(v) FILTER (WHERE greatest(abs(r - 16), abs(c - 24)) BETWEEN 4 AND 10), 6) AS ring FROM obs GROUP BY f", "obs"))
def ring_mean(spark, sf_dir):
    """A city's three by three cells against the ring around it."""
    far = F.greatest(F.abs(F.col("r") - 16), F.abs(F.col("c") - 24))
    return raster.observed(trial.cells(spark, sf_dir)).groupBy("f").agg(r6(F.avg(F.when(far <= 1, F.col("v")))).alias("core"), r6(F.avg(F.when(far.between(4, 10), F.col("v")))).alias("ring"))


@query(sql("SELECT name, lead, CAST(sum(hit_2) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'a:' || model AS name, lead, hit_2, n FROM counts WHERE event % 2 = 0 UNION ALL SELECT 'b:' || model, lead, hit_2, n FROM counts WHERE event % 2 = 1) GROUP BY ALL", "counts"))
def union_runs(spark, sf_dir):
    """Two runs' rows under prefixed model names."""
    rows = trial.score_rows(spark, sf_dir)
    part = lambda k, prefix: rows.where(F.col("event") % 2 == k).withColumn("name", F.concat(F.lit(prefix), "model"))
    both = part(0, "a:").unionByName(part(1, "b:"), allowMissingColumns=True)
    return both.groupBy("name", "lead").agg(F.sum("hit_2").alias("hit"), F.sum("n").alias("n"))


@query(sql("SELECT DISTINCT event FROM fine WHERE event IN (SELECT event FROM issues) AND f_start IN (SELECT f_start FROM coarse)", "issues", "coarse"))
def shared_episodes(spark, sf_dir):
    """Episodes with issues that start where a coarse one does: semi-joins."""
    from pluvia.operators import episodes as E

    index = trial.index(spark, sf_dir)
    fine, coarse = E.episodes(index), E.episodes(index, E.EpisodeSpec(0.05, 3, None, 1, 0.10))
    return fine.join(E.issue_times(index, fine), "event", "left_semi").join(coarse, "f_start", "left_semi").select("event").distinct()


@query(sql("SELECT lead, model, '| ' || model || ' | ' || lead || ' | ' || printf('%.3f', fss) || ' | ' || printf('%+.3f', gain) || ' |' AS line FROM (SELECT a.model, a.lead, a.s AS fss, a.s - b.s AS gain FROM pooled a JOIN pooled b ON a.lead = b.lead AND b.model = 'persistence')", "rows", pooled="SELECT model, lead, 1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r) AS s FROM rows GROUP BY ALL"))
def summary_lines(spark, sf_dir):
    """A table's lines: score and gain over persistence with three digits."""
    pooled = trial.score_rows(spark, sf_dir).groupBy("model", "lead").agg(score.fss().alias("s"))
    base = pooled.where(F.col("model") == pool.BASELINE).select("lead", F.col("s").alias("s0"))
    return pooled.join(base, "lead").select("lead", "model", F.format_string("| %s | %d | %.3f | %+.3f |", "model", "lead", "s", F.col("s") - F.col("s0")).alias("line"))


@query(sql("SELECT event, f, model, lead, n, sum_f, sum_t, round(corr, 6) AS corr FROM counts", "counts"))
def jsonl_round_trip(spark, sf_dir):
    """Score rows written as lines of JSON and read back with their schema; absent keys are NULL."""
    rows = trial.score_rows(spark, sf_dir).select("event", "f", "model", "lead", "n", "sum_f", "sum_t", r6("corr").alias("corr"))
    path = shared.path(spark, "rows")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT p_partkey AS r, k AS c, round(CAST(greatest(0, CASE WHEN v = 7 THEN 0 ELSE v END) AS DOUBLE), 3) AS v FROM (SELECT p_partkey, k, (p_partkey * 13 + k * 7) % 23 - 3 AS v FROM part, range(12) t(k))")
def ascii_grid(spark, sf_dir):
    """Rows of an ASCII grid parsed from text: no data and negative values are zero."""
    cells = F.array(*(((F.col("p_partkey") * 13 + k * 7) % 23 - 3).cast("string") for k in range(12)))
    text = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", cells).alias("line"))
    parsed = text.select(F.col("p_partkey").alias("r"), F.posexplode(F.split("line", r"\s+")).alias("c", "v"))
    v = F.col("v").cast("double")
    return parsed.select("r", "c", F.round(F.greatest(F.lit(0.0), F.when(v == 7, 0.0).otherwise(v)), 3).alias("v"))


@query(sql("SELECT f, r, c, CASE WHEN r BETWEEN 4 AND 27 THEN v END AS v FROM obs WHERE f % 2 = 0 AND f BETWEEN (SELECT min(f) + 100 FROM axis) AND (SELECT min(f) + 130 FROM axis)", "obs"))
def archive_window(spark, sf_dir):
    """A stretch of the archive at a stride of two, with cells outside a region NULL."""
    rain = trial.cells(spark, sf_dir)
    first = rain.agg(F.min("f").alias("a"))
    rows = raster.observed(rain).where("f % 2 = 0").join(F.broadcast(first)).where("f BETWEEN a + 100 AND a + 130")  # one row
    return rows.select("f", "r", "c", F.when(F.col("r").between(4, 27), F.col("v")).alias("v"))


@query(sql("SELECT model, event_kind, horizon, n, round(CAST(was AS DOUBLE) / n, 6) AS base, round(CAST(brier AS DOUBLE) / n, 6) AS brier, round(1 - CAST(brier AS DOUBLE) / nullif(was - CAST(was AS DOUBLE) * was / n, 0), 6) AS skill FROM (" + verification.ORACLE["timing_events"].split("SELECT model, horizon, event_kind, count(*)", 1)[0].replace("WITH ", "WITH ", 1) + "SELECT model, horizon, event_kind, count(*)" + verification.ORACLE["timing_events"].split("SELECT model, horizon, event_kind, count(*)", 1)[1] + ")"))
def timing_brier(spark, sf_dir):
    """Base rate, Brier score and skill of the timing events."""
    n, was, b = F.col("n"), F.col("was"), F.col("brier")
    skill = 1 - F.try_divide(b.cast("double"), was - was.cast("double") * was / n)
    return verification.timing_events(spark, sf_dir).select("model", "event_kind", "horizon", "n", r6(was / n).alias("base"), r6(b / n).alias("brier"), r6(skill).alias("skill"))


@query(sql("SELECT lead, count(*) AS n, round(stddev_samp(a - b), 6) AS sd FROM (SELECT s.lead, ln(s.sum_f / CAST(s.sum_t AS DOUBLE)) AS a, ln(p.sum_f / CAST(p.sum_t AS DOUBLE)) AS b FROM counts s JOIN counts p ON s.event = p.event AND s.f = p.f AND s.lead = p.lead AND s.model = 'shift' AND p.model = 'persistence' WHERE s.sum_f > 0 AND s.sum_t > 0 AND p.sum_f > 0) GROUP BY lead", "counts"))
def paired_log_ratio(spark, sf_dir):
    """Variants side by side on issue and lead, and the spread of their log ratios."""
    wide = trial.score_rows(spark, sf_dir).groupBy("event", "f", "lead").pivot("model", ["shift", "persistence"]).agg(F.first(F.when((F.col("sum_f") > 0) & (F.col("sum_t") > 0), F.log(F.col("sum_f") / F.col("sum_t")))))
    return wide.where("shift IS NOT NULL AND persistence IS NOT NULL").groupBy("lead").agg(F.count("*").alias("n"), r6(F.stddev_samp(F.col("shift") - F.col("persistence"))).alias("sd"))


@query(sql("SELECT count(*) AS rows, round(max(b.w / a.w), 6) AS widest, round(quantile_cont(b.w / a.w, 0.5), 6) AS median FROM (SELECT model, lead, quantile_cont(s0 - s, 0.975) - quantile_cont(s0 - s, 0.025) AS w FROM each_a GROUP BY ALL) a JOIN (SELECT model, lead, quantile_cont(s0 - s, 0.975) - quantile_cont(s0 - s, 0.025) AS w FROM each_b GROUP BY ALL) b USING (model, lead)", "versus", "spell",
    **{f"{k}_a" if k != "each" else "each_a": v.replace("numbered", "numbered_a").replace("drawn", "drawn_a").replace("JOIN vs ", "JOIN vs_a ") for k, v in {"vs": "SELECT * FROM versus", **verification._draws_sql("versus", verification.DRAWS, 0)}.items()},
    su=verification._SPELL_UNITS["su"], **{f"{k}_b" if k != "each" else "each_b": v.replace("numbered", "numbered_b").replace("drawn", "drawn_b").replace("JOIN vs ", "JOIN vs_b ").replace("FROM vs)", "FROM vs_b)") for k, v in {"vs": verification._SPELL_UNITS["vs"], **verification._draws_sql("vs", verification.DRAWS, 2)}.items()}))
def interval_widening(spark, sf_dir):
    """How much wider the intervals are when spells are drawn instead of episodes."""
    width = lambda pairs, seed: pool.interval(pairs, pool.draws(pairs, verification.DRAWS, seed), pool.gain(), ["model", "lead"]).select("model", "lead", (F.col("high") - F.col("low")).alias("w"))
    a, b = width(verification._versus(spark, sf_dir), 0), width(verification._by_spell(spark, sf_dir), 2).withColumnRenamed("w", "wb")
    ratio = F.col("wb") / F.col("w")
    return a.join(b, ["model", "lead"]).agg(F.count("*").alias("rows"), r6(F.max(ratio)).alias("widest"), r6(F.percentile(ratio, F.lit(0.5))).alias("median"))


@query(sql("SELECT id, r, c, round(58.5 - (r + 0.5) * (58.5::DOUBLE - 53.9::DOUBLE) / 160, 6) AS lat, round(5.0 + (c + 0.5) * 11.5 / 224, 6) AS lon FROM (SELECT id, CAST(trunc((58.5 - lat) / (58.5::DOUBLE - 53.9::DOUBLE) * 160) AS INTEGER) AS r, CAST(trunc((lon - 5.0) / 11.5::DOUBLE * 224) AS INTEGER) AS c FROM st)", **_ST))
def cell_centres(spark, sf_dir):
    r, c = G.cell_of(MAIN, F.col("lat"), F.col("lon"))
    lat, lon = G.centre_of(MAIN, F.col("r"), F.col("c"))
    return stations(spark, sf_dir).select("id", r.alias("r"), c.alias("c")).select("id", "r", "c", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query()
def curve_tangents(spark, sf_dir):
    """Monotone cubic tangents of each user's hourly totals (Fritsch and Carlson 1980). Slopes and their harmonic means are windows; the limiter carries from point to point."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("t"), "value")
    along = Window.partitionBy("k").orderBy("t")
    series = e.groupBy("k", "t").agg(F.sum("value").alias("y")).withColumn("slope", (F.lead("y").over(along) - F.col("y")) / (F.lead("t").over(along) - F.col("t")))
    left, right = F.lag("slope").over(along), F.col("slope")
    inner = F.when(left * right > 0, 2 / (1 / left + 1 / right)).otherwise(0.0)
    start = F.when(left.isNull(), F.coalesce(right, F.lit(0.0))).when(right.isNull(), left).otherwise(inner)

    def limit(frame):
        import pandas as pd

        frame = frame.sort_values("t")
        return pd.DataFrame({"k": frame["k"], "t": frame["t"], "m": list(limited(frame["slope"].tolist()[:-1], frame["start"].tolist()))})

    return series.withColumn("start", start).select("k", "t", "slope", "start").groupBy("k").applyInPandas(limit, "k long, t long, m double").withColumn("m", r6("m"))


def limited(slopes, tangents):
    """Tangents scaled so that each piece stays monotone: a piece scales both of its ends, and hands the scaled right one on."""
    carried = tangents[0]
    for slope, ahead in zip(slopes, tangents[1:], strict=True):
        reach = math.hypot(carried, ahead)
        scale = min(1.0, 3 * abs(slope) / reach) if reach else 1.0  # 0 on a flat piece
        yield carried * scale
        carried = ahead * scale
    yield carried


def _add_models():
    texts = {"bw2": movement._block_sql("bw2"), "block-sub": movement._block_sql("block-sub"), "gwx3": movement._half_life_sql("gwx3")}
    for name in ("gwx3", "block-26km", "block-sub", "bw2", "lk", "sprog", "steps-mean", "steps-bps-mean"):

        def run(spark, sf_dir, name=name):
            cells, issues = trial.cells(spark, sf_dir), movement._issues(spark, sf_dir)
            return movement._scores(registry.forecasts(name, cells, issues, 2, radius=movement.RADIUS), cells, issues, registry.history(name), name)

        run.__name__ = f"registry_{name.replace('-', '_')}"
        query(texts.get(name))(run)


_add_models()
