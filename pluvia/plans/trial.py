"""The driver's tables as rasters, forecasts and score rows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import episodes as E
from pluvia.operators import forecast, score
from pluvia.sources import raster

LEADS = 3


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of a session: kept, as an archive is built once and read by every study."""
    return raster.trial_cells(spark, sf_dir).persist()


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a frame with all its cells, kept: what scores start from."""
    return raster.observed_frames(cells(spark, sf_dir)).persist()


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a frame, kept like the archive: episodes are found without reading frames."""
    return E.packed_index(packed(spark, sf_dir), raster.axis(cells(spark, sf_dir))).persist()


def fine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.episodes(index(spark, sf_dir), E.FINE)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir)
    return E.issue_times(found, E.episodes(found, E.FINE))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of two models at the issue times, with the truth."""
    seen = raster.observed(cells(spark, sf_dir))
    when = issues(spark, sf_dir).persist()
    # only frames that are issued on, or are valid for one, take part in the joins
    last = seen.join(when.select("f").distinct(), "f", "left_semi")
    valid = forecast.leads(when, LEADS).select((F.col("f") + F.col("lead")).alias("f")).distinct()
    both = forecast.persistence(when, last, LEADS).unionByName(forecast.shifted(when, last, LEADS, 2, 0))
    return score.with_truth(both, seen.join(valid, "f", "left_semi"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each episode, issue, model and lead, kept: all pooling starts from these few sums. Sums of the trial's whole amounts are whole."""
    rows = score.shift_rows(issues(spark, sf_dir), packed(spark, sf_dir), {"persistence": (0, 0), "shift": (2, 0)}, LEADS)
    return rows.withColumns({k: F.col(k).cast("long") for k in ("sum_f", "sum_t", "sse")}).persist()


#: Common table expressions for the queries' SQL, each with those that it needs before it.
CTES = {
    "showers": "SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS f0, event_id * 7 % 32 AS r0, user_id * 5 % 48 AS c0, 2 + CAST(floor(value / 100) AS BIGINT) AS amp, event_id % 3 - 1 AS vr, 1 + user_id % 3 AS vc FROM events WHERE value >= 150",
    "moved": "SELECT f0 + k AS f, r0 + vr * k AS rr, c0 + vc * k AS cc, amp FROM showers, range(6) t(k)",
    "drizzle": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS f, event_id * 7 % 32 AS r, user_id * 5 % 48 AS c FROM events WHERE value < 150",
    "cells": "SELECT f, r, c, CAST(sum(height) AS BIGINT) AS v FROM (SELECT f, r, c, amp + 2 - abs(r - rr) - abs(c - cc) AS height FROM moved, range(32) a(r), range(48) b(c) WHERE abs(r - rr) + abs(c - cc) < amp + 2 UNION ALL SELECT f, r, c, 1 AS height FROM drizzle) GROUP BY f, r, c",
    "axis": "SELECT unnest(range(a, b + 1)) AS f FROM (SELECT min(f) AS a, max(f) AS b FROM cells)",
    "dense": "SELECT s.f, s.r, s.c, coalesce(v, 0) AS v FROM (SELECT f, r, c FROM (SELECT DISTINCT f FROM cells), range(32) a(r), range(48) b(c)) s LEFT JOIN cells USING (f, r, c)",
    "obs": "SELECT s.f, s.r, s.c, CASE WHEN (s.r * 48 + s.c + s.f) % 97 <> 0 THEN coalesce(v, 0) END AS v FROM (SELECT f, r, c FROM axis, range(32) a(r), range(48) b(c) WHERE f % 29 <> 0) s LEFT JOIN cells USING (f, r, c)",
    "idx": "SELECT f, coalesce(covered, 0) AS covered, CASE WHEN covered > 0 THEN n_wet / CAST(covered AS DOUBLE) END AS wet, covered IS NULL AS missing FROM axis LEFT JOIN (SELECT f, count(v) AS covered, count(*) FILTER (WHERE v >= 2) AS n_wet FROM obs GROUP BY f) USING (f)",
    "rainy": "SELECT f, coalesce(wet, 0) AS wet FROM idx WHERE coalesce(wet, 0) >= 0.05 AND NOT missing",
    "fine_i": "SELECT min(f) AS a, max(f) AS b FROM (SELECT f, sum(n) OVER (ORDER BY f) AS g FROM (SELECT f, CASE WHEN f - lag(f) OVER (ORDER BY f) <= 1 THEN 0 ELSE 1 END AS n FROM rainy)) GROUP BY g",
    "fine_c": "SELECT a, b FROM fine_i WHERE b - a <= 12 UNION ALL SELECT x AS a, least(x + 11, b) AS b FROM (SELECT unnest(range(a, b + 1, 12)) AS x, b FROM fine_i WHERE b - a > 12)",
    "fine": "SELECT row_number() OVER (ORDER BY a) - 1 AS event, a AS f_start, b AS f_end FROM fine_c WHERE b - a >= 1 AND (SELECT max(coalesce(wet, 0)) FROM idx WHERE f BETWEEN a AND b) >= 0.10",
    "coarse_i": "SELECT min(f) AS a, max(f) AS b FROM (SELECT f, sum(n) OVER (ORDER BY f) AS g FROM (SELECT f, CASE WHEN f - lag(f) OVER (ORDER BY f) <= 3 THEN 0 ELSE 1 END AS n FROM rainy)) GROUP BY g",
    "coarse": "SELECT row_number() OVER (ORDER BY a) - 1 AS event, a AS f_start, b AS f_end FROM coarse_i WHERE b - a >= 1 AND (SELECT max(coalesce(wet, 0)) FROM idx WHERE f BETWEEN a AND b) >= 0.10",
    "hist2": "SELECT f FROM idx WHERE NOT missing AND f - 1 IN (SELECT f FROM idx WHERE NOT missing)",
    "issues": "SELECT event, f FROM (SELECT event, f_start, unnest(range(f_start, f_end + 1)) AS f FROM fine) JOIN idx USING (f) WHERE (f - f_start) % 3 = 0 AND wet >= 0.01 AND f IN (SELECT f FROM hist2)",
    "asked": "SELECT event, f, model, lead, f + lead AS g, dx FROM issues, range(1, 4) l(lead), (VALUES ('persistence', 0), ('shift', 2)) m(model, dx)",
    "met": "SELECT event, a.f, model, lead, o.r, o.c, greatest(0, o.c - lead * dx) AS pc, v AS t FROM asked a JOIN obs o ON o.f = a.g",
    "fc": "SELECT event, m.f, model, lead, m.r, m.c, coalesce(v, 0) AS p, t FROM met m JOIN obs o ON o.f = m.f AND o.r = m.r AND o.c = m.pc",
    "counts": "SELECT event, f, model, lead, count(*) AS n, CAST(sum(p) AS BIGINT) AS sum_f, CAST(sum(t) AS BIGINT) AS sum_t, CAST(sum((p - t) * (p - t)) AS BIGINT) AS sse, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS corr, "
    + ", ".join(f"count(*) FILTER (WHERE p >= {x} AND t >= {x}) AS hit_{x}, count(*) FILTER (WHERE p < {x} AND t >= {x}) AS miss_{x}, count(*) FILTER (WHERE p >= {x} AND t < {x}) AS fa_{x}" for x in (1, 2, 4))
    + ", CAST(count(*) FILTER (WHERE (p >= 2) <> (t >= 2)) AS DOUBLE) AS brier FROM fc WHERE t IS NOT NULL GROUP BY ALL",
    "wetfc": "SELECT event, f, model, lead, r, c, t, CASE WHEN t IS NOT NULL AND p >= 2 THEN 1 ELSE 0 END AS wp, CASE WHEN t >= 2 THEN 1 ELSE 0 END AS wt FROM fc",
    "rowbox": "SELECT *, sum(wp) OVER w AS xp, sum(wt) OVER w AS xt FROM wetfc WINDOW w AS (PARTITION BY event, f, model, lead, r ORDER BY c RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    "box": "SELECT *, CAST(sum(xp) OVER w AS BIGINT) AS np, CAST(sum(xt) OVER w AS BIGINT) AS nt FROM rowbox WINDOW w AS (PARTITION BY event, f, model, lead, c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    "fss": "SELECT event, f, model, lead, CAST(sum((np - nt) * (np - nt)) AS BIGINT) AS fss_e, CAST(sum(np * np + nt * nt) AS BIGINT) AS fss_r FROM box GROUP BY ALL",
    "rows": "SELECT * FROM counts JOIN fss USING (event, f, model, lead)",
    "units": "SELECT event AS unit, model, lead, sum(fss_e) AS e, sum(fss_r) AS r FROM rows GROUP BY ALL",
    "versus": "SELECT a.unit, a.model, a.lead, a.e, a.r, b.e AS e0, b.r AS r0 FROM units a JOIN units b ON a.unit = b.unit AND a.lead = b.lead AND b.model = 'persistence' WHERE a.model <> 'persistence'",
    "spell": "SELECT event, sum(n) OVER (ORDER BY f_start, f_end, event) AS spell FROM (SELECT event, f_start, f_end, CASE WHEN f_start - max(f_end) OVER (ORDER BY f_start, f_end, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS n FROM fine)",
    "clim": "SELECT r, c, count(v) AS n, count(*) FILTER (WHERE v >= 2) AS wet, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (WHERE v >= 2 AND idx.wet < 0.05) AS wet_dry, count(*) FILTER (WHERE v IS NOT NULL AND idx.wet < 0.05) AS n_dry FROM obs JOIN idx USING (f) GROUP BY r, c",
    "core": "SELECT r, c, wet_dry, n_dry FROM clim WHERE n_dry > 0 AND wet_dry > 0.04 * n_dry",
}
NEEDS = {
    "moved": ["showers"], "cells": ["moved", "drizzle"], "axis": ["cells"], "dense": ["cells"], "obs": ["axis"], "idx": ["obs"], "rainy": ["idx"], "fine_i": ["rainy"], "fine_c": ["fine_i"], "fine": ["fine_c"],
    "coarse_i": ["rainy"], "coarse": ["coarse_i"], "hist2": ["idx"], "issues": ["fine", "hist2"], "asked": ["issues"], "met": ["asked"], "fc": ["met"], "counts": ["fc"], "wetfc": ["fc"], "rowbox": ["wetfc"], "box": ["rowbox"], "fss": ["box"],
    "rows": ["counts", "fss"], "units": ["rows"], "versus": ["units"], "spell": ["fine"], "clim": ["idx"], "core": ["clim"],
}


def sql(final: str, *names: str, **more: str) -> str:
    """final with the named common table expressions, those that they need, and more of the query's own."""
    order: list[str] = []

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
