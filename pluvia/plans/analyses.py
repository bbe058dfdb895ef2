"""Queries on grids, masks, stations, point series and ingest, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators import asof, score
from pluvia.operators import geometry as G
from pluvia.plans import trial
from pluvia.plans.trial import sql
from pluvia.sources import raster
from pluvia.sources.raster import table
from pluvia.sources.shared import stored
from pluvia.spec import GRIDS, RADARS, TRIAL, GridSpec

QUERIES, ORACLE = {}, {}
MAIN = GRIDS["3.2km"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def r6(c):
    return F.round(c, 6)


def stations(spark, sf_dir):
    """Customers as stations: places from their keys."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("area"), (5 + k * 37 % 1000 / 1000 * 11.5).alias("lon"), (53.9 + k * 61 % 1000 / 1000 * 4.6).alias("lat"))


_ST = {"st": "SELECT c_custkey AS id, c_nationkey AS area, 5 + c_custkey * 37 % 1000 / 1000.0::DOUBLE * 11.5 AS lon, 53.9 + c_custkey * 61 % 1000 / 1000.0::DOUBLE * 4.6 AS lat FROM customer"}
_GC = "2 * 6371 * asin(sqrt(pow(sin((radians(lat) - radians({0})) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin((radians(lon) - radians({1})) / 2), 2)))"
_DIST = "least(" + ", ".join(_GC.format(*at) for at in RADARS.values()) + ")"


@query(sql(f"SELECT id, round(d, 4) AS d, CASE WHEN d < 60 THEN 'near' WHEN d < 120 THEN 'mid' ELSE 'far' END AS band, lon >= 8 AND lon < 15.3 AND lat >= 54.3 AND lat < 58 AS in_box FROM (SELECT *, {_DIST} AS d FROM st)", **_ST))
def cell_dim_distance(spark, sf_dir):
    """Distance to the nearest radar, its band, and the box."""
    d = G.radar_distance(F.col("lat"), F.col("lon"))
    return stations(spark, sf_dir).withColumn("d", d).select("id", F.round("d", 4).alias("d"), G.band(F.col("d")).alias("band"), G.in_box(F.col("lat"), F.col("lon")).alias("in_box"))


@query(sql("SELECT id, CAST(trunc((58.5 - lat) / (58.5::DOUBLE - 53.9::DOUBLE) * 160) AS INTEGER) AS r, CAST(trunc((lon - 5.0) / (16.5::DOUBLE - 5.0::DOUBLE) * 224) AS INTEGER) AS c FROM st", **_ST))
def point_to_cell(spark, sf_dir):
    r, c = G.cell_of(MAIN, F.col("lat"), F.col("lon"))
    return stations(spark, sf_dir).select("id", r.alias("r"), c.alias("c"))


@query("SELECT p_partkey, round(CASE WHEN raw = 255 THEN NULL WHEN rate < 0.05 THEN 0.0 ELSE rate END, 6) AS rate FROM (SELECT p_partkey, raw, pow(pow(10, (raw * 0.5 - 32) / 10) / 200, 1 / 1.6::DOUBLE) AS rate FROM (SELECT p_partkey, p_partkey % 256 AS raw FROM part))")
def dbz_to_rate(spark, sf_dir):
    """Raw radar pixels to rain rates: no data is NULL, traces are zero."""
    raw = F.col("p_partkey") % 256
    rate = F.pow(F.pow(F.lit(10.0), (raw * 0.5 - 32) / 10) / 200, F.lit(1 / 1.6))
    return table(spark, sf_dir, "part").select("p_partkey", r6(F.when(raw == 255, None).when(rate < 0.05, 0.0).otherwise(rate)).alias("rate"))


@query("SELECT day, slot, event_id FROM (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY event_id DESC) AS k FROM (SELECT event_id, t // 86400 AS day, CAST(round_even((t % 86400) / 300.0::DOUBLE, 0) AS BIGINT) AS slot FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events))) WHERE k = 1 AND slot < 288")
def slot_dedupe(spark, sf_dir):
    """Scans onto the day's five-minute slots; the last one written stays."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    slots = table(spark, sf_dir, "events").select("event_id", F.floor(t / 86400).alias("day"), F.bround((t % 86400) / 300).cast("long").alias("slot")).where("slot < 288")
    return slots.groupBy("day", "slot").agg(F.max("event_id").alias("event_id"))


def _clim(spark, sf_dir):
    cells = trial.cells(spark, sf_dir)
    return G.climatology(raster.observed(cells), trial.index(spark, sf_dir), 2, 0.05)


@query(sql("SELECT * FROM clim", "clim"))
def climatology_cells(spark, sf_dir):
    return _clim(spark, sf_dir)


def _core(spark, sf_dir):
    return _clim(spark, sf_dir).where("n_dry > 0 AND wet_dry > 0.04 * n_dry")


_MASK = "SELECT DISTINCT k.r + i AS r, k.c + j AS c FROM core k, range(-1, 2) a(i), range(-1, 2) b(j) WHERE k.r + i BETWEEN 0 AND 31 AND k.c + j BETWEEN 0 AND 47"


@query(sql(_MASK, "core"))
def fixed_echo_mask(spark, sf_dir):
    """Cells that are wet too often while the map is dry, and those next to them."""
    return G.dilate(_core(spark, sf_dir), TRIAL)


#: Rounds in which all cells of a label take the smallest label next to any of them, and then that one's.
_LABELS = {"near": "SELECT a.r * 48 + a.c AS n, b.r * 48 + b.c AS m FROM core a JOIN core b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1", "l0": "SELECT r * 48 + c AS n, r * 48 + c AS l FROM core"}
for _k in range(1, 25):
    _LABELS |= {f"g{_k}": f"SELECT x.l, min(y.l) AS g FROM near JOIN l{_k - 1} x ON x.n = near.n JOIN l{_k - 1} y ON y.n = near.m GROUP BY x.l", f"l{_k}": f"SELECT n, b.g AS l FROM l{_k - 1} x JOIN g{_k} a ON a.l = x.l JOIN g{_k} b ON b.l = a.g"}


@query(sql("SELECT label, cells, peak, row_number() OVER (ORDER BY peak DESC, label) AS place FROM (SELECT l AS label, count(*) AS cells, CAST(max(wet_dry) AS BIGINT) AS peak FROM core JOIN l24 ON n = r * 48 + c GROUP BY l)", "core", **_LABELS))
def fixed_echo_components(spark, sf_dir):
    """Connected cells of fixed echo, numbered by their peaks from the highest on; one row for each component is ordered in a task."""
    core = _core(spark, sf_dir)
    labels = G.components(core, TRIAL, stored(spark))
    found = labels.join(core, ["r", "c"]).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("cells"), F.max("wet_dry").alias("peak"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("peak"), "label")).cast("long"))


@query(sql("SELECT DISTINCT f, r // 8 AS br, c // 8 AS bc FROM (SELECT o.f, o.r + i AS r, o.c + j AS c FROM obs o, range(-2, 3) a(i), range(-2, 3) b(j) WHERE v IS NULL AND abs(i) + abs(j) <= 2) WHERE r BETWEEN 0 AND 31 AND c BETWEEN 0 AND 47", "obs"))
def dilation(spark, sf_dir):
    """Blocks that cells without coverage reach in two steps."""
    gone = raster.observed(trial.cells(spark, sf_dir)).where("v IS NULL")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2))
    near = gone.select("f", "r", "c", F.explode(steps).alias("d")).select("f", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).where("r BETWEEN 0 AND 31 AND c BETWEEN 0 AND 47")
    return near.select("f", F.floor(F.col("r") / 8).alias("br"), F.floor(F.col("c") / 8).alias("bc")).distinct()


@query(sql("SELECT r, c, n FROM (SELECT r, c, count(v) AS n FROM obs GROUP BY r, c), (SELECT count(DISTINCT f) AS m FROM obs) WHERE n >= 0.99 * m", "obs"))
def common_coverage(spark, sf_dir):
    """Cells covered in 99 % of the frames that are there."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    frames = seen.agg(F.count_distinct("f").alias("m"))
    return seen.groupBy("r", "c").agg(F.count("v").alias("n")).join(F.broadcast(frames)).where("n >= 0.99 * m").select("r", "c", "n")  # one row


@query(sql("SELECT x AS per_mille, count(*) FILTER (WHERE n_dry > 0 AND wet_dry * 1000 > x * n_dry) AS cells FROM clim, (VALUES (5), (10), (20), (40), (80)) t(x) GROUP BY x", "clim"))
def mask_sweep(spark, sf_dir):
    """Cells that each threshold would mask."""
    return _clim(spark, sf_dir).withColumn("per_mille", F.explode(F.array(*map(F.lit, (5, 10, 20, 40, 80))))).groupBy("per_mille").agg(F.count_if((F.col("n_dry") > 0) & (F.col("wet_dry") * 1000 > F.col("per_mille") * F.col("n_dry"))).alias("cells"))


@query(sql("SELECT id, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM st, (VALUES (7.0::DOUBLE, 54.5::DOUBLE, 12.0::DOUBLE, 54.2::DOUBLE), (12.0, 54.2, 13.5, 56.5), (13.5, 56.5, 10.0, 58.0), (10.0, 58.0, 9.5, 56.0), (9.5, 56.0, 7.0, 54.5)) e(x1, y1, x2, y2) GROUP BY id", **_ST))
def point_in_polygon(spark, sf_dir):
    """Even-odd crossings of a polygon's edges to the right of each point."""
    corners = [(7.0, 54.5), (12.0, 54.2), (13.5, 56.5), (10.0, 58.0), (9.5, 56.0)]
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    lat, lon = F.col("lat"), F.col("lon")
    crossed = sum((((F.lit(b) > lat) != (F.lit(d) > lat)) & (lon < (c - a) * (lat - b) / (d - b) + a)).cast("int") for (a, b), (c, d) in edges)
    return stations(spark, sf_dir).select("id", (crossed % 2 == 1).alias("inside"))


@query(sql("SELECT s.f, s.r, s.c, round(coalesce(x, 0), 3) AS v FROM (SELECT f, r, c FROM (SELECT DISTINCT f FROM obs), range(8) a(r), range(12) b(c)) s LEFT JOIN (SELECT f, r // 4 AS r, c // 4 AS c, avg(v) AS x FROM obs GROUP BY ALL) USING (f, r, c)", "obs"))
def coarsen(spark, sf_dir):
    """Means of four by four cells; without any covered cell, zero."""
    seen = raster.observed(trial.cells(spark, sf_dir))
    return seen.groupBy("f", F.floor(F.col("r") / 4).alias("r"), F.floor(F.col("c") / 4).alias("c")).agg(F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 3).alias("v"))


@query(sql("SELECT f, coalesce(max(v) FILTER (WHERE r BETWEEN 8 AND 20 AND c BETWEEN 10 AND 30), 0) AS peak FROM obs GROUP BY f", "obs"))
def region_peak(spark, sf_dir):
    inside = F.col("r").between(8, 20) & F.col("c").between(10, 30)
    return raster.observed(trial.cells(spark, sf_dir)).groupBy("f").agg(F.coalesce(F.max(F.when(inside, F.col("v"))), F.lit(0)).alias("peak"))


@query(sql("SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(5.0 + x / 640 * 11.5, 6) AS lon, round(58.5 - y / 480 * 4.6, 6) AS lat FROM (SELECT id, (lon - 5.0) / 11.5 * 640 AS x, (58.5 - lat) / 4.6 * 480 AS y FROM st)", **_ST))
def map_projection(spark, sf_dir):
    """Points on a 640 x 480 viewport, and back."""
    placed = stations(spark, sf_dir).select("id", ((F.col("lon") - 5.0) / 11.5 * 640).alias("x"), ((58.5 - F.col("lat")) / 4.6 * 480).alias("y"))
    return placed.select("id", r6("x").alias("x"), r6("y").alias("y"), r6(5.0 + F.col("x") / 640 * 11.5).alias("lon"), r6(58.5 - F.col("y") / 480 * 4.6).alias("lat"))


_BOX3 = {"xs": "SELECT f, r, c, sum(coalesce(v, 0)) OVER w AS a, sum({0}) OVER w AS b FROM obs WINDOW w AS (PARTITION BY f, r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "ys": "SELECT f, r, c, sum(a) OVER w AS s, sum(b) OVER w AS n FROM xs WINDOW w AS (PARTITION BY f, c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"}


def _box3(count):
    return {k: v.format(count) for k, v in _BOX3.items()}


@query(sql("SELECT f, r // 2 AS r, c // 2 AS c, round(CASE WHEN n / 9.0::DOUBLE >= 0.5 THEN CAST(s AS DOUBLE) / n END, 6) AS v FROM ys WHERE r % 2 = 1 AND c % 2 = 1", "obs", **_box3("CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END")))
def regrid_area(spark, sf_dir):
    seen = raster.observed(trial.cells(spark, sf_dir))
    return G.regrid(seen, 3, 16, 24, 2, "area").withColumn("v", r6("v"))


@query(sql("SELECT f, r // 2 AS r, c // 2 AS c, round(CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n ELSE 0.0 END, 6) AS v FROM ys WHERE r % 2 = 1 AND c % 2 = 1", "obs", **_box3("CASE WHEN v > 0 THEN 1 ELSE 0 END")))
def regrid_legacy(spark, sf_dir):
    seen = raster.observed(trial.cells(spark, sf_dir))
    return G.regrid(seen, 3, 16, 24, 2, "legacy").withColumn("v", r6("v"))


@query(sql("SELECT id, day, n, v FROM (SELECT id, CAST(trunc((58.5 - lat) / (58.5::DOUBLE - 53.9::DOUBLE) * 32) AS INTEGER) AS r, CAST(trunc((lon - 5.0) / (16.5::DOUBLE - 5.0::DOUBLE) * 48) AS INTEGER) AS c FROM st) p LEFT JOIN (SELECT r, c, f // 24 AS day, count(v) AS n, round(avg(v), 6) AS v FROM obs GROUP BY ALL) o USING (r, c)", "obs", **_ST))
def point_reading(spark, sf_dir):
    """Each day's mean of the cell under each station; days are summed up before they meet the stations."""
    r, c = G.cell_of(TRIAL, F.col("lat"), F.col("lon"))
    points = stations(spark, sf_dir).select("id", r.alias("r"), c.alias("c"))
    days = raster.observed(trial.cells(spark, sf_dir)).groupBy("r", "c", F.floor(F.col("f") / 24).alias("day")).agg(F.count("v").alias("n"), r6(F.avg("v")).alias("v"))
    return points.join(days, ["r", "c"], "left").select("id", "day", "n", "v")


# --- joins in time


def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", F.col("user_id").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.round("value", 2).alias("value"))


def _samples(spark, sf_dir):
    """One sample for each key and second."""
    return table(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("user_id").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value").groupBy("k", "t").agg(F.round(F.max("value"), 2).alias("value"))


_EV = {
    "l": "SELECT event_id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'click'",
    "s": "SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(max(value), 2) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL",
}


@query(sql("SELECT event_id, k, t, CASE WHEN t - st <= 43200 THEN value END AS value FROM (SELECT l.event_id, l.k, l.t, s.t AS st, s.value FROM l ASOF LEFT JOIN s ON l.k = s.k AND l.t >= s.t)", **_EV))
def asof_backward(spark, sf_dir):
    return asof.backward(_events(spark, sf_dir, "click").drop("value"), _samples(spark, sf_dir), "k", "t", "value", 43200)


@query(sql("SELECT event_id, k, t, round(CASE WHEN ta IS NULL OR tb IS NULL THEN NULL WHEN ta = tb THEN av ELSE av + (bv - av) * (t - ta) / (tb - ta) END, 6) AS value FROM (SELECT a.*, b.t AS tb, b.value AS bv FROM (SELECT l.event_id, l.k, l.t, s.t AS ta, s.value AS av FROM l ASOF LEFT JOIN s ON l.k = s.k AND l.t >= s.t) a ASOF LEFT JOIN s b ON a.k = b.k AND a.t <= b.t)", **_EV))
def asof_linear(spark, sf_dir):
    return asof.linear(_events(spark, sf_dir, "click").drop("value"), _samples(spark, sf_dir), "k", "t", "value").withColumn("value", r6("value"))


@query(sql("SELECT event_id, k, t, value FROM (SELECT l.event_id, l.k, l.t, s.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - s.t), s.t) AS n FROM l LEFT JOIN s ON l.k = s.k) WHERE n = 1", **_EV))
def nearest_in_time(spark, sf_dir):
    return asof.nearest(_events(spark, sf_dir, "click").drop("value"), _samples(spark, sf_dir), "k", "t", "value")


@query("SELECT a.event_id, a.user_id, CAST(floor(epoch(a.ts) / 300 + 0.5) AS BIGINT) AS slot, round(b.value, 2) AS truth FROM events a JOIN (SELECT user_id, CAST(floor(epoch(ts) / 300 + 0.5) AS BIGINT) AS slot, max(value) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND CAST(floor(epoch(a.ts) / 300 + 0.5) AS BIGINT) = b.slot WHERE a.event_type = 'click' AND a.event_id NOT IN (SELECT event_id FROM events WHERE value < 10)")
def pending_scored(spark, sf_dir):
    """Forecasts meet the truth of their rounded slot; those scored already are left out."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300 + 0.5).alias("slot"))
    done = e.where("value < 10").select("event_id")
    truth = e.where("event_type <> 'click'").groupBy("user_id", "slot").agg(F.round(F.max("value"), 2).alias("truth"))
    return e.where("event_type = 'click'").join(done, "event_id", "left_anti").join(truth, ["user_id", "slot"]).select("event_id", "user_id", "slot", "truth")


@query("SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN (11 * cents + 5) // 10 ELSE cents END AS cents, n.o_orderkey IS NOT NULL AS updated FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o LEFT JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') n USING (o_orderkey)")
def column_update(spark, sf_dir):
    """One column, in whole cents, rewritten where the newer table has the key; a newer key that the old table lacks is an error."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    new = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    both = old.join(new, "o_orderkey", "full")
    known = F.when(F.col("cents").isNull(), F.raise_error(F.concat(F.lit("no such order: "), F.col("o_orderkey").cast("string"))).cast("long")).otherwise(F.col("cents"))
    return both.select("o_orderkey", F.when(F.col("hit"), F.expr("(11 * cents + 5) div 10") + 0 * known).otherwise(known).alias("cents"), F.coalesce("hit", F.lit(False)).alias("updated"))


@query("SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events WHERE CAST(floor(epoch(ts) / 3600) AS BIGINT) NOT IN (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) FROM events WHERE event_type = 'purchase')")
def incremental_days(spark, sf_dir):
    """Hours that the index, here the hours of purchases, lacks."""
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    return e.select("hour").distinct().join(e.where("event_type = 'purchase'").select("hour").distinct(), "hour", "left_anti")


# --- stations and cities


@query(sql("SELECT a.id, round(median(b.v), 6) AS median3 FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM (SELECT a.id, b.id AS nid, pow((a.lon - b.lon) * cos(radians(56.0)), 2) + pow(a.lat - b.lat, 2) AS d FROM st a JOIN st b ON a.area = b.area AND a.id <> b.id)) a JOIN (SELECT c_custkey AS id, c_acctbal AS v FROM customer) b ON b.id = a.nid WHERE k <= 3 GROUP BY a.id", **_ST))
def gauge_neighbours(spark, sf_dir):
    """Median of the three nearest stations of the same area."""
    near = G.nearest(stations(spark, sf_dir).withColumnsRenamed({"lon": "x", "lat": "y"}), 3, stored(spark), math.cos(math.radians(56.0)))
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), F.col("c_acctbal").alias("v"))
    return near.join(v, near["other"] == v["nid"]).groupBy("id").agg(r6(F.percentile("v", F.lit(0.5))).alias("median3"))


@query(sql("SELECT id, other, round(d, 4) AS d FROM (SELECT a.id, b.id AS other, sqrt(pow((a.lon - b.lon) * 111.2 * cos(radians(56.0)), 2) + pow((a.lat - b.lat) * 111.2, 2)) AS d FROM st a, tr b) WHERE d <= 25", **_ST, tr="SELECT s_suppkey AS id, 5 + s_suppkey * 53 % 1000 / 1000.0::DOUBLE * 11.5 AS lon, 53.9 + s_suppkey * 29 % 1000 / 1000.0::DOUBLE * 4.6 AS lat FROM supplier"))
def station_near_tracks(spark, sf_dir):
    """Tracks (suppliers) within 25 km of each station."""
    k, x, y = F.col("s_suppkey"), F.col("lon") * 111.2 * F.cos(F.radians(F.lit(56.0))), F.col("lat") * 111.2
    tracks = table(spark, sf_dir, "supplier").select(k.alias("id"), (5 + k * 53 % 1000 / 1000 * 11.5).alias("lon"), (53.9 + k * 29 % 1000 / 1000 * 4.6).alias("lat"))
    at = lambda points: points.select("id", x.alias("x"), y.alias("y"))
    return G.near_pairs(at(stations(spark, sf_dir)), at(tracks), 25.0).withColumn("d", F.round("d", 4))


#: Trial cities: centre cells.
CITIES = {"north": (6, 12), "middle": (16, 24), "south": (26, 36)}


def _city_hours(spark, sf_dir, cell=1):
    """(event, f, city, model, mm, obs): means over the 3 x 3 cells of each city summed over the leads. cell: the trial's cells in a cell's side."""
    packed, grid = trial.packed(spark, sf_dir), GridSpec(TRIAL.rows // cell, TRIAL.cols // cell)
    frames = packed if cell == 1 else raster.coarsened(packed, cell)
    return score.window_hours(trial.issues(spark, sf_dir), frames, {n: (r // cell, c // cell) for n, (r, c) in CITIES.items()}, {"persistence": (0, 0), "shift": (2 // cell, 0)}, trial.LEADS, 1, grid)


_CITY = {
    "win": "SELECT city, cr + i AS r, cc + j AS c FROM (VALUES ('north', 6, 12), ('middle', 16, 24), ('south', 26, 36)) v(city, cr, cc), range(-1, 2) a(i), range(-1, 2) b(j)",
    "hours": "SELECT event, f, model, city, sum(p) AS mm, sum(t) AS obs FROM (SELECT event, f, model, lead, city, avg(p) AS p, avg(t) AS t FROM fc JOIN win USING (r, c) GROUP BY ALL) GROUP BY ALL HAVING count(t) = 3",
}


@query(sql("SELECT event, f, model, city, round(mm, 6) AS mm, round(obs, 6) AS obs FROM hours", "fc", **_CITY))
def city_hours(spark, sf_dir):
    return _city_hours(spark, sf_dir).withColumns({"mm": r6("mm"), "obs": r6("obs")})


@query(sql("SELECT model, city, count(*) AS n, count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS hit, count(*) FILTER (WHERE mm < 3 AND obs >= 3) AS miss, count(*) FILTER (WHERE mm >= 3 AND obs < 3) AS fa, round(avg(abs(mm - obs)), 6) AS err FROM hours GROUP BY model, city", "fc", **_CITY))
def city_scores(spark, sf_dir):
    p, t = F.col("mm") >= 3, F.col("obs") >= 3
    return _city_hours(spark, sf_dir).groupBy("model", "city").agg(F.count("*").alias("n"), F.count_if(p & t).alias("hit"), F.count_if(~p & t).alias("miss"), F.count_if(p & ~t).alias("fa"), r6(F.avg(F.abs(F.col("mm") - F.col("obs")))).alias("err"))


@query(sql("SELECT model, coalesce(city, 'all') AS city, round(CAST(count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS DOUBLE) / nullif(count(*) FILTER (WHERE mm >= 3 OR obs >= 3), 0), 6) AS csi FROM hours GROUP BY GROUPING SETS ((model, city), (model))", "fc", **_CITY))
def city_rollup(spark, sf_dir):
    p, t = F.col("mm") >= 3, F.col("obs") >= 3
    rolled = _city_hours(spark, sf_dir).rollup("model", "city").agg(F.try_divide(F.count_if(p & t).cast("double"), F.count_if(p | t).cast("double")).alias("csi")).where("model IS NOT NULL")
    return rolled.select("model", F.coalesce("city", F.lit("all")).alias("city"), r6("csi").alias("csi"))


@query(sql("SELECT model, round(CAST(sum(mm) AS DOUBLE) / nullif(sum(obs), 0), 6) AS ratio, round(corr(mm, obs), 6) AS corr, round(CAST(count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE obs >= 3)), 6) AS pod, round(CAST(count(*) FILTER (WHERE mm >= 3 AND obs < 3) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE mm >= 3)), 6) AS far, round(CAST(count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE mm >= 3 OR obs >= 3)), 6) AS csi, count(*) FILTER (WHERE mm >= 3 AND obs < 3) AS wet_dry FROM hours GROUP BY model", "fc", **_CITY))
def gauge_scores(spark, sf_dir):
    p, t = F.col("mm") >= 3, F.col("obs") >= 3
    one = lambda c: F.greatest(F.lit(1), F.count_if(c))
    return _city_hours(spark, sf_dir).groupBy("model").agg(r6(F.try_divide(F.sum("mm"), F.sum("obs"))).alias("ratio"), r6(F.corr("mm", "obs")).alias("corr"), r6(F.count_if(p & t) / one(t)).alias("pod"), r6(F.count_if(p & ~t) / one(p)).alias("far"), r6(F.count_if(p & t) / one(p | t)).alias("csi"), F.count_if(p & ~t).alias("wet_dry"))


@query("SELECT l_suppkey, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) AS b FROM lineitem) GROUP BY l_suppkey")
def rank_corr(spark, sf_dir):
    """Correlation of ordinal ranks, ties by position."""
    line = table(spark, sf_dir, "lineitem")
    rank = lambda *c: F.row_number().over(Window.partitionBy("l_suppkey").orderBy(c[0], "l_orderkey", "l_linenumber", "l_partkey", c[1], "l_discount"))
    return line.select("l_suppkey", rank("l_quantity", "l_extendedprice").alias("a"), rank("l_extendedprice", "l_quantity").alias("b")).groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.corr("a", "b")).alias("rho"))


# --- point series


def _series(spark, sf_dir):
    """(k, t, mm, kind): observed hours, then a nowcast, then an outlook only after the nowcast's end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("t"), "event_type", "value")
    hourly = e.groupBy("k", "t").agg(F.round(F.sum("value"), 2).alias("mm"))
    top = hourly.agg(F.max("t").alias("end"))
    placed = hourly.join(F.broadcast(top)).withColumn("kind", F.when(F.col("t") <= F.col("end") - 48, "observed").when(F.col("t") <= F.col("end") - 24, "nowcast"))  # one row
    outlook = hourly.join(F.broadcast(top)).where("t > end - 36").withColumn("kind", F.lit("outlook"))
    end = placed.where("kind = 'nowcast'").groupBy("k").agg(F.max("t").alias("upto"))
    later = outlook.join(end, "k", "left").where("upto IS NULL OR t > upto").select("k", "t", "mm", "kind")
    return placed.where("kind IS NOT NULL").select("k", "t", "mm", "kind").unionByName(later)


_SER = {
    "hourly": "SELECT user_id AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, round(sum(value), 2) AS mm FROM events GROUP BY ALL",
    "fin": "SELECT max(t) AS fin FROM hourly",
    "placed": "SELECT k, t, mm, CASE WHEN t <= fin - 48 THEN 'observed' WHEN t <= fin - 24 THEN 'nowcast' END AS kind FROM hourly, fin",
    "series": "SELECT * FROM placed WHERE kind IS NOT NULL UNION ALL SELECT k, t, mm, 'outlook' FROM hourly h, fin WHERE t > fin - 36 AND t > coalesce((SELECT max(t) FROM placed p WHERE p.k = h.k AND kind = 'nowcast'), -1)",
}


@query(sql("SELECT * FROM series", **_SER))
def point_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query(sql("""SELECT k, current, peak, first_wet, last_wet, first_dry, CASE WHEN current >= 500 AND first_dry IS NOT NULL THEN 'rain, dry in ' || (first_dry - now) || ' h' WHEN current >= 500 THEN 'rain now'
WHEN first_wet IS NOT NULL THEN 'rain in ' || (first_wet - now) || ' h' WHEN last_wet IS NOT NULL AND now - last_wet <= 24 THEN 'dry since ' || (now - last_wet) || ' h' ELSE 'dry' END AS text FROM
(SELECT k, arg_max(mm, t) FILTER (WHERE kind = 'observed') AS current, max(t) FILTER (WHERE kind = 'observed') AS now, max(mm) FILTER (WHERE kind <> 'observed') AS peak, min(t) FILTER (WHERE kind <> 'observed' AND mm >= 500) AS first_wet,
max(t) FILTER (WHERE kind = 'observed' AND mm >= 500) AS last_wet, min(t) FILTER (WHERE kind <> 'observed' AND mm < 500) AS first_dry FROM series GROUP BY k)""", **_SER))
def point_summary(spark, sf_dir):
    """Current amount, peak ahead, first and last wet and first dry hour, and a sentence."""
    seen, ahead, wet, t = F.col("kind") == "observed", F.col("kind") != "observed", F.col("mm") >= 500, F.col("t")
    each = _series(spark, sf_dir).groupBy("k").agg(
        F.max_by("mm", F.when(seen, t)).alias("current"), F.max(F.when(seen, t)).alias("now"), F.max(F.when(ahead, F.col("mm"))).alias("peak"),
        F.min(F.when(ahead & wet, t)).alias("first_wet"), F.max(F.when(seen & wet, t)).alias("last_wet"), F.min(F.when(ahead & ~wet, t)).alias("first_dry"),
    )
    hours = lambda a, b: (F.col(a) - F.col(b)).cast("string")
    text = (
        F.when((F.col("current") >= 500) & F.col("first_dry").isNotNull(), F.concat(F.lit("rain, dry in "), hours("first_dry", "now"), F.lit(" h"))).when(F.col("current") >= 500, "rain now")
        .when(F.col("first_wet").isNotNull(), F.concat(F.lit("rain in "), hours("first_wet", "now"), F.lit(" h"))).when(F.col("now") - F.col("last_wet") <= 24, F.concat(F.lit("dry since "), hours("now", "last_wet"), F.lit(" h"))).otherwise("dry")
    )
    return each.select("k", "current", "peak", "first_wet", "last_wet", "first_dry", text.alias("text"))


# --- ingest


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, min(event_id) AS first FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def stac_items(spark, sf_dir):
    """JSON items parsed with a schema; malformed ones are left out, the first of a key is kept."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int")).where("p.k IS NOT NULL")
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(sql("SELECT s.r, s.c, round(coalesce(v, 0), 6) AS v FROM (SELECT r, c FROM range(14) a(r), range(20) b(c)) s LEFT JOIN (SELECT least(13, CAST(floor((58.5 - lat) / 4.6 * 14) AS BIGINT)) AS r, least(19, CAST(floor((lon - 5.0) / 11.5 * 20) AS BIGINT)) AS c, avg(greatest(0, c_acctbal)) AS v FROM st JOIN customer ON id = c_custkey WHERE lat BETWEEN 53.9 AND 58.5 AND lon BETWEEN 5.0 AND 16.5 GROUP BY ALL) USING (r, c)", **_ST))
def geojson_grid(spark, sf_dir):
    """GeoJSON points to a grid of means: parsed from text, clipped to the bounds, empty cells zero."""
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    feature = F.to_json(F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("c_acctbal").alias("rate")).alias("properties")))
    text = stations(spark, sf_dir).join(v, "id").select(feature.alias("text"))
    p = text.select(F.from_json("text", "geometry struct<coordinates:array<double>>, properties struct<rate:double>").alias("j")).select(F.col("j.geometry.coordinates")[0].alias("lon"), F.col("j.geometry.coordinates")[1].alias("lat"), F.col("j.properties.rate").alias("v")).where("lat BETWEEN 53.9 AND 58.5 AND lon BETWEEN 5.0 AND 16.5")
    r, c = F.least(F.lit(13), F.floor((58.5 - F.col("lat")) / 4.6 * 14)), F.least(F.lit(19), F.floor((F.col("lon") - 5.0) / 11.5 * 20))
    means = p.groupBy(r.cast("int").alias("r"), c.cast("int").alias("c")).agg(F.avg(F.greatest(F.lit(0.0), "v")).alias("v"))
    spine = spark.range(14).select(F.col("id").cast("int").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return spine.join(means, ["r", "c"], "left").withColumn("v", r6(F.coalesce("v", F.lit(0.0))))


@query("SELECT user_id, hour, click, view FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, round(max(value) FILTER (WHERE event_type = 'click'), 2) AS click, round(max(value) FILTER (WHERE event_type = 'view'), 2) AS view FROM events GROUP BY ALL) WHERE click IS NOT NULL AND view IS NOT NULL")
def station_pivot(spark, sf_dir):
    """Two parameters of a station and hour side by side; incomplete ones are dropped."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "event_type", "value")
    return e.groupBy("user_id", "hour").pivot("event_type", ["click", "view"]).agg(F.round(F.max("value"), 2)).na.drop()


@query("SELECT event_type, t // 3600 AS hour, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, CAST(floor(epoch(ts)) AS BIGINT) - 1 AS t FROM events) GROUP BY ALL")
def gauge_hours(spark, sf_dir):
    """Right-closed hours: a stamp on the hour belongs to the hour that ends there."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(t / 3600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT band, level, count(*) AS n, round(avg(v), 6) AS v FROM (SELECT l_suppkey % 4 AS band, l_returnflag AS level, l_quantity * 3.6 AS v FROM lineitem UNION ALL SELECT l_suppkey % 4, 'layer', avg(l_quantity) * 3.6 FROM lineitem GROUP BY l_suppkey % 4, l_orderkey, l_shipdate) GROUP BY ALL")
def wind_levels(spark, sf_dir):
    """Levels and the mean over levels as one more, in km/h."""
    line = table(spark, sf_dir, "lineitem").withColumn("band", F.col("l_suppkey") % 4)
    layer = line.groupBy("band", "l_orderkey", "l_shipdate").agg((F.avg("l_quantity") * 3.6).alias("v")).select("band", F.lit("layer").alias("level"), "v")
    both = line.select("band", F.col("l_returnflag").alias("level"), (F.col("l_quantity") * 3.6).alias("v")).unionByName(layer)
    return both.groupBy("band", "level").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("v"))
