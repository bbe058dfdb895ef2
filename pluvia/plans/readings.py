"""Queries of single places: wind of stations against the tracks around them, readings with and without fading, a line for each point, masks from storage, vectors of filled fields."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.functions.text import format_lead, format_mm
from pluvia.operators import forecast, motion, pool, score
from pluvia.operators import geometry as G
from pluvia.plans import analyses, movement, studies, trial
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


# --- stations and tracks

#: The trial's cells are taken as so many km wide here, and tracks within NEAR_KM of a station as near.
CELL_KM, NEAR_KM = 10.0, 100.0
_HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
_TRACKS = {
    "tracks": f"SELECT f, (cc + 0.5::DOUBLE) * {CELL_KM}::DOUBLE AS x, (rr + 0.5::DOUBLE) * {CELL_KM}::DOUBLE AS y, vc * {CELL_KM}::DOUBLE AS u, -vr * {CELL_KM}::DOUBLE AS v FROM (SELECT f0 + k AS f, r0 + vr * k AS rr, c0 + vc * k AS cc, vr, vc FROM showers, range(6) t(k))",
    "places": f"SELECT id, (lon - 5.0::DOUBLE) / 11.5::DOUBLE * {TRIAL.cols * CELL_KM}::DOUBLE AS x, (58.5::DOUBLE - lat) / 4.6::DOUBLE * {TRIAL.rows * CELL_KM}::DOUBLE AS y FROM st",
    "blown": f"SELECT f, id, speed, -speed * sin(radians(origin)) AS wu, -speed * cos(radians(origin)) AS wv FROM (SELECT user_id AS id, {_HOUR} AS f, arg_max(value, event_id) / 10.0::DOUBLE * 3.6::DOUBLE AS speed, CAST(max(event_id) * 73 % 360 AS DOUBLE) AS origin FROM events GROUP BY ALL)",
    "around": f"SELECT f, id, avg(u) AS u, avg(v) AS v FROM places s JOIN tracks t ON (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= {NEAR_KM * NEAR_KM}::DOUBLE GROUP BY f, id HAVING count(*) >= 3",
    "met": "SELECT speed / sqrt(u * u + v * v) AS ratio, degrees(atan2(u * wv - v * wu, u * wu + v * wv)) AS turn FROM around JOIN blown USING (f, id) WHERE sqrt(u * u + v * v) >= 10 AND speed >= 1",
}


def _tracks(spark, sf_dir):
    """(f, x, y, u, v): where each shower is in its frames, and its motion to the east and north, in km."""
    moved = raster.showers(raster.table(spark, sf_dir, "events")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    at = lambda place, by: (F.col(place) + F.col(by) * F.col("k") + F.lit(0.5)) * CELL_KM
    return moved.select((F.col("f0") + F.col("k")).alias("f"), at("c0", "vc").alias("x"), at("r0", "vr").alias("y"), (F.col("vc") * CELL_KM).alias("u"), (-F.col("vr") * CELL_KM).alias("v"))


def _station_wind(spark, sf_dir):
    """(f, id, speed, wu, wv): the last event of a user and hour as a station's wind, in km/h, towards the east and north."""
    e = raster.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("f"), "value")
    last = e.groupBy("id", "f").agg((F.max_by("value", "event_id") / 10.0 * 3.6).alias("speed"), F.radians((F.max("event_id") * 73 % 360).cast("double")).alias("origin"))
    return last.select("f", "id", "speed", (-F.col("speed") * F.sin("origin")).alias("wu"), (-F.col("speed") * F.cos("origin")).alias("wv"))


@query(sql(f"SELECT count(*) AS pairs, {studies._quartiles_sql('ratio', ('ratio25', 'ratio50', 'ratio75'))}, {studies._quartiles_sql('turn', ('turn25', 'turn50', 'turn75'))}, round(avg(CASE WHEN abs(turn) <= 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS within_30 FROM met", "showers", **analyses._ST, **_TRACKS))
def station_tracks(spark, sf_dir):
    """The wind of stations against the mean motion of the three or more tracks near them: speed ratio, turn, and the share within 30 degrees."""
    places = analyses.stations(spark, sf_dir).select("id", ((F.col("lon") - 5.0) / 11.5 * (TRIAL.cols * CELL_KM)).alias("x"), ((58.5 - F.col("lat")) / 4.6 * (TRIAL.rows * CELL_KM)).alias("y"))
    wind = _station_wind(spark, sf_dir)
    rain = G.near_means(wind.select("f", "id").join(places, "id"), _tracks(spark, sf_dir), NEAR_KM)
    u, v, wu, wv = (F.col(c) for c in ("u", "v", "wu", "wv"))
    met = rain.join(wind, ["f", "id"]).where((F.sqrt(u * u + v * v) >= 10) & (F.col("speed") >= 1))
    each = stored(spark)(met.select((F.col("speed") / F.sqrt(u * u + v * v)).alias("ratio"), F.degrees(F.atan2(u * wv - v * wu, u * wu + v * wv)).alias("turn")))
    quarters = [r6(F.lit(x).cast("double")).alias(f"{c}{p}") for c in ("ratio", "turn") for p, x in zip((25, 50, 75), pool.quantiles(each, c, (0.25, 0.5, 0.75)), strict=True)]
    return each.agg(F.count("*").alias("pairs"), *quarters, r6(F.avg((F.abs("turn") <= 30).cast("double"))).alias("within_30"))


# --- readings of points

_WIDE = "SELECT id, 4 + id * 41 % 1000 / 1000.0::DOUBLE * 13.5 AS lon, 53.4 + id * 67 % 1000 / 1000.0::DOUBLE * 5.6 AS lat FROM st"
_INSIDE = "lat BETWEEN 53.9 AND 58.5 AND lon BETWEEN 5.0 AND 16.5"


@query(sql(f"SELECT id, lead, CASE WHEN r IS NOT NULL THEN round(raw, 6) END AS raw, CASE WHEN r IS NOT NULL THEN round(raw * (1 - 0.7::DOUBLE * (lead - 1) / 2), 6) END AS faded FROM (SELECT id, lead, CASE WHEN {_INSIDE} THEN least({TRIAL.rows - 1}, CAST(trunc((58.5 - lat) / (58.5::DOUBLE - 53.9::DOUBLE) * {TRIAL.rows}) AS INTEGER)) END AS r, CASE WHEN {_INSIDE} THEN least({TRIAL.cols - 1}, CAST(trunc((lon - 5.0) / (16.5::DOUBLE - 5.0::DOUBLE) * {TRIAL.cols}) AS INTEGER)) END AS c FROM wide, range(1, 4) l(lead)) LEFT JOIN said USING (r, c, lead)", "fc", **analyses._ST, wide=_WIDE, said="SELECT r, c, lead, avg(p) AS raw FROM fc WHERE model = 'shift' GROUP BY ALL"))
def nowcast_readings(spark, sf_dir):
    """The mean forecast at each point and lead, as it is and faded as maps show it; NULL outside the grid. Cells are summed up before they meet the points."""
    n = F.col("id")
    points = analyses.stations(spark, sf_dir).select("id", (4 + n * 41 % 1000 / 1000 * 13.5).alias("lon"), (53.4 + n * 67 % 1000 / 1000 * 5.6).alias("lat"))
    inside = F.col("lat").between(TRIAL.south, TRIAL.north) & F.col("lon").between(TRIAL.west, TRIAL.east)
    r, c = G.cell_of(TRIAL, F.col("lat"), F.col("lon"))
    cells = points.select("id", F.when(inside, F.least(r, F.lit(TRIAL.rows - 1))).alias("r"), F.when(inside, F.least(c, F.lit(TRIAL.cols - 1))).alias("c"), F.explode(F.sequence(F.lit(1), F.lit(trial.LEADS))).alias("lead"))
    said = trial.pairs(spark, sf_dir).where("model = 'shift'").groupBy("r", "c", "lead").agg(F.avg("p").alias("raw"))
    return cells.join(said, ["r", "c", "lead"], "left").select("id", "lead", r6("raw").alias("raw"), r6(F.col("raw") * forecast.fade(F.col("lead"), trial.LEADS, 0.3)).alias("faded"))


_MM = "CASE WHEN {0} < 10 THEN printf('%.1f mm/h', floor({0} * 10 + 0.5) / 10) ELSE printf('%d mm/h', CAST(floor(floor({0} * 10 + 0.5) / 10 + 0.5) AS BIGINT)) END"
_H = "({0} || ' h')"


@query(sql(f"""SELECT k, current, peak, CASE WHEN current IS NULL THEN 'no reading yet'
WHEN current >= 2 AND peak >= 2.5 AND peak > current * 1.5 AND peak_in > 0 THEN 'rain, ' || {_MM.format('current')} || ', up to ' || {_MM.format('peak')} || ' in ' || {_H.format('peak_in')}
WHEN current >= 2 AND dry_in IS NOT NULL THEN 'rain, ' || {_MM.format('current')} || ', dry within ' || {_H.format('dry_in')} WHEN current >= 2 THEN 'rain, ' || {_MM.format('current')}
WHEN first_in IS NOT NULL THEN 'dry, rain in ' || {_H.format('first_in')} || ', up to ' || {_MM.format('peak')} ELSE 'dry' END AS line FROM
(SELECT k, current, peak, peak_in, first_in, CASE WHEN last_at > coalesce(last_wet, 0) THEN dry_at - fin + 48 END AS dry_in FROM (SELECT k, arg_max(x, t) FILTER (WHERE kind = 'observed') AS current, max(x) FILTER (WHERE kind = 'nowcast') AS peak,
max(t) FILTER (WHERE kind = 'nowcast') AS last_at, max(wet) AS last_wet, min(t) FILTER (WHERE kind = 'nowcast' AND x >= 2) - any_value(fin) + 48 AS first_in, min(t) FILTER (WHERE kind = 'nowcast' AND t > coalesce(wet, 0)) AS dry_at, any_value(fin) AS fin,
min(t) FILTER (WHERE kind = 'nowcast' AND x = top) - any_value(fin) + 48 AS peak_in FROM placed2 GROUP BY k))""", **analyses._SER,
    placed2="SELECT k, t, mm / 100 AS x, kind, fin, max(CASE WHEN kind = 'nowcast' AND mm / 100 >= 2 THEN t END) OVER (PARTITION BY k) AS wet, max(CASE WHEN kind = 'nowcast' THEN mm / 100 END) OVER (PARTITION BY k) AS top FROM series, fin"))
def point_lines(spark, sf_dir):
    """A line for each point: what falls now, the peak ahead if it is much more, else how soon it is dry; where it is dry, when rain comes. 2 mm/h and more is rain.

    One aggregate by point keeps the nowcast's hours as an array (a nowcast has few); the rules read it.
    """
    series = analyses._series(spark, sf_dir).withColumn("x", F.col("mm") / 100)
    top = raster.table(spark, sf_dir, "events").agg(F.floor(F.unix_timestamp(F.max("ts").cast("timestamp")) / 3600).alias("fin"))
    ahead = F.array_sort(F.collect_list(F.when(F.col("kind") == "nowcast", F.struct("t", "x"))))
    each = series.groupBy("k").agg(F.max_by("x", F.when(F.col("kind") == "observed", F.col("t"))).alias("current"), ahead.alias("n")).join(F.broadcast(top))  # one row
    hours = lambda t: t - F.col("fin") + 48
    wet = F.filter("n", lambda p: p["x"] >= 2)
    peak = F.array_max(F.transform("n", lambda p: p["x"]))
    facts = each.select("k", "current", peak.alias("peak"), "fin", "n", F.get(wet, F.lit(0))["t"].alias("first"), F.get(F.reverse(wet), F.lit(0))["t"].alias("last"))
    after = F.filter("n", lambda p: F.col("last").isNull() | (p["t"] > F.col("last")))  # none if the last hour is wet
    facts = facts.withColumns({"dry_in": hours(F.get(after, F.lit(0))["t"]), "first_in": hours(F.col("first")), "peak_in": hours(F.get(F.filter("n", lambda p: p["x"] == F.col("peak")), F.lit(0))["t"])})
    mm = lambda c: format_mm(F.floor(F.col(c) * 10 + 0.5) / 10)
    lead = lambda c: format_lead(F.col(c) * 60)
    now, rain = mm("current"), F.col("current") >= 2
    line = (
        F.when(F.col("current").isNull(), "no reading yet")
        .when(rain & (F.col("peak") >= 2.5) & (F.col("peak") > F.col("current") * 1.5) & (F.col("peak_in") > 0), F.concat(F.lit("rain, "), now, F.lit(", up to "), mm("peak"), F.lit(" in "), lead("peak_in")))
        .when(rain & F.col("dry_in").isNotNull(), F.concat(F.lit("rain, "), now, F.lit(", dry within "), lead("dry_in")))
        .when(rain, F.concat(F.lit("rain, "), now))
        .when(F.col("first_in").isNotNull(), F.concat(F.lit("dry, rain in "), lead("first_in"), F.lit(", up to "), mm("peak"))).otherwise("dry")
    )
    return facts.select("k", "current", "peak", line.alias("line"))


#: Views of a map in pixels, and what a degree of longitude counts as in degrees of latitude.
VIEWS, STRETCH = ((640, 480), (300, 900), (16, 12)), 0.5563
_WIDE_KM, _HIGH = f"(11.5::DOUBLE * {STRETCH}::DOUBLE)", "(58.5::DOUBLE - 53.9::DOUBLE)"


@query(sql(f"SELECT id, w, inside, round(px, 6) AS x, round(py, 6) AS y, CASE WHEN scale > 0 THEN round(5.0::DOUBLE + (px - x0) / ({STRETCH}::DOUBLE * scale), 6) END AS lon, CASE WHEN scale > 0 THEN round(58.5::DOUBLE - (py - y0) / scale, 6) END AS lat FROM (SELECT *, x0 + (lon - 5.0::DOUBLE) * {STRETCH}::DOUBLE * scale AS px, y0 + (58.5::DOUBLE - lat) * scale AS py FROM (SELECT *, {_INSIDE} AS inside, (w - {_WIDE_KM} * scale) / 2 AS x0, (h - {_HIGH} * scale) / 2 AS y0 FROM (SELECT *, greatest(0.0::DOUBLE, least((w - 16) / {_WIDE_KM}, (h - 16) / {_HIGH})) AS scale FROM wide, (VALUES {', '.join(map(str, VIEWS))}) v(w, h))))", **analyses._ST, wide=_WIDE))
def map_view(spark, sf_dir):
    """Points in views of several sizes that the map is fitted into, whether the map holds them, and back from pixels; NULL where a view is too small."""
    n = F.col("id")
    points = analyses.stations(spark, sf_dir).select("id", (4 + n * 41 % 1000 / 1000 * 13.5).alias("lon"), (53.4 + n * 67 % 1000 / 1000 * 5.6).alias("lat"), F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in VIEWS))).alias("view"))
    scale, x0, y0 = G.view(TRIAL, F.col("view.w"), F.col("view.h"), STRETCH)
    placed = points.withColumns({"scale": scale, "x0": x0, "y0": y0}).withColumns({"px": F.col("x0") + (F.col("lon") - TRIAL.west) * STRETCH * F.col("scale"), "py": F.col("y0") + (TRIAL.north - F.col("lat")) * F.col("scale")})
    inside = F.col("lat").between(TRIAL.south, TRIAL.north) & F.col("lon").between(TRIAL.west, TRIAL.east)
    back = lambda c: F.when(F.col("scale") > 0, r6(c))
    return placed.select("id", F.col("view.w").alias("w"), inside.alias("inside"), r6("px").alias("x"), r6("py").alias("y"), back(TRIAL.west + (F.col("px") - F.col("x0")) / (STRETCH * F.nullif(F.col("scale"), F.lit(0.0)))).alias("lon"), back(TRIAL.north - (F.col("py") - F.col("y0")) / F.nullif(F.col("scale"), F.lit(0.0))).alias("lat"))


# --- listings and levels

#: Items of a page, and how many of them the page before lists too.
PAGE, OVERLAP = 300, 20


@query(f"SELECT event_type, day, id, row_number() OVER (PARTITION BY event_type, day ORDER BY ts, id) AS place FROM (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, ts, event_id AS id FROM events WHERE value >= 20 AND (event_id // {PAGE} % 7 <> 3 OR event_id % {PAGE} < {OVERLAP} AND (event_id // {PAGE} - 1) % 7 <> 3 AND event_id >= {PAGE}) AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view' AND value < 100))")
def listing_new(spark, sf_dir):
    """New items of a paged listing, each day's in order of time: pages that are cut short and items without a link are skipped, items that two pages list count once, those held already are left out."""
    e = raster.table(spark, sf_dir, "events")
    own = F.floor(F.col("event_id") / PAGE)
    pages = F.array_compact(F.array(own, F.when((F.col("event_id") % PAGE < OVERLAP) & (own > 0), own - 1)))
    item = F.struct(F.col("event_id").alias("id"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind")).alias("properties"), F.when(F.col("value") >= 20, F.concat(F.lit("scan/"), F.col("event_id").cast("string"))).alias("href"))
    text = e.select(F.explode(pages).alias("page"), item.alias("item")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("item").alias("features"))).alias("text"))  # PAGE + OVERLAP items
    sent = text.select(F.when(F.col("page") % 7 == 3, F.expr("left(text, length(text) - 9)")).otherwise(F.col("text")).alias("text"))
    listed = sent.select(F.from_json("text", "features array<struct<id:bigint,properties:struct<at:bigint,kind:string>,href:string>>, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("j")).where("j.bad IS NULL").select(F.explode("j.features").alias("x"))
    items = listed.where("x.id IS NOT NULL AND x.properties.at IS NOT NULL AND x.href IS NOT NULL").select("x.id", F.col("x.properties.at").alias("at"), F.col("x.properties.kind").alias("event_type")).distinct()
    new = items.join(e.where("event_type = 'view' AND value < 100").select(F.col("event_id").alias("id")), "id", "left_anti").withColumn("day", F.floor(F.col("at") / 86_400_000_000))
    return new.select("event_type", "day", "id", F.row_number().over(Window.partitionBy("event_type", "day").orderBy("at", "id")).alias("place"))


#: Levels in the order in which they are declared; their mean follows as one more.
LEVELS = ("R", "N", "A")


@query("""WITH w AS (SELECT date_trunc('month', l_shipdate) AS t, l_returnflag AS level, l_suppkey % 4 AS lat, avg(l_quantity) * 3.6 AS v FROM lineitem GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY t) AS time_no, CASE level WHEN 'R' THEN 1 WHEN 'N' THEN 2 WHEN 'A' THEN 3 ELSE 4 END AS level_no, dense_rank() OVER (ORDER BY lat) AS row_no, round(v, 6) AS v FROM (SELECT * FROM w UNION ALL SELECT t, 'layer', lat, avg(v) FROM w GROUP BY t, lat)""")
def wind_order(spark, sf_dir):
    """A wind cube in order: times ascending, levels as declared and then their mean, latitudes ascending, in km/h."""
    line = raster.table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("t"), F.col("l_returnflag").alias("level"), (F.col("l_suppkey") % 4).alias("lat"), "l_quantity")
    each = line.groupBy("t", "level", "lat").agg((F.avg("l_quantity") * 3.6).alias("v"))
    cube = each.unionByName(each.groupBy("t", "lat").agg(F.avg("v").alias("v")).withColumn("level", F.lit("layer")))
    level = F.array_position(F.array(*map(F.lit, (*LEVELS, "layer"))), F.col("level"))
    rank = lambda c: F.dense_rank().over(Window.orderBy(c))  # noqa: E731  one row for each time, level and latitude
    return cube.select(rank("t").alias("time_no"), level.alias("level_no"), rank("lat").alias("row_no"), r6("v").alias("v"))


# --- masks and vectors


@query(sql("SELECT f, count(v) AS n, count(*) FILTER (WHERE v >= 2) AS wet FROM obs LEFT JOIN mask USING (r, c) WHERE NOT coalesce(masked, FALSE) GROUP BY f", "obs", "core", mask=f"SELECT r, c, TRUE AS masked FROM ({analyses._MASK})"))
def masked_coverage(spark, sf_dir):
    """Covered and wet cells of each frame outside the fixed-echo mask, which is stored with its grid's shape and checked when it is read."""
    kept = stored(spark)(G.packed_mask(analyses.fixed_echo_mask(spark, sf_dir), TRIAL))
    mask = G.mask_cells(kept, TRIAL)
    seen = raster.observed(trial.cells(spark, sf_dir)).join(F.broadcast(mask), ["r", "c"], "left_anti")  # a grid's cells at most
    return seen.groupBy("f").agg(F.count("v").alias("n"), F.count_if(F.col("v") >= 2).alias("wet"))


_KINDS = {
    "filled": "SELECT 'filled' AS variant, f, sum(dx * conf) / nullif(sum(conf), 0) AS dx, sum(dy * conf) / nullif(sum(conf), 0) AS dy FROM filled GROUP BY f",
    "filled_shrunk": "SELECT 'filled_shrunk', f, sum(dx * least(1.0, conf / 0.3) * conf) / nullif(sum(conf), 0), sum(dy * least(1.0, conf / 0.3) * conf) / nullif(sum(conf), 0) FROM filled GROUP BY f",
    "three_pairs": "SELECT 'three_pairs', f, dx, dy FROM three",
    "last_pair": "SELECT 'last_pair', f, v.dx, v.dy FROM vec v JOIN three USING (f)",
}


@query(sql("SELECT variant, count(*) AS n, round(avg(along), 6) AS mean, round(quantile_cont(along, 0.5), 6) AS median FROM (SELECT variant, (dx * wx + dy * wy) / (wx * wx + wy * wy) AS along FROM variants JOIN wind USING (f) WHERE dx IS NOT NULL) GROUP BY variant", "showers", "dense", **movement._match("shrunk"), **movement._filled("soft"), **studies._WIND,
    three="SELECT a.f, avg(b.dx) AS dx, avg(b.dy) AS dy FROM vec a JOIN vec b ON b.f BETWEEN a.f - 2 AND a.f GROUP BY a.f HAVING count(*) = 3", variants=" UNION ALL ".join(_KINDS.values())))
def vector_fills(spark, sf_dir):
    """How much of the wind the vectors of filled fields find, and one pair's vector against the mean of three."""
    filled = movement._blocks(spark, sf_dir, smoothed=True, filled=True)
    one = motion.pair_vectors(movement._blocks(spark, sf_dir))
    last = Window.orderBy("f").rangeBetween(-2, 0)  # one row a frame
    three = one.withColumns({"x": F.avg("dx").over(last), "y": F.avg("dy").over(last), "have": F.count("*").over(last)}).where("have = 3")
    made = [motion.pair_vectors(filled).withColumn("variant", F.lit("filled")), motion.pair_vectors(filled, True).withColumn("variant", F.lit("filled_shrunk"))]
    made += [three.select(F.lit("three_pairs").alias("variant"), "f", F.col("x").alias("dx"), F.col("y").alias("dy")), three.select(F.lit("last_pair").alias("variant"), "f", "dx", "dy")]
    all_ = made[0]
    for m in made[1:]:
        all_ = all_.unionByName(m)
    along = (F.col("dx") * F.col("wx") + F.col("dy") * F.col("wy")) / (F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy"))
    return all_.where("dx IS NOT NULL").join(studies._wind(spark, sf_dir), "f").withColumn("along", along).groupBy("variant").agg(F.count("*").alias("n"), r6(F.avg("along")).alias("mean"), r6(F.percentile("along", F.lit(0.5))).alias("median"))


# --- two grids

_COARSE_CITY = {
    "fc2": "SELECT event, m.f, model, lead, m.r, m.c, coalesce(v, 0) AS p, t FROM met2 m JOIN obs2 o ON o.f = m.f AND o.r = m.r AND o.c = m.pc",
    "win2": analyses._CITY["win"].replace("cr + i", "cr // 2 + i").replace("cc + j", "cc // 2 + j"),
    "hours2": analyses._CITY["hours"].replace("FROM fc JOIN win ", "FROM fc2 JOIN win2 "),
}


@query(sql("SELECT side, model, city, count(*) AS n, round(CAST(count(*) FILTER (WHERE mm >= 3 AND obs >= 3) AS DOUBLE) / nullif(count(*) FILTER (WHERE mm >= 3 OR obs >= 3), 0), 6) AS csi FROM (SELECT 1 AS side, model, city, mm, obs FROM hours UNION ALL SELECT 2, model, city, mm, obs FROM hours2) GROUP BY ALL", "fc", "asked", **analyses._CITY, **{k: studies._COARSE[k] for k in ("obs2", "met2")}, **_COARSE_CITY))
def grid_cities(spark, sf_dir):
    """CSI of rain at cities on the trial grid (side 1) and on one of half its resolution (side 2)."""
    hours = analyses._city_hours(spark, sf_dir).withColumn("side", F.lit(1)).unionByName(analyses._city_hours(spark, sf_dir, 2).withColumn("side", F.lit(2)))
    p, t = F.col("mm") >= 3, F.col("obs") >= 3
    return hours.groupBy("side", "model", "city").agg(F.count("*").alias("n"), r6(F.try_divide(F.count_if(p & t).cast("double"), F.count_if(p | t).cast("double"))).alias("csi"))


@query(sql("SELECT lead, count(*) AS n, round(avg(CASE WHEN CAST(ce0 AS DOUBLE) / cr0 - CAST(ce AS DOUBLE) / cr > CAST(e0 AS DOUBLE) / r0 - CAST(e AS DOUBLE) / r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS better FROM both2 WHERE r > 0 AND r0 > 0 AND cr > 0 AND cr0 > 0 GROUP BY lead", "obs", "asked", "units", **studies._COARSE))
def grid_wins(spark, sf_dir):
    """Share of episodes whose gain over persistence is larger on the coarse grid, of those that have one on both."""
    fine = pool.against(pool.unit_sums(trial.score_rows(spark, sf_dir))).drop("model")
    rows = score.shift_rows(trial.issues(spark, sf_dir), raster.coarsened(trial.packed(spark, sf_dir), 2), {"persistence": (0, 0), "shift": (1, 0)}, trial.LEADS, 2, studies.COARSE)
    coarse = pool.against(pool.unit_sums(rows)).select("unit", "lead", *(F.col(c).alias(f"c{c}") for c in ("e", "r", "e0", "r0")))
    gain = lambda k: F.try_divide(F.col(f"{k}e0").cast("double"), F.col(f"{k}r0").cast("double")) - F.try_divide(F.col(f"{k}e").cast("double"), F.col(f"{k}r").cast("double"))
    each = fine.join(coarse, ["unit", "lead"]).withColumns({"fine": gain(""), "coarse": gain("c")}).where("fine IS NOT NULL AND coarse IS NOT NULL")
    return each.groupBy("lead").agg(F.count("*").alias("n"), r6(F.avg((F.col("coarse") > F.col("fine")).cast("double"))).alias("better"))
