"""Queries on archives by day, ASCII grids, tables made once, and winds of stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import score, structure, templates
from pluvia.plans import trial, verification
from pluvia.plans.analyses import _ST, stations
from pluvia.plans.trial import sql
from pluvia.sources import archive, raster, shared
from pluvia.sources.raster import table
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


@query(sql("SELECT f, f // 24 AS day, count(v) AS covered, count(*) FILTER (WHERE v * (CASE WHEN f // 24 % 3 = 0 THEN 2 ELSE 1 END) >= 2) AS wet FROM obs GROUP BY f", "obs"))
def day_archive(spark, sf_dir):
    """The index of an archive by day, of which every third day has come again with twice the amounts."""
    days = archive.DayArchive(spark, shared.path(spark, "archive"), 24, 2.0)
    frames = raster.observed_frames(trial.cells(spark, sf_dir))
    days.update(frames)
    days.update(frames.where("f div 24 % 3 = 0").select("f", F.transform("v", lambda x: x * 2).alias("v")))
    return days.index().select("f", "day", "covered", "wet")


@query(sql(f"SELECT f, r, count(v) AS covered, round(sum(v), 3) AS total, round(max(v), 3) AS peak, round(53.9 + ({TRIAL.rows} - r) * 0.2::DOUBLE, 6) AS north FROM obs GROUP BY f, r", "obs"))
def ascii_grids(spark, sf_dir):
    """Frames written as ASCII grids and read again, with the header's place: sums of each line of cells."""
    folder = shared.path(spark, "grids")
    archive.write_ascii(raster.observed_frames(trial.cells(spark, sf_dir)), folder, TRIAL.cols, TRIAL.west, TRIAL.south, 0.2)
    cells = archive.read_ascii(spark, folder).select("f", "ncols", "nrows", "south", "cell", F.posexplode("v").alias("at", "v"))
    r = F.expr("at div ncols")
    lines = cells.groupBy(F.col("f").cast("long").alias("f"), r.alias("r"), (F.col("south") + (F.col("nrows") - r) * F.col("cell")).alias("north"))
    return lines.agg(F.count("v").alias("covered"), F.round(F.sum("v"), 3).alias("total"), F.round(F.max("v"), 3).alias("peak")).withColumn("north", r6("north"))


@query(sql("SELECT model, lead, CAST(sum(hit_2) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n, round(1 - CAST(sum(fss_e) AS DOUBLE) / sum(fss_r), 6) AS fss FROM rows GROUP BY model, lead", "rows"))
def summary_once(spark, sf_dir):
    """A summary that is made once for its inputs and parameters: the second call reads the table that the first one has written."""

    def make():
        return trial.score_rows(spark, sf_dir).groupBy("model", "lead").agg(F.sum("hit_2").alias("hit"), F.sum("n").alias("n"), r6(score.fss()).alias("fss"))

    for _ in range(2):
        out = archive.made_once(spark, "summary", [f"{sf_dir}/events.parquet"], {"leads": trial.LEADS, "form": 1}, make)
    return out


_WINDS = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, id, lat, lon, -value * sin(radians(event_id * 37 % 360)) AS u, -value * cos(radians(event_id * 37 % 360)) AS v FROM events JOIN st ON id = user_id WHERE value IS NOT NULL"


@query(sql("SELECT bin, count(*) AS n, round(avg(s), 4) AS d FROM (SELECT CAST(floor(2 * 6371 * asin(sqrt(pow(sin((radians(a.lat) - radians(b.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(a.lon) - radians(b.lon)) / 2), 2))) / 20) AS BIGINT) AS bin, (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) AS s FROM winds a JOIN winds b ON a.t = b.t AND a.id < b.id) WHERE bin < 20 GROUP BY bin", **_ST, winds=_WINDS))
def station_structure(spark, sf_dir):
    """Winds of stations (events of customers): mean squared difference by distance, in bins of 20 km."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    turn = F.radians((F.col("event_id") * 37 % 360).cast("double"))
    winds = e.select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("t"), F.col("user_id").alias("id"), (-F.col("value") * F.sin(turn)).alias("u"), (-F.col("value") * F.cos(turn)).alias("v"))
    return structure.between_points(winds.join(stations(spark, sf_dir).select("id", "lat", "lon"), "id")).withColumn("d", F.round("d", 4))


#: A report of the trial: every kind of mark once at least, and all tables.
TEMPLATE = """# Trial

At one step the shift places rain at {{f:shift:1}}, {{d:shift:1}} ({{ci:shift:1}}) over persistence at {{f:persistence:1}}:
{{pd:shift:persistence:1}}, {{pc:shift:persistence:1}} ({{pci:shift:persistence:1}}); it wins {{pw:shift:persistence:1}} of {{u:shift:1}} episodes ({{n:shift:1}} cases).
Rain {{r:shift:2}} of what fell, over in {{over:shift:2}}, median {{q:shift:2:50}}; Brier {{bs:shift:2}} ({{b:shift:2}}), bias {{bias:shift:2}}, RMSE {{rmse:shift:2}}, r {{corr:shift:2}}.
Events: CSI {{c:shift:3:2}}, found {{pod:shift:3:2}}, false {{far:shift:3:2}}.

{{table:scores}}

{{table:events}}

{{table:rain}}

{{table:pairs}}

{{table:errors}}
"""


def _report_sql() -> str:
    """The same lines by DuckDB: each kind of mark as an expression of scores m, comparisons p and ratios u."""
    value = {
        "f": "printf('%.2f', m.fss)", "d": "printf('%+.3f', p.d)", "r": "printf('%.2f', m.ratio)", "b": "printf('%+.4f', p.brier)", "bs": "printf('%.4f', m.brier)", "rmse": "printf('%.2f', m.rmse)", "bias": "printf('%+.3f', m.bias)", "corr": "printf('%.2f', m.corr)",
        "n": "format('{:,}', m.cases)", "u": "printf('%d', m.units)", "ci": "printf('%+.3f to %+.3f', p.d_low, p.d_high)", "pd": "printf('%+.3f [%+.3f, %+.3f]', p.d, p.d_low, p.d_high)", "pc": "printf('%.0f%%', 100 * p.relative)", "pci": "printf('%.0f%% to %.0f%%', 100 * p.r_low, 100 * p.r_high)",
        "pw": "printf('%.0f%%', 100 * p.wins)", "over": "printf('%.0f%%', 100 * u.over)", **{k: f"printf('{form}', {scale}CASE x WHEN '1' THEN m.{name}_1 WHEN '2' THEN m.{name}_2 ELSE m.{name}_4 END)" for k, form, scale, name in (("c", "%.2f", "", "csi"), ("pod", "%.0f%%", "100 * ", "pod"), ("far", "%.0f%%", "100 * ", "far"))},
        "q": "printf('%.2f', CASE x WHEN '25' THEN u.q25 WHEN '50' THEN u.q50 ELSE u.q75 END)",
    }
    d = lambda x: f"CAST({x} AS DOUBLE)"
    counts = lambda name, top, below: ", ".join(f"{d(f'sum({top}_{t})')} / nullif({' + '.join(f'sum({k}_{t})' for k in below)}, 0) AS {name}_{t}" for t in templates.THRESHOLDS)
    score = lambda k, w="1": f"(1 - {d(f'sum({w} * e{k})')} / sum({w} * r{k}))"
    asked = [tuple(m.values()) for m in templates.marks(templates.with_tables(TEMPLATE, ["persistence", "shift"], [1, 2, 3]))]
    listed = ", ".join(f"({place}, '{mark}', '{kind}', '{a}', '{b}', {lead}, {repr(x) if x else 'NULL'})" for place, mark, kind, a, b, lead, x in asked)
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in value.items())
    draws = {k: v for k, v in verification._draws_sql("unit_sums", 200, 9).items() if k != "each"}
    return sql(
        f"SELECT CAST(place AS INTEGER) AS place, mark, CASE kind {case} END AS text FROM (VALUES {listed}) t(place, mark, kind, a, b, lead, x) LEFT JOIN m ON m.model = t.a AND m.lead = t.lead LEFT JOIN p ON p.a = t.a AND p.b = t.b AND p.lead = t.lead LEFT JOIN u ON u.model = t.a AND u.lead = t.lead",
        "rows",
        m=f"SELECT model, lead, 1 - {d('sum(fss_e)')} / sum(fss_r) AS fss, {d('sum(sum_f)')} / sum(sum_t) AS ratio, sum(brier) / sum(n) AS brier, sqrt({d('sum(sse)')} / sum(n)) AS rmse, {d('sum(sum_f) - sum(sum_t)')} / sum(n) AS bias, avg(corr) AS corr, count(*) AS cases, count(DISTINCT event) AS units, {counts('csi', 'hit', ('hit', 'miss', 'fa'))}, {counts('pod', 'hit', ('hit', 'miss'))}, {counts('far', 'fa', ('hit', 'fa'))} FROM rows GROUP BY model, lead",
        unit_sums="SELECT event AS unit, model, lead, sum(fss_e) AS e, sum(fss_r) AS r, sum(brier) AS brier, sum(n) AS n, sum(sum_f) AS sum_f, sum(sum_t) AS sum_t FROM rows GROUP BY ALL",
        two="SELECT a.unit, a.lead, a.model AS a, b.model AS b, a.e AS e1, a.r AS r1, a.brier AS b1, a.n AS n1, b.e AS e2, b.r AS r2, b.brier AS b2, b.n AS n2 FROM unit_sums a JOIN unit_sums b ON a.unit = b.unit AND a.lead = b.lead",
        **draws,
        edges=f"SELECT a, b, lead, quantile_cont(d, 0.025) AS d_low, quantile_cont(d, 0.975) AS d_high, quantile_cont(r, 0.025) AS r_low, quantile_cont(r, 0.975) AS r_high FROM (SELECT a, b, lead, draw, {score(1, 'w')} - {score(2, 'w')} AS d, {score(1, 'w')} / {score(2, 'w')} - 1 AS r FROM drawn JOIN numbered USING (k) JOIN two USING (unit) GROUP BY a, b, lead, draw) GROUP BY a, b, lead",
        p=f"SELECT * FROM (SELECT a, b, lead, {score(1)} - {score(2)} AS d, {score(1)} / {score(2)} - 1 AS relative, sum(b2) / sum(n2) - sum(b1) / sum(n1) AS brier, avg(CASE WHEN r1 > 0 AND r2 > 0 THEN CASE WHEN {d('e1')} / r1 < {d('e2')} / r2 THEN 1.0 ELSE 0.0 END END) AS wins FROM two GROUP BY a, b, lead) JOIN edges USING (a, b, lead)",
        u=f"SELECT model, lead, avg(CASE WHEN x > 1 THEN 1.0 ELSE 0.0 END) AS over, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM (SELECT model, lead, {d('sum_f')} / sum_t AS x FROM unit_sums WHERE sum_f > 0 AND sum_t > 0) GROUP BY model, lead",
    )


@query(_report_sql())
def report_marks(spark, sf_dir):
    """The texts of all marks of a report, tables included: one plan over the score rows."""
    asked = templates.marks(templates.with_tables(TEMPLATE, ["persistence", "shift"], [1, 2, 3]))
    df = spark.createDataFrame([tuple(m.values()) for m in asked], "place int, mark string, kind string, a string, b string, lead int, x string")
    return templates.texts(df, *templates.relations(trial.score_rows(spark, sf_dir), 200, 9, shared.stored(spark)))
