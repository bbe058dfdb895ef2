"""Streaming queries: each drains its stream and returns what was emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.sources import shared
from pluvia.streaming import streams

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


@query("SELECT event_type, CAST(epoch(day) AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, date_trunc('day', ts) AS day FROM events) GROUP BY event_type, day HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def stream_daily(spark, sf_dir):
    out = streams.drained(streams.tumbling(streams.source(spark, sf_dir), "1 day", "2 hours"))
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 2).alias("total"))


@query("SELECT event_type, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS until, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY event_type, g HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def stream_sessions(spark, sf_dir):
    out = streams.drained(streams.sessions(streams.source(spark, sf_dir), "1 hour", "2 hours"))
    return out.select("event_type", F.floor(F.col("start").cast("double")).alias("start"), F.floor(F.col("until").cast("double")).alias("until"), "n")


@query("SELECT a.event_id AS id, b.event_id AS truth_id FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(floor(epoch(a.ts) / 600 + 0.5) AS BIGINT) = CAST(floor(epoch(b.ts) / 600 + 0.5) AS BIGINT) AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type <> 'click'")
def stream_pending(spark, sf_dir):
    e = streams.source(spark, sf_dir).withColumn("slot", F.floor(F.col("ts").cast("double") / 600 + 0.5))
    forecasts = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts", "slot")
    truth = e.where("event_type <> 'click'").select(F.col("event_id").alias("truth_id"), F.col("user_id").alias("k2"), F.col("ts").alias("ts2"), F.col("slot").alias("slot2"))
    return streams.drained(streams.scored_when_due(forecasts, truth, "1 hour").select("id", "truth_id"))


@query()
def stream_issued(spark, sf_dir):
    e = streams.source(spark, sf_dir).select(F.col("user_id").alias("k"), F.unix_timestamp("ts").alias("t"))
    return streams.drained(streams.issued(e, 6 * 3600))


@query("SELECT event_type, start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 - 3600 * k AS start FROM events, range(6) b(k)) GROUP BY event_type, start HAVING start + 6 * 3600 <= (SELECT epoch(max(ts)) - 7200 FROM events)")
def stream_history(spark, sf_dir):
    """Six hours of history behind every full hour."""
    out = streams.drained(streams.histories(streams.source(spark, sf_dir), "6 hours", "1 hour", "2 hours"))
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 2).alias("total"))


@query("SELECT k, id, t FROM (SELECT event_type AS k, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) AS place FROM events) WHERE place > 3")
def stream_retention(spark, sf_dir):
    """What a collector that keeps the newest three of each kind lets go."""
    e = streams.source(spark, sf_dir).select(F.col("event_type").alias("k"), F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("t"))
    return streams.drained(streams.retired(e, 3))


_FORECASTS = "SELECT event_id AS id, user_id AS k, ts, CAST(floor(epoch(ts) / 600 + 0.5) AS BIGINT) AS slot FROM events WHERE event_type = 'click'"
_TRUTH = "SELECT event_id AS truth_id, user_id AS k, ts, CAST(floor(epoch(ts) / 600 + 0.5) AS BIGINT) AS slot FROM events WHERE event_type <> 'click'"


@query(f"WITH a AS ({_FORECASTS}), b AS ({_TRUTH}), mark AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 1 HOUR AS t), met AS (SELECT id, truth_id FROM a JOIN b ON a.k = b.k AND a.slot = b.slot AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE) SELECT id, truth_id FROM met UNION ALL SELECT id, NULL AS truth_id FROM a, mark WHERE id NOT IN (SELECT id FROM met) AND ts + INTERVAL 10 MINUTE < t")
def stream_unscored(spark, sf_dir):
    """Forecasts with their truth, and those whose truth never came, once, as the watermark has passed the time of any."""
    e = streams.source(spark, sf_dir).withColumn("slot", F.floor(F.col("ts").cast("double") / 600 + 0.5))
    forecasts = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts", "slot")
    truth = e.where("event_type <> 'click'").select(F.col("event_id").alias("truth_id"), F.col("user_id").alias("k2"), F.col("ts").alias("ts2"), F.col("slot").alias("slot2"))
    return streams.drained(streams.scored_or_given_up(forecasts, truth, "1 hour").select("id", "truth_id"))


_SCANS = "SELECT event_id AS id, user_id AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, value AS v FROM events"


@query(f"WITH s AS ({_SCANS}) SELECT a.id, b.id AS truth_id, CAST(b.slot - a.slot AS INTEGER) AS lead, round(a.v - b.v, 6) AS err, b.slot // 24 AS day FROM s a JOIN s b ON a.k = b.k AND b.slot - a.slot BETWEEN 1 AND 12")
def stream_collected(spark, sf_dir):
    """What a collector that issues a forecast for twelve hours with each scan has scored, from a source of 5,000 rows a batch."""
    folder = shared.path(spark, "collected")
    feed = streams.throttled(spark, f"{sf_dir}/events.parquet", 5000, f"{folder}/state", ("event_id", "user_id", "ts", "value")).select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.floor(F.col("ts").cast("timestamp").cast("double") / 3600).alias("slot"), F.col("value").alias("v"))
    collector = streams.Collector(folder, 12, 24)
    streams.collected(feed, collector, f"{folder}/state")
    return collector.table(spark, "scores").select("id", "truth_id", "lead", F.round("err", 6).alias("err"), "day")
