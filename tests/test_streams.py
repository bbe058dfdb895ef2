"""The throttled source, the collector's loop and forecasts whose truth never comes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pluvia.sources import feed
from pluvia.streaming import streams


@pytest.fixture
def events(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(6) if i % 50 else None, 100 + i // 12 + rng.randrange(-3, 4), float(rng.randrange(9)) if i % 31 else None) for i in range(1000)]
    spark.createDataFrame(rows, "id long, k long, slot long, v double").repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 2048).parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), rows


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def reader(path, clock, sizes_of=feed.sizes, **options):
    class Names:
        names = ["id"]  # noqa: RUF012

    return feed.ThrottledReader(Names, {"path": path, **options}, clock, sizes_of)


def test_a_feed_reads_each_row_once_within_its_limit(events):
    path, rows = events
    source, at, got = reader(path, Clock(), rows_per_batch=70, rows_per_task=33), {"row": 0}, []
    while (end := source.latestOffset())["row"] > at["row"]:
        parts = source.partitions(at, end)
        ids = [i for p in parts for b in source.read(p) for i in b.column("id").to_pylist()]
        assert len(ids) == end["row"] - at["row"] <= 70 and all(p.end - p.begin <= 33 for p in parts)
        got += ids
        at = end
    assert got == [r[0] for r in rows]


def test_a_feed_asks_again_after_its_time_only(events):
    import json

    path, _ = events
    clock, fails, asked = Clock(), [False], []

    def sizes_of(p):
        asked.append(clock.now)
        if fails[0]:
            raise OSError("no answer")
        return feed.sizes(p)

    options = {"rows_per_batch": 100, "every_seconds": 60, "retry_seconds": 20}
    source = reader(path, clock, sizes_of, **options)
    first = source.latestOffset()
    clock.now += 59
    assert source.latestOffset() == first and len(asked) == 1
    clock.now += 1
    fails[0] = True
    failed = source.latestOffset()
    assert failed["row"] == first["row"] and failed != first and source.partitions(first, failed) == []
    again = reader(path, clock, sizes_of, resume=json.dumps(failed), **options)  # a restart has not forgotten the failure
    clock.now += 19
    assert source.latestOffset() == again.latestOffset() == failed and len(asked) == 2
    clock.now += 1
    fails[0] = False
    assert again.latestOffset()["row"] == source.latestOffset()["row"] == 200


def test_a_missing_feed_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        feed.sizes("/nowhere/at/all")


def scores(spark, collector):
    return Counter((r.id, r.truth_id, r.lead, r.err) for r in collector.table(spark, "scores").collect())


def plain_scores(rows, steps):
    known = [r for r in rows if None not in r]
    return Counter((a, b, t - s, v - w) for a, k, s, v in known for b, k2, t, w in known if k == k2 and 1 <= t - s <= steps)


def test_a_restarted_stream_goes_on(spark, events, tmp_path):
    path, rows = events
    sizes, folder = [], str(tmp_path / "state")

    def count(batch, number):
        sizes.append((number, batch.count()))
        if number == 4 and len(sizes) == 5:
            raise RuntimeError("lost")

    for _ in range(2):
        running = streams.throttled(spark, path, 90, folder).writeStream.foreachBatch(count).option("checkpointLocation", folder).start()
        try:
            running.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        running.stop()
    assert [n for n, _ in sizes] == [0, 1, 2, 3, 4, 4, *range(5, 12)] and all(x <= 90 for _, x in sizes)
    assert sum(dict(sizes).values()) == len(rows)
    spark.createDataFrame([(5000, 1, 1, 1.0)], "id long, k long, slot long, v double").coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("*.parquet")).rename(tmp_path / "events" / "z.parquet")
    running = streams.throttled(spark, path, 90, folder).writeStream.foreachBatch(count).option("checkpointLocation", folder).start()
    running.processAllAvailable()
    running.stop()
    assert sizes[-1] == (12, 1)


def test_the_collector_scores_each_forecast_once(spark, events, tmp_path):
    path, rows = events
    collector = streams.Collector(str(tmp_path / "out"), 5, 24)
    streams.collected(streams.throttled(spark, path, 300, str(tmp_path / "state")), collector, str(tmp_path / "state"))
    assert scores(spark, collector) == plain_scores(rows, 5)
    assert collector.table(spark, "scans").count() == len(rows)


def test_a_batch_that_is_run_again_changes_nothing(spark, events, tmp_path, monkeypatch):
    path, rows = events
    collector = streams.Collector(str(tmp_path / "out"), 4, 24)
    whole = spark.read.parquet(path)
    parts = [whole.where(F.col("id").between(400 * k, 400 * k + 399)) for k in range(3)]
    for k, part in enumerate(parts):
        if k == 1:  # the attempt before has read other rows, and was lost before it scored
            plain = collector._write
            monkeypatch.setattr(collector, "_write", lambda df, name, batch: (_ for _ in ()).throw(RuntimeError("lost")) if name == "scores" else plain(df, name, batch))
            with pytest.raises(RuntimeError):
                collector(whole.withColumn("slot", F.col("slot") + 1000), k)
            monkeypatch.undo()
        collector(part, k)
        before = scores(spark, collector)
        collector(part, k)
        assert scores(spark, collector) == before
    assert before == plain_scores(rows, 4) and collector.table(spark, "forecasts").count() == 4 * sum(None not in r for r in rows)
    collector(whole.limit(0), 3)
    assert scores(spark, collector) == before


def test_earlier_days_are_not_read(spark, events, tmp_path):
    path, _ = events
    collector = streams.Collector(str(tmp_path / "out"), 1, 24)
    collector(spark.read.parquet(path), 0)
    seen = collector.table(spark, "forecasts").where(F.col("day").between(5, 6) & (F.col("batch") < 1))
    assert {f.split("day=")[1].split("/")[0] for f in seen.inputFiles()} <= {"4", "5", "6", "7"} or "PartitionFilters: [isnotnull(day" in seen._jdf.queryExecution().toString()


def test_forecasts_without_truth_leave_once(spark, tmp_path):
    """Over several batches: a forecast waits, and leaves with its truth or, once that is late, with NULL."""
    hour = 3600
    first = [(1, 1, 0), (2, 1, 1 * hour), (3, 2, 2 * hour)]
    batches = [(first, [(10, 1, 60)]), ([(4, 1, 5 * hour)], [(11, 9, 5 * hour)]), ([(6, 7, 7 * hour)], [(14, 8, 7 * hour)]), ([(5, 1, 9 * hour)], [(12, 1, 9 * hour + 30), (13, 2, 2 * hour)])]
    for name, at, schema in (("a", 0, "id long, k long, t long"), ("b", 1, "truth_id long, k2 long, t long")):
        (tmp_path / name).mkdir()
        for n, both in enumerate(batches):
            spark.createDataFrame(both[at], schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{n}"))
            next((tmp_path / f"{name}{n}").glob("*.parquet")).rename(tmp_path / name / f"{n}.parquet")

    def stream(name, schema, ts, slot):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        return rows.withColumn(ts, F.timestamp_seconds(F.col("t") + 86400)).withColumn(slot, F.floor(F.col("t") / 600 + 0.5)).drop("t")

    made = streams.scored_or_given_up(stream("a", "id long, k long, t long", "ts", "slot"), stream("b", "truth_id long, k2 long, t long", "ts2", "slot2"), "1 hour")
    got = sorted((r.id, r.truth_id) for r in streams.drained(made.select("id", "truth_id")).collect())
    # 3's truth comes after the watermark has passed it: 3 has left with NULL by then
    assert got == [(1, 10), (2, None), (3, None), (4, None), (5, 12), (6, None)], got


def test_a_batch_lists_its_days_only(spark, tmp_path):
    collector = streams.Collector(str(tmp_path / "out"), 1, 24)
    for batch, slot in enumerate((3, 100, 4)):
        collector(spark.createDataFrame([(batch, 1, slot, 1.0 + batch)], "id long, k long, slot long, v double"), batch)
    files = collector._earlier(spark, "scans", {"day=0"}, 2).inputFiles()
    assert files and all("/day=0/" in f for f in files)
    assert [(r.id, r.truth_id, r.err) for r in collector.table(spark, "scores").collect()] == [(0, 2, -2.0)]


def rounds_of(collector, at):
    """Notes the batches that go through a collector's tables."""
    plain = collector._write

    def write(df, name, batch):
        if name == "scans":
            at.append(batch)
        return plain(df, name, batch)

    return write


def test_small_batches_go_through_the_tables_in_rounds(spark, events, tmp_path, monkeypatch):
    """Twelve batches are four rounds, each as long as all before it; the scores are the same."""
    path, rows = events
    collector, at = streams.Collector(str(tmp_path / "out"), 5, 24), []
    monkeypatch.setattr(collector, "_write", rounds_of(collector, at))
    streams.collected(streams.throttled(spark, path, 90, str(tmp_path / "state"), ("id", "k", "slot", "v")), collector, str(tmp_path / "state"), 2)
    assert at == [0, 2, 4, 8]
    assert scores(spark, collector) == plain_scores(rows, 5)
    assert collector.table(spark, "scans").count() == len(rows) and collector.held(spark) == 12
    assert not list((tmp_path / "out" / "kept").glob("*/*"))


def test_few_batches_are_one_round(spark, events, tmp_path, monkeypatch):
    path, rows = events
    collector, at = streams.Collector(str(tmp_path / "out"), 5, 24), []
    monkeypatch.setattr(collector, "_write", rounds_of(collector, at))
    streams.collected(streams.throttled(spark, path, 200, str(tmp_path / "state")), collector, str(tmp_path / "state"))
    assert at == [0] and scores(spark, collector) == plain_scores(rows, 5)


def test_a_round_that_is_lost_is_made_anew(spark, events, tmp_path, monkeypatch):
    """Lost before its scores, before its mark, and after its mark but before the stream has noted its batch."""
    path, rows = events
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(change, *lost):
        collector = streams.Collector(out, 5, 24)
        with monkeypatch.context() as m:
            change(m, collector)
            stream = streams.throttled(spark, path, 90, state)
            if not lost:
                return streams.collected(stream, collector, state, 2)
            with pytest.raises(Exception, match=lost[0]):
                streams.collected(stream, collector, state, 2)
        return None

    def fails(*_):
        raise RuntimeError("lost")

    def before_scores(m, c):
        plain = c._write
        m.setattr(c, "_write", lambda df, name, batch: fails() if name == "scores" and batch == 2 else plain(df, name, batch))

    def before_mark(m, c):
        plain = c.__class__.__call__
        m.setattr(c.__class__, "__call__", lambda self, df, batch: (plain(self, df, batch), fails() if batch == 2 else None))

    def after_mark(m, c):
        plain = c.settle
        m.setattr(c, "settle", lambda s, first: (plain(s, first), fails())[0] if first == 2 else plain(s, first))

    run(before_scores, "lost")
    run(before_mark, "lost")
    assert streams.Collector(out, 5, 24).held(spark) == 2
    run(after_mark, "lost")
    assert streams.Collector(out, 5, 24).held(spark) == 4
    collector = streams.Collector(out, 5, 24)
    run(lambda m, c: None)
    assert scores(spark, collector) == plain_scores(rows, 5)
    assert collector.table(spark, "scans").count() == len(rows) and collector.held(spark) == 12
    run(lambda m, c: None)
    assert scores(spark, collector) == plain_scores(rows, 5) and collector.held(spark) == 12
