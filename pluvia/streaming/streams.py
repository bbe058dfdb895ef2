"""Streaming twins of the archive's incremental jobs, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pluvia.sources import feed, shared


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table's files as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """All that is there now goes through the stream into a table, exactly once; then the table."""
    spark = stream.sparkSession
    folder = shared.path(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """(event_type, start, n, total) of each window that the watermark has passed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("event_type", F.col("w.start").alias("start"), "n", "total")


def histories(events: DataFrame, width: str, every: str, late: str) -> DataFrame:
    """(event_type, start, n, total) of each sliding window that the watermark has passed: the history that stands behind a moment."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("event_type", F.col("w.start").alias("start"), "n", "total")


def retired(events: DataFrame, keep: int) -> DataFrame:
    """(k, id, t) of what leaves as each key's newest rows by (t, id) are kept; the state holds those."""

    def step(key, batches, state: GroupState):
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:  # an Arrow batch beside the few that are kept; what leaves is sent on at once
            rows = sorted([*held, *zip(batch["t"].tolist(), batch["id"].tolist(), strict=True)])
            gone, held = rows[:-keep], rows[-keep:]
            yield pd.DataFrame({"k": [key[0]] * len(gone), "id": [i for _, i in gone], "t": [t for t, _ in gone]})
        if held:
            state.update(([t for t, _ in held], [i for _, i in held]))

    return events.groupBy("k").applyInPandasWithState(step, "k string, id long, t long", "t array<long>, id array<long>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(event_type, start, until, n) of each closed session; a gap of exactly the given length does not part."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("until"))
    return counted.select("event_type", F.col("w.start").alias("start"), "until", "n")


def scored_when_due(forecasts: DataFrame, truth: DataFrame, late: str) -> DataFrame:
    """Each forecast (id, k, ts, slot) with the truth (k2, ts2, slot2, value) of its slot, once it has arrived."""
    return forecasts.withWatermark("ts", late).join(truth.withWatermark("ts2", late), F.expr("k = k2 AND slot = slot2 AND ts2 BETWEEN ts - INTERVAL 10 MINUTES AND ts + INTERVAL 10 MINUTES"))


def issued(events: DataFrame, least_seconds: int) -> DataFrame:
    """(k, t): times at which a forecast is issued, at least so long after the last one of the key; the state holds that one time."""

    def step(key, batches, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b["t"]):
            if last is None or t - last >= least_seconds:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"k": [key[0]] * len(out), "t": out})

    return events.groupBy("k").applyInPandasWithState(step, "k long, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def throttled(spark: SparkSession, path: str, rows_per_batch: int, checkpoint: str, columns: tuple[str, ...] = ("*",), **options) -> DataFrame:
    """The rows of Parquet files as a stream of batches of at most so many rows; it goes on where the checkpoint ends. Only the named columns are read."""
    spark.dataSource.register(feed.Throttled)
    given = {"path": path, "rows_per_batch": rows_per_batch, "resume": feed.last_offset(spark, checkpoint), **options}
    return spark.readStream.format("throttled").schema(spark.read.parquet(path).select(*columns).schema).options(**given).load()


def scored_or_given_up(forecasts: DataFrame, truth: DataFrame, late: str) -> DataFrame:
    """As scored_when_due(), and each forecast whose truth can no longer arrive once, with NULLs: the state lets it go as the watermark passes its time."""
    return forecasts.withWatermark("ts", late).join(truth.withWatermark("ts2", late), F.expr("k = k2 AND slot = slot2 AND ts2 BETWEEN ts - INTERVAL 10 MINUTES AND ts + INTERVAL 10 MINUTES"), "leftOuter")


class Collector:
    """Collect, issue, score: each batch adds scans, forecasts made from them, and scores of what has both by now.

    Three tables in a folder, each in partitions by day and batch. A batch writes all of its own
    partitions anew and reads only earlier ones beside them, so a batch that is run again, after a
    failure at any point, leaves the tables as one run does. A score needs a forecast and its
    truth; the batch that brings the later of the two makes it, so each is made once. Earlier rows
    are read of the days that the batch's rows can meet, which Spark prunes by partition.

    Small batches of a stream may be kept as they come and go through the tables as one, a round,
    whose number is that of its first batch (keep, settle; see collected). A round is marked when
    its tables are whole: one that was lost has no mark and is made anew, with what has come since.

    Scans (id, k, slot, v) of one (k, slot) are all kept, as different scans; a scan without k,
    slot or v is collected, but gives no forecast and is no truth. steps are the leads in slots.
    """

    SCHEMAS = {  # noqa: RUF012
        "scans": "id long, k long, slot long, v double, day long, batch long",
        "forecasts": "id long, k long, issued long, lead int, slot long, p double, day long, batch long",
        "scores": "id long, truth_id long, lead int, err double, day long, batch long",
    }

    def __init__(self, folder: str, steps: int, slots_per_day: int):
        self.folder, self.steps, self.slots = folder, steps, slots_per_day

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table as it is now; before the first batch an empty one."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], self.SCHEMAS[name])
        return spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def _found(self, spark: SparkSession, name: str, pattern: str) -> list[str]:
        """Folders of a table that a pattern names."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{pattern}")
        return [f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]

    def _of(self, spark: SparkSession, name: str, folders: list[str]) -> DataFrame:
        """The rows of some of a table's folders; no other folder is listed."""
        if not folders:
            return spark.createDataFrame([], self.SCHEMAS[name])
        return spark.read.schema(self.SCHEMAS[name]).option("basePath", f"{self.folder}/{name}").parquet(*folders)

    def _write(self, df: DataFrame, name: str, batch: int) -> tuple[DataFrame, set[str]]:
        """Puts df in the place of the batch's partitions; gives them back as stored, and the folders' names of their days."""
        spark = df.sparkSession
        path = f"{self.folder}/{name}"
        # what an earlier attempt has left on days that this one does not write goes too
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in self._found(spark, name, f"day=*/batch={batch}"):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(found), True)
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("day", "batch").parquet(path)
        mine = self._found(spark, name, f"day=*/batch={batch}")
        return self._of(spark, name, mine), {f.split("/")[-2] for f in mine}

    def _earlier(self, spark: SparkSession, name: str, days: set[str], batch: int) -> DataFrame:
        """The rows of batches before this one on some days."""
        there = [f for f in self._found(spark, name, "day=*") if f.split("/")[-1] in days]
        return self._of(spark, name, there).where(F.col("batch") < batch)

    @staticmethod
    def _typed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long"), F.col("k").cast("long"), F.col("slot").cast("long"), F.col("v").cast("double"))

    def held(self, spark: SparkSession) -> int:
        """How many batches of its stream the tables hold; the next round begins there."""
        return max((int(f.split("/")[-1]) for f in self._found(spark, "rounds", "*")), default=0)

    def keep(self, rows: DataFrame, first: int, batch: int) -> None:
        """Keeps a batch for the round that begins with batch first; what an earlier attempt has left goes."""
        self._typed(rows).write.mode("overwrite").parquet(f"{self.folder}/kept/first={first}/batch={batch}")

    def settle(self, spark: SparkSession, first: int) -> int:
        """Takes what is kept for a round through the tables, if there is any; where the next round begins."""
        kept = self._found(spark, "kept", f"first={first}/batch=*")
        if not kept:
            return first
        self(spark.read.schema("id long, k long, slot long, v double").parquet(f"{self.folder}/kept/first={first}"), first)
        then = 1 + max(int(f.split("=")[-1]) for f in kept)
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rounds/{then}")
        system = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        system.createNewFile(mark)
        for found in self._found(spark, "kept", "first=*"):
            if int(found.split("=")[-1]) < then:
                system.delete(spark._jvm.org.apache.hadoop.fs.Path(found), True)
        return then

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        day = lambda c: F.floor(F.col(c) / self.slots).cast("long")
        scans, seen = self._write(self._typed(rows).withColumn("day", day("slot")), "scans", batch)
        known = scans.where("k IS NOT NULL AND slot IS NOT NULL AND v IS NOT NULL")
        made = known.select("id", "k", F.col("slot").alias("issued"), F.col("v").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(self.steps))).alias("lead")).withColumn("slot", F.col("issued") + F.col("lead"))
        forecasts, due = self._write(made.select("id", "k", "issued", "lead", "slot", "p").withColumn("day", day("slot")), "forecasts", batch)
        truth = lambda df: df.where("k IS NOT NULL AND slot IS NOT NULL AND v IS NOT NULL").select("k", "slot", F.col("id").alias("truth_id"), "v")
        scored = []
        if due:  # a scan that is known is followed by forecasts; the rows of a slot are of its day
            earlier = self._earlier(spark, "forecasts", seen, batch)
            scored = [forecasts.join(truth(scans), ["k", "slot"]), earlier.join(truth(scans), ["k", "slot"]), forecasts.join(truth(self._earlier(spark, "scans", due, batch)), ["k", "slot"])]
        for found in scored[1:]:
            scored[0] = scored[0].unionByName(found)
        out = scored[0].select("id", "truth_id", "lead", (F.col("p") - F.col("v")).alias("err"), "day") if scored else spark.createDataFrame([], self.SCHEMAS["scores"]).drop("batch")
        self._write(out, "scores", batch)


def collected(stream: DataFrame, collector: Collector, checkpoint: str, least: int = 32) -> None:
    """Runs the collector over all that its stream has; a later call goes on where this one ends.

    How many rows the source gives at a time does not say how often scores are made. Each batch is
    kept as it comes, and a round takes those kept through the tables as one batch: when they are at
    least so many and no fewer than the batches of all rounds before, and when the stream has no
    more. So rounds grow with what they meet, and a scan is read again in a few of them only.
    """
    spark = stream.sparkSession
    first = collector.held(spark)

    def take(rows: DataFrame, batch: int) -> None:
        nonlocal first
        if batch < first:  # run again after a failure, when a round has it already
            return
        collector.keep(rows, first, batch)
        if batch + 1 - first >= max(least, first):
            first = collector.settle(spark, first)

    running = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    collector.settle(spark, first)
