"""Rasters as relations: cells(f, r, c, v) in long form, NULL for no coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources.shared import spread
from pluvia.spec import TRIAL, GridSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events of at least this value stand for showers, all others for drizzle.
SHOWER = 150


def _placed(events: DataFrame) -> DataFrame:
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return events.select("event_id", "user_id", "value", hours.alias("f0"), (F.col("event_id") * 7 % 32).alias("r0"), (F.col("user_id") * 5 % 48).alias("c0"))


def showers(events: DataFrame) -> DataFrame:
    """The events that stand for showers: first frame, centre, amplitude and motion."""
    amp = (2 + F.floor(F.col("value") / 100)).cast("long").alias("amp")
    return _placed(events).where(F.col("value") >= SHOWER).select("event_id", "f0", "r0", "c0", amp, (F.col("event_id") % 3 - 1).alias("vr"), (1 + F.col("user_id") % 3).alias("vc"))


def drizzle(events: DataFrame) -> DataFrame:
    """(f, r, c, height) of all other events with a value: a single cell of one frame."""
    return _placed(events).where(F.col("value") < SHOWER).select(F.col("f0").alias("f"), F.col("r0").cast("int").alias("r"), F.col("c0").cast("int").alias("c"), F.lit(1).cast("long").alias("height"))


def rain(some: DataFrame, grid: GridSpec = TRIAL, life: int = 6, more: DataFrame | None = None) -> DataFrame:
    """Non-zero cells (f, r, c, v): each shower is a pyramid that moves for some frames; more are amounts (f, r, c, height) of cells."""
    moved = some.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(life - 1)))).select((F.col("f0") + F.col("k")).alias("f"), (F.col("r0") + F.col("vr") * F.col("k")).alias("rr"), (F.col("c0") + F.col("vc") * F.col("k")).alias("cc"), "amp")
    low, high = F.greatest(F.lit(0), F.col("rr") - F.col("amp") - 1), F.least(F.lit(grid.rows - 1), F.col("rr") + F.col("amp") + 1)
    rows = moved.where(low <= high).withColumn("r", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    reach = F.col("amp") + 1 - F.abs(F.col("r") - F.col("rr"))
    left, right = F.greatest(F.lit(0), F.col("cc") - reach), F.least(F.lit(grid.cols - 1), F.col("cc") + reach)
    cells = rows.where((reach >= 0) & (left <= right)).withColumn("c", F.explode(F.sequence(left.cast("int"), right.cast("int"))))
    height = F.col("amp") + 2 - F.abs(F.col("r") - F.col("rr")) - F.abs(F.col("c") - F.col("cc"))
    amounts = cells.select("f", "r", "c", height.alias("height"))
    return (amounts if more is None else amounts.unionByName(more)).groupBy("f", "r", "c").agg(F.sum("height").alias("v"))


def grid_of(frames: DataFrame, grid: GridSpec = TRIAL) -> DataFrame:
    """Every cell of every frame."""
    return frames.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))


def dense(cells: DataFrame, frames: DataFrame | None = None, grid: GridSpec = TRIAL) -> DataFrame:
    """(f, r, c, v) with zeros where cells has no row."""
    spine = grid_of(frames if frames is not None else cells.select("f").distinct(), grid)
    return spine.join(cells, ["f", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def axis(cells: DataFrame) -> DataFrame:
    """All frames from the first to the last one: absent ones too."""
    return cells.agg(F.min("f").alias("a"), F.max("f").alias("b")).select(F.explode(F.sequence("a", "b")).alias("f"))


def observed(cells: DataFrame, grid: GridSpec = TRIAL) -> DataFrame:
    """(f, r, c, v) on the whole axis as a radar would give it: frames that are missing have no rows, cells without coverage are NULL."""
    whole = dense(cells, spread(axis(cells).where("f % 29 <> 0"), "f"), grid)  # the axis is made in one task; its cells are not
    return whole.withColumn("v", F.when((F.col("r") * grid.cols + F.col("c") + F.col("f")) % 97 != 0, F.col("v")))


def frames(cells: DataFrame, grid: GridSpec = TRIAL) -> DataFrame:
    """(f, at, v): a row for each frame, its non-zero cells as two arrays."""
    packed = F.array_sort(F.collect_list(F.struct((F.col("r") * grid.cols + F.col("c")).cast("int").alias("at"), F.col("v").cast("double").alias("v"))))
    return cells.groupBy("f").agg(packed.alias("x")).select("f", F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def unpacked(packed: DataFrame, grid: GridSpec = TRIAL, gaps: bool = False) -> DataFrame:
    """(f, v) of frames (f, at, v), arrays that may be NULL: all cells row by row; with gaps, NaN where a radar would have no coverage."""
    size = grid.rows * grid.cols

    def unpack(batches):
        place = np.arange(size)
        for batch in batches:
            f = batch.column("f").to_numpy()
            out = np.zeros((len(f), size))
            at, v = batch.column("at"), batch.column("v")
            row = np.repeat(np.arange(len(f)), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out[row, at.flatten().to_numpy()] = v.flatten().to_numpy()
            if gaps:
                out[(place[None] + f[:, None]) % 97 == 0] = np.nan
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * size, out.ravel())], ["f", "v"])

    return packed.select("f", "at", "v").mapInArrow(unpack, "f long, v array<double>")


def observed_frames(cells: DataFrame, grid: GridSpec = TRIAL) -> DataFrame:
    """observed() as a row for each frame that is there: (f, v), all cells row by row, NaN for no coverage."""
    return unpacked(axis(cells).where("f % 29 <> 0").join(frames(cells, grid), "f", "left"), grid, gaps=True)


def coarsened(packed: DataFrame, by: int, grid: GridSpec = TRIAL) -> DataFrame:
    """Frames (f, v), NaN for no coverage, on a grid of by times the cell's side: means of the covered cells. The grid's sides are multiples of by."""
    rows, cols = grid.rows // by, grid.cols // by

    def run(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, rows, by, cols, by)
            known = ~np.isnan(v)
            n, total = known.sum(axis=(2, 4)), np.where(known, v, 0.0).sum(axis=(2, 4))
            mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * (rows * cols), mean.ravel())], ["f", "v"])

    return packed.select("f", "v").mapInArrow(run, "f long, v array<double>")


def trial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rain(showers(events), more=drizzle(events))
