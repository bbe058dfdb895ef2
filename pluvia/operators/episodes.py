"""Frame index, rain episodes, issue times and spells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.spec import FINE, WET, EpisodeSpec


def frame_index(cells: DataFrame, frames: DataFrame, threshold: float = WET) -> DataFrame:
    """(f, covered, wet, missing): the wet share of what is covered; NULL if nothing is."""
    seen = cells.groupBy("f").agg(F.count("v").alias("covered"), F.count_if(F.col("v") >= threshold).alias("n_wet"))
    return frames.join(seen, "f", "left").select(
        "f", F.coalesce("covered", F.lit(0)).alias("covered"), F.when(F.col("covered") > 0, F.col("n_wet") / F.col("covered")).alias("wet"), F.col("covered").isNull().alias("missing")
    )


def packed_index(packed: DataFrame, axis: DataFrame, threshold: float = WET) -> DataFrame:
    """frame_index() of frames that are rows (f, v), NaN for no coverage: cells are never rows."""
    covered = F.size(F.filter("v", lambda x: ~F.isnan(x)))
    n_wet = F.size(F.filter("v", lambda x: ~F.isnan(x) & (x >= threshold)))
    seen = packed.select("f", covered.cast("long").alias("covered"), n_wet.alias("n_wet"))
    return axis.join(seen, "f", "left").select("f", F.coalesce("covered", F.lit(0)).alias("covered"), F.when(F.col("covered") > 0, F.col("n_wet") / F.col("covered")).alias("wet"), F.col("covered").isNull().alias("missing"))


def episodes(index: DataFrame, spec: EpisodeSpec = FINE) -> DataFrame:
    """(event, f_start, f_end): rainy frames merged across gaps, cut at the cap, then filtered by length and peak.

    The index has a row for each frame of an archive, so one task can order it.
    """
    order = Window.orderBy("f")
    rainy = index.where((F.coalesce("wet", F.lit(0.0)) >= spec.min_wet) & ~F.col("missing"))
    starts = rainy.withColumn("new", F.coalesce((F.col("f") - F.lag("f").over(order) > spec.gap).cast("int"), F.lit(1)))
    islands = starts.withColumn("island", F.sum("new").over(order)).groupBy("island").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    if spec.cap is None:
        cut = islands.select("a", "b")
    else:
        pieces = F.when(F.col("b") - F.col("a") > spec.cap, F.sequence(F.col("a"), F.col("b"), F.lit(spec.cap).cast("long"))).otherwise(F.array("a"))
        cut = islands.withColumn("x", F.explode(pieces)).select(F.col("x").alias("a"), F.when(F.col("b") - F.col("a") > spec.cap, F.least(F.col("x") + spec.cap - 1, F.col("b"))).otherwise(F.col("b")).alias("b"))
    # the peak is that of all frames of an episode, those in its gaps too
    inside = cut.withColumn("f", F.explode(F.sequence("a", "b"))).join(index, "f")
    kept = inside.groupBy("a", "b").agg(F.max(F.coalesce("wet", F.lit(0.0))).alias("peak")).where((F.col("b") - F.col("a") >= spec.min_span) & (F.col("peak") >= spec.min_peak))
    return kept.select((F.row_number().over(Window.orderBy("a")) - 1).cast("long").alias("event"), F.col("a").alias("f_start"), F.col("b").alias("f_end"))


def complete_history(index: DataFrame, n: int) -> DataFrame:
    """(f): frames whose last n frames, themselves included, are all there. The index holds the whole axis."""
    last = Window.orderBy("f").rowsBetween(-(n - 1), 0)
    return index.withColumn("have", F.sum((~F.col("missing")).cast("int")).over(last)).where(F.col("have") == n).select("f")


def issue_times(index: DataFrame, events: DataFrame, every: int = 3, min_wet: float = 0.01, history: int = 2) -> DataFrame:
    """(event, f): every so many frames of an episode, if wet enough and with a complete history."""
    inside = events.withColumn("f", F.explode(F.sequence("f_start", "f_end"))).where((F.col("f") - F.col("f_start")) % every == 0)
    return inside.join(index.where(F.col("wet") >= min_wet), "f").join(complete_history(index, history), "f", "left_semi").select("event", "f")


def spells(events: DataFrame, gap: int = 3) -> DataFrame:
    """(event, spell): events whose start lies within the gap of the latest end so far share a spell."""
    order = Window.orderBy("f_start", "f_end", "event")
    latest = F.max("f_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("new", F.coalesce((F.col("f_start") - latest > gap).cast("int"), F.lit(1))).select("event", F.sum("new").over(order).alias("spell"))


def reused_issues(issues: DataFrame, valid: DataFrame) -> DataFrame:
    """(event, f) of another run, once each and only where the history exists; events are numbered anew by time."""
    kept = issues.select("event", "f").distinct().join(valid, "f", "left_semi")
    first = kept.groupBy("event").agg(F.min("f").alias("first"))
    number = first.select("event", (F.row_number().over(Window.orderBy("first", "event")) - 1).cast("long").alias("number"))
    return kept.join(number, "event").select(F.col("number").alias("event"), "f")
