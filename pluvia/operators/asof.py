"""Joins in time: backward with a tolerance, nearest, and linear between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _union(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, side, row, x): rows of the left, x of the right, for windows by key."""
    rows = left.select(key, time, F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast("struct<t:bigint,v:double>").alias("x"))
    values = right.select(key, time, F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v")).alias("x"))
    return rows.unionByName(values)


def backward(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tolerance: int) -> DataFrame:
    """left with the value of right's latest row at or before its time, NULL if that is older than the tolerance.

    Both sides go through one window by key and stretch of time as long as the tolerance, to which the values of
    the stretch before are added: a shuffle, no pairs, and a frequent key is many windows.
    """
    stretch = F.floor(F.col(time) / max(1, tolerance))
    both = _union(left, right, key, time, value)
    spread = both.withColumn("stretch", F.explode(F.when(F.col("side") == 1, F.array(stretch)).otherwise(F.array(stretch, stretch + 1))))
    order = Window.partitionBy(key, "stretch").orderBy(time, "side", F.col("x.v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = spread.withColumn("last", F.last("x", True).over(order)).where("side = 1")
    fresh = F.col(time) - F.col("last.t") <= tolerance
    return seen.select("row.*", F.when(fresh, F.col("last.v")).alias(value))


#: Seconds of a stretch of linear and nearest joins.
STRETCH = 86_400


def _around(left: DataFrame, right: DataFrame, key: str, time: str, value: str, stretch: int) -> DataFrame:
    """Rows of the left with the samples at or before (a) and at or after (b) their times.

    Windows are by key and stretch of time, to which the nearest samples of the stretches before and after are
    added, so a frequent key is many windows. Only the ends of the stretches, a row each, are ordered by key.
    """
    both = _union(left, right, key, time, value).withColumn("stretch", F.floor(F.col(time) / stretch))
    ends = both.groupBy(key, "stretch").agg(F.max("x").alias("last"), F.min("x").alias("first"))
    order = Window.partitionBy(key).orderBy("stretch")
    came = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    comes = F.last("first", True).over(Window.partitionBy(key).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumns({"came": came, "comes": comes}).select(key, "stretch", F.explode(F.array("came", "comes")).alias("x")).where("x IS NOT NULL")
    kinds = dict(both.dtypes)
    more = carried.select(key, F.col("x.t").cast(kinds[time]).alias(time), F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), "x", "stretch")
    window = Window.partitionBy(key, "stretch")
    before = window.orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    after = window.orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, 0)
    return both.unionByName(more).withColumn("a", F.last("x", True).over(before)).withColumn("b", F.last("x", True).over(after)).where("side = 1")


def linear(left: DataFrame, right: DataFrame, key: str, time: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """left with right's value at its time, linear between the samples around it; NULL outside them. Sample times are distinct."""
    seen, a, b = _around(left, right, key, time, value, stretch), F.col("a"), F.col("b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col(time) - a["t"]) / (b["t"] - a["t"])
    return seen.select("row.*", F.when(a.isNull() | b.isNull(), None).when(a["t"] == b["t"], a["v"]).otherwise(between).alias(value))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """left with the value of the nearest row of right, however far; the earlier one on ties, NULL without any. Sample times are distinct."""
    seen, a, b = _around(left, right, key, time, value, stretch), F.col("a"), F.col("b")
    later = a.isNull() | (b["t"] - F.col(time) < F.col(time) - a["t"])
    return seen.select("row.*", F.when(later, b["v"]).otherwise(a["v"]).alias(value))
