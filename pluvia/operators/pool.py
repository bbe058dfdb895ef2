"""Pooling of score rows as ratios of sums, paired comparisons, and cluster bootstraps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.operators.score import csi, fss

BASELINE = "persistence"


def summary(rows: DataFrame, thresholds=(1, 2, 4)) -> DataFrame:
    """One row for each model and lead: cases, events and pooled metrics."""
    ratio = F.when((F.col("sum_f") > 0) & (F.col("sum_t") > 0), F.log(F.col("sum_f") / F.col("sum_t")))
    parts = [F.count_distinct("event").alias("events"), F.count("*").alias("cases"), F.stddev_pop(ratio).alias("sd_log_ratio"), F.avg("corr").alias("corr"), fss().alias("fss"), F.try_divide(F.sum("sum_f").cast("double"), F.sum("sum_t").cast("double")).alias("rain_ratio"), F.try_divide(F.sum("brier"), F.sum("n").cast("double")).alias("brier")]
    return rows.groupBy("model", "lead").agg(*parts, *(csi(x).alias(f"csi_{x}") for x in thresholds))


def chosen(rows: DataFrame, models: list[str] | None = None, leads: list[int] | None = None, present: list[str] | None = None) -> DataFrame:
    """The score rows of these models and leads that have these optional keys; None asks for nothing. A key that no row has is in none."""
    for column, wanted in (("model", models), ("lead", leads)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(wanted))
    for key in present or []:
        rows = rows.where(F.col(key).isNotNull() if key in rows.columns else F.lit(False))
    return rows


def fallback_share() -> Column:
    """Share of cases in which the model had to give another one's forecast; a case that does not say is none."""
    return F.avg(F.coalesce(F.col("fallback"), F.lit(False)).cast("double"))


def unit_sums(rows: DataFrame, unit: str = "event") -> DataFrame:
    """(unit, model, lead, e, r): the sums that a ratio needs, for each resampling unit."""
    return rows.groupBy(F.col(unit).alias("unit"), "model", "lead").agg(F.sum("fss_e").alias("e"), F.sum("fss_r").alias("r"))


def against(units: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """(unit, model, lead, e, r, e0, r0) on the units that both have."""
    base = units.where(F.col("model") == baseline).select("unit", "lead", F.col("e").alias("e0"), F.col("r").alias("r0"))
    return units.where(F.col("model") != baseline).join(base, ["unit", "lead"])


def gain() -> Column:
    """Pooled FSS over that of the baseline."""
    return F.try_divide(F.sum("e0").cast("double"), F.sum("r0").cast("double")) - F.try_divide(F.sum("e").cast("double"), F.sum("r").cast("double"))


def wins(pairs: DataFrame) -> DataFrame:
    """Share of units in which the model beats the baseline; units without a reference are left out."""
    better = F.col("e").cast("double") / F.col("r") < F.col("e0").cast("double") / F.col("r0")
    return pairs.where("r > 0 AND r0 > 0").groupBy("model", "lead").agg(F.avg(better.cast("double")).alias("share"))


def draws(units: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, unit, w): how often each of n draws with replacement picks a unit, by hashes, so that every run agrees.

    units (unit): numbered in order; the picks of all draws are one exploded range, no loop.
    """
    numbered = units.select("unit").distinct().withColumn("k", F.row_number().over(Window.orderBy("unit")) - 1)
    size = numbered.agg(F.count("*").alias("size"))
    slots = size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("size > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    picked = slots.select("draw", (hashed % F.col("size")).alias("k")).groupBy("draw", "k").agg(F.count("*").alias("w"))
    return picked.join(numbered, "k").select("draw", "unit", "w")


def interval(pairs: DataFrame, weights: DataFrame, statistic: Column, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys, low, high) of the statistic over draws; pairs' sums e, r, e0, r0 are weighed before it sums them."""
    joined = pairs.join(weights, "unit")
    for c in ("e", "r", "e0", "r0"):
        joined = joined.withColumn(c, F.col(c) * F.col("w"))
    each = joined.groupBy(*keys, "draw").agg(statistic.alias("d"))
    edge = (1 - level) / 2
    return each.groupBy(*keys).agg(F.percentile("d", F.lit(edge)).alias("low"), F.percentile("d", F.lit(1 - edge)).alias("high"))


#: Shares of the rows that percentile_approx may be off by, and that are looked at around a quantile: 1 of so many.
APART = 5000


def quantiles(rows: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column of stored rows, interpolated as percentile does; NULLs are left out.

    Two approximate ranks enclose each quantile; smaller values are counted, and only the values between the two are
    ordered. No task holds all values, and the driver gets two of them for each quantile.
    """
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = known.count()
    if not n:
        return [None] * len(shares)
    off = 1 / APART + 2 / n
    ends = known.agg(F.percentile_approx("x", [x for q in shares for x in (max(0.0, q - off), min(1.0, q + off))], 2 * APART)).first()[0]
    spans = list(zip(ends[::2], ends[1::2], strict=True))
    below = known.agg(*(F.count_if(F.col("x") < a) for a, _ in spans)).first()
    out = []
    for q, (a, b), before in zip(shares, spans, below, strict=True):
        inside = known.where((F.col("x") >= a) & (F.col("x") <= b)).groupBy("x").agg(F.count("*").alias("n"))
        upto = inside.withColumn("upto", F.lit(before) + F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
        at = (n - 1) * q
        low, high = math.floor(at), math.ceil(at)
        v, w = upto.agg(*(F.min(F.when(F.col("upto") > i, F.col("x"))) for i in (low, high))).first()
        out.append(v if v == w else (high - at) * v + (at - low) * w)
    return out
