"""Forecasts from constant vectors, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.spec import TRIAL, GridSpec


def leads(issues: DataFrame, steps: int) -> DataFrame:
    return issues.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(steps))))


def persistence(issues: DataFrame, fields: DataFrame, steps: int) -> DataFrame:
    """(issue columns, model, lead, r, c, p): the last frame for every lead."""
    last = fields.select("f", "r", "c", F.coalesce("v", F.lit(0)).alias("p"))
    return leads(issues, steps).withColumn("model", F.lit("persistence")).join(last, "f")


def bilinear(points: DataFrame, fields: DataFrame, x: Column, y: Column, keys: list[str], grid: GridSpec = TRIAL, name: str = "p") -> DataFrame:
    """points with the field's value at (x, y), clamped to the grid: four weighted corners, one join.

    fields (f, r, c, v) may leave out cells of value zero.
    """
    cx, cy = F.greatest(F.lit(0.0), F.least(F.lit(grid.cols - 1.0), x)), F.greatest(F.lit(0.0), F.least(F.lit(grid.rows - 1.0), y))
    placed = points.withColumn("__x", cx).withColumn("__y", cy).withColumn("__c", F.floor("__x").cast("int")).withColumn("__r", F.floor("__y").cast("int"))
    fx, fy = F.col("__x") - F.col("__c"), F.col("__y") - F.col("__r")
    corners = F.array(*(F.struct((F.least(F.col("__r") + i, F.lit(grid.rows - 1))).alias("r"), F.least(F.col("__c") + j, F.lit(grid.cols - 1)).alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)))
    spread = placed.withColumn("__k", F.explode(corners)).where("__k.w > 0")
    values = fields.select(F.col("f").alias("__f"), F.col("r").alias("__vr"), F.col("c").alias("__vc"), "v")
    hit = spread.join(values, (F.col("f") == F.col("__f")) & (F.col("__k.r") == F.col("__vr")) & (F.col("__k.c") == F.col("__vc")), "left")
    return hit.groupBy(*keys).agg(F.sum(F.col("__k.w") * F.coalesce("v", F.lit(0))).alias(name))


def moved(issues: DataFrame, fields: DataFrame, steps: int, grid: GridSpec = TRIAL, zero_outside: bool = False) -> DataFrame:
    """(.., lead, r, c, p) of issues (.., f, model, dx, dy): each cell reads the last frame where it came from, once.

    zero_outside: no rain enters from beyond the edge. Every cell of every lead is a row here; scores are made on whole frames (motion.vector_counts).
    """
    wide = leads(issues, steps).withColumn("sx", F.col("lead") * F.col("dx")).withColumn("sy", F.col("lead") * F.col("dy"))
    cells = wide.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))
    x, y = F.col("c") - F.col("sx"), F.col("r") - F.col("sy")
    out = bilinear(cells.withColumn("x", x).withColumn("y", y), fields, F.col("x"), F.col("y"), [*[k for k in issues.columns], "lead", "r", "c", "x", "y"], grid)
    p = F.greatest(F.lit(0.0), F.col("p"))
    if zero_outside:
        p = F.when(F.col("x").between(0, grid.cols - 1) & F.col("y").between(0, grid.rows - 1), p).otherwise(0.0)
    return out.withColumn("p", p).drop("x", "y")


def shifted(issues: DataFrame, fields: DataFrame, steps: int, dx: int, dy: int, grid: GridSpec = TRIAL, model: str = "shift") -> DataFrame:
    """As moved, for whole cells: an equi-join."""
    last = fields.select("f", F.col("r").alias("__r"), F.col("c").alias("__c"), F.coalesce("v", F.lit(0)).alias("p"))
    cells = leads(issues, steps).withColumn("model", F.lit(model)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))
    back = cells.withColumn("__r", F.greatest(F.lit(0), F.least(F.lit(grid.rows - 1), F.col("r") - F.col("lead") * dy))).withColumn("__c", F.greatest(F.lit(0), F.least(F.lit(grid.cols - 1), F.col("c") - F.col("lead") * dx)))
    return back.join(last, ["f", "__r", "__c"]).drop("__r", "__c")


def fade(lead: Column, steps: int, floor: float) -> Column:
    """Weight of a lead for display: from 1 at the first step down to the floor."""
    return 1 - (1 - F.lit(floor)) * (lead - 1) / (steps - 1) if steps > 1 else F.lit(1.0)
