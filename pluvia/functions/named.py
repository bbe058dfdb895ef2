"""Regions and metrics by name, for callers that name them in text. Further ones are added to the dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.operators import score
from pluvia.spec import TRIAL, GridSpec

#: Region -> predicate of a cell (r, c) of a grid.
REGIONS: dict[str, Callable[[Column, Column, GridSpec], Column]] = {
    "all": lambda r, c, grid: F.lit(True),
    "north": lambda r, c, grid: r * 2 < grid.rows,
    "east": lambda r, c, grid: c * 2 >= grid.cols,
    "middle": lambda r, c, grid: (F.abs(2 * r - grid.rows + 1) * 2 < grid.rows) & (F.abs(2 * c - grid.cols + 1) * 2 < grid.cols),
}
#: Metric -> aggregate of score rows.
METRICS: dict[str, Callable[[], Column]] = {
    "fss": score.fss,
    **{f"csi_{x}": (lambda x=x: score.csi(x)) for x in score.THRESHOLDS},
    "rain_ratio": lambda: F.try_divide(F.sum("sum_f").cast("double"), F.sum("sum_t").cast("double")),
    "brier": lambda: F.try_divide(F.sum("brier"), F.sum("n").cast("double")),
    "corr": lambda: F.avg("corr"),
}


def region(name: str, r: Column, c: Column, grid: GridSpec = TRIAL) -> Column:
    if name not in REGIONS:
        raise KeyError(f"no region {name!r}; there are {', '.join(sorted(REGIONS))}")
    return REGIONS[name](r, c, grid)


def metrics(*names: str) -> list[Column]:
    """Aggregates of the named metrics, under their names."""
    if missing := [n for n in names if n not in METRICS]:
        raise KeyError(f"no metric {', '.join(missing)}; there are {', '.join(sorted(METRICS))}")
    return [METRICS[n]().alias(n) for n in names]
