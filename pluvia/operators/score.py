"""Scores of forecasts as sums and counts, so that any grouping follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.sources.shared import spread
from pluvia.spec import TRIAL, WET, GridSpec

KEYS = ("event", "f", "model", "lead")
THRESHOLDS = (1, 2, 4)


def box_sums(df: DataFrame, values: dict[str, Column], half: int, keys: tuple[str, ...]) -> DataFrame:
    """Sums of values over the (2 half + 1) squared cells around each cell of dense fields; what lies beyond the edge counts as zero.

    One window runs along the rows for all values, one along the columns; both stay within a field,
    so the fields' partitioning serves both.
    """
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-half, half)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-half, half)
    rows = df.select("*", *(F.sum(v).over(across).alias(f"__{name}") for name, v in values.items()))
    return rows.select("*", *(F.sum(f"__{name}").over(down).alias(name) for name in values)).drop(*(f"__{name}" for name in values))


def with_truth(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecasts (.., f, lead, r, c, p) with the truth t at f + lead; those whose frame is missing drop out, cells without coverage have t NULL."""
    then = truth.select(F.col("f").alias("__valid"), "r", "c", F.col("v").alias("t"))
    return forecasts.withColumn("__valid", F.col("f") + F.col("lead")).join(then, ["__valid", "r", "c"]).drop("__valid")


def counts(pairs: DataFrame, keys: tuple[str, ...] = KEYS, thresholds=THRESHOLDS, wet: float = WET, prob: Column | None = None) -> DataFrame:
    """Cell by cell sums over the cells that the truth covers."""
    return pairs.groupBy(*keys).agg(*count_columns(thresholds, wet, prob)).where("n > 0")


def count_columns(thresholds=THRESHOLDS, wet: float = WET, prob: Column | None = None) -> list[Column]:
    """Aggregates of rows (p, t); those without truth add nothing."""
    t = F.col("t")
    p = F.when(t.isNotNull(), F.col("p"))
    parts = [F.count("t").alias("n"), F.sum(p).alias("sum_f"), F.sum(t).alias("sum_t"), F.sum((p - t) * (p - t)).alias("sse")]
    parts.append(F.when((F.stddev_pop(p) > 0) & (F.stddev_pop("t") > 0), F.corr(p.cast("double"), t.cast("double"))).alias("corr"))
    for x in thresholds:
        parts += [F.count_if((p >= x) & (t >= x)).alias(f"hit_{x}"), F.count_if((p < x) & (t >= x)).alias(f"miss_{x}"), F.count_if((p >= x) & (t < x)).alias(f"fa_{x}")]
    chance = prob if prob is not None else (p >= wet).cast("double")
    parts.append(F.sum((chance - (t >= wet).cast("double")) ** 2).alias("brier"))
    return parts


def fractions(pairs: DataFrame, half: int, keys: tuple[str, ...] = KEYS, wet: float = WET) -> DataFrame:
    """pairs with np and nt: wet cells of forecast and truth around each cell; cells without truth count as dry in both."""
    known = F.col("t").isNotNull()
    wet_p, wet_t = F.when(known & (F.col("p") >= wet), 1).otherwise(0), F.when(known & (F.col("t") >= wet), 1).otherwise(0)
    return box_sums(pairs.repartition(*keys), {"np": wet_p, "nt": wet_t}, half, keys)


def fss_sums(pairs: DataFrame, half: int, keys: tuple[str, ...] = KEYS, wet: float = WET, name: str = "fss") -> DataFrame:
    """Error and reference sums of the fractions score, in counts of cells squared: divide by the window's size squared for fractions."""
    return fractions(pairs, half, keys, wet).groupBy(*keys).agg(*fss_columns(name))


def fss_columns(name: str = "fss") -> list[Column]:
    np_, nt = F.col("np"), F.col("nt")
    return [F.sum((np_ - nt) * (np_ - nt)).alias(f"{name}_e"), F.sum(np_ * np_ + nt * nt).alias(f"{name}_r")]


def rows(pairs: DataFrame, half: int = 4, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Score rows: counts and fractions sums in one aggregation over fields that are dealt out once."""
    return fractions(pairs, half, keys).groupBy(*keys).agg(*count_columns(), *fss_columns()).where("n > 0")


def fss_bands(pairs: DataFrame, half: int, keys: tuple[str, ...], wet: float = WET) -> DataFrame:
    """The same by the column band, for cells with truth only: bands do not add up to the total."""
    np_, nt = F.col("np"), F.col("nt")
    return fractions(pairs, half, keys, wet).where(F.col("t").isNotNull()).groupBy(*keys, "band").agg(F.sum((np_ - nt) * (np_ - nt)).alias("fss_e"), F.sum(np_ * np_ + nt * nt).alias("fss_r"))


def neighbourhood(pairs: DataFrame, half: int, keys: tuple[str, ...] = KEYS, wet: float = WET) -> DataFrame:
    """pairs with pn: the share of wet forecast cells among the covered cells around each cell."""
    known = F.col("t").isNotNull()
    spread = box_sums(pairs.repartition(*keys), {"num": F.when(known & (F.col("p") >= wet), 1).otherwise(0), "den": known.cast("int")}, half, keys)
    return spread.withColumn("pn", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0)).drop("num", "den")


def reliability(pairs: DataFrame, prob: Column, observed: Column, keys: tuple[str, ...], bins: int = 10) -> DataFrame:
    """(.., bin, n, p_sum, o_sum)."""
    return pairs.groupBy(*keys, F.least(F.floor(prob * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(prob).alias("p_sum"), F.sum(observed.cast("double")).alias("o_sum"))


def csi(x) -> Column:
    return F.try_divide(F.sum(f"hit_{x}").cast("double"), F.sum(F.col(f"hit_{x}") + F.col(f"miss_{x}") + F.col(f"fa_{x}")).cast("double"))


def fss(name: str = "fss") -> Column:
    return 1 - F.try_divide(F.sum(f"{name}_e").cast("double"), F.sum(f"{name}_r").cast("double"))


def box_counts(wet: np.ndarray, half: int) -> np.ndarray:
    """Sums over the (2 half + 1) squared cells around each cell of [frame, r, c]; what lies beyond the edge counts as zero."""
    side = 2 * half + 1
    total = np.pad(wet, ((0, 0), (half + 1, half), (half + 1, half))).cumsum(axis=1).cumsum(axis=2)
    return total[:, side:, side:] - total[:, :-side, side:] - total[:, side:, :-side] + total[:, :-side, :-side]


def frame_sums(p: np.ndarray, t: np.ndarray, half: int, thresholds=THRESHOLDS, wet: float = WET) -> dict[str, np.ndarray]:
    """What rows() gives for each of [frame, r, c] forecasts p and truths t (NaN for no coverage)."""
    known = ~np.isnan(t)
    a, b = np.where(known, p, 0.0), np.where(known, t, 0.0)
    each = lambda x: x.reshape(len(x), -1).sum(axis=1)
    n, sa, sb = each(known), each(a), each(b)
    safe = np.maximum(n, 1)
    va, vb, cov = each(a * a) / safe - (sa / safe) ** 2, each(b * b) / safe - (sb / safe) ** 2, each(a * b) / safe - sa * sb / safe**2
    flat = (va <= 1e-12) | (vb <= 1e-12)
    out = {"n": n, "sum_f": sa, "sum_t": sb, "sse": each((a - b) ** 2), "corr": np.where(flat, np.nan, cov / np.sqrt(np.where(flat, 1, va * vb)))}
    for x in thresholds:
        yes, was = known & (p >= x), known & (b >= x)
        out |= {f"hit_{x}": each(yes & was), f"miss_{x}": each(~yes & was), f"fa_{x}": each(yes & ~was)}
    yes, was = known & (p >= wet), known & (b >= wet)
    fc, truth = box_counts(yes.astype(np.int64), half), box_counts(was.astype(np.int64), half)
    return out | {"brier": each(yes != was).astype(float), "fss_e": each((fc - truth) ** 2), "fss_r": each(fc**2 + truth**2)}


def shifted_frames(last: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each frame moved by its own whole cells; the edge is drawn out, no coverage counts as dry."""
    n, h, w = last.shape
    r = np.clip(np.arange(h)[None] - down[:, None], 0, h - 1)
    c = np.clip(np.arange(w)[None] - right[:, None], 0, w - 1)
    return np.nan_to_num(last[np.arange(n)[:, None, None], r[:, :, None], c[:, None, :]])


def shift_rows(issues: DataFrame, packed: DataFrame, models: dict[str, tuple[int, int]], steps: int, half: int = 4, grid: GridSpec = TRIAL) -> DataFrame:
    """rows() of whole-cell shifts {name: (dx, dy) a step} at the issues (event, f) on packed frames (f, v).

    Frames are rows, and an issue meets its last frame and its truths: one shuffle of frames for each, none of cells.
    """
    asked = issues.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("g", F.col("f") + F.col("lead"))
    met = asked.join(packed.select("f", F.col("v").alias("last")), "f").join(spread(packed.select(F.col("f").alias("g"), F.col("v").alias("truth")), "g"), "g").select("event", "f", "lead", "last", "truth")
    names = ["n", "sum_f", "sum_t", "sse", "corr", *(f"{k}_{x}" for x in THRESHOLDS for k in ("hit", "miss", "fa")), "brier", "fss_e", "fss_r"]
    doubles = {"sum_f", "sum_t", "sse", "corr", "brier"}
    schema = "event long, f long, model string, lead int, " + ", ".join(f"{k} {'double' if k in doubles else 'long'}" for k in names)

    def run(batches):
        for part in few(batches):
            stack = lambda k, part=part: part.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, grid.rows, grid.cols)
            last, truth, lead = stack("last"), stack("truth"), part.column("lead").to_numpy()
            for name, (dx, dy) in models.items():
                sums = frame_sums(shifted_frames(last, lead * dy, lead * dx), truth, half)
                columns = [pa.array(sums[k], pa.float64() if k in doubles else pa.int64(), from_pandas=True) for k in names]
                yield pa.RecordBatch.from_arrays([part.column("event"), part.column("f"), pa.array([name] * part.num_rows), part.column("lead"), *columns], ["event", "f", "model", "lead", *names])

    return met.mapInArrow(run, schema).where("n > 0")


def window_hours(issues: DataFrame, packed: DataFrame, windows: dict[str, tuple[int, int]], models: dict[str, tuple[int, int]], steps: int, half: int = 1, grid: GridSpec = TRIAL) -> DataFrame:
    """(event, f, city, model, mm, obs) of whole-cell shifts {name: (dx, dy) a step} at the issues (event, f) on packed frames (f, v), NaN for no coverage.

    mm and obs are means over the (2 half + 1) squared cells around each window's centre, summed over the leads; issues without a truth at a lead drop out.
    A frame tells its own means, and those that the shifts will bring, in a few numbers: these meet the issues, no cell is a row. Sums run in the order of the leads.
    """
    names = ["f", "city", "t", *models]
    schema = "f long, city string, t double, " + ", ".join(f"`{m}` double" for m in models)
    around = np.arange(-half, half + 1)

    def run(batches):
        for part in few(batches):
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, grid.rows, grid.cols)
            for city, (r, c) in windows.items():
                own = v[:, r - half : r + half + 1, c - half : c + half + 1].reshape(len(v), -1)
                known = ~np.isnan(own)
                n, total = known.sum(axis=1), np.where(known, own, 0.0).sum(axis=1)
                columns = [np.where(n > 0, total / np.maximum(n, 1), np.nan)]
                for dx, dy in models.values():
                    amount = np.zeros(len(v))
                    for k in range(1, steps + 1):
                        from_r, from_c = np.clip(r + around - k * dy, 0, grid.rows - 1), np.clip(c + around - k * dx, 0, grid.cols - 1)
                        amount += np.nan_to_num(v[:, from_r][:, :, from_c]).reshape(len(v), -1).sum(axis=1) / len(around) ** 2
                    columns.append(amount)
                yield pa.RecordBatch.from_arrays([part.column("f"), pa.array([city] * len(v)), *(pa.array(x, from_pandas=True) for x in columns)], names)

    means = packed.select("f", "v").mapInArrow(run, schema)
    served = means.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("f", F.col("f") - F.col("k"))  # k 0: the issue's own frame
    truths = [F.max(F.when(F.col("k") == k, F.col("t"))).alias(f"__t{k}") for k in range(1, steps + 1)]
    each = served.groupBy("f", "city").agg(*(F.max(F.when(F.col("k") == 0, F.col(m))).alias(m) for m in models), *truths)
    obs = sum((F.col(f"__t{k}") for k in range(2, steps + 1)), F.col("__t1"))  # NULL if any of them is
    met = issues.select("event", "f").join(each.withColumn("obs", obs).where("obs IS NOT NULL"), "f")
    return met.unpivot(["event", "f", "city", "obs"], list(models), "model", "mm").select("event", "f", "city", "model", "mm", "obs")


def wet_counts(p: np.ndarray, t: np.ndarray, wet: float = WET) -> tuple[float, int, int]:
    """(sum_f, hit, fa) of a forecast frame and its truth; a forecast within half a millionth of the threshold reaches it."""
    yes, was = np.round(p, 6) >= wet, t >= wet
    return float(p.sum()), int((yes & was).sum()), int((yes & ~was).sum())


def few(batches, rows: int = 64):
    """Parts of so many rows at most: what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Sums of a forecast frame, by issue and lead.
FRAME_COUNTS = "f long, lead int, sum_f double, hit long, fa long"


def with_truths(issues: DataFrame, frames: DataFrame, steps: int) -> DataFrame:
    """issues (f, ..) with truths, an array (lead, at, v) of the packed frames that are there at each lead; others are dry."""
    ahead = frames.select("f", "at", "v").withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("f", F.col("f") - F.col("lead"))
    found = ahead.join(issues.select("f").distinct(), "f", "left_semi").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("lead", "at", "v"))).alias("truths"))
    return issues.join(found, "f", "left")


def truths_of(column: pa.Array, i: int, steps: int, grid: GridSpec) -> np.ndarray:
    """[lead, r, c] of a row of with_truths()."""
    out = np.zeros((steps, grid.rows * grid.cols))
    if column[i].is_valid:
        some = column[i].values
        for k, lead in enumerate(some.field("lead").to_pylist()):
            out[lead - 1, some.field("at")[k].values.to_numpy()] = some.field("v")[k].values.to_numpy()
    return out.reshape(steps, grid.rows, grid.cols)


def frame_counts(fs: list[int], made: list[np.ndarray], truths: list[np.ndarray]) -> pa.RecordBatch:
    """FRAME_COUNTS of forecasts [lead, r, c], one for each issue, and their truths."""
    rows = [(f, s + 1, *wet_counts(p[s], t[s])) for f, p, t in zip(fs, made, truths, strict=True) for s in range(len(p))]
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], [c.split()[0] for c in FRAME_COUNTS.split(", ")])
