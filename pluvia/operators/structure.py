"""Structure functions: how much motion or wind differs between places, by their distance.

On a grid all pairs of cells with the same offset are one sum, and the sums of all offsets are a
correlation of the frame with itself. Correlations add up as spectra, so a task adds the spectra of
its frames and turns them back once: work grows with the cells, not with their pairs. Sums come from
floating-point transforms and are good to about twelve digits; numbers of pairs are exact.

Places of scattered points meet those of the squares around, whose side is the largest distance asked for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.sources.shared import spread

SUMS = "i int, j int, n long, s double"
EARTH_KM = 6371


def offset_sums(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    """(i, j, n, s): for each offset of rows i and columns j, of a pair only one of the two, the pairs of known cells and the sum of their vectors' squared differences.

    frames: (at, u, v), the places of the known cells, row by row, and their vectors; a frame without known cells gives nothing.
    """
    shape = (2 * rows, 2 * cols)

    def run(batches):
        count = total = np.zeros((shape[0], shape[1] // 2 + 1), complex)
        for batch in batches:
            for at, u, v in zip(*(batch.column(c) for c in ("at", "u", "v")), strict=True):
                place = np.divmod(at.values.to_numpy(), cols)
                fields = []
                for values in (1.0, u := u.values.to_numpy(zero_copy_only=False).astype(float), v := v.values.to_numpy(zero_copy_only=False).astype(float), u * u + v * v):
                    grid = np.zeros(shape)
                    grid[place] = values
                    fields.append(np.fft.rfft2(grid))
                known, fu, fv, squares = fields
                count = count + np.abs(known) ** 2
                total = total + 2 * (np.conj(squares) * known).real - 2 * (np.abs(fu) ** 2 + np.abs(fv) ** 2)
        i, j = np.meshgrid(np.arange(-rows + 1, rows), np.arange(-cols + 1, cols), indexing="ij")
        half = (i > 0) | ((i == 0) & (j > 0))
        i, j = i[half], j[half]
        n, s = (np.fft.irfft2(x, s=shape)[i, j] for x in (count, total))
        n = np.rint(n).astype(np.int64)
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), pa.array(n[some]), pa.array(np.maximum(0, s[some]))], ["i", "j", "n", "s"])

    return frames.select("at", "u", "v").mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def by_distance(sums: DataFrame, cell: float = 1.0, width: float = 1.0) -> DataFrame:
    """(bin, n, d): the mean squared difference of all pairs whose distance in cells of the given side falls into a bin of the given width."""
    place = F.floor(F.sqrt((F.col("i") * F.col("i") + F.col("j") * F.col("j")).cast("double")) * cell / width)
    return sums.groupBy(place.alias("bin")).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("d"))


def between_points(points: DataFrame, width: float = 20.0, bins: int = 20) -> DataFrame:
    """(bin, n, d) of points (t, id, lat, lon, u, v): pairs of the same time by great-circle distance in km, up to bins of the given width.

    The squared differences between the points of two places are sums of each place's points, so a time's points
    of one place are one row, and places meet in squares of the largest distance; what an id's own points have
    added is taken off again. Vectors are taken from their mean, which changes no difference. A point without
    coordinates or vector takes no part; several rows of an id at a time are points of their own, but no pairs.
    """
    known = points.where("t IS NOT NULL AND id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")
    # one row
    mean = known.agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    from_mean = known.join(F.broadcast(mean)).select("t", "id", "lat", "lon", (F.col("u") - F.col("mu")).alias("u"), (F.col("v") - F.col("mv")).alias("v"))
    sums = [F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("s")]
    own = from_mean.groupBy("t", "id", "lat", "lon").agg(*sums)
    places = own.groupBy("t", "lat", "lon").agg(*(F.sum(k).alias(k) for k in ("n", "u", "v", "s")))
    within = lambda some: some.where("n > 1").select(F.lit(0).cast("long").alias("bin"), F.expr("n * (n - 1) div 2").alias("n"), (F.col("n") * F.col("s") - F.col("u") * F.col("u") - F.col("v") * F.col("v")).alias("s"))
    minus = lambda some: some.select("bin", (-F.col("n")).alias("n"), (-F.col("s")).alias("s"))
    # an id's rows of several places at a time: few, they meet by id
    moved = own.groupBy("t", "id").agg(F.count("*").alias("places")).where("places > 1").select("t", "id")
    again = _between(own.join(moved, ["t", "id"], "left_semi"), ["t", "id"], width, bins)
    added = [_between(places, ["t"], width, bins), within(places), minus(within(own)), minus(again)]
    found = reduce(DataFrame.unionByName, added).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    return found.select("bin", "n", (F.greatest(F.lit(0.0), F.col("s")) / F.col("n")).alias("d"))


def _between(places: DataFrame, keys: list[str], width: float, bins: int) -> DataFrame:
    """(bin, n, s): pairs of points, and the sum of their squared differences, between different places of the same keys; each pair of places once."""
    reach = width * bins
    km = EARTH_KM * np.pi / 180  # of a degree of latitude
    # columns of squares are as wide in degrees as the largest distance is at the northernmost latitude that a neighbour can have
    row = F.floor(F.col("lat") * km / reach)
    across = F.greatest(F.lit(1e-3), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("row") * (reach / km)) + 3 * reach / km))))
    a = places.withColumn("row", row)
    # a point's own column is counted in the widths of each row that it may meet
    around = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    column = lambda: F.floor(F.col("lon") * km * across / reach)
    left = a.select(*keys, "row", "lat", "lon", *(F.col(c).alias(f"{c}1") for c in ("lat", "lon", "n", "u", "v", "s")))
    left = left.withColumn("step", around).withColumn("row", F.col("row") + F.col("step")).withColumn("near", around).withColumn("col", column() + F.col("near")).drop("lat", "lon", "step", "near")
    right = a.withColumn("col", column()).select(*keys, "row", "col", "lat", "lon", "n", "u", "v", "s")
    met = spread(left, *keys, "row", "col").join(spread(right, *keys, "row", "col"), [*keys, "row", "col"]).where("lat1 < lat OR (lat1 = lat AND lon1 < lon)")
    half = lambda x, y: F.pow(F.sin((F.radians(x) - F.radians(y)) / 2), F.lit(2))
    d = 2 * EARTH_KM * F.asin(F.sqrt(half(F.col("lat1"), F.col("lat")) + F.cos(F.radians("lat1")) * F.cos(F.radians("lat")) * half(F.col("lon1"), F.col("lon"))))
    square = F.col("n1") * F.col("s") + F.col("n") * F.col("s1") - 2 * (F.col("u1") * F.col("u") + F.col("v1") * F.col("v"))
    return met.select(F.floor(d / width).alias("bin"), (F.col("n1") * F.col("n")).alias("n"), square.alias("s")).where(F.col("bin") < bins).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
