"""Grids, masks and regridding as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.sources.shared import spread
from pluvia.spec import BANDS, BOX, RADARS, GridSpec

EARTH_KM = 6371


def cell_of(grid: GridSpec, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(row, column) of the cell that holds a point; truncates, does not check bounds."""
    c = (lon - grid.west) / (grid.east - grid.west) * grid.cols
    r = (grid.north - lat) / (grid.north - grid.south) * grid.rows
    return r.cast("int"), c.cast("int")


def centre_of(grid: GridSpec, r: Column, c: Column) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    return grid.north - (r + 0.5) * (grid.north - grid.south) / grid.rows, grid.west + (c + 0.5) * (grid.east - grid.west) / grid.cols


def great_circle(lat: Column, lon: Column, to_lat, to_lon) -> Column:
    """Haversine distance in km."""
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.lit(x)) for x in (lat, lon, to_lat, to_lon))
    s = F.sin((a - c) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((b - d) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(s))


def radar_distance(lat: Column, lon: Column) -> Column:
    return F.least(*(great_circle(lat, lon, *at) for at in RADARS.values()))


def band(distance: Column) -> Column:
    return reduce(lambda c, b: c.when((distance >= b[1][0]) & (distance < b[1][1]), b[0]), BANDS.items(), F.when(F.lit(False), None))


def in_box(lat: Column, lon: Column) -> Column:
    west, east, south, north = BOX
    return (lon >= west) & (lon < east) & (lat >= south) & (lat < north)


def climatology(cells: DataFrame, index: DataFrame, wet: float, dry_map: float) -> DataFrame:
    """(r, c, n, wet, total, wet_dry, n_dry): covered frames, wet ones, sum, and both counts on frames that are dry on the whole."""
    rows = cells.join(index.select("f", F.col("wet").alias("share")), "f")
    dry = F.col("share") < dry_map
    return rows.groupBy("r", "c").agg(F.count("v").alias("n"), F.count_if(F.col("v") >= wet).alias("wet"), F.sum("v").alias("total"), F.count_if((F.col("v") >= wet) & dry).alias("wet_dry"), F.count_if(F.col("v").isNotNull() & dry).alias("n_dry"))


def dilate(cells: DataFrame, grid: GridSpec, radius: int = 1, diamond: bool = False) -> DataFrame:
    """(r, c) within the radius of a cell: squares, or diamonds of as many steps."""
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not diamond or abs(i) + abs(j) <= radius]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    return cells.select("r", "c", near.alias("d")).select((F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1)).distinct()


def components(cells: DataFrame, grid: GridSpec, write) -> DataFrame:
    """(r, c, label): label, the smallest cell number that eight-neighbour steps reach. write stores a table between rounds."""
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    labels = write(cells.select("r", "c", (F.col("r") * grid.cols + F.col("c")).alias("label")))
    while True:
        spread = labels.select(F.col("label"), "r", "c", near.alias("d")).select((F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"), F.col("label").alias("other"))
        lower = labels.join(spread, ["r", "c"]).groupBy("r", "c").agg(F.min("other").alias("label"))
        # a label is a cell's number: its own label is as good
        at = lower.select((F.col("r") * grid.cols + F.col("c")).alias("number"), F.col("label").alias("further"))
        after = write(lower.join(at, F.col("label") == F.col("number")).select("r", "c", F.least("label", "further").alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "before"), ["r", "c"]).where("label <> before").limit(1).count()
        labels = after
        if not changed:
            return labels


def nearest(points: DataFrame, k: int, write, scale: float = 1.0) -> DataFrame:
    """(area, id, other, d, k): the k nearest other points of the same area for each of (area, id, x, y), d the squared distance with x scaled, ties to the smaller other.

    Points of one place have the same neighbours but for themselves, and of a place only the k + 1 smallest
    ids can be among them: places look for k + 1 points, of which each point leaves itself out.
    Places are dealt into squares and meet those of the squares around; a place whose last distance
    reaches beyond them goes on to squares of twice the side. write stores a table between rounds.
    An id is one point. Points without id or coordinates take no part; areas of k points or fewer give fewer rows.
    """
    points = points.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("area", "id", "x", "y")
    few = write(points.withColumn("n", F.row_number().over(Window.partitionBy("area", "x", "y").orderBy("id"))).where(F.col("n") <= k + 1))
    places = few.where("n = 1").select("area", "x", "y")
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    spans = places.groupBy("area").agg(F.greatest(wide, high, F.lit(1e-9)).alias("extent"), F.sqrt(F.greatest(wide, F.lit(1e-9)) * F.greatest(high, F.lit(1e-9)) * k / F.count("*")).alias("side"))
    sized = lambda some: some.join(spans, "area").withColumn("side", F.greatest("side", F.col("extent") / 2**20))
    waiting, near, factor, found = write(sized(places)), write(sized(few.drop("n"))), 1.0, []
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    square = lambda axis: F.floor(F.col(axis) / (F.col("side") * factor))
    while True:
        asked = waiting.withColumn("n", around).withColumns({"i": square("x") + F.col("n.i"), "j": square("y") + F.col("n.j")}).drop("n")
        others = near.select("area", square("x").alias("i"), square("y").alias("j"), F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        met = asked.join(others, ["area", "i", "j"]).withColumn("d", F.pow((F.col("x") - F.col("x2")) * scale, F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)))
        best = write(met.withColumn("k", F.row_number().over(Window.partitionBy("area", "x", "y").orderBy("d", "other"))).where(F.col("k") <= k + 1))
        inside = F.col("side") * factor * (0.999 * min(1.0, scale))
        sure = best.where((F.col("k") == k + 1) & (F.col("d") <= inside * inside)).select("area", "x", "y")
        whole = waiting.where(F.col("side") * factor >= F.col("extent")).select("area", "x", "y")
        settled = sure.unionByName(whole).distinct()
        found.append(best.join(settled, ["area", "x", "y"], "left_semi").select("area", "x", "y", "other", "d", "k"))
        waiting = write(waiting.join(settled, ["area", "x", "y"], "left_anti"))
        if waiting.isEmpty():
            break
        factor *= 2
    lists = reduce(DataFrame.unionByName, found).groupBy("area", "x", "y").agg(F.array_sort(F.collect_list(F.struct("k", "other", "d"))).alias("near"))
    rest = F.slice(F.filter("near", lambda p: p["other"] != F.col("id")), 1, k)
    each = points.join(lists, ["area", "x", "y"]).select("area", "id", F.posexplode(rest).alias("at", "p"))
    return each.select("area", "id", F.col("p.other").alias("other"), F.col("p.d").alias("d"), (F.col("at") + 1).alias("k"))


def regrid(cells: DataFrame, k: int, rows: int, cols: int, scale: int, mode: str = "area", cover: float = 0.5) -> DataFrame:
    """(f, r, c, v) on a grid of rows x cols whose cells measure scale native ones: the k x k box at the native cell under each centre.

    cells are dense, v NULL where not covered. area: mean of what is covered, NULL under the least
    cover; legacy: mean of what is wet, 0 if nothing is. Even boxes reach one cell further up and left.
    """
    low, high = -(k // 2), (k - 1) // 2
    across, down = Window.partitionBy("f", "r").orderBy("c").rangeBetween(low, high), Window.partitionBy("f", "c").orderBy("r").rangeBetween(low, high)
    v = F.coalesce("v", F.lit(0))
    count = F.col("v").isNotNull() if mode == "area" else v > 0
    box = cells.repartition("f").withColumn("a", F.sum(v).over(across)).withColumn("b", F.sum(count.cast("int")).over(across)).withColumn("s", F.sum("a").over(down)).withColumn("n", F.sum("b").over(down))
    # the native cell under the centre of (r, c) is the one that (r + 1/2) scale falls in
    at = lambda x: (F.col(x) - scale // 2) / scale
    here = box.where(((F.col("r") - scale // 2) % scale == 0) & ((F.col("c") - scale // 2) % scale == 0)).select("f", at("r").cast("int").alias("r"), at("c").cast("int").alias("c"), "s", "n").where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    if mode == "area":
        value = F.when(F.col("n") / (k * k) >= cover, F.col("s") / F.col("n"))
    else:
        value = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    return here.select("f", "r", "c", value.alias("v"))


def packed_mask(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """(rows, cols, at): a mask as one row with its grid's shape; at holds the masked cells (r, c) row by row, a grid's cells at most."""
    at = F.array_sort(F.collect_set((F.col("r") * grid.cols + F.col("c")).cast("int")))
    return cells.agg(at.alias("at")).select(F.lit(grid.rows).alias("rows"), F.lit(grid.cols).alias("cols"), "at")


def mask_cells(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """(r, c) of a packed mask; one that was made for another grid, or holds cells outside of it, is an error."""
    other = F.concat(F.lit(f"the mask is not for {grid.rows} x {grid.cols} cells but for "), F.col("rows").cast("string"), F.lit(" x "), F.col("cols").cast("string"))
    inside = F.forall("at", lambda x: (x >= 0) & (x < grid.rows * grid.cols))
    same = (F.col("rows") == grid.rows) & (F.col("cols") == grid.cols) & inside
    at = mask.select(F.explode(F.when(same, F.col("at")).otherwise(F.raise_error(other).cast("array<int>"))).alias("at"))
    return at.select(F.expr(f"at div {grid.cols}").cast("int").alias("r"), (F.col("at") % grid.cols).alias("c"))


#: Points of a place that are one row, at most, and the parts in which places meet others.
LISTED, SHARES = 256, 4


def _listed(points: DataFrame) -> DataFrame:
    """(x, y, share, ids): points (id, x, y) of the same place as lists."""
    place = Window.partitionBy("x", "y", "share").orderBy("id")
    shared = points.select("id", "x", "y", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share"))
    return shared.withColumn("part", F.floor((F.row_number().over(place) - 1) / LISTED)).groupBy("x", "y", "share", "part").agg(F.collect_list("id").alias("ids")).drop("part")


def near_pairs(points: DataFrame, others: DataFrame, km: float) -> DataFrame:
    """(id, other, d): all pairs of points and others, both (id, x, y), at most km apart. What has no id or place takes no part.

    Points of one place are lists. Both sides' lists are dealt into squares of that side and meet in a square or
    its neighbours, so squares and distances are of lists; only the pairs that are the result are rows, and each
    list of points makes its own. Lists are short and go to as many partitions as shuffles have.
    """
    i, j = F.floor(F.col("x") / km), F.floor(F.col("y") / km)
    around = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)))).alias("to")
    a = spread(_listed(points.where("id IS NOT NULL")).withColumns({"i": i, "j": j}), "i", "j", "share")
    dealt = _listed(others.where("id IS NOT NULL")).select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ids").alias("other_ids"), i.alias("i"), j.alias("j"), around).withColumns({"i": F.col("i") + F.col("to.p"), "j": F.col("j") + F.col("to.q")}).drop("to")
    b = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    near = a.join(b, ["i", "j", "share"]).withColumn("d", F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)).where(F.col("d") <= km)
    return near.select(F.explode("ids").alias("id"), "other_ids", "d").select("id", F.explode("other_ids").alias("other"), "d")


def near_means(stations: DataFrame, tracks: DataFrame, km: float, least: int = 3) -> DataFrame:
    """(f, id, u, v, n): the mean motion of a frame's tracks (f, x, y, u, v) within km of each station that the frame has (f, id, x, y), where there are at least so many.

    A frame's tracks of one place are summed, and so are its stations: places are dealt into squares of that
    side, a track's to its own and the eight around it, and meet in an equi-join by frame and square; stations
    get the sums of their place.
    """
    i, j = F.floor(F.col("x") / km), F.floor(F.col("y") / km)
    around = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)))).alias("to")
    sums = {"su": F.sum("u"), "cu": F.count("u"), "sv": F.sum("v"), "cv": F.count("v"), "n": F.count("*")}
    summed = tracks.groupBy("f", "x", "y").agg(*(c.alias(k) for k, c in sums.items()))
    dealt = summed.select("f", F.col("x").alias("tx"), F.col("y").alias("ty"), *sums, i.alias("i"), j.alias("j"), around).withColumns({"i": F.col("i") + F.col("to.p"), "j": F.col("j") + F.col("to.q")}).drop("to")
    places = stations.select("f", "x", "y").distinct().select("f", "x", "y", i.alias("i"), j.alias("j"))
    met = spread(places, "f", "i", "j").join(spread(dealt, "f", "i", "j"), ["f", "i", "j"])
    near = met.where((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")) <= km * km)
    whole = [F.sum(k).alias(k) for k in sums]
    each = stations.select("f", "id", "x", "y").join(near.groupBy("f", "x", "y").agg(*whole), ["f", "x", "y"]).groupBy("f", "id").agg(*whole).where(F.col("n") >= least)
    mean = lambda k: F.try_divide(F.col(f"s{k}").cast("double"), F.col(f"c{k}").cast("double")).alias(k)
    return each.select("f", "id", mean("u"), mean("v"), "n")


def view(grid: GridSpec, width: Column, height: Column, stretch: float, margin: float = 8.0) -> tuple[Column, Column, Column]:
    """(scale, x, y): pixels a degree of latitude and the map's corner where the grid fits a view with a margin; a degree of longitude counts as stretch. A view that is all margin has scale 0."""
    wide, high = (grid.east - grid.west) * stretch, grid.north - grid.south
    scale = F.greatest(F.lit(0.0), F.least((width - 2 * margin) / wide, (height - 2 * margin) / high))
    return scale, (width - wide * scale) / 2, (height - high * scale) / 2
