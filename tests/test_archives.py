"""Structure functions against all pairs; archives by day, ASCII grids and tables made once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import structure
from pluvia.sources import archive


def test_sums_by_offset_are_those_of_all_pairs(spark):
    rng, rows, cols = np.random.default_rng(2), 5, 7
    frames, want = [], {}
    for f in range(6):
        at = sorted(rng.choice(rows * cols, [0, 1, 2, 20, 35, 11][f], replace=False).tolist())
        u, v = rng.integers(-9, 9, (2, len(at))).astype(float)
        frames.append((f, at, u.tolist(), v.tolist()))
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                d = math.floor(math.hypot(at[a] // cols - at[b] // cols, at[a] % cols - at[b] % cols) * 2 / 1.5)
                n, s = want.get(d, (0, 0.0))
                want[d] = n + 1, s + (u[a] - u[b]) ** 2 + (v[a] - v[b]) ** 2
    df = spark.createDataFrame(frames, "f long, at array<int>, u array<double>, v array<double>").repartition(3)
    sums = structure.offset_sums(df, rows, cols)
    got = {r.bin: (r.n, r.d) for r in structure.by_distance(sums, 2.0, 1.5).collect()}
    assert got.keys() == want.keys() and all(got[d][0] == n and abs(got[d][1] - s / n) < 1e-9 for d, (n, s) in want.items())
    assert sums.where("i < 0 OR (i = 0 AND j <= 0)").isEmpty() and structure.offset_sums(df.limit(0), rows, cols).isEmpty()


@pytest.mark.parametrize("north", [0, 35, -52, 62])
def test_points_meet_all_within_reach(spark, north):
    """Squares leave out no pair, on either side of the equator and far north."""
    rng = random.Random(north)
    points = [(t, i, north + rng.uniform(-9, 9), rng.uniform(-15, 15), rng.uniform(-5, 5), rng.uniform(-5, 5)) for t in range(2) for i in range(70)]
    points += [(0, 500, None, 1.0, 1.0, 1.0), (0, 501, 1.0, 1.0, None, 1.0), (None, 502, 1.0, 1.0, 1.0, 1.0), (1, 3, float(north), 0.0, 1.0, 1.0)]
    want = {}
    known = [p for p in points if None not in p]
    for p in known:
        for q in known:
            if p[0] == q[0] and p[1] < q[1]:
                la, lb = math.radians(p[2]), math.radians(q[2])
                d = 2 * 6371 * math.asin(math.sqrt(math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(p[3] - q[3]) / 2) ** 2))
                if d < 900:
                    n, s = want.get(int(d // 100), (0, 0.0))
                    want[int(d // 100)] = n + 1, s + (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2
    got = {r.bin: (r.n, r.d) for r in structure.between_points(spark.createDataFrame(points, "t long, id long, lat double, lon double, u double, v double"), 100.0, 9).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s / n) < 1e-9 for k, (n, s) in want.items())


def test_points_of_a_place_are_one_row(spark):
    """Many points in few places, ids with several rows at a time and in two places: every pair counts, but none is a row."""
    rng = random.Random(3)
    places = [(55.0, 9.0), (55.3, 9.2), (57.0, 12.0)]
    points = [(t, i, *places[i % 3], 300 + rng.uniform(-5, 5), rng.uniform(-5, 5)) for t in range(2) for i in range(90) for _ in range(1 + i % 2)]
    points += [(0, 5, *places[0], 301.0, 2.0)]  # usually in another place
    want = {}
    for p in points:
        for q in points:
            if p[0] == q[0] and p[1] < q[1]:
                la, lb = math.radians(p[2]), math.radians(q[2])
                d = 2 * 6371 * math.asin(math.sqrt(math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(p[3] - q[3]) / 2) ** 2))
                n, s = want.get(int(d // 20), (0, 0.0))
                want[int(d // 20)] = n + 1, s + (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2
    table = spark.createDataFrame(points, "t long, id long, lat double, lon double, u double, v double")
    got = {r.bin: (r.n, r.d) for r in structure.between_points(table).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s / n) < 1e-9 for k, (n, s) in want.items())
    one = table.groupBy("t", "lat", "lon").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("s"))
    assert one.count() == 6 and structure._between(one, ["t"], 20.0, 20).agg(F.sum("n")).first()[0] == sum(n for k, (n, _) in want.items() if k) + _own(points)


def _own(points):
    """Pairs of one id in two places at a time."""
    return sum(p[:2] == q[:2] and p[2:4] < q[2:4] for p in points for q in points)


def frames(spark, numbers, factor=1.0):
    return spark.createDataFrame([(f, [factor * (f % 5), float("nan"), 3.0]) for f in numbers], "f long, v array<double>")


def test_an_update_writes_its_days_only(spark, tmp_path):
    days = archive.DayArchive(spark, str(tmp_path / "archive"), 10, 2.0)
    assert days.frames().isEmpty() and days.index().isEmpty()
    assert sorted(r.day for r in days.update(frames(spark, range(-5, 40)).unionByName(frames(spark, [7, 8]))).collect()) == [-1, 0, 1, 2, 3]
    files = lambda name, day: {p: p.stat().st_mtime_ns for p in (tmp_path / "archive" / name / f"day={day}").glob("*.parquet")}
    before = {(n, d): files(n, d) for n in ("frames", "index") for d in (-1, 0, 1, 2, 3)}
    days.update(frames(spark, range(10, 14), 10.0))
    after = {k: files(*k) for k in before}
    assert {k for k in before if before[k] != after[k]} == {("frames", 1), ("index", 1)}
    assert sorted(r.f for r in days.frames().collect()) == [*range(-5, 14), *range(20, 40)]  # a day is written anew, whole
    assert {(r.f, r.covered, r.wet) for r in days.index(9, 21).collect()} == {(f, 2, 1 + ((f % 5) * (10 if f // 10 == 1 else 1) >= 2)) for f in (9, 10, 11, 12, 13, 20, 21)}
    assert days.stale().isEmpty()


def test_reads_are_pruned_by_day(spark, tmp_path):
    days = archive.DayArchive(spark, str(tmp_path / "archive"), 10, 2.0)
    days.update(frames(spark, range(100)))
    some = days.frames(31, 45)
    assert sorted(r.f for r in some.collect()) == list(range(31, 46))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_lost_index_is_made_again(spark, tmp_path, monkeypatch):
    days = archive.DayArchive(spark, str(tmp_path / "archive"), 10, 2.0)
    days.update(frames(spark, range(30)))
    monkeypatch.setattr(archive.DayArchive, "rebuild", lambda self, d: None)
    days.update(frames(spark, range(25, 45)))
    monkeypatch.undo()
    assert sorted(r.day for r in days.stale().collect()) == [2, 3, 4]
    days.rebuild(days.stale())
    assert days.stale().isEmpty() and days.index().count() == days.frames().count() == 40


def test_ascii_grids(spark, tmp_path):
    made = spark.createDataFrame([(3, [1.5, float("nan"), 0.0, -2.0, None, 7.25])], "f long, v array<double>")
    archive.write_ascii(made, str(tmp_path / "made"), 3, 5.0, 54.0, 0.5)
    (r,) = archive.read_ascii(spark, str(tmp_path / "made")).collect()
    assert (r.f, r.ncols, r.nrows, r.west, r.south, r.cell, r.v) == (3, 3, 2, 5.0, 54.0, 0.5, [1.5, None, 0.0, -2.0, None, 7.25])
    (tmp_path / "given").mkdir()
    (tmp_path / "given" / "a.asc").write_text("NROWS  2\nNCols 2\nXLLCENTER 10\nyllcenter\t20\nCELLSIZE 2\nnodata_value 5\n1 2\n5 1e1\n\n")
    (tmp_path / "given" / "b.asc").write_text("ncols 3\r\nnrows 1\r\nxllcorner 1\r\nyllcorner 2\r\ncellsize 1\r\n-9999 3 4")
    got = {r.file: (r.west, r.south, r.v) for r in archive.read_ascii(spark, str(tmp_path / "given")).collect()}
    assert got == {"a.asc": (9.0, 19.0, [1.0, 2.0, None, 10.0]), "b.asc": (1.0, 2.0, [None, 3.0, 4.0])}
    (tmp_path / "given" / "c.asc").write_text("ncols 3\nnrows 1\n1 2")
    with pytest.raises(Exception, match="not an ASCII grid"):
        archive.read_ascii(spark, str(tmp_path / "given")).collect()


def test_a_table_is_made_once_for_its_inputs(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    spark.range(10).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    call = lambda **p: archive.made_once(spark, "sum", [source], p, make).first().s
    assert [call(a=1), call(a=1), call(a=2)] == [45, 45, 45] and len(made) == 2
    assert source not in archive.made_once(spark, "sum", [source], {"a": 1}, make).inputFiles()[0]
    spark.range(5).write.mode("append").parquet(source)
    assert call(a=1) == 55 and len(made) == 3
