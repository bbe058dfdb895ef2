"""An archive of frames in partitions by day, ASCII grids, and tables that are made once for given inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources import shared


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class DayArchive:
    """Frames (f, v), all cells row by row and NaN for no coverage, and an index (f, covered, wet), both in a folder and by day.

    An update writes its days anew, whole, and leaves all others as they are; the index follows for
    those days only. Days are written before their index, so an update that is lost half-way leaves
    days whose index is older: stale() names them, and rebuild() makes their index again. Rows with a
    null f or v are dropped, of rows of the same f one stays: the archive holds a frame once.
    """

    spark: SparkSession
    folder: str
    per_day: int
    wet: float

    FRAMES = "f long, v array<double>, day long"
    INDEX = "f long, covered long, wet long, day long"

    def _read(self, name: str, schema: str) -> DataFrame:
        at, system = _path(self.spark, f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if system.exists(at) else self.spark.createDataFrame([], schema)

    def frames(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The frames from first to last; only the files of their days are read."""
        return self._within(self._read("frames", self.FRAMES), first, last)

    def index(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self._within(self._read("index", self.INDEX), first, last)

    def _within(self, rows: DataFrame, first: int | None, last: int | None) -> DataFrame:
        for bound, above in ((first, True), (last, False)):
            if bound is not None:
                day = F.lit(bound // self.per_day)
                rows = rows.where(F.col("day") >= day if above else F.col("day") <= day).where(F.col("f") >= bound if above else F.col("f") <= bound)
        return rows

    def _write(self, rows: DataFrame, name: str) -> None:
        # a day's rows come from one task or, where it has many, a few: so it has few files
        rows.repartition("day", F.pmod("f", F.lit(8))).sortWithinPartitions("day", "f").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/{name}")

    def update(self, frames: DataFrame) -> DataFrame:
        """Puts the days of frames (f, v) in the place of those that are there; the days as rows."""
        rows = frames.where("f IS NOT NULL AND v IS NOT NULL").groupBy("f").agg(F.max("v").alias("v")).withColumn("day", F.expr(f"cast(floor(f / {self.per_day}) as long)"))
        kept = shared.stored(self.spark)(rows)
        self._write(kept, "frames")
        days = kept.select("day").distinct()
        self.rebuild(days)
        return days

    def rebuild(self, days: DataFrame) -> None:
        """Makes the index of these days again."""
        rows = self._read("frames", self.FRAMES).join(days, "day", "left_semi")
        known = F.filter("v", lambda x: ~F.isnan(x))
        self._write(rows.select("f", F.size(known).cast("long").alias("covered"), F.size(F.filter(known, lambda x: x >= self.wet)).cast("long").alias("wet"), "day"), "index")

    def stale(self) -> DataFrame:
        """Days whose frames and index do not hold the same frames."""
        frames, index = self._read("frames", self.FRAMES).select("day", "f", F.lit(1).alias("a")), self._read("index", self.INDEX).select("day", "f", F.lit(1).alias("b"))
        return frames.join(index, ["day", "f"], "full").where("a IS NULL OR b IS NULL").select("day").distinct()


#: The keys of an ASCII grid's header.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")
NODATA = -9999


def write_ascii(frames: DataFrame, folder: str, cols: int, west: float, south: float, cell: float) -> None:
    """A file for each frame (f, v): a header and the rows from the north on; NaN and NULL are the value for no data."""
    number = F.transform("v", lambda x: F.when(x.isNull() | F.isnan(x), F.lit(str(NODATA))).otherwise(x.cast("string")))
    lines = F.transform(F.sequence(F.lit(0), F.size("v") - 1, F.lit(cols)), lambda i: F.array_join(F.slice(number, i + 1, cols), " "))
    head = F.format_string(f"ncols {cols}\nnrows %d\nxllcorner {west}\nyllcorner {south}\ncellsize {cell}\nNODATA_value {NODATA}\n", (F.size("v") / cols).cast("int"))
    frames.select(F.concat(head, F.array_join(lines, "\n")).alias("value"), "f").repartition("f").write.partitionBy("f").text(folder)


def read_ascii(spark: SparkSession, folder: str) -> DataFrame:
    """(f, file, ncols, nrows, west, south, cell, v) of ASCII grids, v row by row from the north on, NULL for no data.

    A file is one row, so it is read in one task. Keys may be in either case and any order; west and
    south are the lower left cell's corner, whether the header gives that or its centre. A file
    without a size, or whose numbers are not as many as it says, is an error. f is the folder's, if it has one.
    """
    text = spark.read.text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    head = F.regexp_extract("value", r"^\s*((?:[A-Za-z_]+[ \t]+\S+\s+)*)", 1)
    key = lambda name: F.regexp_extract(F.lower("head"), rf"(?:^|\s){name}\s+(\S+)", 1)
    number = lambda name: F.when(key(name) != "", key(name)).cast("double")
    parts = text.withColumn("head", head).withColumn("body", F.filter(F.split(F.expr("substring(value, length(regexp_extract(value, '^\\\\s*((?:[A-Za-z_]+[ \\\\t]+\\\\S+\\\\s+)*)', 0)) + 1)"), r"\s+"), lambda x: x != ""))
    known = parts.select("*", *(number(k).alias(k) for k in HEADER))
    values = F.transform("body", lambda x: F.when(x.cast("double") != F.coalesce("nodata_value", F.lit(float(NODATA))), x.cast("double")))
    whole = F.when(F.col("ncols").isNull() | F.col("nrows").isNull() | (F.size("body") != F.col("ncols") * F.col("nrows")), F.raise_error(F.concat(F.lit("not an ASCII grid of its size: "), F.col("file")))).otherwise(values)
    corner = lambda axis: F.coalesce(f"{axis}llcorner", F.col(f"{axis}llcenter") - F.col("cellsize") / 2)
    own = [c for c in text.columns if c not in ("value", "file")]
    return known.select(*own, "file", F.col("ncols").cast("int").alias("ncols"), F.col("nrows").cast("int").alias("nrows"), corner("x").alias("west"), corner("y").alias("south"), F.col("cellsize").alias("cell"), whole.alias("v"))


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Of the files at the inputs (names, lengths, times of change) and the parameters."""
    found = []
    for path in inputs:
        at, system = _path(spark, path)
        files = system.listFiles(at, True)
        while files.hasNext():
            x = files.next()
            found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), parameters], sort_keys=True).encode()).hexdigest()[:32]


def made_once(spark: SparkSession, name: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, as a table in the shared folder that is named by its fingerprint: made if it is not there, else read without its inputs.

    A table counts once it is whole: it is written under another name and then renamed. Of two that
    are made at a time one stays; they are equal.
    """
    to = f"{shared.folder(spark)}/pluvia/once/{name}-{fingerprint(spark, inputs, parameters)}"
    at, system = _path(spark, to)
    if not system.exists(at):
        path = shared.path(spark, "making")
        make().write.parquet(path)
        system.mkdirs(at.getParent())
        if not system.rename(_path(spark, path)[0], at) and not system.exists(at):
            raise OSError(f"{path} cannot be renamed to {to}")
    return spark.read.parquet(to)
