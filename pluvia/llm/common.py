"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as spark.checkpoint.dir names it.

    Where the session names none, a local session gets a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pluvia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    return stored(df, tag)[0]


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pluvia/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: At most so many keys are hot: each holds at least this share of all rows.
HOT_SHARE = 1000


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int, counts: DataFrame | None = None) -> DataFrame:
    """left joined (inner) with right, which holds each key once; no key of left, however frequent, goes to one task.

    rows bounds left's rows. Keys with more than rows / HOT_SHARE rows are at most HOT_SHARE, so their rows of
    right are broadcast; all others meet in a shuffle. counts (key, n) saves counting again.
    """
    least = max(64, -(-rows // HOT_SHARE))
    counted = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
    hot = right.join(F.broadcast(counted.where(F.col("n") > least).select(key)), key)  # HOT_SHARE keys at most, by count
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return cold.unionByName(left.join(F.broadcast(hot), key))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, n: int, k: int) -> Column:
    """Whether crc32 of the column's text is k modulo n; a null is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n == k, F.lit(False))


def sample_rows(labels: DataFrame, n: int, *by: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of their ids: the same ones in every run."""
    return labels.orderBy(F.xxhash64(*by), *by).limit(n)


def text_blocks(rows: DataFrame, key: str, block_bytes: int):
    """The rows (key, text), all different and stored, as lists of (key, text); one list is on the driver at a time.

    A list holds at most block_bytes of text beside its longest row: rows are dealt by hash, and
    where a part is larger, cut by the running size within it.
    """
    sized = rows.withColumn("size", (F.octet_length("text") + 16).cast("long"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= block_bytes:
        yield [(r[key], r["text"]) for r in rows.collect()]
        return
    share = max(1, block_bytes // 4)
    before = F.sum("size").over(Window.partitionBy("part").orderBy("size", key, "text").rowsBetween(Window.unboundedPreceding, -1))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64(key, "text"), F.lit(-(-total // share)))).withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / share))
    cut = written(dealt, "blocks")
    group, used = [], 0
    for r in sorted(cut.groupBy("part", "cut").agg(F.sum("size").alias("size")).collect()):
        if group and used + r["size"] > block_bytes:
            yield _rows_of(cut, key, group)
            group, used = [], 0
        group.append((r["part"], r["cut"]))
        used += r["size"]
    yield _rows_of(cut, key, group)


def _rows_of(cut: DataFrame, key: str, group: list[tuple[int, int]]) -> list[tuple]:
    rows = cut.where(F.col("part").isin([p for p, _ in group]) & F.concat_ws(" ", F.col("part").cast("string"), F.col("cut").cast("string")).isin([f"{p} {c}" for p, c in group]))
    return [(r[key], r["text"]) for r in rows.collect()]
