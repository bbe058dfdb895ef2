"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key (md5 of its id and its text's md5). Within its source, documents are ordered
by key; their words' prefix sums are computed in two levels: sums of key ranges (the key's
first digits), running sums of those ranges, and running sums within a range. A source with a
budget of several times its size repeats whole epochs; the rest of the budget is cut exactly,
the document at the cut giving only its first words.

A source's target is its weight's share of all words, at most three times its size; what
exceeds that is reshared by weight (water filling, in closed form over the sources).

A null text has size 0 and takes 0. A null source is a source, the last one. A null id counts
as an empty one: rows of one id, or without one, have keys of their own as long as their texts
differ, so they are spread like others. Rows that repeat whole have one key and are
interchangeable: those of a task are one row with their number until their places are known, so
every run gives the same rows and no key's rows meet in one task. An empty table gives no rows; if all sizes
are 0, all targets are 0. Sources themselves (not documents) are ordered in one task, so there
may be as many as one task sorts. Columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.llm.common import table, written

#: Hex digits of the key that name a range: 4,096 ranges of each source hold about equal shares of it.
RANGE_DIGITS = 3
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of the text, hash-random key."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row for each source; these rows are ordered in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    # sources fill up in the order of their caps for each unit of weight
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level that holds is the one of the first source that stays below its cap
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), F.col("level").alias("level")))).over(everything)
    return levels.withColumn("first", first).select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("first.level") * F.col("weight"))).alias("target"))


def mix(sizes: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of sized(), which should be stored, as it is read more than once."""
    # rows that repeat whole count as one of n rows in each task that reads them
    ranged = sizes.withColumn("part", F.substring("key", 1, RANGE_DIGITS)).groupBy("source", "part", "key", "doc_id", "size", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    parts = ranged.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("part_size"))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(running), F.lit(0))).alias("o")
    placed = offsets.join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "o.part", "o.offset", "g.source_size", "g.target").alias("p")
    both = ranged.alias("r").join(placed, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    rows = both.select("r.doc_id", "r.source", "r.size", "r.key", "r.part", "r.task", "r.n", "p.offset", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "task").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    each = rows.withColumn("first", first).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("first") + F.col("repeat") * F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(written(sized(table(spark, sf_dir, "documents")), "sizes")).drop("source")


ORACLE_OP7 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
             / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(cap AS DOUBLE), min_level * weight) END AS target
      FROM l, (SELECT arg_min(level, k) AS min_level FROM l WHERE level * weight <= cap)),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS taken
FROM p
"""
