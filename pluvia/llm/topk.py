"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers; a term is a component. Candidates are packed into blocks
that hold one posting array of weights for each term. A query is its sparse row of non-zero
weights: term by term, its weight times the posting array is added to the dense score array
of the block, from which a partition selection keeps the k best. The blocks' selections are
merged by query.

Every query block meets every candidate block, so all scores are computed: work and the bytes
of the pairs of blocks grow with the square of the rows. Blocks are bounded (``block`` candidates
and ``BLOCK_BYTES`` of weights, or one vector; ``queries`` queries) and are cut from the rows as
they are read, whatever their ids, vectors of very different sizes apart. Selections leave a task only after it has merged all its blocks of a query.

Sums that could leave the exact range of 64-bit integers (told by the largest weights of both
blocks) are made with Python's integers, so ranks are exact for all finite components; a score
beyond the range of the result's long is shown as that range's end, and ranked by ``beyond``,
bytes that sort like the whole number.

Vectors that are null, or hold a null or a component that is not finite (or is not when
scaled), take no part. A row with a null id is a candidate, after all others that tie with it. Of vectors of different sizes, missing components count as zero. Every
row is a candidate and, if asked, a query of its own, told apart by its block and place: rows
with equal ids each get a list, and meet each other. Ties go to the smaller id. Empty vectors
score 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.llm.common import table, written

BLOB = "block long, n int, width int, ids binary, weights binary, places binary"
LONG = (1 << 63) - 1
#: Weights of a block.
BLOCK_BYTES = 16 << 20


def _numbers(column: pa.Array, i: int, kind) -> np.ndarray:
    """A binary value as numbers, without a copy."""
    return np.frombuffer(column[i].as_buffer(), kind)


def packed(vectors: DataFrame, size: int, most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of at most size rows (vec_id, terms, asked) and most bytes of weights, or one row: ids, for each term the weights of all of them, and the places of those asked for.

    A block holds vectors of about one size, between a power of two and the next. Its number is made of its partition and its place in it.
    """

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            kinds = np.array([max(n - 1, 0).bit_length() for n in batch.column("terms").value_lengths().to_pylist()])
            for kind in np.unique(kinds).tolist():
                rows = batch if (kinds == kind).all() else batch.take(pa.array(np.flatnonzero(kinds == kind)))
                limit, at = max(1, min(size, most >> kind + 3)), 0
                while at < rows.num_rows:
                    parts = held.setdefault(kind, [])
                    part = rows.slice(at, limit - sum(p.num_rows for p in parts))
                    parts.append(part)
                    at += part.num_rows
                    if sum(p.num_rows for p in parts) == limit:
                        yield _pack(number, held.pop(kind))
                        number += 1
            # what waits is copied out of its batches; widest first, until it is within two blocks
            held = {kind: [pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(c) for p in parts]) for c in range(parts[0].num_columns)], schema=batch.schema)] for kind, parts in held.items()}
            while len(held) > 1 and sum(p.num_rows << kind + 3 for kind, (p,) in held.items()) > 2 * most:
                yield _pack(number, held.pop(max(held)))
                number += 1
        for parts in held.values():
            yield _pack(number, parts)
            number += 1

    return vectors.mapInArrow(run, BLOB)


def _blob(block, ids: np.ndarray, weights: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    numbers = (pa.array([block], pa.int64()), pa.array([weights.shape[1]], pa.int32()), pa.array([len(weights)], pa.int32()))
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x.tobytes()], pa.binary()) for x in (ids, weights, places))], [c.split()[0] for c in BLOB.split(", ")])


def _pack(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    terms = pa.concat_arrays([c.cast(pa.list_(pa.float64())) for c in rows.column("terms").chunks])
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    weights[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = terms.flatten().to_numpy()
    ids = rows.column("vec_id")
    named = np.column_stack((ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()))
    return _blob(number, named.astype(np.int64), weights, np.flatnonzero(rows.column("asked").to_numpy()))


def _ids(column: pa.Array, i: int) -> np.ndarray:
    """For each row whether its id is null, and the id: pairs that sort as ids do, null last."""
    return _numbers(column, i, np.int64).reshape(-1, 2)


def _asked(batches, most):
    """The rows of blocks that are asked for, as blocks of at most so many; places tell where they stand in the block of all."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, n, width = (batch.column(c)[i].as_py() for c in ("block", "n", "width"))
            ids, places = _ids(batch.column("ids"), i), _numbers(batch.column("places"), i, np.int64)
            weights = _numbers(batch.column("weights"), i, float).reshape(width, n)
            for b in range(0, len(places), most):
                some = places[b : b + most]
                yield _blob(block, ids[some], np.ascontiguousarray(weights[:, some]), some)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids (pairs of _ids)."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)  # all that tie with the last one stay until ids decide
    else:
        keep = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(keep.tolist(), key=lambda i: (-scores[i], *ids[i].tolist()))[:k], int)
    return keep[np.lexsort((ids[keep, 1], ids[keep, 0], -scores[keep]))[:k]]


def accumulate(query: np.ndarray, postings: np.ndarray, top: float) -> np.ndarray:
    """Scores of all candidates, none of whose weights exceeds top; whole numbers as doubles, or as Python's integers where sums could pass 2^53."""
    terms = np.flatnonzero(query[: len(postings)])
    wide = len(terms) * float(np.abs(query[terms]).max(initial=0)) * top >= 2.0**53
    scores = np.zeros(postings.shape[1], object if wide else float)
    for term in terms:
        if wide:
            w = int(query[term])
            scores += np.array([w * int(x) for x in postings[term].tolist()], object)
        else:
            scores += query[term] * postings[term]
    return scores


def beyond(score: int) -> bytes | None:
    """Bytes that sort like whole numbers outside the long's range; None inside."""
    if -LONG <= score < LONG:
        return None
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    whole = len(size).to_bytes(4, "big") + size
    return whole if score > 0 else bytes(255 - b for b in whole)


SELECTED = pa.schema([("q_block", pa.int64()), ("q_place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])


def _search(batches, k):
    """Top k of each query over the candidate blocks that this task meets."""
    held: dict[tuple[int, int], dict[int, tuple]] = {}
    for batch in batches:
        c = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            n, width, q_n, q_width, block, q_block = (c[x][i].as_py() for x in ("n", "width", "q_n", "q_width", "block", "q_block"))
            ids, postings = _ids(c["ids"], i), _numbers(c["weights"], i, float).reshape(width, n)
            asked, weights, places = _ids(c["q_ids"], i)[:, 1], _numbers(c["q_weights"], i, float).reshape(q_width, q_n), _numbers(c["q_places"], i, np.int64)
            top_weight = float(np.abs(postings).max(initial=0))
            mine = held.setdefault((q_block, int(places[0])), {})
            for j, (q, place) in enumerate(zip(asked.tolist(), places.tolist(), strict=True)):
                scores, names = accumulate(weights[:, j], postings, top_weight), ids
                if block == q_block:  # the query's own row
                    scores, names = np.delete(scores, place), np.delete(ids, place, 0)
                top = best(names, scores, k)
                names, scores = names[top], scores[top]
                if place in mine:
                    wide = scores.dtype == object or mine[place][2].dtype == object
                    names = np.concatenate((mine[place][1], names))
                    scores = np.array([*map(int, mine[place][2]), *map(int, scores)], object) if wide else np.concatenate((mine[place][2], scores))
                    top = best(names, scores, k)
                    names, scores = names[top], scores[top]
                mine[place] = (q, names, scores)
            if len(held) > 4:  # bounds memory; what leaves early is merged later
                yield _rows({b: held.pop(b) for b in list(held) if b != (q_block, int(places[0]))})
    if held:
        yield _rows(held)


def _rows(held):
    rows = [(block, place, q, None if unnamed else v, int(s)) for (block, _), one in held.items() for place, (q, ids, scores) in one.items() for (unnamed, v), s in zip(ids.tolist(), scores.tolist(), strict=True)]
    columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]
    shown = [max(-LONG - 1, min(LONG, s)) for s in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns[:4], shown, [beyond(s) for s in columns[4]]], SELECTED.types, strict=True)], schema=SELECTED)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component as a double without a fraction, rows that take part only."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger doubles have no fraction
    return vectors.where(F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("terms"))


def search(vectors: DataFrame, asked, k: int = 5, block: int = 8192, queries: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, beyond) for the rows of (vec_id, terms) that asked, a Column, admits, against all other rows."""
    mine = written(packed(vectors.withColumn("asked", F.coalesce(asked, F.lit(False))), block), "vectors")  # a place in a block names a row, so blocks are cut once
    slots = max(1, mine.count())
    theirs = mine.mapInArrow(lambda b: _asked(b, queries), BLOB)
    theirs = theirs.select(*(F.col(c).alias(f"q_{c}") for c in theirs.columns)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))  # to about one candidate block each, as rows of bytes
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes with much work: partitions are not put together
    pairs = mine.drop("places").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).repartition(parts, "slot").join(theirs.repartition(parts, "slot"), "slot")
    found = pairs.mapInArrow(lambda b: _search(b, k), "q_block long, q_place long, query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "beyond")


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 50 == 0).drop("beyond")


ORACLE_OP6 = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.t, c.t) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
