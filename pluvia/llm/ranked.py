"""Ranked lexical search over an index that is stratified by document length.

The score of a document depends on its length only through the whole number m, so documents of
equal m form a stratum. A segment is a part of a stratum; the index has a row for each segment
and term: the numbers of occurrences (tf) in ascending order, and for each of them the documents.
Within a segment the impact of a term is computed once for each tf and serves all its documents.

A search keeps the rows of its terms and sums up, for each stratum, the highest impacts that a
query's terms can have there. The strata with the highest bounds are visited first, and the k-th
best score found there is a floor for all others: strata without a query whose bound reaches its
floor are left out, the others are visited in the order of their bounds, and each task leaves out
the segments under the floor, which rises as it goes on. A bound equal to the floor is visited, as
a smaller doc_id may win the tie. No document that could be among the k best is left out.

Documents are dealt by cuts of their lengths and, where many have one length, by hash, so a
frequent length is several segments of several tasks; a segment ends after ``SEGMENT`` terms (one
document at least). Queries are the different texts of the items, in blocks of at most about
``block_bytes`` that are broadcast; each block reads the index once.

Null and empty texts have no terms: such documents are neither counted nor found, such items get
no rows. Each item row gets its own results, whatever its item_id; items of equal text are
searched once. Rows of equal doc_id are documents of their own; a null doc_id comes last among
equal scores. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.llm.common import table, text_blocks, text_of, written
from pluvia.llm.decontaminate import words_of

#: Terms, with repeats, after which a segment ends.
SEGMENT = 1_000_000
BLOCK_BYTES = 2 << 20
#: Strata of the highest bounds that give the floor.
AHEAD = 4
#: Text of a stretch of lengths, and cuts of the lengths at most; beyond, a stretch is dealt by hash.
STRETCH, CUTS = 32 << 20, 2048
#: df documents have the term, at most top times; docs: their places in the segment, by tf. The row of the empty term has the documents' ids instead.
INDEX = "m long, segment long, term string, top int, df int, tfs binary, sizes binary, docs binary"


class Index(NamedTuple):
    """postings: rows of INDEX; documents and terms, with repeats, of the whole corpus."""

    postings: DataFrame
    n_docs: int
    n_terms: int


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _lengths(batches):
    """(n, docs, bytes): how many documents of a task have n terms, and their bytes."""
    found: dict[int, list[int]] = {}
    for batch in batches:
        for text in batch.column("text"):
            have = found.setdefault(len(words_of(raw := text.as_py())), [0, 0])
            have[:] = have[0] + 1, have[1] + len(raw)
    found.pop(0, None)
    columns = [list(found), *zip(*found.values(), strict=True)] if found else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["n", "docs", "bytes"])


def build(docs: DataFrame, segment: int = SEGMENT, stretch: int = STRETCH) -> Index:
    """The index of (doc_id, text), stored in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("h"))
    lengths = written(rows.select("text").mapInArrow(_lengths, "n long, docs long, bytes long").groupBy("n").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes")), "ranked-lengths")
    n_docs, n_terms, size = lengths.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("docs"), F.col("n") * F.col("docs"), F.col("bytes")))).first()
    parts = max(1, -(-size // stretch))
    # cuts of the lengths by bytes; a length that holds several shares is between equal cuts
    shares = [k / min(parts, CUTS) for k in range(1, min(parts, CUTS))]
    cuts = [int(x) for x in lengths.agg(F.percentile("n", F.array(*map(F.lit, shares)), F.col("bytes"))).first()[0]] if shares and size else []
    more = -(-parts // CUTS)

    def placed(batches):
        for batch in batches:
            m, part = [], []
            for text, h in zip(batch.column("text"), batch.column("h").to_pylist(), strict=True):
                n = len(words_of(text.as_py()))
                low, high = bisect_left(cuts, n), bisect_right(cuts, n)
                m.append(25 + 75 * n * n_docs // n_terms if n else None)
                part.append((low + h % (high - low + 1)) * more + (h >> 8) % more)
            yield batch.append_column("m", pa.array(m, pa.int64())).append_column("part", pa.array(part, pa.int64()))

    dealt = rows.mapInArrow(placed, "doc_id long, text string, h long, m long, part long").where("m IS NOT NULL").drop("h")
    stored = dealt.repartition("part").sortWithinPartitions("part", "m").mapInArrow(lambda b: _segments(b, segment), INDEX)
    return Index(written(stored, "ranked"), n_docs, n_terms)


def _segments(batches, most):
    """Segments from rows sorted by m; a segment's number is made of its task's and its place there."""
    from pyspark import TaskContext

    number, at, ids, words, sizes = TaskContext.get().partitionId() << 32, None, [], [], []
    for batch in batches:
        for m, doc_id, text in zip(batch.column("m").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = words_of(text.as_py())
            if ids and (m != at or len(words) + len(found) > most):
                yield _segment(at, number, ids, words, sizes)
                number, ids, words, sizes = number + 1, [], [], []
            at = m
            ids.append(doc_id)
            words += found
            sizes.append(len(found))
    if ids:
        yield _segment(at, number, ids, words, sizes)


def _segment(m: int, number: int, ids: list, words: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    numbers = _Numbers()
    term = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs, tf = np.unique(term * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    order = np.argsort(term * (int(tf.max()) + 1) + tf, kind="stable")  # documents keep their order
    term, doc, tf = term[order], doc[order], tf[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])  # of each (term, tf)
    groups = np.searchsorted(term[first], np.arange(len(numbers) + 1))  # where a term's begin, and
    begins = np.searchsorted(term, np.arange(len(numbers) + 1))  # where its documents do
    known = pa.array([i is not None for i in ids])
    shared = [pa.array(np.full(len(numbers) + 1, x), pa.int64()) for x in (m, number)]
    blobs = [(tf[first], groups), (np.diff(np.r_[first, len(tf)]), groups), (doc, begins)]
    last = [known.cast(pa.int8()).to_numpy(zero_copy_only=False).tobytes(), None, np.array([i or 0 for i in ids], np.int64).tobytes()]
    columns = [pa.concat_arrays([_slices(x, at), pa.array([y], pa.binary())]) for (x, at), y in zip(blobs, last, strict=True)]
    names = pa.array([*numbers, b""], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*shared, names, pa.array([*tf[first][groups[1:] - 1].tolist(), 0], pa.int32()), pa.array([*np.diff(begins).tolist(), 0], pa.int32()), *columns], [c.split()[0] for c in INDEX.split(", ")])


def _slices(numbers: np.ndarray, at: np.ndarray) -> pa.Array:
    """The slices between places as binary values of four bytes a number."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(numbers.astype(np.int32))])


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What an occurrence count gives in documents of normaliser m, before the term's weight."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A block of query texts: numbered terms, and for each query its terms with their repeats."""

    def __init__(self, block: list[tuple[int, str]]):
        self.numbers = _Numbers()
        self.names, terms, times, sizes = [], [], [], []
        for name, text in block:
            if not (words := words_of(text)):
                continue
            own, repeats = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            self.names.append(name)
            sizes.append(len(own))
            terms.append(own)
            times.append(repeats)
        self.numbers = dict(self.numbers)
        self.starts = np.cumsum([0, *sizes])[:-1]
        self.terms = np.concatenate([*terms, np.zeros(0, np.int64)])
        self.times = np.concatenate([*times, np.zeros(0, np.int64)])
        self.weights = np.zeros(len(self.numbers), np.int64)
        self.floor = np.zeros(len(self.names), np.int64)

    def of(self, q: int) -> list[tuple[int, int]]:
        """(term, repeats) of a query."""
        part = slice(self.starts[q], self.starts[q + 1] if q + 1 < len(self.starts) else None)
        return list(zip(self.terms[part].tolist(), self.times[part].tolist(), strict=True))

    def bounds(self, terms: np.ndarray, tops: np.ndarray, m: int) -> np.ndarray:
        """The highest score that each query can reach where terms occur at most tops times."""
        best = np.zeros(len(self.numbers), np.int64)
        best[terms] = self.weights[terms] * impacts(tops, m)
        return np.add.reduceat(best[self.terms] * self.times, self.starts)


def _leading(batches, queries, ahead):
    """Of the strata that a task meets, the ahead ones with the highest bounds for each query."""
    best = np.zeros((0, len(queries.names)), np.int64)
    names = np.zeros((0, len(queries.names)), np.int64)
    for m, bounds in _bounds(batches, queries):
        best, names = np.vstack((best, bounds)), np.vstack((names, np.full((1, best.shape[1]), m)))
        if len(best) > 4 * ahead:
            keep = np.argsort(-best, axis=0, kind="stable")[:ahead]
            best, names = np.take_along_axis(best, keep, 0), np.take_along_axis(names, keep, 0)
    at, q = np.nonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, names[at, q], best[at, q])], ["q", "m", "bound"])


def _bounds(batches, queries):
    for batch in batches:
        for m, entries in zip(batch.column("m").to_pylist(), batch.column("entries"), strict=True):
            term, top = (entries.values.field(k).to_numpy(zero_copy_only=False) for k in ("term", "top"))
            yield m, queries.bounds(term, top, m)


def _reaching(batches, queries):
    """(m, bound): the highest bound of each stratum in which a query can reach its floor."""
    rows = [(m, int(bounds.max())) for m, bounds in _bounds(batches, queries) if (bounds >= np.maximum(queries.floor, 1)).any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["m", "bound"])


class Segment:
    """The postings of a segment for the terms that are asked for."""

    def __init__(self, m: int):
        self.m, self.terms, self.tops, self.rows, self.ids, self.known = m, [], [], {}, None, None

    def add(self, batch: pa.RecordBatch, i: int, term: int | None, top: int) -> None:
        read = lambda c, kind=np.int32: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        if term is None:
            self.known, self.ids = read("tfs", np.int8).astype(bool), read("docs", np.int64)
        else:
            self.terms.append(term)
            self.tops.append(top)
            self.rows[term] = read("tfs"), read("sizes"), read("docs")

    def adds(self, term: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term, and what it adds to each: an impact for each tf, once."""
        tfs, sizes, docs = self.rows[term]
        return docs, np.repeat(weight * impacts(tfs, self.m), sizes)


def _each(batches):
    """Segments, one after the other, from rows in which those of a segment stand together."""
    at, held = None, None
    for batch in batches:
        for i, (number, m, term, top) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("segment", "m", "no", "top")), strict=True)):
            if number != at:
                if held is not None:
                    yield held
                at, held = number, Segment(m)
            held.add(batch, i, term, top)
    if held is not None:
        yield held


FOUND = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _visit(batches, queries, k, only=None):
    """The k best of each query in the segments that a task meets; only: (m, query) pairs to visit, all if None."""
    floor = queries.floor.copy()
    kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for segment in _each(batches):
        if not segment.terms:
            continue
        asked = np.flatnonzero(queries.bounds(np.array(segment.terms), np.array(segment.tops), segment.m) >= np.maximum(floor, 1)).tolist()
        if only is not None:
            asked = [q for q in asked if (segment.m, q) in only]
        adds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in asked:
            scores = np.zeros(len(segment.ids), np.int64)
            for term, times in queries.of(q):
                if term in segment.rows:
                    if term not in adds:
                        adds[term] = segment.adds(term, int(queries.weights[term]))
                    docs, more = adds[term]
                    scores[docs] += more if times == 1 else times * more
            some = np.flatnonzero(scores >= max(1, floor[q]))
            one = scores[some], np.where(segment.known, segment.ids, (1 << 63) - 1)[some], segment.known[some]
            if q in kept:
                one = tuple(map(np.concatenate, zip(kept[q], one, strict=True)))
            order = np.lexsort((one[1], ~one[2], -one[0]))[:k]
            kept[q] = tuple(x[order] for x in one)
            if len(order) == k:
                floor[q] = max(floor[q], kept[q][0][-1])
    for q, (scores, ids, known) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), queries.names[q]), pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], schema=FOUND)


def _search(index: Index, block: list[tuple[int, str]], k: int, ahead: int) -> DataFrame | None:
    """(q, doc_id, score): the k best of each task for each query of the block."""
    queries, spark = Queries(block), index.postings.sparkSession
    if not queries.names:
        return None
    asked = spark.createDataFrame([("", None), *((t.decode(), n) for t, n in queries.numbers.items())], "term string, no int")  # the block's terms
    rows = written(index.postings.join(F.broadcast(asked), "term").drop("term"), "ranked-postings")
    for r in rows.where("no IS NOT NULL").groupBy("no").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        queries.weights[r["no"]] = weight(index.n_docs, r["df"])
    given = spark.sparkContext.broadcast(queries)
    tops = rows.where("no IS NOT NULL").groupBy("m", F.col("no").alias("term")).agg(F.max("top").alias("top"))
    strata = written(tops.groupBy("m").agg(F.collect_list(F.struct("term", "top")).alias("entries")), "ranked-strata")  # at most the block's terms each
    leading = strata.mapInArrow(lambda b: _leading(b, given.value, ahead), "q long, m long, bound long")
    first = leading.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "m"))).where(F.col("k") <= ahead)
    only = {(r["m"], r["q"]) for r in first.collect()}  # ahead rows for each query of the block
    form = "q long, doc_id long, score long"
    together = lambda df, *by: df.repartition("segment").sortWithinPartitions(*by, "segment")
    if only:
        seen = together(rows.where(F.col("m").isin(sorted({m for m, _ in only})))).mapInArrow(lambda b: _visit(b, given.value, k, only), form)
        place = {name: j for j, name in enumerate(queries.names)}
        for r in seen.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("k") == k).collect():  # one for each query
            queries.floor[place[r["q"]]] = r["score"]
        given = spark.sparkContext.broadcast(queries)
    reaching = strata.mapInArrow(lambda b: _reaching(b, given.value), "m long, bound long")
    visited = together(rows.join(reaching, "m"), F.desc("bound"))
    return written(visited.mapInArrow(lambda b: _visit(b, given.value, k), form), "ranked-found")


def search(index: Index, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, ahead: int = AHEAD) -> DataFrame:
    """(item_id, rank, doc_id, score) for each row of items (item_id, text)."""
    items = items.select("item_id", text_of().alias("text"))
    texts = written(items.select("text").where("text <> ''").distinct().withColumn("q", F.monotonically_increasing_id()), "ranked-queries")
    found = [x for block in text_blocks(texts, "q", block_bytes) if (x := _search(index, block, k, ahead)) is not None]
    if not found:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score")).limit(0)
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return items.join(texts, "text").join(best, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
norm AS (SELECT row, doc_id, w, 25 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
tf AS (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(w) AS term FROM norm) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, n_docs),
s AS (SELECT item, item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM asked JOIN weights USING (term) JOIN tf USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
