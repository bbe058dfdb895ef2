"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made of the XXH64 hashes of a text's shingles. Different fingerprints are dealt
into tiles by the population counts of their two halves, and tiles into blocks of bounded size.
Fingerprints within the radius differ by no more than it in the sum of both counts' differences,
so tile pairs beyond that are skipped; all others are compared exactly, block by block, with
numpy's exclusive-or and bit counts. Of a block pair's links, a spanning forest leaves the task:
no connection is lost, and copies cannot multiply. Components are found by alternating large-star
and small-star steps on the links of different fingerprints. Every pair of tiles within the radius
is compared, so this work grows with the square of the different fingerprints.

Minima of a node's neighbours are combined before they are shuffled, and what goes back to the
rows of a frequent node, fingerprint or component is broadcast (there are at most a thousand that
are frequent), so no key's rows meet in one task.

A null text is empty; texts without words have fingerprint zero and link like any other. Words
and hashes of a text are made some at a time, so memory grows only with its bytes. Rows with
equal or null ids are rows of their own; a null id never names a component unless no row of it
has an id. Empty tables give no rows. keep_one() keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import discard, split_join, stored, table, text_of, written

SHINGLE = 4
RADIUS = 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


PIECE = 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(data: bytes, overlap: int):
    """Lists of words of some bytes each; all but the first begin with the last words of the one before."""
    at, kept = 0, []
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        words = data[at:end].split()  # at ASCII white space, which is what parts words here
        if words:
            yield kept + words
            kept = (kept + words)[-overlap:] if overlap else []
        at = end


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    h, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for words in word_runs(text.encode().translate(LOWER), shingle - 1):
        line = b" ".join(words)
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = [h(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
        if hashes:
            n += len(hashes)
            votes += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if not n:  # fewer words than a shingle: the whole sequence, if there is one
        words = text.encode().translate(LOWER).split()
        if not words:
            return 0
        n = 1
        votes = np.unpackbits(np.array([h(b" ".join(words), 42)], np.uint64).view(np.uint8)).astype(np.int64)
    return int(np.packbits(votes * 2 > n).view(np.int64)[0])


def _fingerprints(batches, name):
    for batch in batches:
        out = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), out], ["row", name])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(row, fp) of (row, text)."""
    return rows.select("row", text_of().alias("text")).mapInArrow(lambda b: _fingerprints(b, "fp"), "row long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what exact comparison of all pairs of a and b connects."""
    rows, cols = [], []
    for i in range(0, len(a), 128):
        near = np.flatnonzero(np.bitwise_count(a[i : i + 128, None] ^ b[None, :]).ravel() <= radius)
        if len(near):
            r, c = i + near // len(b), near % len(b)
            keep = r < c if same else slice(None)
            rows.append(r[keep].astype(np.int32))
            cols.append(c[keep].astype(np.int32))
    if not rows or not sum(map(len, rows)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, c = np.concatenate(rows), np.concatenate(cols) + (0 if same else len(a))
    nodes = a if same else np.concatenate((a, b))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[r], label[c])
        before = label.copy()
        np.minimum.at(label, label[r], low)
        np.minimum.at(label, label[c], low)
        np.minimum.at(label, r, low)
        np.minimum.at(label, c, low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _compare(batches, radius):
    for batch in batches:
        left, right = [], []
        for a, b, same in zip(batch.column("fps"), batch.column("others"), batch.column("same").to_pylist(), strict=True):
            u, v = _forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), same, radius)
            left.append(u.view(np.int64))
            right.append(v.view(np.int64))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([join(left), join(right)], ["u", "v"])


def links(fps: DataFrame, radius: int = RADIUS, block: int = 2048) -> DataFrame:
    """(u, v): links that connect all different fingerprints of (fp) within the radius."""
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiled = fps.select("fp", (high * 64 + low).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # 33 x 33 rows at most
    dealt = tiled.join(F.broadcast(sizes), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = written(dealt.groupBy("tile", "block").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    near = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0)))
    ahead = blocks.select("tile", "block", "fps", F.explode(near).alias("d"))
    # a step in the low count must not run over into the high one
    ahead = ahead.where((F.col("tile") % 64 + F.col("d.y")).between(0, 32)).withColumn("to", F.col("tile") + F.col("d.x") * 64 + F.col("d.y"))
    ahead = ahead.join(F.broadcast(sizes.select(F.col("tile").alias("to"), F.col("blocks").alias("to_blocks"))), "to")
    ahead = ahead.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1))).where((F.col("to") != F.col("tile")) | (F.col("to_block") >= F.col("block")))
    # on even terms, each pair goes to the block of either side
    theirs = blocks.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("fps").alias("others"))
    pairs = ahead.join(theirs, ["to", "to_block"]).select("fps", "others", ((F.col("to") == F.col("tile")) & (F.col("to_block") == F.col("block"))).alias("same"))
    return pairs.mapInArrow(lambda b: _compare(b, radius), "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root: the smallest node it reaches."""
    spark = edges.sparkSession
    edges, path = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, n = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, near_path = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        least = near.select("u", F.least("u", "m").alias("m"))
        large, large_path = stored(split_join(both, least, "u", 2 * n, near.select("u", "n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low, low_path = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = split_join(large, low.select("u", "m"), "u", 2 * n, low.select("u", "n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, new_path = stored(small.distinct(), "edges")
        for old in (path, near_path, large_path, low_path):
            discard(spark, old)
        path = new_path
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        n = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(row, fp, root) of (row, fp): root, the fingerprint that stands for its component. rows should be stored."""
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("n")), "different")
    found = components(links(fps, radius))
    roots = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return split_join(rows, roots, "fp", rows.count(), fps).select("row", "fp", "root")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; all columns stay."""
    mark = fresh(docs, "__row")
    marked = written(docs.withColumn(mark, F.monotonically_increasing_id()), "simhash-rows")
    prints = written(fingerprints(marked.select(F.col(mark).alias("row"), "text")), "fingerprints")
    ids = marked.select(F.col(mark).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = near_duplicates(prints).join(ids, "row").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("row"))).alias("m"))
    return marked.join(first.select(F.col("m.row").alias(mark)), mark, "left_semi").select(docs.columns)


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", text_of().alias("text")).mapInArrow(_with_ids, "doc_id long, row long, fp long"), "fingerprints")
    return classes(prints)


def _with_ids(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())], ["doc_id", "row", "fp"])


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, row, fp), which should be stored; component_id: the smallest doc_id of the component."""
    fps = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "different")
    found = components(links(fps, radius))
    rooted = written(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")
    # a component's fingerprints are combined before the shuffle, and its name goes back by split_join
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    names = written(names, "names")
    named = split_join(rooted.select("fp", "root"), names.select("root", "component_id"), "root", rooted.count(), names.select("root", "n")).select("fp", "component_id")
    return split_join(prints, named, "fp", prints.count(), fps.select("fp", "n")).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
