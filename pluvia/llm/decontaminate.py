"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ten consecutive words of a benchmark item (an item of fewer words is
one window). For the patterns of one length m, the shift table gives, for the hash of a block of
two words, how far its last occurrence in any pattern lies before the pattern's end; a block in
no pattern lets the search skip m - 1 words. Where the shift is zero, the block's bucket holds
the patterns that end in it, ordered by the hash of all their words, and those of the text's
hash are compared word by word. Patterns of fewer words have tables of their own. Tables are
arrays: about 40 bytes a window beside the words themselves, of which each is held once.

The different benchmark items go to the executors in blocks of at most ``block_bytes`` of text
(beside the longest item); each block searches all documents, and the blocks' finds are put
together by document. A worker keeps the tables of its last block.

Null and empty texts have no words; null and empty items give no window. Items with a null
item_id count for hits, but have no id to list. Rows of equal item_id and text are one item. Repeated
windows and items of equal text each list their ids; repeated document rows are searched one by one (with several blocks they are
told apart by a row id). An empty benchmark leaves every document clean. clean() keeps all
columns, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import table, text_blocks, text_of, written

#: Everything but ASCII letters, digits and bytes of other characters parts words; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
BLOCK = 2
BLOCK_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


#: Odd multipliers of the hash of a window's words, one for each place.
FACTORS = [int(x) | 1 for x in np.random.default_rng(10).integers(1 << 40, 1 << 62, 64)]
WIDE = (1 << 64) - 1


class WuManber:
    """Tables for the patterns of one length: starts are their places in the items' words, one for each different pattern."""

    def __init__(self, length: int, ids: np.ndarray, starts: np.ndarray, vocabulary: list[bytes]):
        self.length, self.block, self.vocabulary, self.ids = length, min(BLOCK, length), vocabulary, ids
        self.default = length - self.block + 1
        bits = max(10, int(4 * len(starts)).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = bytearray([self.default]) * (1 << bits)
        view = np.frombuffer(self.shift, np.uint8)
        for end in range(self.block, length + 1):  # nearer to the end, smaller: the last to write is the least
            view[self._blocks(starts + end)] = length - end
        last = self._blocks(starts + length)
        whole = np.zeros(len(starts), np.uint64)
        for j in range(length):
            whole += ids[starts + j].astype(np.uint64) * np.uint64(FACTORS[j % 64])
        order = np.lexsort((whole, last))
        self.starts, self.whole, self.order = starts[order], whole[order], order
        self.bucket = np.searchsorted(last[order], np.arange((1 << bits) + 1))

    def _blocks(self, ends: np.ndarray) -> np.ndarray:
        one, two = self.ids[ends - self.block].astype(np.uint64), self.ids[ends - 1].astype(np.uint64)
        return ((one * np.uint64(FACTORS[0]) + two * np.uint64(FACTORS[1])) & np.uint64(WIDE) >> np.uint64(20)).astype(np.int64) & self.mask

    def search(self, words: list[bytes], known: list[int | None]):
        """(start, pattern) of each occurrence; known: each word's number, None if no item has it."""
        n, m, block, default, shift, mask = len(words), self.length, self.block, self.default, self.shift, self.mask
        x, y, low = FACTORS[0], FACTORS[1], WIDE >> 20
        end = m
        while end <= n:
            one, two = known[end - block], known[end - 1]
            if one is None or two is None:
                end += default
                continue
            at = (one * x + two * y) & low & mask
            step = shift[at]
            if step:
                end += step
                continue
            window = known[end - m : end]
            if None not in window:
                whole = sum(w * FACTORS[j % 64] for j, w in enumerate(window)) & WIDE
                lo, hi = int(self.bucket[at]), int(self.bucket[at + 1])
                k = lo + int(np.searchsorted(self.whole[lo:hi], np.uint64(whole)))
                while k < hi and int(self.whole[k]) == whole:
                    start = int(self.starts[k])
                    if all(self.vocabulary[i] == w for i, w in zip(self.ids[start : start + m].tolist(), words[end - m : end], strict=True)):
                        yield end - m, int(self.order[k])
                    k += 1
            end += 1


class Matcher:
    """Wu-Manber tables of some items, (id, text) each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        number: dict[bytes, int] = {}
        parts, lengths = [], []
        for _, text in items:
            words = words_of(text)
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            lengths.append(len(words))
        ids, lengths = np.concatenate([*parts, np.zeros(0, np.int32)]), np.array(lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        self.number, self.ids, self.searches = number, [i for i, _ in items], []
        vocabulary = list(number)
        for m in sorted({min(size, n) for n in lengths.tolist() if n}):
            of = np.flatnonzero(np.minimum(lengths, size) == m)
            many = lengths[of] - m + 1
            item = np.repeat(of, many)
            starts = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            _, at, same = np.unique(np.lib.stride_tricks.sliding_window_view(ids, m)[starts], axis=0, return_index=True, return_inverse=True)
            order = np.argsort(same, kind="stable")
            self.searches.append((WuManber(m, ids, starts[at], vocabulary), item[order], np.searchsorted(same[order], np.arange(len(at) + 1))))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs (start, end) of hit words, and the places of the items found."""
        runs, seen = [], set()
        known = list(map(self.number.get, words))
        for k, (tables, _, _) in enumerate(self.searches):
            for start, pattern in tables.search(words, known):
                runs.append((start, start + tables.length))
                seen.add((k, pattern))
        found: set[int] = set()
        for k, pattern in seen:
            _, owners, begin = self.searches[k]
            found.update(owners[begin[pattern] : begin[pattern + 1]].tolist())
        merged: list[list[int]] = []
        for s, e in sorted(runs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        return [(s, e) for s, e in merged], found


SCHEMA = "row_id long, doc_id long, n_words long, runs array<struct<s:int,e:int>>, items array<string>"


def _search_block(docs: DataFrame, items: list, size: int) -> DataFrame:
    given, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(given, name, size)
        pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            n, runs, ids = [], [], []
            for t in batch.column("text"):
                words = words_of(t.as_py())
                hit, found = matcher.find(words)
                n.append(len(words))
                runs.append([{"s": s, "e": e} for s, e in hit])
                ids.append(sorted({matcher.ids[k] for k in found if matcher.ids[k] is not None}))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pair), pa.array(ids, pa.list_(pa.string()))], ["row_id", "doc_id", "n_words", "runs", "items"])

    return docs.mapInArrow(run, SCHEMA)


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """The different items, (id, text) each, in blocks of at most block_bytes of text beside the longest item; one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text")).where("text <> ''").distinct()
    return text_blocks(written(items, "benchmark"), "item_id", block_bytes)


#: The tables of the last block that this worker has searched for.
_built: dict[str, Matcher] = {}


def _matcher(items, name: str, size: int) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(items.value, size)
    return _built[name]


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, doc_id, n_words, runs, items) for every document: its hit word runs and the items found in it."""
    bare = docs.select(F.lit(0).cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = item_blocks(benchmark, block_bytes)
    part, following = next(blocks), next(blocks, None)
    if following is None:
        return _search_block(bare, part, size)
    marked = written(bare.withColumn("row_id", F.monotonically_increasing_id()), "decontaminate")
    out = None
    while part is not None:
        found = written(_search_block(marked, part, size), "decontaminate")  # one block of items at a time
        out = found if out is None else out.unionByName(found)
        part, following = following, next(blocks, None)
    return out.groupBy("row_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def hits(found: DataFrame) -> DataFrame:
    """search()'s rows with n_hit, the number of words in the union of the runs."""
    step = F.aggregate(
        "runs", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, r: F.struct(F.greatest(a["upto"], r["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["upto"], r["s"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return found.withColumn("n_hit", step)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold a benchmark window; all columns stay. What one block of items leaves goes on to the next."""
    at = docs.columns.index("text")
    for k, part in enumerate(item_blocks(benchmark, block_bytes)):
        if k:
            docs = written(docs, "decontaminate")
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(part), at, size)
    return docs


def _without(docs: DataFrame, items, at: int, size: int) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(items, name, size)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(words_of(t.as_py()))[0] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = hits(search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows as strings of words around single spaces; a document word is hit if a window that covers it starts up to nine words before it.
ORACLE_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
