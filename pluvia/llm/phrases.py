"""Collocations: phrases whose words stand together more often than their parts alone explain.

Counting. Phrases of up to five words are counted in three passes over all texts: words; pairs
whose both words are frequent; longer phrases all of whose pairs are frequent. A phrase is at most
as frequent as its parts, so nothing frequent is passed over. Frequent words and pairs are made
known to the tasks as bits by hash, in a table of fixed size: a wrong bit lets a phrase be
counted that then turns out rare, and changes no result. A task counts its phrases by exact
numbers of its words and sends each on once for every ``HELD`` words.

Merging. The frequent phrases of all lengths are one stream, kept in two orders: by their words
from the last to the first (suffix order) and from the first to the last (prefix order). In
prefix order a phrase's beginnings are the phrases passed last, each a beginning of the next, so
one pass of a stack of at most five counts merges the streams of all lengths in lockstep: it gives
each phrase the counts of its beginnings, and each beginning the highest count among its extensions
to the right. The pass in suffix order gives the counts of the endings and the extensions to the
left. Nothing is looked up by hash. Streams are cut at phrases that were picked by hash, about
evenly; beginnings of the first phrase after a cut are carried there as copies.

A phrase goes if a phrase one word longer that holds it is as frequent; longer ones need not be
looked at, as those in between would be as frequent too. Scores are made of Python's integers.

A null text is empty; a null lang is ``und``, together with rows that say so. Repeated rows count
each time. Empty tables, or those without frequent phrases, give no rows. Words are what is
between spaces and tabs; all else but the marks that part pieces belongs to them. Other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.llm.common import table, text_of, written

LEAST = 100
LONGEST = 5
TOP = 2000
#: Words after which a task sends on its counts.
HELD = 4_000_000
#: Bits of the tables of frequent words and pairs: 16 for each, within these bounds.
MIN_BITS, MAX_BITS = 20, 27
#: Cuts of a sorted stream at most.
CUTS = 1024
#: A-Z become a-z, marks and line breaks part pieces, tabs part words.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair(left, right):
    """A hash of two hashes, or arrays of them."""
    with np.errstate(over="ignore"):
        x = (np.asarray(left, np.uint64) * MIX) ^ np.asarray(right, np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Numbers the words of a task from 1; words that are not frequent are 0, as piece marks are; an empty one is -1."""

    def __init__(self, lang: str, bits: bytes | None):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.bits, self.names, self.hashes = lang.encode() + b" ", bits, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        n, h = 0, xxhash.xxh64_intdigest(self.lang + word)
        if self.bits is None or self.bits[(at := h & 8 * len(self.bits) - 1) >> 3] >> (at & 7) & 1:
            n = len(self.names)
            self.names.append(word)
            self.hashes.append(h)
        self[word] = n
        return n


def _set(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set; the table has a power of two of them."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return np.frombuffer(bits, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


COUNTED = "lang string, phrase string, f long"


def _count(batches, sizes, words, pairs, held_words):
    """(lang, phrase, f) of the phrases of so many words, each once for every held_words words of the task."""
    held: dict[str, tuple[_Words, list[np.ndarray]]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if lang not in held:
                held[lang] = _Words(lang, words), []
            numbers, parts = held[lang]
            tokens = text.as_buffer().to_pybytes().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
            got = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
            parts += got[got >= 0], np.zeros(1, np.int32)
            size += len(got)
            if size >= held_words:
                yield from _counts(held, sizes, pairs)
                held, size = {}, 0
    yield from _counts(held, sizes, pairs)


def _counts(held, sizes, pairs):
    for lang, (numbers, parts) in held.items():
        stream = np.concatenate([*parts, np.zeros(max(sizes), np.int32)])
        hashes, names = np.array(numbers.hashes, np.uint64), pa.array(numbers.names, pa.binary()).cast(pa.string())
        starts = np.flatnonzero(stream)
        if min(sizes) > 1:
            starts = starts[stream[starts + 1] > 0]
        if pairs is not None:  # places at which a frequent pair begins
            starts = starts[_set(pairs, _pair(hashes[stream[starts]], hashes[stream[starts + 1]]))]
            begins = np.zeros(len(stream), bool)
            begins[starts] = True
        for n in sizes:
            if n > 2:
                starts = starts[begins[starts + n - 2]]
            at, count = _different(stream, starts, n)
            words = (names.take(pa.array(stream[at + j])) for j in range(n))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pc.binary_join_element_wise(*words, " "), pa.array(count, pa.int64())], ["lang", "phrase", "f"])


def _different(stream, starts, n):
    """A place of each different phrase of n words, and its occurrences. Phrases are told apart by the numbers of their words."""
    key = stream[starts].astype(np.int64)
    for j in range(1, n):
        key = (key << 32) | stream[starts + j]
        if j < n - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return starts[first], count


def _bits(frequent: DataFrame) -> bytes:
    """The table of bits by hash of frequent words or pairs (lang, phrase): at most 2^MAX_BITS bits come to the driver."""
    log = min(MAX_BITS, max(MIN_BITS, (16 * frequent.count()).bit_length()))

    def places(batches):
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h = [xxhash.xxh64_intdigest(f"{lang} {w}") for w in phrase.split(" ")]
                at.append(int(h[0] if len(h) == 1 else _pair(h[0], h[1])) & (1 << log) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])

    words = frequent.mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << log - 6, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.astype("<i8").tobytes()


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held_words: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to longest words with f >= least, words themselves too; and (lang, n)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))
    share = rows.sparkSession.sparkContext.broadcast

    def level(tag, sizes, words=None, pairs=None):
        part = rows.mapInArrow(lambda b: _count(b, sizes, words and words.value, pairs and pairs.value, held_words), COUNTED)
        summed = part.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        return written(summed if words is None else summed.where(F.col("f") >= least), f"phrases-{tag}")

    every = level("words", (1,))
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    out = every.where(F.col("f") >= least)
    if longest > 1:
        words = share(_bits(out))
        two = level("pairs", (2,), words)
        out = out.unionByName(two)
        if longest > 2:
            out = out.unionByName(level("longer", tuple(range(3, longest + 1)), words, share(_bits(two))))
    return out, total


#: ends: counts of the phrase's last one, two, ... words; extended: the highest count of the phrases one word longer seen so far; copy: only carried past a cut.
STREAM = "lang string, words array<string>, f long, n long, ends array<long>, extended long, copy boolean"
SCORED = "lang string, phrase string, a long, l long, r long, n long, score long, copy boolean"
KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _dealt(batches, cuts):
    """The rows with the number of their stretch; what begins the first phrase of a later stretch goes there too, as a copy."""
    for batch in batches:
        rows, parts, copies = [], [], []
        for i, (lang, words) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True)):
            key = [w.encode() for w in words]
            own = bisect_right(cuts, (lang, key))
            after = bisect_left(cuts, (lang, [*key[:-1], key[-1] + b"\0"]), own)  # cuts at phrases that begin with this one
            for part in range(own, after + 1):
                rows.append(i)
                parts.append(part)
                copies.append(part > own)
        taken = batch.take(pa.array(rows, pa.int64())).drop_columns(["copy"])
        yield taken.append_column("copy", pa.array(copies, pa.bool_())).append_column("part", pa.array(parts, pa.int32()))


def _merge(batches, closed, schema):
    """One pass over rows sorted by key: what stands on the stack begins the present row. closed makes an output row, or None, of each row and the counts of its beginnings."""
    stack: list[tuple[list[str], dict, list[int]]] = []
    place = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key, here = row["key"], (row["part"], row["lang"])
            while stack and (here != place or len(stack[-1][0]) >= len(key) or stack[-1][0] != key[: len(stack[-1][0])]):
                _, top, counts = stack.pop()
                out.append(closed(top, counts))
            place = here
            if len(stack) != len(key) - 1:
                raise AssertionError(f"only {len(stack)} beginnings of {key!r} precede it")
            if stack:
                above = stack[-1][1]
                above["extended"] = max(above["extended"], row["f"])
            stack.append((key, row, [x[1]["f"] for x in stack]))
        yield _batch([x for x in out if x is not None], schema)
    yield _batch([x for _, top, counts in reversed(stack) if (x := closed(top, counts)) is not None], schema)


def _with_ends(row: dict, counts: list[int]) -> tuple | None:
    if row["copy"] and row["extended"] < row["f"]:
        return None
    return row["lang"], row["words"], row["f"], row["n"], counts, row["extended"], row["copy"]


def _score(row: dict, counts: list[int]) -> tuple | None:
    """A candidate with its lowest-scoring cut; of copies, those that are held by a phrase as frequent."""
    a, n, size, covered = row["f"], row["n"], len(row["words"]), row["extended"] >= row["f"]
    if size < 2 or covered != row["copy"]:
        return None
    score, _, left, right = min((1000 * a * n // (counts[k - 1] * row["ends"][size - k - 1]), k, counts[k - 1], row["ends"][size - k - 1]) for k in range(1, size))
    return row["lang"], " ".join(row["words"]), a, left, right, n, score, row["copy"]


def _merged(rows: DataFrame, key: Column, closed, schema: str, cuts: int) -> DataFrame:
    """The stream in the order of key, merged stretch by stretch."""
    rows = rows.withColumn("key", key)
    picked = rows.select("lang", "key").orderBy(F.xxhash64("lang", "key"), "lang", "key").limit(cuts).collect()  # one row for each cut
    at = rows.sparkSession.sparkContext.broadcast(sorted((r["lang"], [w.encode() for w in r["key"]]) for r in picked))
    dealt = rows.mapInArrow(lambda b: _dealt(b, at.value), f"{STREAM.removesuffix(', copy boolean')}, key array<string>, copy boolean, part int")
    return dealt.repartition("part").sortWithinPartitions("part", "lang", "key").mapInArrow(lambda b: _merge(b, closed, schema), schema)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, held_words: int = HELD, cuts: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first top phrases."""
    grams, total = counted(docs, least, longest, held_words)
    rows = grams.join(total, "lang").select("lang", F.split("phrase", " ").alias("words"), "f", "n")
    rows = written(rows.select("*", F.lit(None).cast("array<long>").alias("ends"), F.lit(0).cast("long").alias("extended"), F.lit(False).alias("copy")), "phrases-counts")
    if cuts is None:
        cuts = min(CUTS, rows.count() // 500)
    suffix = written(_merged(rows, F.reverse("words"), _with_ends, STREAM, cuts), "phrases-suffix")
    scored = written(_merged(suffix.where("not copy"), F.col("words"), _score, SCORED, cuts), "phrases-prefix")
    # at most longest - 1 copies for each cut of either order
    gone = suffix.where("copy").select("lang", F.array_join("words", " ").alias("phrase")).unionByName(scored.where("copy").select("lang", "phrase")).distinct()
    best = scored.where("not copy").drop("copy").join(F.broadcast(gone), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first ones of each of 256 parts of a lang, then those of the lang
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, words, count(*) AS f FROM (SELECT lang, k, w[i:i + k - 1] AS words FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, words[1:k - 1] AS part, f FROM g UNION ALL SELECT lang, words[2:k] AS part, f FROM g) WHERE len(part) > 0 GROUP BY ALL),
cut AS (SELECT g.lang, g.words, g.f AS a, c AS k, l.f AS l, r.f AS r, n, (1000 * CAST(g.f AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS c FROM g WHERE k > 1) g JOIN total USING (lang)
        JOIN g l ON l.lang = g.lang AND l.words = g.words[1:c] JOIN g r ON r.lang = g.lang AND r.words = g.words[c + 1:g.k]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS pick FROM cut) WHERE pick = 1),
kept AS (SELECT best.lang, array_to_string(best.words, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.words WHERE longer.f IS NULL OR longer.f < a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000
"""
