"""Exact duplicates by a cuckoo-filter index of live digests.

A ``CuckooIndex`` has buckets of four slots. A slot holds the 16-bit fingerprint of a live
digest and, beside it, that digest's entry: the different contents that have it, each with its
number of live rows and its largest id. A digest is in one of two buckets that follow from its
hash and its fingerprint; a slot whose fingerprint agrees is a hit, and a hit counts only after
the entry's digest and then its content compare equal. A full pair of buckets moves entries to
their other bucket; when that does not end, the table doubles and is filled anew from the stored
keys. A content whose last live row goes leaves its entry, and an empty entry its slot.

On Spark: each task first puts its own rows into an index, emptied whenever its contents exceed
``HELD`` bytes, so that however many copies a text has, a task sends it on about once. What is
left is dealt by the hash of the digest to shards of about ``SHARD`` bytes of text, each an index
of its own. The stored index has a row for each live content. ``insert`` and ``remove`` read the
shards that new rows fall into and write a new index; the old one is not changed.

Rows meet their content's entry by digest; only where one digest has several contents do they
meet by text too. A null text is an empty one, and equal to it. A row without an id counts for
its group's size, never as the one to keep unless no row of the group has an id; then keep_id is
null and all of them are kept, as nothing tells them apart. Rows of equal id and text are all
kept or all dropped with that id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import HOT_SHARE, table, text_of, written

SLOTS = 4
#: Moves of entries before the table doubles.
KICKS = 200
#: Bytes of text after which a task sends on what it has.
HELD = 48 << 20
SHARD = 3 << 20
DIGEST_BYTES = 32


class Content:
    """A live content: its text, its number of live rows, the largest id of them, and whether that is still sure."""

    __slots__ = ("rows", "stale", "text", "top")

    def __init__(self, text: bytes):
        self.text, self.rows, self.top, self.stale = text, 0, None, False


class CuckooIndex:
    def __init__(self, buckets: int = 256):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask, self.live = buckets - 1, 0
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: a free slot
        self.entries: list[tuple[bytes, list[Content]] | None] = [None] * (SLOTS * buckets)

    def _place(self, digest: bytes) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(digest, 12)
        return (h >> 48) or 1, h & self.mask

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int | None:
        """The slot of a live digest: fingerprints first, then the stored key."""
        print_, bucket = self._place(digest)
        for b in (bucket, self._other(bucket, print_)):
            for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                if self.prints[slot] == print_ and self.entries[slot][0] == digest:
                    return slot
        return None

    def _put(self, entry: tuple[bytes, list[Content]]) -> tuple[bytes, list[Content]] | None:
        """Puts an entry into a free slot, moving others; what is left without one after KICKS moves, if any."""
        print_, bucket = self._place(entry[0])
        for kick in range(KICKS):
            for b in (bucket, self._other(bucket, print_)):
                for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.entries[slot] = print_, entry
                        return None
            slot = SLOTS * bucket + (kick + print_) % SLOTS
            self.prints[slot], print_ = print_, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, print_)  # where the one that was put out may go
        return entry

    def _insert(self, entry: tuple[bytes, list[Content]]) -> None:
        while (left := self._put(entry)) is not None:
            stored = [e for e in self.entries if e is not None] + [left]
            while stored:  # twice as large, or larger still
                self._empty(2 * (self.mask + 1))
                rest = [self._put(e) for e in stored]
                if all(e is None for e in rest):
                    break
            self.live = len(stored)
            return
        self.live += 1

    def find(self, digest: bytes, text: bytes) -> Content | None:
        slot = self._slot(digest)
        return None if slot is None else next((c for c in self.entries[slot][1] if c.text == text), None)

    def add(self, digest: bytes, text: bytes, rows: int, top: int | None, stale: bool = False) -> bool:
        """Counts live rows of a content; whether it is new."""
        slot = self._slot(digest)
        contents = [] if slot is None else self.entries[slot][1]
        content = next((c for c in contents if c.text == text), None)
        if new := content is None:
            content = Content(text)
            contents.append(content)
            if slot is None:
                self._insert((digest, contents))
        content.rows += rows
        content.stale |= stale
        if top is not None:
            content.top = top if content.top is None else max(content.top, top)
        return new

    def remove(self, digest: bytes, text: bytes, rows: int, top: int | None) -> None:
        """Takes live rows of a content away; a content or digest without any goes. Unknown ones are left alone."""
        if (slot := self._slot(digest)) is None:
            return
        contents = self.entries[slot][1]
        for content in contents:
            if content.text == text:
                content.rows -= rows
                content.stale |= top is not None and content.top is not None and top >= content.top
                if content.rows <= 0:
                    contents.remove(content)
                break
        if not contents:
            self.prints[slot], self.entries[slot] = 0, None
            self.live -= 1

    def contents(self):
        """(digest, contents) of all live digests."""
        return (e for e in self.entries if e is not None)


SENT = "digest binary, text binary, n long, top long, kind int"
#: n_texts: different contents of the digest; stale: top has left and is not known.
STORED = "shard long, digest binary, n_texts int, text binary, n long, top long, stale boolean"
LIVE, ADDED, REMOVED, TOPS = range(4)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _combine(batches, held, digest_bytes, kind):
    """A row for each different text of a task, or of each stretch of its rows that holds so many bytes."""
    index, size = CuckooIndex(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes()
            if index.add(hashlib.sha256(raw).digest()[:digest_bytes], raw, 1, doc_id):
                size += len(raw) + 200
                if size > held:
                    yield _batch([(d, c.text, c.rows, c.top, kind) for d, contents in index.contents() for c in contents], SENT)
                    index, size = CuckooIndex(), 0
    yield _batch([(d, c.text, c.rows, c.top, kind) for d, contents in index.contents() for c in contents], SENT)


def _shards(batches):
    """The live contents of each shard after its rows, sorted by shard and kind, have been put in or taken out."""
    at, index = None, CuckooIndex()

    def stored():
        return _batch([(at, d, len(contents), c.text, c.rows, c.top, c.stale) for d, contents in index.contents() for c in contents], STORED)

    for batch in batches:
        texts, digests = batch.column("text"), batch.column("digest")
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "n", "top", "stale")), strict=True)
        for i, (shard, kind, n, top, stale) in enumerate(rows):
            if shard != at:
                if at is not None:
                    yield stored()
                at, index = shard, CuckooIndex()
            digest, text = digests[i].as_py(), texts[i].as_py()
            if kind == REMOVED:
                index.remove(digest, text, n, top)
            elif kind == TOPS:
                if (content := index.find(digest, text)) is not None:
                    content.top, content.stale = top, False
            else:
                index.add(digest, text, n, top, bool(stale))
    if at is not None:
        yield stored()


class Index(NamedTuple):
    """live: rows of STORED; shards: their number."""

    live: DataFrame
    shards: int
    digest_bytes: int


def _sent(docs: DataFrame, kind: int, held: int, digest_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _combine(b, held, digest_bytes, kind), SENT)


def _updated(sent: DataFrame, live: DataFrame | None, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards))
    rows = sent.select(shard.alias("shard"), "kind", "digest", "text", "n", "top", F.lit(False).alias("stale"))
    if live is not None:
        rows = rows.unionByName(live.select("shard", F.lit(LIVE).alias("kind"), "digest", "text", "n", "top", "stale"))
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_shards, STORED)


def build(docs: DataFrame, held: int = HELD, shard: int = SHARD, digest_bytes: int = DIGEST_BYTES) -> Index:
    """The index of the rows (doc_id, text), stored in the shared folder."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard))
    return Index(written(_updated(_sent(docs, ADDED, held, digest_bytes), None, shards), "cuckoo"), shards, digest_bytes)


def _changed(index: Index, sent: DataFrame, tag: str) -> Index:
    sent = written(sent, "cuckoo-sent")
    shard = F.pmod(F.xxhash64("digest"), F.lit(index.shards))
    touched = sent.select(shard.alias("shard")).distinct()
    within = _updated(sent, index.live.join(touched, "shard", "left_semi"), index.shards)
    return index._replace(live=written(within.unionByName(index.live.join(touched, "shard", "left_anti")), tag))


def insert(index: Index, docs: DataFrame, held: int = HELD) -> Index:
    """The index with further rows."""
    return _changed(index, _sent(docs, ADDED, held, index.digest_bytes), "cuckoo")


def remove(index: Index, docs: DataFrame, stay: DataFrame, held: int = HELD) -> Index:
    """The index without the rows of docs, each in it once more at least; stay: the rows left, read for texts whose kept row goes."""
    less = _changed(index, _sent(docs, REMOVED, held, index.digest_bytes), "cuckoo")
    stale = less.live.where("stale").select("digest", "text")
    rows = _keyed(stay, less.digest_bytes).withColumn("text", text_of().cast("binary"))
    tops = rows.join(stale, ["digest", "text"], "left_semi").groupBy("digest", "text").agg(F.max("doc_id").alias("top"))
    return _changed(less, tops.select("digest", "text", F.lit(0).cast("long").alias("n"), "top", F.lit(TOPS).alias("kind")), "cuckoo")


def _keyed(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """(doc_id, text, sha, digest) of the rows."""
    sha: Column = F.sha2(text_of().cast("binary"), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", sha.alias("sha")).withColumn("digest", F.expr(f"substring(unhex(sha), 1, {digest_bytes})"))


def groups(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs, all of which are in the index."""
    rows = _keyed(docs, index.digest_bytes)
    found = index.live.select("digest", "n_texts", "text", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    single = found.where("n_texts = 1").drop("n_texts", "text")
    several = written(single.where("group_size > 1"), "cuckoo-groups")  # copies only: any other row is its own group
    rest = found.where("n_texts > 1")
    crowded = written(rest.select("digest").distinct(), "cuckoo-crowded")
    bare = rows.select("doc_id", "sha", "digest")
    if mixed := not crowded.isEmpty():
        bare = bare.join(crowded, "digest", "left_anti")
    # at most HOT_SHARE contents have over least rows: theirs are told by broadcast, and spread in the join of all others
    least = max(64, -(-(several.agg(F.sum("group_size")).first()[0] or 0) // HOT_SHARE))
    hot = several.where(F.col("group_size") > least).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = several.where(F.col("group_size") <= least).withColumn("salt", F.lit(0).cast("long"))
    met = bare.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot_size").isNull(), F.lit(0)).otherwise(1 + F.monotonically_increasing_id() % 4096))
    met = met.join(cold, ["digest", "salt"], "left")
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    out = met.select("doc_id", "sha", keep.alias("keep_id"), F.coalesce("hot_size", "group_size", F.lit(1).cast("long")).alias("group_size"))
    if mixed:
        texts = rows.join(crowded, "digest", "left_semi").withColumn("text", text_of().cast("binary"))
        out = out.unionByName(texts.join(rest.drop("n_texts"), ["digest", "text"]).select("doc_id", "sha", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, build(docs))


ORACLE_OP12 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
