"""Ranked search, exact duplicates and collocations against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pluvia.llm import common, cuckoo, phrases, ranked

from .test_operators import DOCS, prose, rows

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    more = [(100 + i, prose(rng.choice([3, 30, 31, 32, 200]), rng), "en", "a", 1, None, None, None) for i in range(150)]
    return spark.createDataFrame(rows() + more, DOCS).repartition(5).persist()


# ranked search


def ranked_plain(docs, items, k=10):
    texts = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    texts = [(d, Counter(w), len(w)) for d, w in texts if w]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, w, _ in texts for t in w)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, w, n in texts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t, times in asked.items() if w[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


ITEMS = [("a", "rain of THE wind"), ("b", None), ("c", ""), ("d", "no such word"), ("e", "naïve naïve Über echo 中文"), ("a", "cloud"), (None, "gust, front"), ("f", "rain of THE wind"), ("g", "hunter2hunter2 one")]


@pytest.mark.parametrize(("segment", "ahead", "block_bytes"), [(400_000, 4, 1 << 20), (60, 1, 1 << 20), (2000, 2, 40)])
def test_ranked_search_finds_the_best_of_all_documents(spark, docs, segment, ahead, block_bytes):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, score int")
    got = ranked.search(ranked.build(docs, segment), items, ahead=ahead, block_bytes=block_bytes).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter(ranked_plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS))


def test_ranked_search_with_ties_and_empty_tables(spark, docs):
    same = spark.createDataFrame([(i, "rain here") for i in range(40, 0, -1)] + [(None, "rain here"), (7, "rain here"), (50, "dry")], "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([("q", "rain")], "item_id string, text string")
    got = [(r["rank"], r.doc_id) for r in sorted(ranked.search(ranked.build(same), items).collect(), key=lambda r: r["rank"])]
    assert got == list(enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 9], 1))
    assert ranked.search(ranked.build(same.limit(0)), items).count() == 0
    assert ranked.search(ranked.build(docs), items.limit(0)).count() == 0
    assert ranked.search(ranked.build(docs), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_segments_under_the_floor_are_not_visited(spark, docs, monkeypatch):
    index = ranked.build(docs, 200)
    queries = ranked.Queries([(0, "rain wind echo 中文 gust")])
    texts = [set(TERM.findall((r.text or "").translate(LOWER))) for r in docs.collect()]
    for term, n in queries.numbers.items():
        queries.weights[n] = ranked.weight(index.n_docs, sum(term.decode() in t for t in texts))
    asked = spark.createDataFrame([("", None), *((t.decode(), n) for t, n in queries.numbers.items())], "term string, no int")
    batches = index.postings.join(asked, "term").coalesce(1).sortWithinPartitions("segment").toArrow().to_batches()
    visited = []
    plain = ranked.Segment.adds
    monkeypatch.setattr(ranked.Segment, "adds", lambda self, t, w: visited.append(self.m) or plain(self, t, w))
    everything = [r for b in ranked._visit(batches, queries, 1) for r in b.to_pylist()]
    before, visited[:] = len(visited), []
    queries.floor[0] = everything[0]["score"]
    assert [r for b in ranked._visit(batches, queries, 1) for r in b.to_pylist()] == everything
    assert 0 < len(visited) < before


@pytest.mark.parametrize("stretch", [1 << 12, 1 << 25])
def test_a_frequent_length_is_dealt_to_several_tasks(spark, stretch):
    same = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words w"), F.col("id")).alias("text"))
    index = ranked.build(same, 500, stretch)
    sizes = [r.n for r in index.postings.where("term = 'some'").groupBy("segment").agg(F.sum("df").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 166 and index.postings.select("m").distinct().count() == 1
    assert ranked.search(index, spark.createDataFrame([("q", "w77")], "item_id string, text string")).first().doc_id == 77


def test_blocks_of_texts_hold_their_bound(spark):
    texts = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)] + [(5000, "y" * 9000)], "q long, text string")
    stored = common.written(texts, "texts")
    blocks = list(common.text_blocks(stored, "q", 4000))
    assert sorted(x for b in blocks for x in b) == sorted((r.q, r.text) for r in texts.collect())
    assert all(sum(len(t) + 16 for _, t in b) <= 4000 + 9016 for b in blocks) and len(blocks) > 10


# exact duplicates


def groups_plain(pairs):
    found = defaultdict(list)
    for d, t in pairs:
        found[t or ""].append(d)
    out = []
    for t, ids in found.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return Counter(out)


def as_rows(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize(("held", "shard", "digest_bytes"), [(48 << 20, 3 << 20, 32), (300, 2000, 32), (1000, 5000, 1)])
def test_exact_groups(spark, docs, held, shard, digest_bytes):
    """With digests of one byte nearly all contents share theirs with others."""
    given = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    index = cuckoo.build(given, held, shard, digest_bytes)
    assert as_rows(cuckoo.groups(given, index)) == groups_plain([(r.doc_id, r.text) for r in given.collect()])


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_rows_are_inserted_and_removed(spark, docs, digest_bytes):
    parts = [docs.where(F.pmod(F.coalesce("doc_id", F.lit(1)), F.lit(3)) == k) for k in range(3)]
    index = cuckoo.build(parts[0].unionByName(parts[1]), shard=3000, digest_bytes=digest_bytes)
    index = cuckoo.insert(index, parts[2].unionByName(parts[2].withColumn("doc_id", F.col("doc_id") + 500)), held=500)
    left = parts[0].unionByName(parts[2]).unionByName(parts[2].withColumn("doc_id", F.col("doc_id") + 500))
    gone = left.where("doc_id > 500")  # the largest ids of their groups
    left = left.where("doc_id <= 500 OR doc_id IS NULL")
    index = cuckoo.remove(cuckoo.remove(index, parts[1], left.unionByName(gone)), gone, left)
    assert as_rows(cuckoo.groups(left, index)) == groups_plain([(r.doc_id, r.text) for r in left.collect()])
    assert index.live.count() == left.select(F.coalesce("text", F.lit(""))).distinct().count() and not index.live.where("stale").count()


def test_exact_groups_of_no_rows_and_of_one_text(spark, docs):
    assert cuckoo.groups(docs.limit(0), cuckoo.build(docs.limit(0))).count() == 0
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(0).alias("n")).unionByName(spark.createDataFrame([(None, "", 1), (None, None, 1)], "doc_id long, text string, n int"))
    got = as_rows(cuckoo.groups(same, cuckoo.build(same)))
    assert got == groups_plain([(r.doc_id, r.text) for r in same.collect()])
    sent = cuckoo._sent(same, cuckoo.ADDED, cuckoo.HELD, 32)
    assert sent.count() <= 2 * same.rdd.getNumPartitions()  # a task sends a text once, whatever its copies


def test_cuckoo_index_like_a_dictionary():
    rng = random.Random(3)
    for buckets in (2, 64):
        index, plain = cuckoo.CuckooIndex(buckets), {}
        for step in range(20_000):
            text = str(rng.randrange(4000)).encode()
            digest = hashlib.sha256(text).digest()[: rng.choice([32]) if step else 32]
            if rng.random() < 0.6:
                assert index.add(digest, text, 1, step) == (text not in plain)
                plain[text] = plain.get(text, 0) + 1
            else:
                index.remove(digest, text, 1, None)
                if text in plain:
                    plain[text] -= 1
                    if not plain[text]:
                        del plain[text]
        assert {c.text: c.rows for _, contents in index.contents() for c in contents} == plain
        assert index.live == len(plain) and index.mask + 1 > buckets  # it has grown
        assert all((index.find(hashlib.sha256(t).digest(), t) is not None) == (t in plain) for t in (str(i).encode() for i in range(4100)))


# collocations


def phrases_plain(data, top, least, longest):
    n, f = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    many = {k: v for k, v in f.items() if v >= least}
    covered = set()
    for (lang, w), v in many.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * v >= 100 * many[lang, w[i : i + size]]:
                    covered.add((lang, w[i : i + size]))
    out = defaultdict(list)
    for (lang, w), a in many.items():
        if len(w) > 1 and (lang, w) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (many[lang, w[:k]] * many[lang, w[k:]]), k, many[lang, w[:k]], many[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(8)
    fixed = ["New York city hall", "more or less", "as far as I know", "a\x01b c", "x\ty  z", "Über über naïve"]
    data = [(None, None), ("en", ""), ("und", "New York"), ("de", " \t ,.")]
    for i in range(500):
        words = [rng.choice(WORDS + fixed) + rng.choice(["", "", "", ",", "\n", "."]) for _ in range(rng.randrange(40))]
        data.append((["en", "de", None, "und", "fr "][min(i % 9, 4)], " ".join(words)))
    return data


WORDS = ["rain", "snow", "the", "of", "city", "know", "a", "b", "中文", "x"]


@pytest.mark.parametrize(("least", "longest", "top", "cuts", "held"), [(5, 5, 2000, 0, 4_000_000), (5, 5, 2000, 40, 50), (3, 4, 7, 400, 200), (8, 2, 50, 3, 1000), (100, 5, 2000, None, 4_000_000)])
def test_collocations(spark, talk, least, longest, top, cuts, held):
    """Streams with many cuts give what uncut ones give; beginnings are carried past cuts."""
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in talk], "lang string, text string, n long, words long").repartition(4)
    got = phrases.collocations(docs, top, least, longest, held, cuts)
    assert sorted(tuple(r) for r in got.collect()) == phrases_plain(talk, top, least, longest)


def test_collocations_of_long_products_and_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a b " * 1000), ("en", "c " * 5)], "lang string, text string")
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    big = 3 * 10**12
    row = {"lang": "en", "words": ["a", "b"], "f": big, "n": 10**15, "ends": [big], "extended": 0, "copy": False}
    assert phrases._score(row, [big])[6] == 1000 * 10**15 // big


def test_a_table_of_bits_with_wrong_ones_changes_nothing(spark, talk, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_BITS", 6)
    monkeypatch.setattr(phrases, "MAX_BITS", 6)
    docs = spark.createDataFrame(talk, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=5).collect()) == phrases_plain(talk, 2000, 5, 5)
