"""run() and each stage against plain versions on a small folder of tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pluvia.llm import quality, simhash
from pluvia.llm.common import fold
from tests.llm.test_operators import base_plain, mixed_plain, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    data, marks = [], []
    for i in range(260):
        text = prose(rng.randrange(5, 80), rng)
        if i % 5 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
            marks.append((i, 0, 0))
        elif i % 3:
            marks.append((i, 1, 0))
        if i % 13 == 0:
            text += f" password={'%x' % rng.getrandbits(60)} ok"
        data.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    item = prose(14, rng)
    data += [(300 + k, t, "en", "s1", len(t)) for k, (_, t, *_) in enumerate(data[:20])]
    data += [(400, "before " + item + " after", "en", "s2", 1), (None, prose(40, rng), None, None, None), (401, None, "en", "s0", None), (402, "", "en", "s0", 0)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_run_is_the_plain_pipeline(spark, folder):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"), keep=~fold("doc_id", 5, 0))
    rows = [tuple(r) for r in docs.collect()]
    texts = [(r[1] or "").encode() for r in rows]
    sizes = np.array([len(t) for t in texts])
    scores = quality.document_scores(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert 150 < len(rows) < 260
    fps = [simhash.fingerprint(r[1] or "") % (1 << 64) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    rows = [r for _, r in best.values()]
    rows = [r for r in rows if item not in (r[1] or "")]

    def redacted(t):
        for s, e, _ in reversed(base_plain(t or "")):
            t = t[:s] + "[REDACTED]" + t[e:]
        return t

    rows = [(r[0], redacted(r[1]), r[3]) for r in rows]
    total, target, size = mixed_plain(rows)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((g.doc_id, g["size"], g.source, g.source_size) for g in got) == Counter((i, size(t), s, total[s]) for i, t, s in rows)
    taken = Counter()
    for g in got:
        taken[g.source] += g.taken
        assert abs(g.target - target[g.source]) < 1e-6 and 0 <= g.taken <= 3 * g["size"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in target)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).count() == 0
        assert stage(spark, docs, path).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
