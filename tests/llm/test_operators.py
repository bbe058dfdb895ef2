"""Each operator against a plain version of itself, with nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import decontaminate, mixing, quality, repeats, secrets, simhash, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, spans string"
WORDS = ["the", "of", "rain", "Über", "naïve", "cloud", "map", "drift", "wind", "hour", "cell", "front", "gust", "中文", "echo"]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(11)
    prose = lambda n: globals()["prose"](n, rng)
    shared = prose(90)
    long = prose(30_000)
    texts = [None, "", " ", "one", prose(40), shared, shared, "x " + shared + " y", shared.upper(), "a" * 1000, "ab" * 700, long, long[:4000] + "!" + long[4000:], prose(300)]
    texts += ["password = 'hunter2hunter2' and AKIA" + "B2" * 10 + " " + "0f" * 16, "token:abc secret=tokens: longenough1 PASSWD:“x", "api_key=" + "Zq9" * 8]
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), 0.5, 7, "z") for i, t in enumerate(texts)]
    return out + [(5, shared, "en", "a", 1, None, None, None), (None, prose(50), None, None, None, None, None, None), (None, None, None, "a", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    data = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(14)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def base_plain(t):
    kinds = (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)")
    found = [(m.start(), m.end(), k) for k, (p, n) in enumerate(zip(kinds, (6, 20, 24), strict=True)) for m in re.finditer(p, t, re.ASCII) if len(m[1]) >= n]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_secret_spans(docs, empty):
    got = secrets.scan(docs, secrets.infer(docs)).collect()
    plain = Counter((r[0], tuple(base_plain(r[1] or ""))) for r in rows())
    assert Counter((r.doc_id, tuple((s.start, s.end, secrets.KINDS.index(s.kind)) for s in r.spans if s.kind != "grammar")) for r in got) == plain
    assert secrets.scan(empty, secrets.infer(empty)).count() == 0
    clean = secrets.redact(docs, None)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(base_plain(r.text or "") for r in clean.where("doc_id = 14").collect())


def ordinary(rng, n=2000, letters="etaoinshr"):
    """Counts of neighbouring characters in words of some letters, and some numbers."""
    text = " ".join(["".join(rng.choice(letters) for _ in range(7)) for _ in range(n)] + [str(rng.randrange(10**8)) for _ in range(n // 10)]).encode()
    return secrets.pair_counts(np.frombuffer(text, np.uint8), np.zeros(1, int), np.array([len(text)]))


def test_pair_counts_are_those_of_the_texts_runs(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 3)
    texts = ["", "ab", "a", "b a-b", "é=ab", "   ", "abcabcabc"]
    plain = Counter()
    for t in texts:
        for a, b in zip(" " + t, t + " ", strict=True):
            plain[a if a.encode() in secrets.ALPHABET else "", b if b.encode() in secrets.ALPHABET else ""] += 1
    raw = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in raw])
    got = secrets.pair_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    names = ["", *secrets.ALPHABET.decode()]
    mine = {(names[i], names[j]): int(got[i, j]) for i, j in zip(*np.nonzero(got), strict=True)}
    assert {k: n for k, n in mine.items() if k != ("", "")} == {k: n for k, n in plain.items() if k != ("", "") and n}


def plain_automaton(values, alpha, support):
    """Merged states as sets of prefixes, and the likelihoods that follow from them."""
    prefixes = list(dict.fromkeys(v[:i] for v in values for i in range(len(v) + 1)))
    state = {p: {p} for p in prefixes}  # prefixes that are one state share a set
    bound = np.sqrt(0.5 * np.log(2 / alpha))
    place = {p: i for i, p in enumerate(sorted(prefixes, key=lambda p: first_use(values, p)))}
    ends = lambda s: sum(v in s for v in values)
    goes = lambda s, c: sum(v[: len(p) + 1] == p + c for v in values for p in s)
    visits = lambda s: sum(v[: len(p)] == p for v in values for p in s)
    letters = sorted({c for v in values for c in v})
    after = lambda s, c: next((state[p + c] for p in s if p + c in state), None)

    def alike(a, b, seen):
        if a is b or (id(a), id(b)) in seen:
            return True
        seen.add((id(a), id(b)))
        n, m = visits(a), visits(b)
        far = bound * (n**-0.5 + m**-0.5)
        if abs(ends(a) / n - ends(b) / m) > far:
            return False
        return all(abs(goes(a, c) / n - goes(b, c) / m) <= far and (after(a, c) is None or after(b, c) is None or alike(after(a, c), after(b, c), seen)) for c in letters)

    def merge(a, b):
        if a is b:
            return
        a |= b
        for p in b:
            state[p] = a
        for c in letters:  # all that follows by one letter is one state
            follow = [state[p + c] for p in a if p + c in state]
            for x in follow[1:]:
                merge(follow[0], x)

    number = lambda s: min(place[p] for p in s)
    for d in range(max(map(len, prefixes)) + 1):
        kept = []
        for s in sorted({id(state[p]): state[p] for p in prefixes if len(p) == d}.values(), key=lambda s: (-visits(s), number(s))):
            if state[next(iter(s))] is s:
                same = next((r for r in kept if alike(r, s, set())), None)
                kept += [s] if same is None else []
                if same is not None:
                    merge(same, s)
    for p in sorted(prefixes, key=place.get)[1:]:
        s = state[p]
        if number(s) == place[p] and visits(s) >= support:
            for r in sorted({id(x): x for x in state.values()}.values(), key=number):
                if number(r) < place[p] and visits(r) >= support and alike(r, s, set()):
                    merge(*sorted((r, s), key=number))
                    break

    def likelihood(value):
        total, at = 0.0, state[""]
        for c in [*value, None]:
            n, m = visits(at), visits(at) - ends(at)
            end = (ends(at) + secrets.SMOOTH) / (n + 2 * secrets.SMOOTH)
            if c is None:
                return total + np.log(end)
            counts = {x: goes(at, x) for x in letters}
            sort = next((k for k in secrets.SORTS if c in k), None)
            share = secrets.ANY / 68
            if sort and m:
                share += secrets.OWN * counts.get(c, 0) / m + secrets.KIND * sum(k for x, k in counts.items() if x in sort) / m / len(sort)
            elif sort:
                share += (secrets.OWN + secrets.KIND) / 68
            total += np.log((1 - end) * share)
            at = after(at, c) or (after(at, max(counts, key=lambda x: (counts[x], x))) if m else state[""])

    return likelihood, len({id(s) for s in state.values()})


def first_use(values, prefix):
    """Where the prefix first comes up when the values are read one after the other."""
    return next((i, len(prefix)) for i, v in enumerate(values) if v.startswith(prefix))


def test_merged_states_are_those_of_a_plain_merge():
    rng = random.Random(13)
    for support in (1, 4, 10):
        for _ in range(4):
            values = ["k-" * rng.randrange(1, 3) + "".join(rng.choice("aB3") for _ in range(rng.randrange(2, 5))) + "z" * rng.randrange(3) for _ in range(25)]
            auto, (plain, states) = secrets.Automaton(values, alpha=0.3, support=support), plain_automaton(values, 0.3, support)
            assert len(auto.states) == states
            for v in [*values[:6], "", "q", "k-qaB", "zzzz", "k-é3"]:
                assert abs(auto.log_likelihood(v) - plain(v)) < 1e-9, (values, v)


def test_automata_keep_lengths_and_places():
    rng = random.Random(21)
    fixed = secrets.Automaton(["tok-" + "".join(rng.choice("0123456789abcdef") for _ in range(36)) for _ in range(130)])
    assert len(fixed.states) >= 41
    value = "tok-" + "0a1b2c" * 6
    gap = lambda v: fixed.log_likelihood(value) - fixed.log_likelihood(v)
    assert gap(value[:-1]) > 3 and gap(value + "0") > 6 and gap("0" + value[1:]) > 3 and gap("-kot" + value[4:]) > 10
    free = secrets.Automaton(["".join(rng.choice("0123456789abcdef") for _ in range(8 + int(rng.expovariate(0.1)))) for _ in range(300)])
    assert len(free.states) < 40  # where lengths are open, places become one state


def test_credentials_of_a_hidden_pattern_are_found():
    """Half of a kind's credentials teach; of the others, no base pattern tells, nearly all are found in running text, and nothing else is."""
    rng = random.Random(5)
    some = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    formats = {"hex": lambda: some(40, "0123456789abcdef"), "assign": lambda: "sk_" + some(24, letters + letters.upper() + "0123456789"), "access": lambda: "AKIA" + some(16, letters.upper() + "234567")}
    text = " ".join(some(rng.randrange(2, 30), "etaoinshrdlucm") for _ in range(3000)) + " " + " ".join(f"{some(8, letters)}.{some(7, letters)}@mail-{k}.example.org 4{rng.randrange(10**15):015d}" for k in range(300))
    raw = np.frombuffer(text.encode(), np.uint8)
    pairs = secrets.pair_counts(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    for kind, made in formats.items():
        values = [made() for _ in range(260)]
        grammar = secrets.Grammar({kind: values[:130]}, pairs)
        found = sum([s[3] for s in grammar.added(f"so {v} it", [])] == [v] for v in values[130:])
        assert found >= 0.95 * 130, (kind, found)
        assert grammar.added(text, []) == [], kind


def test_grammar_finds_credentials_of_a_learned_format_and_nothing_else():
    rng = random.Random(3)
    key = lambda: "sk-" + "".join(rng.choice("ABCDEF0123456789") for _ in range(32))
    short = lambda: "".join(rng.choice("QWXZJK") for _ in range(10))
    grammar = secrets.Grammar({"assign": [key() for _ in range(120)], "access": [short() for _ in range(60)]}, ordinary(rng))
    assert sum(secrets.spans_of(f"see {k}. There", grammar) == [(4, 4 + len(k), "grammar", k)] for k in (key() for _ in range(100))) >= 95
    found = [[s[3] for s in grammar.added(f"x={k}", [])] == [k] for k in (short() for _ in range(100))]
    assert sum(found) >= 90  # no digit in them, and they are short
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 20))) for _ in range(3000)] + [str(rng.randrange(10**k)) for k in range(1, 18) for _ in range(20)]
    assert grammar.added(" ".join([*words, "https4/nothing/to/find/here2 etaoinshretaoin1 2024-01-31"]), []) == []


def test_grammar_scores_runs_that_base_spans_cover_in_part():
    rng = random.Random(3)
    key = lambda: "sk-" + "".join(rng.choice("ABCDEF0123456789") for _ in range(8)) + "".join(rng.choice("abcdef0123456789") for _ in range(30))
    grammar = secrets.Grammar({"assign": [key() for _ in range(120)]}, ordinary(rng))
    secret = key()
    found = secrets.spans_of(f"see {secret} there", grammar)
    assert {"hex", "grammar"} == {s[2] for s in found}
    assert (4, 4 + len(secret)) in {s[:2] for s in found}
    text = f"token={secret}"
    assert [s[2] for s in secrets.spans_of(text, grammar) if s[2] == "grammar"] == []


def test_secrets_learn_every_kind_from_all_documents(spark):
    rng = random.Random(7)
    some = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    texts = [f"password={some(12, 'abcdefghjkmnpq23456789')}" for _ in range(5000)] + [f"key AKIA{some(16, 'ABCDEFGH2345')}" for _ in range(20)] + ["secret=" + "Z9" * 5_000_000, some(24, "0123456789abcdef")]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grammar = secrets.infer(data)
    assert set(grammar.kinds) == {"assign", "access", "hex"}
    got = secrets.scan(data.where("doc_id >= 5020"), grammar).collect()
    assert {(s.start, s.end, s.kind) for r in got for s in r.spans} >= {(0, 10_000_007, "assign"), (0, 24, "hex")}


def test_secret_grammar_does_not_depend_on_row_order(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 8) for _ in range(20)) + f" token={rng.getrandbits(60):x}") for i in range(300)]
    a, b = (secrets.infer(spark.createDataFrame(d, "doc_id long, text string").repartition(n), max_values=40) for d, n in ((data, 1), (data[::-1], 16)))
    assert a.plain == b.plain and {k: (x.states, y) for k, (x, y) in a.kinds.items()} == {k: (x.states, y) for k, (x, y) in b.kinds.items()}


def test_quality_scores_whole_texts(spark, docs, empty, labels):
    net = quality.train(docs, labels)
    got = quality.score(docs, net, "p").collect()
    assert len(got) == docs.count() and all(0 <= r.p <= 1 for r in got)
    same = [r.p for r in got if r.doc_id == 5]
    assert len(same) == 2 and abs(same[0] - same[1]) < 1e-5
    assert quality.score(empty, net, "p").count() == 0
    only = quality.train(docs, labels.where("quality = 1"))
    assert only.constant is not None and quality.train(docs, labels.limit(0)).constant == 0.5


def test_network_matches_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(6, 256, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32), rng.normal(size=(5, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(size=4).astype(np.float32), 0.1, np.array([0.5, 0.2, 0.3, -0.1]))
    texts = [b"", b"a", bytes(rng.integers(0, 256, 250).tolist()), bytes(rng.integers(0, 256, 1500).tolist()), b"q" * 256]

    def plain(t):
        n = (len(t) + 6) // 256 + 1
        data = t + bytes(n * 256 + 6 - len(t))
        pooled = np.array([np.max([sum(net.filters[k][data[s + k]] for k in range(6)) for s in range(b * 256, b * 256 + 256)], axis=0) for b in range(n)])
        chunks = np.array([np.maximum(pooled[i], pooled[i + 1]) for i in range(n - 1)] or [pooled[0]])
        z = np.maximum(np.maximum(chunks + net.bias, 0) @ net.hidden, 0) @ net.out + 0.1
        return 1 / (1 + np.exp(-(np.array([z.mean(), z.max(), z.min(), 1]) @ net.mix)))

    sizes = np.array([len(t) for t in texts])
    got = quality.document_scores(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)
    alone = [quality.document_scores(net, np.frombuffer(t, np.uint8), np.zeros(1, np.int64), np.array([len(t)]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-5)


def test_a_long_text_after_a_short_one_takes_no_more_memory_than_alone():
    import tracemalloc

    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(6, 256, 32)).astype(np.float32), np.zeros(32, np.float32), rng.normal(size=(32, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(size=4).astype(np.float32), 0.1, np.array([0.5, 0.2, 0.3, -0.1]))
    net.tables()
    long = rng.integers(0, 256, 8 << 20).astype(np.uint8)
    peaks, scores = [], []
    for sizes in ([8 << 20], [10, 8 << 20, 10]):
        data, sizes = np.concatenate([long[:s] for s in sizes]), np.array(sizes)
        tracemalloc.start()
        scores.append(quality.document_scores(net, data, np.cumsum(sizes) - sizes, sizes))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert scores[0][0] == scores[1][1]
    assert peaks[0] < 80 << 20 and peaks[1] < 1.2 * peaks[0]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").select("predicted", "quality").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) > 0.95 * len(got)


def test_quality_keeps_columns_of_its_own_names(spark, docs, labels):
    net = quality.train(docs, labels)
    odd = docs.withColumn("__quality", F.lit(1)).withColumn("__score_text", F.lit("x"))
    all_ = quality.score(odd, net)
    assert [*sorted(all_.columns)] == sorted(odd.columns) and all_.count() == docs.count()
    kept = quality.keep(odd, net, 0.4)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in all_.where("score >= 0.4").collect())


def test_token_counts_of_every_prefix(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, model).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows())
    assert tokens.count_tokens(empty, model).count() == 0
    counter, rng = tokens.PrefixCounter(model), random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\té中▁\x00<s>The ing") for _ in range(rng.randrange(25)))
        p, plain = counter.prefixes(t), [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert p.all() == plain and p.total == plain[-1]
        assert p.within(4) == max(i for i in range(len(t) + 1) if plain[i] <= 4)
    some = docs.where("doc_id IN (0, 1, 4, 13, 14, 15)").select("doc_id", "text")
    text = dict(some.collect())
    for r in tokens.count_tokens(some, model, limit=50, prefixes=True).collect():
        t = text[r.doc_id] or ""
        assert r.prefix_tokens[-1] == r.n_tokens and len(r.prefix_tokens) == len(t) + 1 and r.prefix_tokens[r.fit_chars] <= 50
        assert all(r.prefix_tokens[i] == len(sp.encode(t[:i])) for i in range(0, len(t), 37))


@pytest.mark.parametrize(("size", "seeds"), [(255, 60), (65_535, 2)])
def test_token_counts_of_segments_whose_counts_fall_again(size, seeds):
    """A long word's counts are kept in the width of the largest, which need not be the last."""
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    counter, fell = tokens.PrefixCounter(model), 0
    for seed in range(seeds):
        rng = random.Random(seed)
        letters = "".join(rng.choice("etaoinshrdluABCü中文9") for _ in range(8 * size))
        p = counter.prefixes(letters)
        plain = p.all()
        for total in range(size - 5, size + 6):  # words that end with about so many tokens, and where the count falls next
            end = plain.index(total)
            ends = [end, *(i for i in range(end, end + 400) if plain[i] < plain[i - 1])][:3]
            for i in ends if size < 1000 else ends[-1:]:
                word = counter.prefixes(letters[:i])
                counts = word.all()
                fell += max(counts) > counts[-1]
                assert word.total == counts[-1] == plain[i] and counts == plain[: i + 1]
                if size < 1000 or total == size:
                    assert word.total == len(sp.encode(letters[:i]))
    assert fell


def test_a_prefix_is_computed_once(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    counter, calls = tokens.PrefixCounter(public.path("piece_bpe_32k.model")), Counter()
    plain = counter.prefix_counts
    monkeypatch.setattr(counter, "prefix_counts", lambda s: calls.update([s]) or plain(s))
    for text in ("the rain the rain the rain " * 40, "x" * 3000 + " rain"):
        p = counter.prefixes(text)
        assert p.within(10) < p.within(100) and p.total > 100
    assert max(calls.values()) == 1


def test_levenshtein_automaton():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
            d = new
        return d[-1]

    terms = {"cat": 1.0, "idiot": 2.0, "worthless": 3.0, "idiots": 1.5}
    lexicon, rng = toxicity.Lexicon(terms, {"vequ": 1.0}), random.Random(8)
    for _ in range(3000):
        word = list(rng.choice([*terms, "other", "veq"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = [rng.choice("idotshwrz")] * rng.randrange(2)
        word = "".join(word)
        allowed = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
        near = [distance(word, t) for t in terms if distance(word, t) <= allowed[t]]
        kind = (lexicon.match(word) or (None,))[0]
        assert kind == ("exact" if 0 in near else "stem" if word.startswith("vequ") else "near" if near else None), word


def test_long_words_are_not_kept():
    lexicon, known = toxicity.Lexicon({"scoundrel": 2.0}, {}), {}
    toxicity.features("a scoundrel " + " ".join(f"{k}" + "x" * 100_000 for k in range(20)), lexicon, known)
    assert "scoundrel" in known and max(map(len, known)) <= toxicity.KEPT_CHARS


def test_quotation_marks_and_apostrophes():
    lexicon = toxicity.Lexicon({"scoundrel": 2.0}, {})
    kind = lambda t: next(k for k, i in (("exact", 1), ("near", 3), ("quoted", 4)) if toxicity.features(t, lexicon, {})[i] > 0)
    assert kind("we don’t like it you scoundrel isn’t it") == kind("we do not like it you scoundrel is not it") == "exact"
    assert kind("we don't like it, you scoundrel, don't we") == "exact"
    for t in ('he cried "you scoundrel!" and left', "«scoundrel»", "« scoundrel »", "„du scoundrel“, rief er", "»scoundrel«", "‘scoundrel’ is a word", "the word scoundrel", "she wrote that scoundrel"):
        assert kind(t) == "quoted", t
    for t in ('"good" you scoundrel "bye"', '"a b c d e f g h i scoundrel b c"', "a word of no use scoundrel", '"scoundrel'):
        assert kind(t) == "exact", t


def plain_features(text, words, stems, reporting):
    low = text.lower()
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:[@$!|*'][^\W_]+)*", low)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, before = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(d[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return d[-1]

    def kind(w):
        if w in words:
            return "exact", words[w]
        if heads := [s for k, s in stems.items() if w.startswith(k)]:
            return "stem", heads[0]
        near = sorted((d, -x) for t, x in words.items() if (d := distance(w, t)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2))
        return ("near", -near[0][1]) if near else None

    def mark(i):
        b, a = low[i - 1] if i else " ", low[i + 1] if i + 1 < len(low) else " "
        if b.isalnum() and a.isalnum():
            return 0
        if b.isalnum() or a.isalnum():
            return 1 if a.isalnum() else -1
        if b.isspace() != a.isspace():
            return 1 if b.isspace() else -1
        return (low[i] in "“„«‘‚‹") - (low[i] in "”»’›")

    hits = [(i, k) for i, (s, e) in enumerate(tokens) if (k := kind(low[s:e]))]
    n = Counter()
    best = 0.0
    for i, (name, weight) in hits:
        s, e = tokens[i]
        left = max(0, tokens[i - 8][0] - 1) if i >= 8 else 0
        right = tokens[i + 8][1] + 1 if i + 8 < len(tokens) else len(low)
        sides = lambda at: [x for j in at if low[j] in "\"'“”„«»‘’‚‹›" and (x := mark(j))]
        before, after = sides(range(left, s)), sides(range(e, min(right, len(low))))
        quoted = (before[-1:] == [1] and after[:1] == [-1]) or any(low[x:y] in reporting for x, y in tokens[max(0, i - 3) : i])
        n["quoted" if quoted else name] += 1
        best = max(best, 0.0 if quoted else weight)
        n["company"] += any(0 < abs(i - j) <= 8 for j, _ in hits)
    open_ = n["exact"] + n["stem"]
    return [1.0, np.log1p(n["exact"]), np.log1p(n["stem"]), np.log1p(n["near"]), np.log1p(n["quoted"]), best, np.log1p(n["company"]), min(1.0, 20 * open_ / max(1, len(tokens))), float(open_ > 0)]


def test_toxicity_features_are_those_of_a_plain_version(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_STATES", 30)
    rng = random.Random(17)
    words, stems = {"scoundrel": 2.0, "idiot": 1.5, "bad": 1.0}, {"vequ": 1.2}
    lexicon, known = toxicity.Lexicon(words, stems), {}
    parts = ["scoundrel", "scoundrl", "Idiot", "idoit", "bad", "bed", "vequous", "rain", "the", "don’t", "said", '"', "“", "”", "« ", " »", "‘", "’", "'", ", ", ".", " ", " ", " ", " ", "(", ")"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + " " * rng.randrange(2) for _ in range(rng.randrange(60)))
        assert np.allclose(toxicity.features(text, lexicon, known), plain_features(text, words, stems, toxicity.REPORTING)), text


def test_toxicity_with_few_rows_of_a_label(spark):
    data = [(i, "you scoundrel go" if i < 4 else "the rain falls") for i in range(40)]
    some = spark.createDataFrame(data, "doc_id long, text string")
    for n in (1, 2, 3):
        marks = spark.createDataFrame([(i, int(i < n)) for i in range(40) if i < n or i >= 4], "doc_id long, toxic int")
        assert toxicity.train(some, marks).constant is None
    assert toxicity.train(some, spark.createDataFrame([(5, 0), (6, 0), (900, 1)], "doc_id long, toxic int")).constant is not None


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in got) > 0.97 * len(got)
    assert sum(r.predicted for r in got if r.toxic) > 0.9 * sum(r.toxic for r in got)


def test_toxicity(spark, docs, empty, labels):
    rng = random.Random(1)
    data = [(i, prose(30, rng) + (" scoundrel " if i % 2 else " ") + prose(5, rng)) for i in range(400)]
    some = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 400)], "doc_id long, toxic int")
    model = toxicity.train(some, marks)
    assert "scoundrel" in model.words
    mine = spark.createDataFrame([(1, "you scoundrel go " + prose(20, rng)), (2, prose(25, rng)), (3, None), (4, "you scoundrl go " + prose(20, rng))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(mine, model).collect()}
    assert got[1] > 0.5 > 0.3 > got[2] and got[3] < 0.3
    assert toxicity.Lexicon(model.words, model.stems).match("scoundrl")[0] == "near"
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_lexicon_is_the_same_for_any_partitioning(spark):
    rng = random.Random(5)
    common = [f"common{chr(97 + i)}word" for i in range(20)]
    data = [(i, " ".join([prose(10, rng), *(w for w in common if rng.random() < 0.04), *["scoundrel"] * (i % 2)])) for i in range(800)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, toxic int")
    one, many = (toxicity.train(spark.createDataFrame(data, "doc_id long, text string").repartition(n), marks) for n in (1, 200))
    assert "scoundrel" in one.words
    assert (one.words, one.stems) == (many.words, many.stems)


ITEMS = [(0, "rain cloud map"), (1, None), (2, ""), (3, "The MAP"), (None, "gust"), (10, "the rain"), (4, "the rain")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, empty, block_bytes):
    long = (rows()[13][1] or "").split()
    items = [*ITEMS, (7, " ".join(long[20:45])), (8, " ".join(long[40:49]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def plain(t):
        words, hit, ids = split(t), set(), set()
        for i, text in items:
            w = split(text)
            m = min(10, len(w))
            for s in range(len(w) - m + 1) if w else ():
                for k in range(len(words) - m + 1):
                    if words[k : k + m] == w[s : s + m]:
                        hit |= set(range(k, k + m))
                        ids |= {str(i)} if i is not None else set()
        return len(words), len(hit), tuple(sorted(ids))

    small = docs.where("doc_id IS NULL OR doc_id NOT IN (11, 12)")
    got = decontaminate.hits(decontaminate.search(small, bench, block_bytes=block_bytes)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got) == Counter((r[0], *plain(r[1])) for r in rows() if r[0] not in (11, 12))
    kept = decontaminate.clean(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect() if r.doc_id not in (11, 12)) == Counter(r[0] for r in rows() if r[0] not in (11, 12) and not plain(r[1])[1])
    assert decontaminate.search(empty, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_of_items_that_repeat(spark):
    """Equal items are one, so their number makes no block larger; blocks hold their bound."""
    same = spark.range(200_000).select(F.lit("7").alias("item_id"), F.lit("some words " * 8).alias("text"))
    more = spark.range(3000).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("other words "), F.col("id")).alias("text"))
    blocks = list(decontaminate.item_blocks(same.unionByName(more), 20_000))
    assert len(blocks) > 3 and max(sum(len(t) + 16 for _, t in b) for b in blocks) <= 20_000 + 104
    assert sum(map(len, blocks)) == 3001
    docs = spark.createDataFrame([(1, "here some words " + "some words " * 9), (2, "other words 12"), (3, "x")], "doc_id long, text string")
    got = decontaminate.hits(decontaminate.search(docs, same.unionByName(more), block_bytes=20_000)).collect()
    assert {(r.doc_id, tuple(r["items"]), r.n_hit) for r in got} == {(1, ("7",), 20), (2, ("12",), 3), (3, (), 0)}


def test_decontamination_tables_stay_small():
    import tracemalloc

    rng = random.Random(2)
    items = [(str(i), " ".join(f"w{rng.randrange(30_000)}" for _ in range(300))) for i in range(1500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    matcher = decontaminate.Matcher(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * size  # 320 MB for a block of 8 MB
    words = decontaminate.words_of("some words then " + " ".join(items[7][1].split()[5:30]) + " and more")
    assert matcher.find(words) == ([(3, 28)], {7})


@pytest.mark.parametrize("block", [64, 8192])
def test_topk(spark, block):
    rng = random.Random(6)
    data = [(i, [rng.choice([-0.5, 0.0, 0.013, 0.5, 2.0]) for _ in range(6)], 0) for i in range(300)]
    data += [(300, None, 1), (301, [1.0, None], 1), (302, [1.0, float("nan")], 1), (303, [float("inf")], 1), (None, [1.0], 1), (100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (304, [], 2), (350, [2.0], 2)]
    data += [(400 + i, [1e12 + i, -3e11], 3) for i in range(4)] + [(450, [-1e13, 1.0], 3), (451, [1e305], 3), (452, [1e307], 3), (500, [-1e300], 3)]
    some = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>, block int").repartition(3))
    got = topk.search(some, F.col("vec_id") % 50 == 0, block=block, queries=2).collect()
    clean = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in data if v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    shown = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    lists = []
    for at, (q, own) in enumerate(clean):
        if q is not None and q % 50 == 0:
            best = sorted(((-score(own, v), i is None, i) for k, (i, v) in enumerate(clean) if k != at), key=lambda x: (*x[:2], x[2] or 0))[:5]
            lists += [(q, rank, i, shown(-s)) for rank, (s, _, i) in enumerate(best, 1)]
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == Counter(lists)
    assert sum(r.query_id == 100 and r.rank == 1 for r in got) == 3 and sum(r.beyond is not None for r in got) > 5
    assert topk.search(some.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_more_rows_than_an_arrow_batch(spark):
    """A block holds rows of several batches; its query meets all of them."""
    rows = spark.range(20_500, numPartitions=1).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    got = topk.search(topk.quantised(rows), F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(k, 20_500 - k, 65536 * (20_500 - k) + 65536) for k in range(1, 6)]


def test_topk_blocks_hold_their_bytes(spark):
    """A wide vector among narrow ones, and many middling ones, make no block larger than its bound."""
    data = [(i, [1.0] * 8) for i in range(999)] + [(1000, [2.0] * 50_000), (None, [9.0] * 8)] + [(2000 + i, [0.5] * 3000) for i in range(60)]
    some = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2)).withColumn("asked", F.lit(True))
    blocks = topk.packed(some, 8192, 1 << 20).select("n", "width", F.length("weights").alias("bytes")).collect()
    assert sum(b.n for b in blocks) == len(data) and all(b.bytes <= 1 << 20 or b.n == 1 for b in blocks) and len(blocks) < 20
    got = topk.search(some.drop("asked"), F.col("vec_id") == 1000).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == sorted((k, 2000 + k - 1, 512 * 128 * 3000) for k in range(1, 6))
    tied = topk.search(some.drop("asked").where("vec_id < 4 OR vec_id IS NULL"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in tied] == [None, 1, 2, 3]


def mixed_plain(data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in data:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(total.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s] or not total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(3 * total[s])
            left -= target[s]
        open_ -= over
    return total, target, size


def test_mixing(spark, docs, empty):
    data = [(r[0], r[1], r[3]) for r in rows()] + [(100 + i, prose(i % 9, random.Random(i)), "big") for i in range(200)] + [(400, "few words", "tiny"), (401, None, "none")]
    some = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, key int").repartition(4)
    total, target, size = mixed_plain(data)
    sizes = mixing.sized(some).persist()
    got = mixing.mix(sizes).collect()
    assert len(got) == len(data)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == total[r.source] and 0 <= r.taken <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in target)
    again = Counter(map(tuple, mixing.mix(mixing.sized(some.repartition(2)).persist()).collect()))
    assert again == Counter(map(tuple, got))
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_mixing_of_rows_that_repeat_whole(spark):
    """Each copy has a place of its own, though they are counted before they meet."""
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source")).repartition(8)
    few = spark.createDataFrame([(1, "one", "b"), (2, "a b c", "b"), (2, "a b c", "b")], "doc_id long, text string, source string")
    docs = same.unionByName(few)
    sizes = mixing.sized(docs).persist()
    got = mixing.mix(sizes)
    taken = {r.source: (r.n, r.taken, r.target) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert taken["a"][:2] == (100_000, int(taken["a"][2])) and taken["b"] == (3, 21, 21.0)
    part = F.substring("key", 1, mixing.RANGE_DIGITS)
    counted = sizes.groupBy("source", part, "key", "doc_id", "size", F.spark_partition_id()).count()
    assert counted.where("source = 'a'").count() <= 8


def test_warc_round_trip(spark):
    data = [(i, f"http://x/{i}\n", "<p>" + "ab" * (i % 5) + "</p>", 1) for i in range(60)] + [(60, None, None, 1), (61, "u", "", 1), (5, "http://x/5", "<p></p>", 1), (None, "n", "<p>abab</p>", 1), (None, "n", "alone", 1), (62, "l", "é" * 50_000, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, size int").repartition(3)
    import tempfile

    folder = "file://" + tempfile.mkdtemp()
    manifest = warc.write(pages, folder, roll=2000)
    assert manifest.count() > 3 and not [f for f in manifest.select("final").collect() if "temporary" in f[0]]
    last = {}
    for i, _, h, _ in data:
        last[h or ""] = max(i if i is not None else -1, last.get(h or "", -1))
    expected = Counter()
    for i, _, h, _ in data:
        h = h or ""
        revisit = last[h] >= 0 and i != last[h]
        expected[i, len(h.encode()), warc.sha1(h.encode()), "revisit" if revisit else "response", last[h] if revisit else None] += 1
    got = warc.read(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert all(bytes(r.payload).decode() in last for r in got if r.record_type == "response")
    folder = "file://" + tempfile.mkdtemp()
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


def test_warc_keeps_rows_that_repeat(spark):
    import tempfile

    data = [(7, "u", "same")] * 6 + [(None, None, None)] * 5 + [(8, "v", "same")]
    folder = "file://" + tempfile.mkdtemp()
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string").repartition(2), folder, roll=1)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect())
    assert got == {(7, "revisit", 8): 6, (8, "response", None): 1, (None, "response", None): 5}


def test_warc_files_depend_on_the_rows_alone(spark):
    import tempfile

    data = [(i * 37 % 1000 if i % 50 else None, f"u{i}", "body %d" % (i % 300)) for i in range(900)]
    names = []
    for n, parts in ((1, 2), (7, 5)):
        folder = "file://" + tempfile.mkdtemp()
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made = warc.write(spark.createDataFrame(data, "page_id long, url string, html string").repartition(n), folder, roll=5000, shard_pages=40)
        names.append(sorted((r.final.rsplit("/", 1)[1], r.records, r.bytes) for r in made.collect()))
        assert warc.read(spark, folder).count() == 900
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert names[0] == names[1] and len({n[:11] for n, *_ in names[0]}) > 5


def test_warc_shards_are_looked_up_by_key(spark):
    """The numbers are those of counting bounds, and no row carries the bounds."""
    rng = random.Random(5)
    keys = [(rng.choice([None, -3, 0, 2**60, 2**60 + 1, *range(40)]), bytes(rng.randrange(256) for _ in range(2))) for _ in range(400)]
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    begins = sorted(set(rng.sample(keys, 60)), key=order)
    made = warc.with_shard(spark.createDataFrame(keys, "page_id long, digest binary"), begins)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and made.columns == ["page_id", "digest", "shard"]
    assert all(r.shard == sum(order(b) <= order((r.page_id, bytes(r.digest))) for b in begins) for r in made.collect())
    assert {r.shard for r in warc.with_shard(made.drop("shard"), []).collect()} == {0}


def test_simhash(spark, docs, empty):
    import xxhash

    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for r in rows()[:11]:
        assert simhash.fingerprint(r[1] or "") % (1 << 64) == plain(r[1])
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {0} | {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for s in seeds for _ in range(25)}
    fps = [f % (1 << 64) for f in fps]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)] + [(9999, signed(fps[0]))], "row long, fp long")
    for block in (2048, 16):
        edges = simhash.components(simhash.links(table.select("fp").distinct(), block=block)).collect()
        root = {e.node: e.root for e in edges}
        groups = {}
        for f in fps:
            groups.setdefault(root.get(signed(f), signed(f)), set()).add(f)
        expected = {}
        for f in fps:
            expected.setdefault(find(f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    odd = docs.withColumn("__row", F.lit(1)).withColumn("root", F.lit("r"))
    assert simhash.keep_one(odd).columns == odd.columns
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and 6 not in ids and ids[0] == 1 and 1 not in ids and ids[None] == 1
    assert simhash.keep_one(empty).count() == 0


def test_fingerprints_of_long_texts_are_made_piece_by_piece(monkeypatch):
    texts = [prose(400, random.Random(i)) for i in range(5)] + ["  a b\tc \n d", "a b c", " ", "x" * 300 + " y z w v"]
    whole = [simhash.fingerprint(t) for t in texts]
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t) for t in texts] == whole


def test_near_duplicate_classes(spark, monkeypatch):
    from pluvia.llm import common

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = [(i, b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i, b in enumerate(base * 8)] + [(1000 + i, base[0]) for i in range(300)] + [(5, 0), (5, 0), (None, 0), (None, (1 << 62) - 1)]
    rows = spark.createDataFrame([(d, k, f) for k, (d, f) in enumerate(prints)], "doc_id long, row long, fp long")
    group = list(range(len(prints)))
    for i, (_, f) in enumerate(prints):
        for j in range(i):
            if (f ^ prints[j][1]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(prints, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    for share in (1000, 100_000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = simhash.classes(rows).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", least.get(g)) for (d, f), g in zip(prints, group, strict=True))


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeats(spark, docs, empty, hot):
    got = repeats.remove_repeats(docs, hot=hot).collect()
    texts = [(r[1] or "").encode() for r in rows()]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))

    def plain(t):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        return len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()

    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r[0], *plain((r[1] or "").encode())) for r in rows())
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_survive_colliding_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 260).tolist()) for _ in range(6)]
    texts[3] = texts[0][:230] + texts[3][230:]
    monkeypatch.setattr(repeats, "_powers", lambda n, seed: (np.zeros(256, np.uint64), np.ones(n, np.uint64), np.ones(n, np.uint64)))
    n = np.full(6, 61)
    runs = repeats.repeated_windows(repeats.Hasher(4000), np.zeros(6, int), np.ones(6, int), n, n - 1, texts)
    count = Counter(t[i : i + 200] for t in texts for i in range(61))
    repeated = [{i for i in range(61) if count[t[i : i + 200]] > 1} for t in texts]
    assert len(repeated[0]) > 30 and [{i for a, b in r for i in range(a, b + 1)} for r in runs] == repeated


def test_periodic_texts_give_few_rows():
    import pyarrow as pa

    for text, most in (("a" * 600_000, 20), ("abc" * 200_000, 30), ("x" * 300 + "y" * 300, 250)):
        batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([text])], ["row", "text"])
        got = pa.Table.from_batches(repeats._segments([batch], repeats.SEED)).to_pylist()
        assert len(got) <= most and sum(r["n"] for r in got) > 1
        assert len(text) < 1000 or sum(r["windows"] for r in got if r["n"] == 0) >= len(text) - 300


def test_names_that_clash_are_told_and_equal_rows_are_one():
    import pyarrow as pa

    a, b = b"a" * 100 + b"b" * 120, b"c" * 220
    rows = [(1, 5, 1, 21, 60, a), (1, 5, 2, 21, 60, a), (1, 5, 1, 21, 60, b), (2, 5, 1, 21, 60, b)]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), repeats.CUT_KINDS, strict=True)]
    got = pa.Table.from_batches(repeats._sorted_groups([pa.RecordBatch.from_arrays(columns, repeats._names(repeats.CUT))])).to_pylist()
    assert [(r["anchor"], r["clash"], [(x["a"], x["b"]) for x in r["runs"]]) for r in got] == [(1, False, [(0, 20)]), (1, True, []), (2, False, [])]


def test_repeats_of_a_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    texts = [long, long[300_000:301_000], "q" * 1_000_000, long[5:180] + "!" + long[400_000:400_220]]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(4)] == [(700_000, 1220, 2), (1000, 1000, 1), (1_000_000, 1_000_000, 1), (396, 220, 1)]
