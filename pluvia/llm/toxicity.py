"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and stems that open words, that tell toxic
texts from others by a log-likelihood ratio. It forms a trie; the Levenshtein automaton of the
allowed distance (0 for short terms, 1 from five letters, 2 from nine) runs along its edges, and
the intersection is made deterministic as words are read, so that a word costs one table lookup
for each letter. Each hit is seen in its window, eight words to either side: it is quoted if the
nearest quotation mark before it opens and the nearest one after it closes (a mark between two
letters is an apostrophe and counts as none), or if one of the three words before it reports
speech; and it has company if another hit stands in the window. A logistic regression on the
counts of exact, stem, misspelled, quoted and accompanied hits gives the score.

The fit uses at most ``max_rows`` labelled rows of each label, those with the smallest hashes of
their ids; of documents with one id, one, and equal texts teach once. Every second row of each
label gives the lexicon, the others the weights; if a label has a single row, all rows serve
both. The lexicon holds every word and stem of three toxic texts or more whose log odds reach
``least_odds`` and whose log-likelihood ratio reaches one of ``ratios``: the one whose weights
predict left-out folds best (the smallest, if there are under 50 rows or under 5 of a label). ``reporting``,
the words that report speech, is a parameter. All texts are scored whole.

A null text is empty, has no hits and gets the intercept's score. Rows are scored one by one, so
repeated rows repeat their scores. Without labelled rows of both labels all scores are the
label's smoothed share. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.llm.common import fold, sample_rows, table, text_of

WORDS = re.compile(r"[^\W_]+(?:[@$!|*'][^\W_]+)*")
MARKS = re.compile("[\"'“”„«»‘’‚‹›]")
OPENING, CLOSING = "“„«‘‚‹", "”»’›"
#: Words that report what others said; what train() takes unless it is given others.
REPORTING = frozenset("said says quoted called wrote writes term word phrase sagte schrieb nannte dijo escribió llamó dit écrit appelé".split())
NEAR, SPEECH = 8, 3
#: Longer words are matched each time that they occur.
KEPT_CHARS = 64
STEMS = (4, 5, 6)
FEATURES = 9
#: A task's automaton starts anew when it has made so many states.
MOST_STATES = 50_000


class Lexicon:
    """A trie of terms with the automaton that accepts their misspellings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.allowed: list[int] = [0]
        self.reach: list[int] = [0]  # the largest distance that a term below a node allows
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for term, weight in terms.items():
                allow = 0 if ends is self.stem or len(term) < 5 else 1 if len(term) < 9 else 2
                at = 0
                self.reach[0] = max(self.reach[0], allow)
                for c in term:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.allowed.append(0)
                        self.reach.append(0)
                    at = self.children[at][c]
                    self.reach[at] = max(self.reach[at], allow)
                ends[at] = max(weight, ends[at] or 0.0)
                if ends is self.word:
                    self.allowed[at] = max(self.allowed[at], allow)
        self.alphabet = {c for d in self.children for c in d}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_of: list[float | None] = []
        self.word_of: list[tuple[int, float] | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, some: set[tuple[int, int]]) -> frozenset:
        """With what dropped letters reach; nothing beyond what a term below allows."""
        todo, out = list(some), set()
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or (node, e) in out:
                continue
            out.add((node, e))
            if e < self.reach[node]:
                todo += [(child, e + 1) for child in self.children[node].values()]
        best: dict[int, int] = {}
        for node, e in out:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _state(self, some: frozenset) -> int:
        if some not in self.states:
            self.states[some] = len(self.sets)
            self.sets.append(some)
            self.moves.append({})
            accepted = [(e, -w) for node, e in some if (w := self.word[node]) is not None and e <= self.allowed[node]]
            best = min(accepted, default=None)
            self.word_of.append((best[0], -best[1]) if best else None)
            self.stem_of.append(max((w for node, e in some if e == 0 and (w := self.stem[node]) is not None), default=None))
        return self.states[some]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e))
            if e < self.reach[node]:
                out.add((node, e + 1))
                out |= {(x, e + 1) for k, x in self.children[node].items() if k != c}
        to = self._state(self._closed(out))
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, float] | None:
        """(exact, stem or near; the term's weight), or None."""
        if len(self.sets) > MOST_STATES:
            self._begin()
        state, stem, alphabet = self.start, None, self.alphabet
        moves, sets = self.moves, self.sets
        for c in word:
            if c not in alphabet:
                c = ""
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if stem is None:
                stem = self.stem_of[state]
            if not sets[state]:
                break
        found = self.word_of[state]
        if found and found[0] == 0:
            return "exact", found[1]
        if stem is not None:
            return "stem", stem
        return ("near", found[1]) if found else None


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    reporting: frozenset = REPORTING
    constant: float | None = None


def side(text: str, at: int) -> int:
    """1 for a mark that opens a quotation, -1 for one that closes it, 0 for an apostrophe."""
    before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if before.isalnum() and after.isalnum():
        return 0
    if before.isalnum() != after.isalnum():
        return 1 if after.isalnum() else -1
    bare_before, bare_after = not before.strip(), not after.strip()
    if bare_before != bare_after:
        return 1 if bare_before else -1
    return (text[at] in OPENING) - (text[at] in CLOSING)


def _quoted(text: str, left: int, start: int, end: int, right: int) -> bool:
    last = next((s for m in reversed(list(MARKS.finditer(text, left, start))) if (s := side(text, m.start()))), 0)
    return last > 0 and next((s for m in MARKS.finditer(text, end, right) if (s := side(text, m.start()))), 0) < 0


def features(text: str, lexicon: Lexicon, known: dict, reporting: frozenset = REPORTING) -> list[float]:
    hits, n, last, low, recent = [], 0, None, text.lower(), deque(maxlen=NEAR)
    for n, m in enumerate(WORDS.finditer(low), 1):
        word = m[0]
        got = known.get(word, last)
        if got is last:
            got = lexicon.match(word) or 0
            if len(word) <= KEPT_CHARS:  # at most 400,000 of them
                if len(known) > 400_000:
                    known.clear()
                known[word] = got
        if got:
            left = recent[0].start() if recent else 0
            if len(recent) < NEAR:
                left = 0  # marks before the first word
            ahead = list(islice(WORDS.finditer(low, m.end()), NEAR))
            right = ahead[-1].end() if len(ahead) == NEAR else len(low)
            told = any(w[0] in reporting for w in list(recent)[-SPEECH:])
            hits.append((n, got, told or _quoted(low, max(0, left - 1), m.start(), m.end(), right + 1)))
        recent.append(m)
    counts, best, company = Counter(), 0.0, 0
    for k, (place, (kind, weight), quoted) in enumerate(hits):
        counts["quoted" if quoted else kind] += 1
        best = max(best, 0.0 if quoted else weight)
        company += any(abs(place - hits[j][0]) <= NEAR for j in (k - 1, k + 1) if 0 <= j < len(hits))
    open_hits = counts["exact"] + counts["stem"]
    return [1.0, math.log1p(counts["exact"]), math.log1p(counts["stem"]), math.log1p(counts["near"]), math.log1p(counts["quoted"]), best, math.log1p(company), min(1.0, 20 * open_hits / max(n, 1)), float(open_hits > 0)]


def _score_batch(texts: list[str], lexicon: Lexicon, known: dict, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = np.array([features(t, lexicon, known, model.reporting) for t in texts]).reshape(len(texts), FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def _term_counts(batches):
    """For each word and stem, the toxic and the other texts of this task that hold it."""
    counts: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(WORDS.findall(text.lower()))
            terms = {("word", w) for w in words if len(w) >= 3} | {("stem", w[:k]) for w in words for k in STEMS if len(w) > k}
            for t in terms:
                counts.setdefault(t, [0, 0])[label] += 1
    rows = [(k, t, n[1], n[0]) for (k, t), n in counts.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "term", "toxic", "other"])


def _document_counts(sample: DataFrame) -> DataFrame:
    counts = sample.mapInArrow(_term_counts, "kind string, term string, toxic long, other long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    return counts.where("toxic > 0")


def _chosen(top: list, least_ratio: float, reporting: frozenset) -> Model:
    """The lexicon of the terms that reach the ratio; a stem counts only if it opens more words than one."""
    some = [r for r in top if r["ratio"] >= least_ratio]
    opens: dict[str, int] = {}
    for r in some:
        if r["kind"] == "word":
            for k in STEMS:
                opens[r["term"][:k]] = max(opens.get(r["term"][:k], 0), r["toxic"])
    return Model({r["term"]: r["odds"] for r in some if r["kind"] == "word"}, {r["term"]: r["odds"] for r in some if r["kind"] == "stem" and r["toxic"] > 1.2 * opens.get(r["term"], 0)}, reporting=reporting)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    ridge, w = np.diag([0.01, *[0.3] * (x.shape[1] - 1)]), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
    return w


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 5) -> float:
    """Log loss of rows that a fit on the other folds scores."""
    fold_, total = np.arange(len(y)) % folds, 0.0
    for k in range(folds):
        out = fold_ == k
        z = np.clip(x[out] @ _logistic(x[~out], y[~out], weight[~out]), -30, 30)
        total += float((weight[out] * np.logaddexp(0, np.where(y[out] == 1, -z, z))).sum())
    return total


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_rows: int = 3000, ratios: tuple = (5.0, 8.0, 12.0, 20.0), least_odds: float = 1.5, reporting: frozenset = REPORTING) -> Model:
    """Fits on at most max_rows labelled rows of each label that keep admits (a Column on doc_id)."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = (rows.where(keep) if keep is not None else rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    share = rows.agg(F.avg("label"), F.count("*")).first()
    picked = sample_rows(rows.where("label = 1"), max_rows, "doc_id").unionByName(sample_rows(rows.where("label = 0"), max_rows, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # max_rows bounds what is broadcast
    found = found.groupBy("label", "x").agg(F.min("doc_id").alias("doc_id"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))  # over max_rows rows at most
    sample = found.select("doc_id", "label", F.col("x.text").alias("text"), (turn % 2).alias("half")).persist()
    sizes = {(h, y): n for h, y, n in sample.groupBy("half", "label").count().collect()}
    if len({y for _, y in sizes}) < 2:
        sample.unpersist()
        return Model(constant=float(((share[0] or 0) * share[1] + 1) / (share[1] + 2)))
    first, second = (sample.where("half = 1"), sample.where("half = 0")) if len(sizes) == 4 else (sample, sample)
    yes, no = (sizes.get((1, y), 0) + (sizes.get((0, y), 0) if len(sizes) < 4 else 0) for y in (1, 0))
    counts = _document_counts(first.select("text", "label"))
    odds = F.log((F.col("toxic") + 0.5) / (yes + 1)) - F.log((F.col("other") + 0.5) / (no + 1))
    # Dunning's ratio, for the toxic side only
    total = yes + no
    ratio = F.col("toxic") * F.log(F.col("toxic") * total / ((F.col("toxic") + F.col("other")) * F.lit(yes))) + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") * total / ((F.col("toxic") + F.col("other")) * F.lit(no)))).otherwise(0.0)
    top = counts.withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("toxic") >= 3) & (F.col("odds") > least_odds) & (F.col("ratio") >= min(ratios))).orderBy("term", "kind").collect()  # max_rows bounds the terms
    models = [_chosen(top, r, reporting) for r in ratios]

    def rest(batches):
        lexicons = [(Lexicon(m.words, m.stems), {}) for m in models]
        for batch in batches:
            x = [[features(t, lexicon, known, reporting) for lexicon, known in lexicons] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.list_(pa.float64())))], ["doc_id", "label", "x"])

    got = sorted((r["doc_id"], r["label"], r["x"]) for r in second.select("doc_id", "label", "text").mapInArrow(rest, "doc_id long, label int, x array<array<double>>").collect())
    sample.unpersist()
    xs, y = np.array([g[2] for g in got]), np.array([g[1] for g in got], float)
    # each label weighs as in all labelled rows
    weight = np.where(y == 1, share[0] / y.mean(), (1 - share[0]) / (1 - y.mean()))
    # of equal losses, the larger lexicon
    best = min(range(len(models)), key=lambda k: round(_loss(xs[:, k], y, weight), 9)) if len(y) >= 50 and 5 <= y.sum() <= len(y) - 5 else 0
    model = models[best]
    model.weights = _logistic(xs[:, best], y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of terms

    def run(batches):
        lexicon, known = Lexicon(given.value.words, given.value.stems), {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_score_batch(batch.column("text").to_pylist(), lexicon, known, given.value), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels, keep=~fold("doc_id", 4, 2))
    return score(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
