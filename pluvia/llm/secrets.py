"""Secret scan: base patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference: the labelled credentials of a kind form a prefix tree with counts; states
whose outgoing and ending frequencies agree within a Hoeffding bound, and whose successors
do too, are merged, first those of a depth and then those of different depths, which turns the
tree into a small probabilistic automaton that keeps places and lengths where a format has them
and has loops where it repeats. A string's probability is that of its symbols and of stopping after
them. Every candidate of a text is scored: each run of the credential alphabet (the base
patterns') that is at least as long as the shortest labelled credential, parted at ``=`` and
without ``.``, ``-`` and ``/`` at its ends. It counts if its log-likelihood ratio against
ordinary text is at least ``evidence`` nats, and, for each character, at least what all
but ``tail`` of the labelled credentials of the kind reach under an automaton that did not learn from them. Those
are added as spans of kind ``grammar``, unless base spans cover them whole.

The credentials to learn from are what the base patterns find in all documents: of each kind
the ``max_values`` different ones with the smallest hashes, of at most ``max_length``
characters (longer ones teach nothing; longer candidates are scored like all others). Ordinary
text is a model of neighbouring characters, counted over all runs of all documents. All texts
are scanned whole. Results do not depend on partitions or the order of rows.

A null text is empty; a text without finds has empty strings and zeros. Rows are scanned one
by one, so repeated rows repeat their results. An empty table gives no rows. With no
credential to learn from, only base spans are found; with few, their automaton is coarse, as
states of few visits merge. Very long runs take time in proportion to their length. Columns
other than doc_id and text are ignored by the scan, and kept by redact, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import table, text_of, written
from pluvia.llm.quality import arrow_texts

KINDS = ("assign", "access", "hex", "grammar")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The credential alphabet. In the model of ordinary text, 0 is whatever else stands around a run.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CLASSES = len(ALPHABET) + 1
CLASS = np.zeros(256, np.uint16)
CLASS[np.frombuffer(ALPHABET, np.uint8)] = np.arange(1, CLASSES)
#: Endings, and goings on, that each state is given beside its own; share of the uniform distribution in ordinary text.
SMOOTH, UNIFORM = 0.1, 0.05
PIECE = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if any(len(w) >= 24 for w in text.split()):  # a run of hex digits lies within a word
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Kinds of symbols: one that a state has not seen is as likely as its kind lets expect.
SORTS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_.=-")
SORT = {c: k for k, some in enumerate(SORTS) for c in some}
#: Shares of a symbol's probability that come from the symbol, from its kind, and from all symbols alike.
OWN, KIND, ANY = 0.6, 0.35, 0.05
#: Visits without which states of different depths stay apart.
SUPPORT = 10


class Automaton:
    """A probabilistic automaton: states with counts of symbols, of endings and of visits.

    Compatible states of the same depth are merged first, level by level, so that what stands at a
    place of all credentials is known well before places are compared; then states of different
    depths, which makes loops where a format repeats, and keeps lengths where it does not. Merged
    states' successors by the same symbol are merged too.
    """

    def __init__(self, values: list[str], alpha: float = 0.05, support: int = SUPPORT):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        depth = [0]
        for v in values:
            at = 0
            for c in v:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                    depth.append(depth[at] + 1)
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.parent = list(range(len(self.next)))
        self._merge_levels(depth)
        self._merge_depths(support)
        self._finish()

    def _of(self, q: int) -> int:
        """The state that q has been merged into."""
        while self.parent[q] != q:
            self.parent[q] = q = self.parent[self.parent[q]]
        return q

    def visits(self, q: int) -> int:
        return self.ends[q] + self.count[q].total()

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states, and what follows them, may share their probabilities."""
        todo, seen = [(a, b)], set()
        while todo:
            p, q = pair = tuple(map(self._of, todo.pop()))
            if p == q or pair in seen:
                continue
            seen.add(pair)
            n, m = self.visits(p), self.visits(q)
            far = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > far:
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p][c] / n - self.count[q][c] / m) > far:
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = map(self._of, todo.pop())
            if p == q:
                continue
            p, q = min(p, q), max(p, q)
            self.parent[q] = p
            self.ends[p] += self.ends[q]
            self.count[p].update(self.count[q])
            for c, after in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], after))
                else:
                    self.next[p][c] = after

    def _merge_levels(self, depth: list[int]) -> None:
        levels: dict[int, list[int]] = {}
        for q, d in enumerate(depth):
            levels.setdefault(d, []).append(q)
        for _, level in sorted(levels.items()):
            kept: list[int] = []
            for q in sorted({self._of(q) for q in level}, key=lambda q: (-self.visits(q), q)):  # the best supported first
                if (r := next((r for r in kept if self._alike(r, q)), None)) is None:
                    kept.append(q)
                else:
                    self._merge(r, q)

    def _merge_depths(self, support: int) -> None:
        for t in range(1, len(self.parent)):
            if self.parent[t] != t or self.visits(t) < support:
                continue
            for r in range(t):
                if self.parent[r] == r and self.visits(r) >= support and self._alike(r, t):
                    self._merge(r, t)
                    break

    def _finish(self) -> None:
        """Log shares: of each symbol with the state after it, of any other symbol, and of the end."""
        states = [q for q in range(len(self.parent)) if self.parent[q] == q]
        number = {q: i for i, q in enumerate(states)}
        self.states = []
        for q in states:
            n, m = self.visits(q), self.count[q].total()
            end = (self.ends[q] + SMOOTH) / (n + 2 * SMOOTH)
            sorts = Counter()
            for c, k in self.count[q].items():
                sorts[SORT.get(c)] += k
            # a symbol that the state lacks leads where most others do
            onward = number[self._of(self.next[q][max(self.count[q], key=lambda c: (self.count[q][c], c))])] if m else 0
            share = lambda c, q=q, m=m, sorts=sorts: ANY / len(SORT) + (OWN * self.count[q][c] / m + KIND * sorts[SORT[c]] / m / len(SORTS[SORT[c]]) if m else (OWN + KIND) / len(SORT))
            arcs = {c: (math.log((1 - end) * share(c)), number[self._of(self.next[q][c])] if c in self.next[q] else onward) for c in SORT}
            self.states.append((arcs, math.log((1 - end) * ANY / len(SORT)), math.log(end), onward))
        del self.next, self.count, self.ends, self.parent

    def log_likelihood(self, value: str) -> float:
        """Of the symbols and the end."""
        total, at = 0.0, 0
        for c in value:
            arcs, miss, _, onward = self.states[at]
            share, at = arcs.get(c, (miss, onward))
            total += share
        return total + self.states[at][2]


def pair_counts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each class of character follows each other one in the texts; what is around a text counts as no run."""
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        before = np.zeros(1, np.uint16)
        for at in range(s, s + n, PIECE):
            c = np.concatenate((before, CLASS[data[at : min(s + n, at + PIECE)]]))
            out += np.bincount(c[:-1] * np.uint16(CLASSES) + c[1:], minlength=len(out))
            before = c[-1:]
        out[int(before[0]) * CLASSES] += 1
    return out.reshape(CLASSES, CLASSES)


def _covered(start: int, end: int, base: list) -> bool:
    """Whether base spans, which come by start, leave nothing of a run."""
    for s, e, *_ in base:
        if s <= start < e:
            start = e
    return start >= end


class Grammar:
    """Automata by kind, the model of ordinary text, and the scores from which a candidate counts."""

    def __init__(self, values: dict[str, list[str]], pairs: np.ndarray, evidence: float = math.log(1e6), tail: float = 0.01):
        pairs = pairs.astype(float)
        pairs[0, 0] = 0  # runs only
        share = (pairs + 1 / CLASSES) / (pairs.sum(axis=1, keepdims=True) + 1)
        logs = np.log((1 - UNIFORM) * share + UNIFORM / CLASSES)
        names = ["", *ALPHABET.decode()]
        self.plain = {(a, b): float(logs[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)}
        self.evidence, self.known, self.kinds = evidence, {}, {}
        self.shortest = min((len(v) for some in values.values() for v in some), default=0)
        for kind, some in sorted(values.items()):
            if some:
                # each half is scored by what the other half teaches
                halves = (some[::2], some[1::2]) if len(some) > 1 else (some, some)
                scores = sorted(self._ratio(auto, v) / len(v) for auto, rest in ((Automaton(a), b) for a, b in (halves, halves[::-1])) for v in rest)
                self.kinds[kind] = (Automaton(some), scores[int(tail * len(scores))])
        self.runs = re.compile(r"[A-Za-z0-9+/_.-]{%d,}" % max(1, self.shortest))

    def _ratio(self, auto: Automaton, value: str) -> float:
        plain, before = self.plain, ""
        total = 0.0
        for c in value:
            total += plain[before, c]
            before = c
        return auto.log_likelihood(value) - total - plain[before, ""]

    def score(self, value: str) -> float:
        """By how many nats the best automaton's ratio exceeds what its kind asks for; negative for what is no credential."""
        return max((r - max(self.evidence, bound * len(value)) for r, bound in ((self._ratio(a, value), b) for a, b in self.kinds.values())), default=-math.inf)

    def _counts(self, value: str) -> bool:
        got = self.known.get(value)
        if got is None:
            got = self.score(value) >= 0
            if len(value) <= 64:  # words come again and again
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[value] = got
        return got

    def added(self, text: str, base: list) -> list[tuple[int, int, str, str]]:
        if not self.kinds:
            return []
        out = []
        for m in self.runs.finditer(text):
            value = m[0].strip(".-/")
            at = m.start() + m[0].find(value)
            if len(value) >= self.shortest and self._counts(value) and not _covered(at, at + len(value), base):
                out.append((at, at + len(value), "grammar", value))
        return out

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def spans_of(text: str, grammar: Grammar | None) -> list[tuple[int, int, str, str]]:
    base = base_spans(text)
    more = grammar.added(text, base) if grammar else []
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def _learn(batches, max_length):
    """Credentials of each batch, and at the end this task's counts of neighbouring characters: (kind, value, n)."""
    pairs = np.zeros((CLASSES, CLASSES), np.int64)
    for batch in batches:
        found = {(s[2], s[3]) for t in batch.column("text") for s in base_spans(t.as_py()) if len(s[3]) <= max_length}
        pairs += pair_counts(*arrow_texts(batch.column("text")))
        yield _counted([(k, v, 1) for k, v in found])
    yield _counted([("pair", str(i), int(pairs.flat[i])) for i in np.flatnonzero(pairs)])


def _counted(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "n"])


def infer(docs: DataFrame, max_values: int = 300, max_length: int = 256) -> Grammar:
    """Learns from max_values of each kind of what the base patterns find in all documents, and from all documents' runs."""
    found = docs.select(text_of().alias("text")).mapInArrow(lambda b: _learn(b, max_length), "kind string, value string, n long")
    found = written(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    values: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        picked = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(max_values).collect()
        values[kind] = sorted(r["value"] for r in picked)
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    for r in found.where("kind = 'pair'").collect():  # CLASSES squared rows at most
        pairs[int(r["value"])] = r["n"]
    return Grammar(values, pairs.reshape(CLASSES, CLASSES))


def scan(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """(doc_id, spans): array of (start, end, kind) for every whole text, in code points."""
    given = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by infer's limits

    def run(batches):
        for batch in batches:
            out = [[{"start": s, "end": e, "kind": k} for s, e, k, _ in spans_of(t.as_py(), given.value)] for t in batch.column("text")]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(docs: DataFrame, grammar: Grammar | None, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every credential span of its texts replaced by a mark; null texts stay null, all columns stay."""
    given = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(at):
                t = t.as_py()
                spans = spans_of(t, given.value) if t else []
                if spans:
                    parts, last = [], 0
                    for s, e, *_ in spans:
                        if e > last:
                            if s >= last:
                                parts += [t[last:s], mark]
                            last = e
                    t = "".join([*parts, t[last:]])
                out.append(t)
            columns = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, infer(docs))

    def joined(keep):
        return F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(lambda s: s["kind"] != "grammar"), 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"),
    )
