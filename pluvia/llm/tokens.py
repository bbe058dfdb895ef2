"""Token counts by prefix dynamic programming.

For a BPE vocabulary, the last token of a prefix's encoding is the one token that ends
there and stands next to the last token of the shorter prefix in the encoding of the two
alone. Going through a text from left to right, each prefix therefore needs one look at
the tokens that end in it, and its count is the shorter prefix's plus one. The counts of
all prefixes answer how many tokens a text has, where a budget ends and what a cut costs,
without encoding anything again.

No token crosses the start of a run of word marks, nor a character that no piece holds, so
a text falls into segments whose counts add up. A text's prefix counts are its segments'
arrays of counts, one after another, each with the count that stands before it; all answers
about the text come from them, and nothing is computed twice: segments of up to ``SHORT``
characters are kept for the task (``max_segments`` of them at most), longer ones for the text.

A null text is empty and has no tokens; empty texts have none. Very long segments take
time in proportion to their length, and one to four bytes for each character. Repeated rows are counted one by one. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import table, text_of

MARK = "▁"
HEAD = 7
SHORT = 64


class PrefixCounter:
    """Counts for one BPE model with byte fallback and the identity as its normalizer."""

    def __init__(self, model: str, max_segments: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank) or sp.normalize("ﬁ \n") != f"{MARK}ﬁ{MARK}\n":
            raise ValueError("the model's pieces cross words, or it changes texts before encoding")
        self.endings = {p[i:] for p in self.rank for i in range(len(p))}  # what may stand before a prefix's end
        chars = set("".join(self.rank))
        apart = "".join(c for c in "\n\t\r" if c not in chars)
        self.segments = re.compile(f"[{apart}]|{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" if apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.max_segments = max_segments
        self.kept: dict[str, bytes | array] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.built: dict[str, tuple | None] = {}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}

    def encode(self, text: str) -> list[str]:
        """Merges the best ranked pair, leftmost first, until none is left. For short texts only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: str):
        """The two tokens whose merge gives this one last, (None, None) for a character, None if its own encoding is another one.

        Third, whether all merges on the way to it have rising ranks, so that ranks tell their order.
        """
        if token not in self.built:
            parts, rank, before = list(token), self.rank, None
            while len(parts) > 1:
                best, at = min((rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
                if best == float("inf"):
                    break
                before = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) > 1:
                self.built[token] = None
            elif before is None:
                self.built[token] = None, None, True
            else:
                inner = [self.halves(x) for x in before]
                rising = all(x and x[2] for x in inner) and all(len(x) == 1 or rank[x] < rank[token] for x in before)
                self.built[token] = *before, rising
        return self.built[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether the encoding of left and right together is the two of them: no merge across their border comes first.

        Undoes the merges of both tokens from the last one back; what then meets at the border must
        not have a merge that ranks before the one undone (a merge further left goes first on ties).
        """
        a = self.halves(left) if left else (None, None, True)
        b = self.halves(right)
        if a is None or b is None:
            return False
        if not left:
            return True
        if not (a[2] and b[2]):
            return self.encode(left + right) == [left, right]
        rank, limit = self.rank, float("inf")
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            ra, rb = rank[left] if a[0] else -1.0, rank[right] if b[0] else -1.0
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, left = ra, a[1]
                a = self.halves(left)
            else:
                limit, right = rb + 0.5, b[0]
                b = self.halves(right)

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of segment[:i] for i from 1 to its length."""
        if len(segment) > HEAD:  # many segments begin alike: their first prefixes are known
            if (known := self.heads.get(segment[:HEAD])) is None:
                if len(self.heads) >= self.max_segments // 4:
                    self.heads.clear()
                known = self.heads[segment[:HEAD]] = self._extend(segment[:HEAD], [0], [""])
            return self._extend(segment, [*known[0]], [*known[1]])[0][1:]
        return self._extend(segment, [0], [""])[0][1:]

    def _extend(self, segment: str, counts: list[int], last: list[str]) -> tuple[list[int], list[str]]:
        """Goes on from the prefixes in counts and last, the token that ends each."""
        rank, endings, pairs = self.rank, self.endings, self.pairs
        for end in range(len(counts), len(segment) + 1):
            begin = end - 1
            token = segment[begin]
            if token not in rank:  # falls back to its bytes, which merge with nothing
                counts.append(counts[-1] + len(token.encode()))
                last.append("")
                continue
            found = [(begin, token)]
            while begin:
                begin -= 1
                token = segment[begin:end]
                if token not in endings:
                    break
                if token in rank:
                    found.append((begin, token))
            for begin, token in reversed(found):
                fit = pairs.get((last[begin], token))
                if fit is None:
                    if len(pairs) >= 2 * self.max_segments:
                        pairs.clear()
                    fit = pairs[last[begin], token] = self.fits(last[begin], token)
                if fit:
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    break
            else:
                raise AssertionError(f"no token ends prefix {end} of {segment!r}")
        return counts, last

    def counts(self, segment: str) -> bytes | array:
        """The segment's prefix counts as an array; small ones are bytes."""
        got = self.kept.get(segment)
        if got is None:
            plain = self.prefix_counts(segment)
            most = max(plain)  # not the last count: counts may fall again
            got = bytes(plain) if most < 1 << 8 else array("H" if most < 1 << 16 else "I", plain)
            if len(segment) <= SHORT:
                if len(self.kept) >= self.max_segments:
                    self.kept.clear()
                self.kept[segment] = got
        return got

    def split(self, text: str) -> list[str]:
        return self.segments((MARK + text).replace(" ", MARK)) if text else []

    def prefixes(self, text: str) -> Prefixes:
        known, counts = self.kept.get, self.counts
        return Prefixes([known(s) or counts(s) for s in self.split(text)])


class Prefixes:
    """The token counts of all prefixes of a text: its segments' arrays and the count before each."""

    def __init__(self, arrays: list[bytes | array]):
        self.arrays = arrays
        self.total = sum([a[-1] for a in arrays])

    @property
    def before(self):
        """The count that stands before each segment."""
        return accumulate((a[-1] for a in self.arrays), initial=0)

    def all(self) -> list[int]:
        """Tokens of text[:i] for i from 0 to its length. The mark before the text is no character of it."""
        out = [base + x for base, a in zip(self.before, self.arrays, strict=False) for x in a]
        return [0, *out[1:]] if out else [0]

    def within(self, limit: int) -> int:
        """Characters of the longest prefix of at most limit tokens."""
        if self.total <= limit:
            return max(0, sum(map(len, self.arrays)) - 1)
        best = chars = -1  # the mark before the text
        for base, a in zip(self.before, self.arrays, strict=False):
            if base > limit:
                break
            if base + a[-1] <= limit:
                best = chars + len(a)
            else:  # counts may fall again where a token takes in more characters
                best = max([best, *(chars + i for i, x in enumerate(a, 1) if base + x <= limit)])
            chars += len(a)
        return max(0, best)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars, the longest prefix within the limit, in code points.

    With prefixes, also prefix_tokens: the array of the counts of all prefixes, from the empty one on.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefixes
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()))

    def run(batches):
        counter = PrefixCounter(model)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                t = t.as_py()
                p = counter.prefixes(t)
                rows.append((len(t.encode()), p.total, p.total > limit, p.within(limit), *([p.all()] if prefixes else [])))
            columns = zip(*rows, strict=True) if rows else [()] * (4 + prefixes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
