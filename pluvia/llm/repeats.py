"""Suffix-array dedup: removes bytes covered by strings of 200 bytes that start more than once.

Two equal windows of 200 bytes have the same smallest 32-gram (by hash, leftmost on ties) at the
same place: their anchor. Consecutive windows with one anchor form a segment, about 85 windows of
a text. So windows can only be equal if their segments' anchors are:

1. segments that repeat within a slice of one text (periodic texts have one for each byte) are
   found there, by their bytes; one of them goes on with the number of all, and their windows,
   merged into runs, are settled;
2. segments are counted by anchor; an anchor that occurs once is done;
3. the bytes of all other segments go to their anchor's group, copies of one task as one row.
   Rows of equal bytes become one; the suffixes that start at the windows are sorted: a mergesort
   whose comparisons find the common extension by binary search on prefix polynomial hashes.
   Neighbours whose extension reaches 200 bytes are then compared byte by byte; should hashes
   have collided, the group is sorted by its bytes. Suffixes of a segment that came more than
   once, by its bytes, are repeated without a neighbour;
4. anchors with more than ``hot`` rows would be large groups. Their windows are dealt anew, by
   blocks of 16 (then single ones) and the bytes that a block's windows share; blocks of equal
   bytes become one row, and the smaller groups are sorted as in step 3.

So every repeat is settled by bytes. Hashes only name things: an anchor and a segment's hash name
it on the way back to its text. Should two different segments get one name, the group tells, and
all is done again with other hashes.

This finds every repeated window, and their union is cut out of each text.

A null text is empty. Texts under 200 bytes are kept whole. Repeated rows are copies of one
another. Null or repeated doc_ids: rows get ids of their own first. Empty tables give no rows.
Columns other than doc_id and text are ignored. What is gathered for a text (its segments that
occur elsewhere, its runs) grows with its bytes, at about half a byte for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import table, text_of, written
from pluvia.llm.quality import arrow_texts, slices

LENGTH = 200
GRAM = 32
SLICE = 1 << 18
PLACE = np.uint64((1 << 22) - 1)
SEED = 20240229


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd base modulo 2^64, and their inverses."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 40, 1 << 62)) | 5
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, inverse)):
        out[0] = 1
        have = 1
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * np.uint64(pow(b, have, 1 << 64))
            have += take
    return values, up, down


class Hasher:
    def __init__(self, n: int, seed: int = SEED):
        self.values, self.up, self.down = _powers(n + 1, seed)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, prefixes: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        """Hash of size bytes from each start."""
        return (prefixes[start + size] - prefixes[start]) * self.down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(hasher: Hasher, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
    """(text, first window, windows, anchor's place in the first window, anchor hash, the segment's hash) of the texts that lie one after another in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    p = hasher.prefixes(data)
    n = len(data) - GRAM + 1
    grams = mixed((p[GRAM:] - p[:n]) * hasher.down[:n])
    anchor = (smallest((grams & ~PLACE) | np.arange(n, dtype=np.uint64), LENGTH - GRAM + 1) & PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(anchor))
    whole = owner[start] == owner[start + LENGTH - 1]
    start, anchor = start[whole], anchor[whole]
    if not len(start):
        return none, none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    windows = np.diff(np.append(new, len(start)))
    first, at = start[new], anchor[new]
    text = owner[first]
    name = mixed(hasher.hashes(p, first, windows + LENGTH - 1) ^ mixed(windows.astype(np.uint64) << np.uint64(16) | (at - first).astype(np.uint64)))
    return text, first - begin[text], windows, at - first, grams[at].view(np.int64), name.view(np.int64)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


SEGMENT = "anchor long, sid long, row long, lo long, windows int, place int, n int"
SEGMENT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _once(raw: bytes, at: np.ndarray, text: np.ndarray, first: np.ndarray, windows: np.ndarray, anchor: np.ndarray, name: np.ndarray):
    """Segments that stand several times in one text: (which to keep, how many it stands for, [(kept one, first window, windows)] of settled runs)."""
    order = np.lexsort((first, name, anchor, text))
    t, a, s = text[order], anchor[order], name[order]
    same = np.flatnonzero((t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (s[1:] == s[:-1]))
    count, keep = np.ones(len(text), np.int64), np.ones(len(text), bool)
    if not len(same):
        return keep, count, []
    head = np.arange(len(order))
    equal = lambda i, j: windows[i] == windows[j] and raw[at[i] : at[i] + windows[i] + LENGTH - 1] == raw[at[j] : at[j] + windows[j] + LENGTH - 1]
    spans: dict[int, list[tuple[int, int]]] = {}
    for k in (same + 1).tolist():
        one, this = int(order[head[k - 1]]), int(order[k])
        if equal(one, this):  # bytes decide; others stay rows of their own
            head[k] = head[k - 1]
            keep[this] = False
            count[one] += 1
            spans.setdefault(one, [(int(first[one]), int(first[one] + windows[one]))]).append((int(first[this]), int(first[this] + windows[this])))
    by_text: dict[int, list] = {}
    for one, some in spans.items():
        by_text.setdefault(int(text[one]), []).append((one, some))
    settled = []
    for groups in by_text.values():
        one = groups[0][0]
        settled += [(one, s, e - s) for s, e in _merged([x for _, some in groups for x in some])]
    return keep, count, settled


def _segments(batches, seed):
    hasher = Hasher(SLICE + LENGTH, seed)
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        data, starts, sizes = arrow_texts(batch.column("text"))
        for i, upto in slices(sizes, SLICE):
            begin = starts[i:upto] - starts[i]
            chunk = data[starts[i] : starts[i] + sizes[i:upto].sum()]
            # a text over SLICE bytes goes in pieces that overlap by all but one byte of a window
            for off in range(0, max(1, len(chunk) - LENGTH + 1), SLICE) if upto == i + 1 else (0,):
                part = chunk[off : off + SLICE + LENGTH - 1] if upto == i + 1 else chunk
                own = (begin, sizes[i:upto]) if upto > i + 1 else (np.array([0]), np.array([len(part)]))
                text, first, windows, place, anchor, name = segments(hasher, part, *own)
                if not len(text):
                    continue
                keep, count, settled = _once(part.tobytes(), first + own[0][text], text, first, windows, anchor, name)
                row, lo = rows[i + text], first + off
                whole = [x[keep] for x in (anchor, name, row, lo, windows, place, count)]
                one = np.array([x[0] for x in settled], np.int64)
                runs = [anchor[one], name[one], row[one], np.array([x[1] + off for x in settled], np.int64), np.array([x[2] for x in settled], np.int64), place[one], np.zeros(len(one), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(zip(whole, runs, strict=True), SEGMENT_KINDS, strict=True)], _names(SEGMENT))


class Suffixes:
    """Suffixes of a buffer of segments, compared over LENGTH bytes by their hashes."""

    def __init__(self, hasher: Hasher, data: np.ndarray):
        self.data, self.hasher, self.p = data, hasher, hasher.prefixes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, LENGTH at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        p, down = self.p, self.hasher.down
        da, db, pa_, pb = down[a], down[b], p[a], p[b]
        for _ in range(LENGTH.bit_length()):
            mid = (low + high + 1) >> 1
            same = (p[a + mid] - pa_) * da == (p[b + mid] - pb) * db
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether a sorts before b; ties: what equals b does."""
        n = self.common(a, b)
        end = n >= LENGTH
        n = np.minimum(n, LENGTH - 1)
        return np.where(end, ties, self.data[a + n] < self.data[b + n])

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes of each group (equal groups stand together): all groups' runs are merged at once."""
        sizes = np.bincount(group)
        begin = (np.cumsum(sizes) - sizes)[group]
        end = begin + sizes[group]
        width, most = 1, int(sizes.max())
        suffix = suffix.copy()
        place = np.arange(len(suffix)) - begin
        while width < most:
            left = begin + place // (2 * width) * (2 * width)
            middle = np.minimum(left + width, end)
            right = np.minimum(left + 2 * width, end)
            todo = np.flatnonzero(middle < right)
            in_left = (np.arange(len(suffix)) < middle)[todo]
            # rank of each suffix in the other run, by binary search
            base = np.where(in_left, middle[todo], left[todo])
            low, high = base.copy(), np.where(in_left, right[todo], middle[todo])
            own = suffix[todo]
            while len(busy := np.flatnonzero(low < high)):
                mid = (low[busy] + high[busy]) >> 1
                smaller = np.empty(len(busy), bool)
                for ties in (False, True):  # of equals, the left run's come first
                    some = in_left[busy] != ties
                    smaller[some] = self.before(suffix[mid[some]], own[busy[some]], ties)
                low[busy] = np.where(smaller, mid + 1, low[busy])
                high[busy] = np.where(smaller, high[busy], mid)
            mine = todo - np.where(in_left, left[todo], middle[todo])
            suffix[left[todo] + mine + low - base] = own
            width *= 2
        return suffix

    def repeated(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The suffixes (in the order of the groups, sorted) that share LENGTH bytes with another one of their group."""
        ordered = self.sort(suffix, group)
        near = np.flatnonzero(group[1:] == group[:-1])
        equal = near[self.common(ordered[near], ordered[near + 1]) >= LENGTH]
        span = np.arange(LENGTH)
        hit, wrong = np.zeros(len(ordered), bool), set()
        for b in range(0, len(equal), 20_000):
            e = equal[b : b + 20_000]
            same = (self.data[ordered[e][:, None] + span] == self.data[ordered[e + 1][:, None] + span]).all(axis=1)
            wrong |= set(group[e[~same]].tolist())
            hit[e[same]] = hit[e[same] + 1] = True
        for g in wrong:  # hashes collided: the bytes themselves decide
            at = np.flatnonzero(group == g)
            texts = [self.data[s : s + LENGTH].tobytes() for s in ordered[at]]
            hit[at] = [texts.count(t) > 1 for t in texts]
        return ordered[hit]


def repeated_windows(hasher: Hasher, anchor: np.ndarray, counts: np.ndarray, windows: np.ndarray, places: np.ndarray, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each different segment of some anchors, the runs (first, last) of windows that repeat. Segments that occur twice repeat whole."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    n = int(windows.sum())
    owner = np.repeat(np.arange(len(texts)), windows)
    index = np.arange(n) - np.repeat(np.cumsum(windows) - windows, windows)
    left = places[owner] - index  # bytes of the window before its anchor
    order = np.lexsort((left, anchor[owner]))
    a, l = anchor[owner][order], left[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (l[1:] != l[:-1])))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    hit = np.zeros(n, bool)
    if many.any():
        place = begin[owner[order]] + index[order]
        _, group = np.unique(group[many], return_inverse=True)
        found = Suffixes(hasher, data).repeated(place[many], group)
        of = np.searchsorted(begin, found, side="right") - 1
        first = np.cumsum(windows) - windows
        hit[first[of] + found - begin[of]] = True
    hit |= (counts > 1)[owner]
    out, first = [], 0
    for w in windows.tolist():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[first : first + w].view(np.int8), [0]))))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
        first += w
    return out


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "anchor long, sid long, clash boolean, runs array<struct<a:int,b:int>>"


def _sorted_groups(batches, most=1500):
    """Rows of an anchor follow one another, by name; whole groups are taken together until there are enough. Rows of equal bytes become one."""
    hasher = Hasher(most * 3 * LENGTH)
    held: list[dict] = []

    def done(rows):
        own = hasher if hasher_size(rows) < len(hasher.down) else Hasher(hasher_size(rows))
        column = lambda k: np.array([r[k] for r in rows], np.int64)
        runs = repeated_windows(own, column("anchor"), column("n"), column("windows"), column("place"), [r["bytes"] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(column("anchor")), pa.array(column("sid")), pa.array([r["clash"] for r in rows], pa.bool_()), pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], RUNS)], ["anchor", "sid", "clash", "runs"])

    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            row = {c: v[i].as_py() for c, v in columns.items()} | {"clash": False}
            last = held[-1] if held else None
            if last and last["anchor"] == row["anchor"] and last["sid"] == row["sid"]:
                if last["bytes"] == row["bytes"] and last["place"] == row["place"]:
                    last["n"] += row["n"]
                    continue
                row["clash"] = True
            if len(held) >= most and last["anchor"] != row["anchor"]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def hasher_size(rows: list[dict]) -> int:
    return sum(len(r["bytes"]) for r in rows)


CUT = "anchor long, sid long, n long, windows int, place int, bytes binary"
CUT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _cut(batches, most=32 << 20):
    """The bytes of each wanted segment; equal ones of this task are one row, as far as most bytes of them are held."""
    held: dict[tuple, int] = {}
    used = 0

    def rows():
        columns = zip(*((*k[:2], n, *k[2:]) for k, n in held.items()), strict=True) if held else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, CUT_KINDS, strict=True)], _names(CUT))

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, listed in enumerate(batch.column("wanted")):
            text = texts[i].as_py()
            for w in listed.as_py():
                key = (w["anchor"], w["sid"], w["windows"], w["place"], text[w["lo"] : w["lo"] + w["windows"] + LENGTH - 1])
                if key in held:
                    held[key] += w["n"]
                else:
                    held[key] = w["n"]
                    used += len(key[4]) + 200
                    if used > most:
                        yield rows()
                        held.clear()
                        used = 0
    yield rows()


PIECE = "anchor long, sid long, first int, n long, anchor2 long, sid2 long, windows int, place int, bytes binary"


def _split(batches, width):
    """Each segment's windows in blocks of width places before the anchor; a block is known by the bytes that all its windows share."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, place, last = r["bytes"], r["place"], r["place"] - r["windows"] + 1
            for block in range(last // width, place // width + 1):
                high, low = min(place, block * width + width - 1), max(last, block * width)
                core = place - block * width  # where the block's last window starts
                data = text[place - high : place - low + LENGTH]
                shared = b"%d|%d|" % (r["anchor"], block) + text[core : core + LENGTH - width + 1]
                rows.append((r["anchor"], r["sid"], place - high, r["n"], digest(shared), digest(b"%d|" % high + data), high - low + 1, high, data))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(PIECE))


def repeated_in_groups(cut: DataFrame, hot: int, widths: tuple[int, ...] = (16, 1)) -> DataFrame:
    """(anchor, sid, clash, runs) of segments (anchor, sid, n, windows, place, bytes): by sorting the suffixes of each anchor's group.

    A group of more than hot segments is dealt anew by blocks of its windows; blocks of equal bytes become one
    row before the next sort. Single windows of a group are all alike or of other groups, so the last width ends this.
    """
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if widths:
        big = written(cut.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("anchor"), "large-groups")
        large = cut.join(big, "anchor", "left_semi").groupBy("anchor", "sid", "windows", "place", "bytes").agg(F.sum("n").alias("n"))
        split = written(large.select("anchor", "sid", "n", "windows", "place", "bytes").mapInArrow(lambda b, w=widths[0]: _split(b, w), PIECE), "pieces")
        pieces = split.groupBy("anchor2", "sid2", "windows", "place", "bytes").agg(F.sum("n").alias("n"))
        pieces = written(pieces.select(F.col("anchor2").alias("anchor"), F.col("sid2").alias("sid"), "n", "windows", "place", "bytes"), "pieces")
        found = repeated_in_groups(pieces, hot, widths[1:]).withColumnsRenamed({"anchor": "anchor2", "sid": "sid2"})
        back = split.select("anchor", "sid", "first", "anchor2", "sid2").join(found, ["anchor2", "sid2"])
        back = back.select("anchor", "sid", "clash", F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("runs"))
        cut = cut.join(big, "anchor", "left_anti")
    runs = cut.repartition(parts, "anchor").sortWithinPartitions("anchor", "sid", "bytes", "place").mapInArrow(_sorted_groups, FOUND).where((F.size("runs") > 0) | F.col("clash"))
    return runs.unionByName(back) if widths else runs


def repeated_runs(rows: DataFrame, hot: int = 1000) -> DataFrame:
    """(row, a, b): runs of repeated windows of each text of (row, text), first and last start in bytes."""
    for seed in range(SEED, SEED + 5):
        found = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(lambda b, seed=seed: _segments(b, seed), SEGMENT)
        often = found.groupBy("anchor").agg(F.sum("n").alias("c")).where("c > 1").select("anchor")
        often = written(often, "anchors")  # stored, so that the join can split an anchor with many segments
        some = written(found.join(often, "anchor"), "segments")
        settled = some.where("n = 0").select("row", F.col("lo").alias("a"), (F.col("lo") + F.col("windows") - 1).alias("b"))
        open_ = some.where("n > 0")
        wanted = open_.groupBy("row").agg(F.collect_list(F.struct("anchor", "sid", F.col("n").cast("long").alias("n"), "windows", "place", "lo")).alias("wanted"))
        cut = written(rows.join(wanted, "row").select("text", "wanted").mapInArrow(_cut, CUT), "suffixes")
        runs = written(repeated_in_groups(cut, hot), "repeats")
        if runs.where("clash").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("different segments had one name under each of five hashes")
    part = open_.join(runs, ["anchor", "sid"]).select("row", "lo", F.explode("runs").alias("r")).select("row", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))
    return settled.unionByName(part)


def _keep(batches, texts_too):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, listed in enumerate(batch.column("runs")):
            text, runs = texts[i].as_py(), listed.as_py()
            parts, last, removed, spans = [], 0, 0, 0
            for s, e in _merged([(r["a"], r["b"] + LENGTH) for r in runs] if runs else []):
                parts.append(text[last:s])
                last, removed, spans = e, removed + e - s, spans + 1
            kept = b"".join([*parts, text[last:]])
            for column, v in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts_too else None), strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, texts: bool = True, hot: int = 1000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept, the bytes that stay, only with texts."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    total, ids, known = bare.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if total == ids == known:
        rows = bare.select(F.col("doc_id").alias("row"), "text")
    else:
        marked = written(bare.withColumn("row", F.monotonically_increasing_id()), "rows")
        rows = marked.select("row", "text")
    runs = repeated_runs(rows, hot).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = rows.join(runs, "row", "left")
    if total == ids == known:
        joined = joined.withColumn("doc_id", F.col("row"))
    else:
        joined = joined.join(marked.select("row", "doc_id"), "row", "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(lambda b: _keep(b, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")
