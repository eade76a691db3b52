"""Exact removal of repeated substrings across documents, by suffix arrays.

A byte goes if some window of WIDTH bytes that covers it also starts in a document with a smaller id.

1. Windows are dealt out by content: a window belongs to the smallest hashed k-mer in it (its anchor), so that equal
   windows meet. Consecutive windows with one anchor form a piece of text, which moves as a whole.
2. Anchors seen in one document only are left out early: shards exchange sorted anchor lists by hash range, and only
   pieces with an anchor that several documents have go on. A shard sends each distinct piece once.
3. The pieces of a bucket of anchors make up suffix arrays of bounded size, each of a few shards' pieces. Suffixes are
   sorted by Larsson-Sadakane refinement (groups of equal prefixes are refined by doubling, singletons are left alone),
   Kasai's recurrence gives common prefixes, and runs of common prefixes of WIDTH or more are equal windows. The arrays of
   different shards are merged by binary search of the windows of one in those of the others.
4. Each piece learns the smallest document id for each of its windows; shards then look up their documents' pieces.

The texts are shuffled once, by shard, and that exchange serves all three passes over them. Nulls count as empty;
texts shorter than WIDTH bytes lose nothing. Rows with a null id neither remove nor lose anything. Rows repeated under
one id don't remove each other. Very long texts are worked on in stretches that overlap by a window; besides its bytes, a
flag for each byte is held of a text. Equal strings have no order among them but their documents' ids. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts_for, text_bytes
from .jaccard import mix

WIDTH = 50
KMER = 20
#: Windows of one piece at most; repetitive text would make endless ones.
PIECE_WINDOWS = 64
SHARD_BYTES = 10 << 20
CHUNK_BYTES = 1 << 18
#: Anchors of a hash range, and buckets of pieces for each shard.
RANGE_ANCHORS = 400_000
BUCKETS_PER_SHARD = 4
#: Pieces of a bucket are sorted in parts of about PART_BYTES, by anchor; a part's pieces make arrays of ARRAY_BYTES, in the
#: order of their shards, that fit in a processor's cache.
PART_BYTES, ARRAY_BYTES = 1 << 20, 1 << 19
PARTS = 256

_U = np.uint64
_BYTE = mix(np.arange(256, dtype=_U), 77)
_P = _U(0x9E3779B97F4A7C15 | 1)


def _power(n: int) -> np.uint64:
    return _U(pow(int(_P), n, 1 << 64))


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hash of the k bytes from each position on; windows are doubled and then joined to make k."""
    width, h = 1, _BYTE[data]
    parts = {1: h}
    while width * 2 <= k:
        h = h[:-width] + _power(width) * h[width:]
        width *= 2
        parts[width] = h
    left = k - width
    while left:
        add = max(w for w in parts if w <= left)
        n = len(data) - width - add + 1
        h = h[:n] + _power(width) * parts[add][width : width + n]
        width, left = width + add, left - add
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(29)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    over = n - width
    return np.minimum(x[: len(x) - over], x[over:]) if over else x


class Pieces:
    """Pieces of a stretch of documents: start in the stretch, number of windows, anchor, document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        n = len(data) - WIDTH + 1
        if n <= 0:
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, _U)
            self._data = data
            return
        anchor = sliding_min(kmer_hashes(data), WIDTH - KMER + 1)
        valid = np.ones(n + WIDTH, bool)
        for lag in range(1, WIDTH):  # windows that begin so near a document's end would leave it
            at = ends - lag
            valid[at[(at >= 0) & (at < len(valid))]] = False
        valid = valid[:n]
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        heads = np.flatnonzero(head)
        # a run ends where the next begins, or where windows stop being valid
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | head[1:]
        windows = np.flatnonzero(stop) - heads + 1
        cuts = -(-windows // PIECE_WINDOWS)
        if len(cuts) and cuts.max() > 1:
            part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            heads = np.repeat(heads, cuts) + part * PIECE_WINDOWS
            windows = np.minimum(PIECE_WINDOWS, np.repeat(windows, cuts) - part * PIECE_WINDOWS)
        self.start, self.windows, self.anchor = heads, windows, anchor[heads]
        self.doc = np.searchsorted(ends, heads, side="right")
        self._data = data

    def contents(self) -> np.ndarray:
        """Polynomial hash of each piece's bytes, from prefix sums of bytes weighted by powers of the base."""
        n = len(self.start)
        if not n:
            return np.zeros(0, _U)
        data, size = self._data, self.windows + WIDTH - 1
        pw = _powers(len(data) + 1)
        prefix = np.concatenate(([_U(0)], np.cumsum(_BYTE[data] * pw[: len(data)], dtype=_U)))
        raw = (prefix[self.start + size] - prefix[self.start]) * _inverse_powers(len(data) + 1)[self.start]
        return mix(raw + size.astype(_U), 6)


def _table(base: int, held: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Powers of a base modulo 2**64, kept for the next call."""
    if base not in held or len(held[base]) < n:
        held[base] = np.concatenate(([_U(1)], np.cumprod(np.full(2 * n, _U(base)), dtype=_U)))
    return held[base]


_HELD: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    return _table(int(_P), _HELD, n)


def _inverse_powers(n: int) -> np.ndarray:
    """They make a content hash independent of its place."""
    return _table(pow(int(_P), -1, 1 << 64), _HELD, n)


def stretches(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a shard in stretches of about CHUNK_BYTES: bytes, ends, row numbers and places in the documents.

    A longer document comes in parts, each with the first WIDTH - 1 bytes of the next, so that every window is in one part.
    """
    held, rows, at, size = [], [], [], 0
    for row, text in enumerate(frame["text"]):
        raw = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")
        for start in range(0, max(1, len(raw) - WIDTH + 1), CHUNK_BYTES):
            part = raw[start : start + CHUNK_BYTES + WIDTH - 1]
            held.append(part)
            rows.append(row)
            at.append(start)
            size += len(part)
            if size >= CHUNK_BYTES:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(rows), np.array(at)
                held, rows, at, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(rows), np.array(at)


def _with_id(frame: pd.DataFrame) -> pd.DataFrame:
    return frame[frame["known"]].sort_values("id", kind="stable")


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number; by doubling."""
    x = np.concatenate((text, np.zeros(8, np.uint8))).astype(_U)
    for k in (1, 2, 4):
        x = x[:-k] << _U(8 * k) | x[k:]
    return x[: len(text)]


def suffix_ranks(words: np.ndarray, room: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Rank of each position by its first `depth` bytes, by Larsson-Sadakane refinement.

    words: 8 bytes from each position on; room: bytes from a position to its piece's end. The first pass sorts by 8
    bytes; each further one doubles the prefix, and only groups of several suffixes are sorted again. A position with
    less room than the prefix keeps the rank of the last prefix that it had room for, and is not asked for again.
    """
    rank = np.zeros(len(words), np.int32)
    pos = np.flatnonzero(room >= 8).astype(np.int32)
    key = words[pos]
    width = 8
    while len(pos):
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(head)
        sizes = np.diff(np.concatenate((at, [len(pos)])))
        if width == 8:
            first = at
        else:  # places within the group of the shorter prefix
            old = rank[pos[at]]
            outer = np.concatenate(([True], old[1:] != old[:-1]))
            first = old + at - at[outer][np.cumsum(outer) - 1]
        rank[pos] = np.repeat(first.astype(np.int32), sizes)
        if width == depth:
            break
        step = min(width, depth - width)
        more = np.repeat(sizes > 1, sizes)
        pos = pos[more]
        pos = pos[room[pos] >= width + step]
        key = rank[pos].astype(_U) << _U(32) | rank[pos + step].astype(_U)
        width += step
    return rank


def kasai(text: np.ndarray, words: np.ndarray, order: np.ndarray, place: np.ndarray, tied: np.ndarray, start: np.ndarray, windows: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """Common prefix, up to `limit` bytes, of each window with the one before it in `order`; 0 where it isn't tied.

    order: positions of windows, sorted; place: each position's index in it, -1 where no window begins; tied: whether
    a position has the rank of its neighbour in order. Kasai's recurrence walks each piece from its first window on:
    the next window shares at least one byte less than this one, if the neighbour's next position is a window too and
    sorts before it; else counting starts anew, eight bytes at a time. All pieces walk in step.
    """
    lcp = np.zeros(len(order), np.int16)
    before = np.concatenate(([-1], order[:-1]))
    h = np.zeros(len(start), np.int64)
    last = np.full(len(start), -1)  # the neighbour of each piece's window before
    live = np.arange(len(start))
    for j in range(int(windows.max()) if len(windows) else 0):
        live = live[windows[live] > j]
        use = tied[start[live] + j]
        last[live[~use]] = -1
        own = live[use]
        pos = start[own] + j
        at = place[pos]
        prior = before[at]
        follow = place[np.minimum(last[own] + 1, len(place) - 1)]
        holds = (last[own] >= 0) & (follow >= 0) & (follow < at)
        length = np.where(holds, np.maximum(h[own] - 1, 0), 0)
        last[own] = prior
        for unit, step in ((words, 8), (text, 1)):
            grow = np.flatnonzero(length + step <= limit)
            while len(grow):
                grow = grow[unit[pos[grow] + length[grow]] == unit[prior[grow] + length[grow]]]
                length[grow] += step
                grow = grow[length[grow] + step <= limit]
        h[own] = length
        lcp[at] = length
    return lcp


class WindowArray:
    """The windows of some pieces in suffix order, equal ones put together, each with the smallest document id."""

    def __init__(self, text: np.ndarray, start: np.ndarray, windows: np.ndarray, low: np.ndarray) -> None:
        size = windows + WIDTH - 1
        room = np.repeat(start + size, size) - np.arange(len(text))
        self.text, words = text, words_at(text)
        rank = suffix_ranks(words, room)
        pos = np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        of = rank[pos]
        by = np.argsort(of)
        order, of = pos[by], of[by]
        place = np.full(len(text), -1)
        place[order] = np.arange(len(order))
        tied = np.zeros(len(text), bool)
        tied[order[1:]] = of[1:] == of[:-1]
        lcp = kasai(text, words, order, place, tied, start, windows)
        head = lcp < WIDTH
        head[:1] = True
        firsts = np.flatnonzero(head)
        self.group = np.empty(len(pos), np.int64)  # of each window, piece after piece
        self.group[by] = np.cumsum(head) - 1
        self.low = np.minimum.reduceat(np.repeat(low, windows)[by], firsts) if len(firsts) else np.zeros(0, np.int64)
        self.first = order[firsts]

    def keys(self) -> np.ndarray:
        """The distinct windows in order, as strings; a last byte keeps zeros at their ends from being cut off."""
        out = np.ones((len(self.first), WIDTH + 1), np.uint8)
        out[:, :WIDTH] = self.text[self.first[:, None] + np.arange(WIDTH)]
        return out.view(f"S{WIDTH + 1}").ravel()

    def merge(self, other: WindowArray) -> None:
        """Take over smaller ids of equal windows of the other array, and give it ours: by binary search."""
        ours, theirs = self.keys(), other.keys()
        if not len(ours) or not len(theirs):
            return
        at = np.minimum(np.searchsorted(theirs, ours), len(theirs) - 1)
        hit = np.flatnonzero(theirs[at] == ours)
        both = np.minimum(self.low[hit], other.low[at[hit]])
        self.low[hit] = both
        other.low[at[hit]] = both


# --- the passes ------------------------------------------------------------------------------------------------------


def _smallest(text: np.ndarray, start: np.ndarray, windows: np.ndarray, content: np.ndarray, low: np.ndarray, high: np.ndarray, shard: np.ndarray, array_bytes: int) -> list[tuple]:
    """The runs of `smallest` for some of a bucket's pieces: shard, contents, first and last windows, smallest ids."""
    size = windows + WIDTH - 1
    by = np.lexsort((shard, content))
    firsts = np.flatnonzero(np.concatenate(([True], content[by][1:] != content[by][:-1])))
    one = by[firsts]
    order = np.lexsort((content[one], shard[one]))  # each distinct piece with the first shard that has it
    one, lowest = one[order], np.minimum.reduceat(low[by], firsts)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kind = np.empty(len(content), np.int64)
    kind[by] = np.repeat(place, np.diff(np.concatenate((firsts, [len(by)]))))
    # arrays of bounded size over the distinct pieces, shard after shard
    arrays, spans = [], []
    filled = np.cumsum(size[one])
    a = 0
    while a < len(one):
        b = max(a + 1, int(np.searchsorted(filled, filled[a] - size[one[a]] + array_bytes, side="right")))
        own = one[a:b]
        s = size[own]
        local = np.cumsum(s) - s
        arrays.append(WindowArray(text[np.repeat(start[own] - local, s) + np.arange(s.sum())], local, windows[own], lowest[a:b]))
        spans.append((a, b))
        a = b
    for i in range(len(arrays)):
        for j in range(i):  # those before agree on their common windows already, so that one merge with each is enough
            arrays[i].merge(arrays[j])
    found = np.concatenate([x.low[x.group] for x in arrays])
    count = windows[one]
    first = np.cumsum(count) - count
    piece = np.repeat(np.arange(len(one)), count)
    offset = np.arange(len(found)) - first[piece]
    head = np.concatenate(([True], (found[1:] != found[:-1]) | (piece[1:] != piece[:-1])))
    at = np.flatnonzero(head)
    run_piece, run_start, run_low = piece[at], offset[at], found[at]
    run_end = run_start + np.diff(np.concatenate((at, [len(found)])))
    run_first = np.searchsorted(run_piece, np.arange(len(one) + 1))
    runs = run_first[kind + 1] - run_first[kind]
    entry = np.repeat(np.arange(len(kind)), runs)
    run = np.repeat(run_first[kind] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    use = run_low[run] < high[entry]
    entry, run = entry[use], run[use]
    by = np.argsort(shard[entry], kind="stable")
    entry, run = entry[by], run[by]
    to = shard[entry]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else np.zeros(0, np.int64)
    return [(int(to[a]), content[entry[a:b]].tobytes(), run_start[run[a:b]].astype(np.uint8).tobytes(), run_end[run[a:b]].astype(np.uint8).tobytes(), run_low[run[a:b]].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, what is left)."""
    bounded_batches(docs.sparkSession)
    known = F.col(id_col).cast("long").isNotNull()
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), known.alias("known"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_bytes = text_bytes(given)
    shards = parts_for(n_bytes, shard_bytes)
    ranges = max(1, n_bytes * 2 // ((WIDTH - KMER + 2) * RANGE_ANCHORS))
    buckets = shards * BUCKETS_PER_SHARD
    sharded = given.withColumn("shard", F.pmod(F.xxhash64("id", "known", "text"), F.lit(shards)).cast("int")).repartition(shards, "shard")

    def range_of(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash range of each anchor, and the 32 bits by which it is told apart within the range."""
        return ((anchor >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64), mix(anchor, 8).astype(np.uint32)

    def anchors(frame: pd.DataFrame) -> pd.DataFrame:
        """A shard's distinct anchors by range, and those which several of its documents have."""
        frame = _with_id(frame)
        ids = frame["id"].to_numpy(np.int64)
        found, owners = [], []
        for data, ends, rows, _ in stretches(frame):
            p = Pieces(data, ends)
            a, doc = p.anchor, ids[rows[p.doc]] if len(p.doc) else np.zeros(0, np.int64)
            by = np.lexsort((doc, a))
            a, doc = a[by], doc[by]
            once = np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))[: len(a)]
            found.append(a[once])
            owners.append(doc[once])
        a = np.concatenate(found) if found else np.zeros(0, _U)
        doc = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by = np.argsort(a, kind="stable")
        a, doc = a[by], doc[by]
        head = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
        firsts = np.flatnonzero(head)
        many = np.zeros(len(firsts), bool)
        if len(firsts):
            many = np.minimum.reduceat(doc, firsts) != np.maximum.reduceat(doc, firsts)
        a = a[firsts]
        r, low = range_of(a)
        cut = np.searchsorted(r, np.arange(ranges + 1))
        hold = [k for k in range(ranges) if cut[k] < cut[k + 1]]
        part = [slice(cut[k], cut[k + 1]) for k in hold]
        shard = int(frame["shard"].iloc[0]) if len(frame) else 0
        return pd.DataFrame({"range": np.array(hold, np.int64), "shard": np.full(len(hold), shard), "anchors": [low[s].tobytes() for s in part], "many": [np.packbits(many[s]).tobytes() for s in part]})

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        """For each shard, its anchors of a range that another document has too."""
        lists = [np.frombuffer(x, np.uint32) for x in frame["anchors"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool) for m, x in zip(frame["many"], lists, strict=True)])
        a = np.concatenate(lists)
        by = np.argsort(a, kind="stable")
        s = a[by]
        head = np.concatenate(([True], s[1:] != s[:-1]))
        firsts = np.flatnonzero(head)
        good = (np.diff(np.concatenate((firsts, [len(s)]))) > 1) | np.logical_or.reduceat(many[by], firsts)
        take = np.zeros(len(a), bool)
        take[by] = good[np.cumsum(head) - 1]
        ends = np.cumsum([len(x) for x in lists])
        out = [x[take[e - len(x) : e]] for x, e in zip(lists, ends, strict=True)]
        return pd.DataFrame({"shard": frame["shard"], "range": frame["range"], "anchors": [x.tobytes() for x in out]})[[len(x) > 0 for x in out]]

    def pieces(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """A shard's distinct pieces with shared anchors, by bucket, with the smallest and largest id that has each."""
        columns = ["bucket", "shard", "content", "low", "high", "windows", "part", "bytes"]
        frame = _with_id(frame)
        if not len(frame) or not len(wanted):
            return pd.DataFrame(columns=columns)
        keys = np.sort(np.concatenate([np.frombuffer(x, np.uint32).astype(_U) | _U(int(r) << 32) for r, x in zip(wanted["range"], wanted["anchors"], strict=True)]))
        ids = frame["id"].to_numpy(np.int64)
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("content", "low", "high", "windows", "bucket", "part")}
        texts = []
        for data, ends, rows, _ in stretches(frame):
            p = Pieces(data, ends)
            r, low32 = range_of(p.anchor)
            key = low32.astype(_U) | r.astype(_U) << _U(32)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            content, doc = p.contents()[hit], ids[rows[p.doc[hit]]]
            by = np.lexsort((doc, content))
            hit, content, doc = hit[by], content[by], doc[by]
            firsts = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1]))[: len(content)])
            if not len(firsts):
                continue
            one = hit[firsts]
            parts["content"].append(content[firsts])
            parts["low"].append(doc[firsts])
            parts["high"].append(np.maximum.reduceat(doc, firsts))
            parts["windows"].append(p.windows[one])
            dealt = mix(p.anchor[one], 9)
            parts["bucket"].append((dealt % _U(buckets)).astype(np.int64))
            parts["part"].append((dealt >> _U(56)).astype(np.uint8))
            size = p.windows[one] + WIDTH - 1
            gather = np.repeat(p.start[one] - np.cumsum(size) + size, size) + np.arange(size.sum())
            texts.append(data[gather])
        if not texts:
            return pd.DataFrame(columns=columns)
        joined = {k: np.concatenate(v) for k, v in parts.items()}
        text = np.concatenate(texts)
        size = joined["windows"] + WIDTH - 1
        start = np.cumsum(size) - size
        by = np.lexsort((joined["content"], joined["bucket"]))
        content, bucket = joined["content"][by], joined["bucket"][by]
        firsts = np.flatnonzero(np.concatenate(([True], (content[1:] != content[:-1]) | (bucket[1:] != bucket[:-1]))))
        low, high = np.minimum.reduceat(joined["low"][by], firsts), np.maximum.reduceat(joined["high"][by], firsts)
        one = by[firsts]
        bucket, content = bucket[firsts], content[firsts]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        shard = int(frame["shard"].iloc[0])
        out = []
        for a, b in zip(cut, cut[1:], strict=False):
            own = one[a:b]
            size_ = size[own]
            gather = np.repeat(start[own] - np.cumsum(size_) + size_, size_) + np.arange(size_.sum())
            out.append((int(bucket[a]), shard, content[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), joined["windows"][own].astype(np.uint8).tobytes(), joined["part"][own].tobytes(), text[gather].tobytes()))
        return pd.DataFrame(out, columns=columns)

    def smallest(frame: pd.DataFrame) -> pd.DataFrame:
        """For each shard's pieces of a bucket, runs of windows with the smallest id of any document, where that is
        below the largest id that the shard has for the piece."""
        whole = {c: np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("content", _U), ("low", np.int64), ("high", np.int64), ("windows", np.uint8), ("part", np.uint8))}
        whole["windows"] = whole["windows"].astype(np.int64)
        whole["shard"] = np.repeat(frame["shard"].to_numpy(), [len(x) for x in frame["windows"]])
        text = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        size = whole["windows"] + WIDTH - 1
        whole["start"] = np.cumsum(size) - size
        n = min(PARTS, max(1, len(text) // PART_BYTES))
        part = whole["part"].astype(np.int64) * n // PARTS
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(n + 1))
        out = [_smallest(text, *(whole[c][by[a:b]] for c in ("start", "windows", "content", "low", "high", "shard")), array_bytes) for a, b in zip(cut, cut[1:], strict=False) if a < b]
        return pd.DataFrame([row for rows in out for row in rows], columns=["shard", "content", "first", "last", "low"])

    def apply(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        """Remove from a shard's documents what their pieces' runs say."""
        take = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in runs[c]]) if len(runs) else np.zeros(0, t)
        content, low = take("content", _U), take("low", np.int64)
        first, last = take("first", np.uint8).astype(np.int64), take("last", np.uint8).astype(np.int64)
        by = np.argsort(content, kind="stable")
        content, low, first, last = content[by], low[by], first[by], last[by]
        frame = frame.sort_values(["known", "id"], kind="stable")
        known, ids = frame["known"].to_numpy(bool), frame["id"].to_numpy(np.int64)
        out = []
        held, mask, raw = -1, np.zeros(0, bool), []  # the document that is open: its flags, and its bytes in parts

        def close() -> None:
            if held >= 0:
                data = np.concatenate(raw)
                removed = int(mask.sum())
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
                out.append((int(ids[held]) if known[held] else pd.NA, len(data), removed, spans, (data[~mask] if removed else data).tobytes()))

        for data, ends, rows, places in stretches(frame):
            p = Pieces(data, ends)
            own = p.contents()
            a, b = np.searchsorted(content, own, side="left"), np.searchsorted(content, own, side="right")
            n = b - a
            which = np.repeat(np.arange(len(n)), n)
            run = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            use = (low[run] < ids[rows[p.doc[which]]]) & known[rows[p.doc[which]]]
            which, run = which[use], run[use]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, p.start[which] + first[run], 1)
            np.add.at(edge, p.start[which] + last[run] - 1 + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            at = 0
            for row, place, end in zip(rows.tolist(), places.tolist(), ends.tolist(), strict=True):
                if row != held:
                    close()
                    held, mask, raw = row, gone[at:end], [data[at:end]]
                else:  # the first bytes are the last ones of the part before
                    over = len(mask) - place
                    mask = np.concatenate((mask[:place], mask[place:] | gone[at : at + over], gone[at + over : end]))
                    raw.append(data[at + over : end])
                at = end
        close()
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"id": "Int64"})

    by_range = sharded.groupBy("shard").applyInPandas(anchors, "range long, shard int, anchors binary, many binary")
    wanted = by_range.groupBy("range").applyInPandas(shared, "shard int, range long, anchors binary")
    found = sharded.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(pieces, "bucket long, shard int, content binary, low binary, high binary, windows binary, part binary, bytes binary")
    runs = found.groupBy("bucket").applyInPandas(smallest, "shard int, content binary, first binary, last binary, low binary")
    out = sharded.groupBy("shard").cogroup(runs.groupBy("shard")).applyInPandas(apply, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def brute_force(docs: list[tuple[int, bytes]], width: int = WIDTH) -> list[tuple[int, int, int, int, str]]:
    """The same by a dictionary of windows, for tests: id, n_bytes, n_removed, n_spans, kept_sha256."""
    low: dict[bytes, int] = {}
    for i, raw in docs:
        for k in range(len(raw) - width + 1):
            low[raw[k : k + width]] = min(i, low.get(raw[k : k + width], i))
    out = []
    for i, raw in docs:
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if low[raw[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out
