"""N-gram Jaccard self-join by PartEnum signatures, with exact links.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Equal sets count as one.
2. Sizes fall into bands; a set takes part in its own band and in those where a larger similar set may be. In a band,
   similar sets differ in at most k elements. The feature domain is dealt into n1 partitions of n2 parts each; in some
   partition the sets then differ in at most k2 parts, so that some choice of n2 - k2 of its parts holds the same
   elements of both. Each such choice is a signature: similar sets share at least one.
3. Sets that share a signature may be similar unless their sketches rule it out: the sums of differences between
   counts of elements in buckets never exceed the number of elements that differ. The sets that share signatures with
   one smallest id fall into classes joined by pairs not ruled out; each is tied to the smallest of its class, not to
   all others.
   The ties make candidate groups: connected components that contain whole classes of linked sets. Very frequent
   signatures tie all their sets without looking at sketches.
4. Within a candidate group, links are found exactly: a search from set to set counts overlaps through postings of
   the sets not yet reached, so that each link to a set already reached costs nothing. Large groups are dealt into
   blocks, and every two blocks meet in one task.

Nothing is dropped: there is no cap on groups, partners or sizes. Nulls and texts without words have no shingles and
are linked with nothing. Repeated rows are in one class; rows of one id with unlike texts are each linked for
themselves. Rows with a null id are linked with nothing. Very long texts are hashed in pieces; a task holds
their hashed words and sets whole. Ties can't arise: links are exact. An empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, few_ids, materialize, parts_for, text_bytes
from .components import components

#: A candidate group beyond these is dealt into blocks.
BLOCK_SETS = 4096
BLOCK_SHINGLES = 1_500_000

#: Signatures with more sets, or so many in one batch of rows, tie all of them.
MAX_SHARERS, MAX_IN_BATCH = 16_384, 48
#: Bytes of sketches that are compared at once, and of a text that is hashed at once.
COMPARED_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Rows of one class beyond which it is looked up by broadcast; a class of a smaller share than one in HOT_CLASSES isn't, so
#: that these number HOT_CLASSES at most.
HOT_ROWS, HOT_CLASSES = 1_000, 100_000
#: Bytes of text whose signatures one task brings together.
BUCKET_BYTES = 8 << 20

_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finalizer: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 7)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers_cache() -> list[np.ndarray]:
    return [np.ones(1, _U)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd constant, modulo 2**64."""
    held = _powers_cache()
    if len(held[0]) < n:
        held[0] = np.concatenate(([_U(1)], np.cumprod(np.full(max(n, 256) * 2, _U(0xD6E8FEB86659FD93)), dtype=_U)))
    return held[0]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z as a-z; in pieces, so that only the hashes follow the text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data):  # a piece ends before white space
            gap = np.flatnonzero(_IS_SPACE[data[end : end + PIECE_BYTES]])
            end += int(gap[0]) if len(gap) else PIECE_BYTES
            if len(gap):
                break
        out.append(_hashed(data[at:end]))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, _U), *out])


def _hashed(data: np.ndarray) -> np.ndarray:
    inside = ~_IS_SPACE[data]
    if not inside.any():
        return np.zeros(0, _U)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    at = np.flatnonzero(inside)
    lens = end - start
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, lens)
    return mix(np.add.reduceat(_BYTE[data[at]] * _powers(int(lens.max()))[place], first) + lens.astype(_U), 1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashed shingles of so many words, sorted; a shorter text is one shingle, an empty one has none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    span = min(n, words)
    out = []
    for at in range(0, n - span + 1, PIECE_BYTES):
        total = np.zeros(min(PIECE_BYTES, n - span + 1 - at), _U)
        for k in range(span):
            total += mix(w[at + k : at + k + len(total)], 11 + k)
        out.append(np.unique(mix(total + _U(span), 3)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


class Scheme:
    """Bands of sizes and PartEnum's parameters for Jaccard >= num / den."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold is above 0 and at most 1")
        self.num, self.den = num, den
        self.low = [1]
        # Partitions must seldom have an empty part, or emptiness becomes a signature that many sets share. At lower
        # thresholds parts are small, so that bands are narrower and more partitions are spare.
        ratio, self.spare = ((den / num) ** 3, 0.1) if num / den > 0.85 else (den / num, 0.4)
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self._low = np.array(self.low)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self._low, size, side="right")) - 1

    def bands(self, size: int) -> range:
        """The set's own band up to that of the largest set that may be similar."""
        return range(self.band(size), self.band(size * self.den // self.num) + 1)

    @lru_cache(maxsize=4096)  # noqa: B019
    def shape(self, band: int) -> tuple[int, int, int, int]:
        """n1 partitions of n2 parts, of which k2 may differ; spare partitions beyond what is needed."""
        k = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 1, 1, 0, 0
        if k <= 3:
            return 1, k + 3, k, 0
        # two parts, of which one may differ, make the fewest signatures: k + 1 and what the spare partitions add
        n1 = k // 2 + 1
        spare = int(n1 * self.spare) + 1
        return n1 + spare, 2, 1, spare

    def linked(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exactly whether intersection / union >= num / den."""
        return self.den * inter >= self.num * (a + b - inter)


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a batch of sets: (index of the set, signature)."""
    jobs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, s in enumerate(sets):
        if len(s):
            for band in scheme.bands(len(s)):
                jobs.setdefault(scheme.shape(band)[1:3], []).append((k, band))
    owner, out = [], []
    for (n2, k2), own in jobs.items():
        shape = [scheme.shape(band) for _, band in own]
        n1 = np.array([x[0] for x in shape])
        sizes = np.array([len(sets[k]) for k, _ in own])
        base = np.concatenate(([0], np.cumsum(n1)))
        h = np.concatenate([sets[k] for k, _ in own])
        job = np.repeat(np.arange(len(own)), sizes)
        part = ((mix(h, 21) >> _U(32)) * n1[job].astype(_U) >> _U(32)).astype(np.int64)
        cell = (base[job] + part) * n2 + (mix(h, 22) % _U(n2)).astype(np.int64)
        count = np.bincount(cell, minlength=base[-1] * n2).reshape(-1, n2)
        total = np.zeros(base[-1] * n2, _U)
        np.add.at(total, cell, mix(h, 23))
        total = total.reshape(-1, n2)
        at = np.repeat(np.arange(len(own)), n1)
        salt = mix(np.array([b for _, b in own], _U)[at] << _U(32) | (np.arange(base[-1]) - base[at]).astype(_U), 24)
        choices = list(combinations(range(n2), n2 - k2))
        filled = np.stack([count[:, c].sum(1) > 0 for c in choices], 1)
        # a set without more hollow partitions than there are spare ones needs no signature of emptiness
        hollow = np.bincount(at[~filled.all(1)], minlength=len(own))
        spare = np.array([x[3] for x in shape])
        take = filled | (hollow > spare)[at][:, None]
        for j, c in enumerate(choices):
            sig = mix(total[:, c].sum(1) + salt, 30 + j)
            hit = take[:, j]
            owner.append(np.array([k for k, _ in own])[at[hit]])
            out.append(sig[hit])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(owner), np.concatenate(out)


def classes(sets: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """For each set, the index of the first set of its class: sets joined by chains of links, found exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.full(n, -1)
    vocabulary, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    keep = df[inverse] > 1
    inverse, of = inverse[keep], of[keep]
    # elements of each set, and postings: the sets of each element, of which those reached are sorted out now and then
    first = np.searchsorted(of, np.arange(n + 1))
    by_element = np.argsort(inverse, kind="stable")
    posting = of[by_element]
    start = np.searchsorted(inverse[by_element], np.arange(len(vocabulary) + 1))
    left = n
    reached = np.zeros(n, bool)
    rebuilt = n
    for root in range(n):
        if reached[root]:
            continue
        queue = [root]
        reached[root] = True
        label[root] = root
        left -= 1
        while queue and left:
            if left * 2 < rebuilt:
                live = ~reached[posting]
                ahead = np.concatenate(([0], np.cumsum(live)))
                posting, start, rebuilt = posting[live], ahead[start], left
            i = queue.pop()
            e = inverse[first[i] : first[i + 1]]
            lens = start[e + 1] - start[e]
            total = int(lens.sum())
            if not total:
                continue
            ends = np.cumsum(lens)
            near = posting[np.repeat(start[e] - ends + lens, lens) + np.arange(total)]
            inter = np.bincount(near, minlength=n)
            other = np.flatnonzero((inter > 0) & ~reached)
            hit = other[scheme.linked(inter[other], size[i], size[other])]
            if len(hit):
                reached[hit] = True
                label[hit] = root
                left -= len(hit)
                queue += hit.tolist()
    return label


def _frame_sets(frame: pd.DataFrame, words: int) -> list[np.ndarray]:
    return [shingles(t if isinstance(t, str) else None, words) for t in frame["text"]]


def sketch(elements: np.ndarray) -> np.ndarray:
    """Counts of the elements in buckets, a power of two of them, a quarter to a half as many as elements; each at most 255."""
    bits = min(14, max(4, (len(elements) // 4).bit_length()))
    return np.minimum(np.bincount((mix(elements, 51) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _differences(sketches: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """The sum of differences between each sketch and one: a longer one of a pair adds neighbouring buckets up."""
    out = np.empty(len(sketches), np.int64)
    length = np.array([len(x) for x in sketches])
    for n in np.unique(length).tolist():
        same = np.flatnonzero(length == n)
        fold = min(n, len(one))
        target = one.reshape(fold, -1).sum(1, dtype=np.int32)
        width = max(1, COMPARED_BYTES // (4 * n))
        for at in range(0, len(same), width):
            rows = np.stack([sketches[k] for k in same[at : at + width]])
            out[same[at : at + width]] = np.abs(rows.reshape(len(rows), fold, -1).sum(2, dtype=np.int32) - target).sum(1)
    return out


def unruled_classes(sketches: list[np.ndarray], size: np.ndarray, scheme: Scheme) -> np.ndarray:
    """For each set, the first set of its class: sets joined by pairs that neither sizes nor sketches rule out.

    Each set is compared with those not yet reached whose size may do, COMPARED_BYTES at a time. A full bucket no longer
    counts; sets that have one are ruled out by size alone.
    """
    n = len(size)
    full = np.array([bool((x == 255).any()) for x in sketches])
    by_size = np.argsort(size, kind="stable")
    ordered = size[by_size]
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        queue = [root]
        while queue:
            i = queue.pop()
            near = by_size[np.searchsorted(ordered, -(-size[i] * scheme.num // scheme.den)) : np.searchsorted(ordered, size[i] * scheme.den // scheme.num, side="right")]
            near = near[label[near] < 0]
            if not len(near):
                continue
            differ = _differences([sketches[k] for k in near], sketches[i])
            hit = near[full[i] | full[near] | (differ * (scheme.den + scheme.num) <= (size[near] + size[i]) * (scheme.den - scheme.num))]
            label[hit] = root
            queue += hit.tolist()
    return label


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _whole(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column)])


def sets_table(given: DataFrame, words: int, scheme: Scheme, buckets: int) -> DataFrame:
    """All that is made of the texts, in one pass over them. given: id (0 where it is null), known (whether it isn't), text.

    Rows of facts have id, known, n (shingles), f1 and f2 (fingerprint of the set) and its sketch; they are dealt evenly to
    the buckets. The others are the signatures of each batch of sets by bucket, packed: sigs with ids; every_sigs with
    every_ids; tie_a, tie_b.
    Where a batch has very many sets with one signature, only the smallest id carries it on, among every_sigs: it stands
    for all of them, to which it is tied.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("id", kind="stable")
            ids, known = frame["id"].to_numpy(np.int64), frame["known"].to_numpy(bool)
            sets = _frame_sets(frame, words)
            facts = {"id": ids, "known": known, "n": [len(s) for s in sets], "bucket": ((mix(ids.view(_U), 63) + np.arange(len(ids), dtype=_U)) % _U(buckets)).astype(np.int32), "fact": True, "sketch": [sketch(s).tobytes() for s in sets]}
            facts |= {f"f{k}": [int(mix(s, 40 + k).sum(dtype=_U).view(np.int64)) for s in sets] for k in (1, 2)}
            yield pd.DataFrame(facts).assign(**dict.fromkeys(PACKED))
            rows = _signature_rows(ids[known], [s for s, k in zip(sets, known, strict=True) if k], scheme, buckets)
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", *PACKED]).assign(**NO_FACT)

    return given.mapInPandas(run, f"bucket int, {FACTS}, " + ", ".join(f"{c} binary" for c in PACKED))


PACKED = ("sigs", "ids", "every_sigs", "every_ids", "tie_a", "tie_b")
FACTS = "fact boolean, id bigint, known boolean, n bigint, f1 bigint, f2 bigint, sketch binary"
NO_FACT = {"fact": False, "id": 0, "known": False, "n": 0, "f1": 0, "f2": 0, "sketch": None}


def _signature_rows(ids: np.ndarray, sets: list[np.ndarray], scheme: Scheme, buckets: int) -> list[tuple]:
    """The packed signatures of a batch by bucket; ids ascend."""
    owner, sig = signatures(sets, scheme)
    if not len(sig):
        return []
    by = np.lexsort((owner, sig))
    owner, sig = owner[by], sig[by]
    head = np.concatenate(([True], sig[1:] != sig[:-1]))
    at = np.flatnonzero(head)
    count = np.diff(np.concatenate((at, [len(sig)])))
    many = np.repeat(count > MAX_IN_BATCH, count)
    tied = np.unique(ids[np.stack((owner, np.repeat(owner[at], count)), 1)[many & ~head]], axis=0)
    every_sig, every_id = sig[many & head], ids[owner[many & head]]
    owner, sig = owner[~many], sig[~many]
    bucket = (sig % _U(buckets)).astype(np.int64)
    by = np.lexsort((owner, bucket))  # in order of owners, ids repeat and pack well
    owner, sig, bucket = owner[by], sig[by], bucket[by]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    to = (every_sig % _U(buckets)).astype(np.int64)
    tie_to = tied[:, 1] % buckets
    rows = []
    for k in np.unique(np.concatenate((bucket, to, tie_to))).tolist():
        own = slice(cut[k], cut[k + 1])
        rows.append((k, _blob(sig[own]), _blob(ids[owner[own]]), _blob(every_sig[to == k]), _blob(every_id[to == k]), _blob(tied[tie_to == k, 0]), _blob(tied[tie_to == k, 1])))
    return rows


def sharers_of(table: DataFrame, buckets: int) -> DataFrame:
    """Groups of sets that share a signature, packed by a bucket of their smallest id (near, lengths, members), and ties
    (tie_a, tie_b) of those that need no sketches. Of signatures with the same sharers, one is enough. Facts go through."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        facts = frame.loc[frame["fact"], list(NO_FACT)].assign(near=-2, lengths=None, members=None, tie_a=None, tie_b=None)
        frame = frame[~frame["fact"]]
        sig = np.concatenate((_whole(frame["sigs"], _U), _whole(frame["every_sigs"], _U)))
        ids, every_ids = _whole(frame["ids"], np.int64), _whole(frame["every_ids"], np.int64)
        every = np.concatenate((np.zeros(len(ids), bool), np.ones(len(every_ids), bool)))
        ids = np.concatenate((ids, every_ids))
        by = np.argsort(sig, kind="stable")
        sig = sig[by]
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)])
        count = np.diff(np.concatenate((at, [len(sig)])))
        shared = np.repeat(count > 1, count)
        by, group = by[shared], np.repeat(np.arange(len(at)), count)[shared]
        ids, every = ids[by], every[by]
        order = np.lexsort((ids, group))
        ids, every, group = ids[order], every[order], group[order]
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[: len(group)])
        count = np.diff(np.concatenate((at, [len(group)])))
        a, b = [_whole(frame["tie_a"], np.int64)], [_whole(frame["tie_b"], np.int64)]
        rows = []
        if len(at):
            loose = np.logical_or.reduceat(every, at) | (count > MAX_SHARERS)
            star = np.repeat(loose, count)
            a.append(ids[star])
            b.append(np.repeat(ids[at], count)[star])
            who = np.add.reduceat(mix(ids.view(_U), 61), at) + count.astype(_U)
            _, one = np.unique(np.where(loose, _U(0), who), return_index=True)
            one = one[~loose[one]]
            near = (mix(ids[at[one]].view(_U), 62) % _U(buckets)).astype(np.int64)
            by = np.argsort(near, kind="stable")
            one, near = one[by], near[by]
            cut = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1], [True]))) if len(one) else np.zeros(0, np.int64)
            for x, y in zip(cut, cut[1:], strict=False):
                n, first = count[one[x:y]], at[one[x:y]]
                rows.append((int(near[x]), _blob(n.astype(np.int32)), _blob(ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]), b"", b""))
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((a, b), 1)[a != b], axis=0)
        if len(pairs):
            rows.append((-1, b"", b"", _blob(pairs[:, 0]), _blob(pairs[:, 1])))
        found = pd.DataFrame(rows, columns=["near", "lengths", "members", "tie_a", "tie_b"]).assign(**NO_FACT)
        return pd.concat([x for x in (facts, found) if len(x)]) if len(facts) or len(found) else found

    return table.groupBy("bucket").applyInPandas(run, f"near int, lengths binary, members binary, tie_a binary, tie_b binary, {FACTS}")


def ties_of(groups: DataFrame, facts: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: ties between sets that share signatures. groups: those of sharers_of."""

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"a": _whole(frame["tie_a"], np.int64), "b": _whole(frame["tie_b"], np.int64)})

    def members(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(_whole(frame["members"], np.int64))
        return pd.DataFrame({"near": np.full(len(ids), frame["near"].iloc[0]), "id": ids})

    def unruled(frame: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        sets = sets.drop_duplicates().sort_values("id", kind="stable")
        twice = set(sets.loc[sets["id"].duplicated(), "id"])  # one id with several texts: nothing is ruled out
        sets = sets.drop_duplicates("id")
        known, sizes = sets["id"].to_numpy(np.int64), sets["size"].to_numpy(np.int64)
        sketches = [np.full(16, 255, np.uint8) if i in twice else np.frombuffer(x, np.uint8) for i, x in zip(sets["id"], sets["sketch"], strict=True)]
        # the sets that share a signature with one smallest id are looked at together, each pair once
        families: dict[int, list[np.ndarray]] = {}
        for lengths, ids in zip(frame["lengths"], frame["members"], strict=True):
            ends = np.cumsum(np.frombuffer(lengths, np.int32))
            ids = np.frombuffer(ids, np.int64)
            for a, b in zip(np.concatenate(([0], ends)), ends, strict=False):
                families.setdefault(int(ids[a]), []).append(ids[a:b])
        out = []
        for found in families.values():
            own = np.unique(np.concatenate(found))
            at = np.searchsorted(known, own)
            label = unruled_classes([sketches[k] for k in at], sizes[at], scheme)
            out.append(np.stack((own, own[label]))[:, own != own[label]])
        pairs = np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    packed = groups.filter("near >= 0").select("near", "lengths", "members")
    wanted = packed.select("near", "members").groupBy("near").applyInPandas(members, "near int, id bigint")
    sets = wanted.join(facts.select("id", F.col("n").alias("size"), "sketch"), "id")
    close = packed.groupBy("near").cogroup(sets.groupBy("near")).applyInPandas(unruled, "a bigint, b bigint")
    return close.unionByName(groups.filter("near = -1").select("tie_a", "tie_b").mapInPandas(plain, "a bigint, b bigint"))


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links (the id itself if none)."""
    bounded_batches(docs.sparkSession)
    scheme = Scheme(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = parts_for(text_bytes(texts), BUCKET_BYTES)
    known = F.col("id").isNotNull()
    given = texts.select(F.coalesce("id", F.lit(0)).alias("id"), known.alias("known"), "text")
    # the texts are read once, and their sets' facts and signatures go through one exchange
    sets = materialize(sharers_of(sets_table(given, words, scheme, buckets), buckets), "shingle-sets")
    facts = sets.filter("fact").select(F.when(F.col("known"), F.col("id")).alias("id"), "n", "f1", "f2", "sketch")
    leaders = facts.filter("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("leader"), F.count("*").alias("rows"))
    groups = components(ties_of(sets.filter("not fact"), facts, scheme))

    # of equal sets, only the one with the smallest id goes on
    ones = leaders.join(groups.withColumnRenamed("component", "grp"), F.col("leader") == F.col("id")).select("id", "n", "grp")
    totals = ones.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("load"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int")
    several = totals.filter("members > 1").select("grp", blocks.alias("blocks"))
    placed = ones.join(several, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")), lambda b: F.least(b, F.col("block")) * F.col("blocks") + F.greatest(b, F.col("block")))
    )
    placed = materialize(placed.select("id", "grp", "blocks", "block"), "placed")
    discard(groups)
    meetings = texts.join(few_ids(placed), "id").select("id", "grp", "blocks", "text", F.explode(pairs).alias("pair"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        sets = [shingles(t if isinstance(t, str) else None, words) for t in frame["text"]]
        ids = frame["id"].to_numpy()
        label = classes(sets, scheme)
        hit = ids != ids[label]
        return pd.DataFrame({"a": ids[hit], "b": ids[label][hit], "whole": (frame["blocks"] == 1).to_numpy()[hit]})

    links = materialize(meetings.groupBy("grp", "pair").applyInPandas(link, "a bigint, b bigint, whole boolean"), "links")
    discard(placed)
    # groups of one block are settled; what the blocks of larger ones have found is put together
    pieced = components(links.filter("not whole").select("a", "b"))
    found = links.filter("whole").select(F.col("a").alias("leader"), F.col("b").alias("component"))
    found = found.unionByName(pieced.filter("id <> component").select(F.col("id").alias("leader"), "component"))
    # only classes of several rows, or linked to a smaller one, have a component that isn't the row's own id
    final = leaders.join(found, "leader", "left").filter("rows > 1 or component is not null")
    final = materialize(final.select("n", "f1", "f2", "rows", F.coalesce("component", "leader").alias("component")), "classes")
    discard(links)
    discard(pieced)
    row = facts.select("id", "n", "f1", "f2")
    open_ = (F.col("n") > 0) & F.col("id").isNotNull()
    key = ["n", "f1", "f2"]
    # classes of very many rows are no key of a shuffle
    hot = final.filter(F.col("rows") > max(HOT_ROWS, facts.count() // HOT_CLASSES)).drop("rows")
    out = row.filter(~open_).withColumn("component", F.col("id"))
    out = out.unionByName(row.filter(open_).join(F.broadcast(hot), key).select("id", *key, "component"))
    others = row.filter(open_).join(F.broadcast(hot.select(*key)), key, "left_anti").join(final.drop("rows"), key, "left")
    out = out.unionByName(others.select("id", *key, F.coalesce("component", "id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
