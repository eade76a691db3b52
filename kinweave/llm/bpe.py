"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition (in chunks of bounded size) form one flat array of symbols. An index maps
every adjacent pair to all its positions in that array. Active ranks are applied in ascending order; a merge is
applied to all positions of its pair at once, and only the lists of the neighbouring pairs are updated. A merge
can only create pairs of higher rank, so one ascending sweep gives the same symbols as merging word by word.

Nulls encode as the empty text; empty texts give no ids. Repeated rows are encoded each. Very long texts are cut
where white space follows something else, which no pre-token spans, so memory follows the piece and not the text.
Columns of the input besides the id and the text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, bounded_batches

#: Distinct pre-tokens encoded together, and kept before the index starts afresh.
CHUNK_WORDS = 150_000
CACHE_WORDS = 250_000
#: Longest stretch of a text that is pre-tokenized at once.
PIECE_CHARS = 1 << 20

# The pre-tokenizer's pattern and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)))


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 stays, the others follow from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(free)) for b in range(256)]


def _category_ranges(first: str) -> str:
    """A character class with every code point whose general category begins with `first`."""
    spans: list[list[int]] = []
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] == first:
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class PreTokenizer:
    """Splits text into pre-tokens. Latin-1 text takes a short pattern, other text explicit Unicode classes."""

    def __init__(self) -> None:
        self.latin = regex.compile(PATTERN)
        self._full: re.Pattern | None = None

    @property
    def full(self) -> re.Pattern:
        if self._full is None:
            letters, numbers, ws = _category_ranges("L"), _category_ranges("N"), WHITE_SPACE
            self._full = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{ws}{letters}{numbers}]+|[{ws}]+(?![^{ws}])|[{ws}]+")
        return self._full

    def pieces(self, text: str) -> Iterator[str]:
        """The text in stretches that end where white space follows something else."""
        at, n = 0, len(text)
        while n - at > PIECE_CHARS:
            cut = re.compile(rf"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]").search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return self.full.findall(text)


class _Numbered(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE tokenizer file, and the encoder that applies them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merge_left, self.merge_right = left, right
        self.merge_to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.pre = PreTokenizer()
        self.forget()

    def forget(self) -> None:
        """Drop the words known so far."""
        self.words = _Numbered()
        self.done = 0
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair is no merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word starts, by the pair occurrence index."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        # a gap of one closes every word, so that no pair spans two words
        start = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lens + 1, out=start[1:])
        sym = np.full(int(start[-1]) + 1, -1, np.int64)
        taken = np.ones(int(start[-1]), bool)
        taken[start[1:] - 1] = False
        sym[:-1][taken] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1] = n - 1
        prv[0] = n - 1

        occurs: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            ranks = self._ranks(sym[at], sym[nxt[at]])
            hit = ranks >= 0
            if not hit.any():
                return
            at, ranks = at[hit], ranks[hit]
            if len(at) > 1:
                by = np.argsort(ranks, kind="stable")
                at, ranks = at[by], ranks[by]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                lists, first = np.split(at, cuts), ranks[np.concatenate(([0], cuts))].tolist()
            else:
                lists, first = [at], ranks.tolist()
            for rank, found in zip(first, lists, strict=True):
                if rank in occurs:
                    occurs[rank].append(found)
                else:
                    occurs[rank] = [found]
                    heapq.heappush(active, rank)

        index(np.flatnonzero(sym[:-1] >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            lists = occurs.pop(rank)
            a, b, new = int(self.merge_left[rank]), int(self.merge_right[rank]), int(self.merge_to[rank])
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            follow = nxt[at]
            hit = (sym[at] == a) & (sym[follow] == b)
            at, follow = at[hit], follow[hit]
            if a == b and len(at) > 1:  # of overlapping occurrences, every second one from the left
                head = np.concatenate(([True], follow[:-1] != at[1:]))
                run = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                at, follow = at[run % 2 == 0], follow[run % 2 == 0]
            if not len(at):
                continue
            sym[at] = new
            sym[follow] = -2
            after = nxt[follow]
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            index(np.unique(np.concatenate((at, before))) if len(at) > 1 else np.concatenate((before, at)))
        alive = sym[:-1] >= 0
        counts = np.add.reduceat(alive, start[:-1]) if len(raw) else np.zeros(0, np.int64)
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        return sym[:-1][alive].astype(np.int32), at

    def _learn(self) -> None:
        """Encode the words seen since the last call."""
        if self.done < len(self.words):
            new = list(self.words)[self.done :] if self.done else list(self.words)
            for k in range(0, len(new), CHUNK_WORDS):
                flat, start = self.encode_words(new[k : k + CHUNK_WORDS])
                self.flat = np.concatenate((self.flat, flat))
                self.start = np.concatenate((self.start, self.start[-1] + start[1:]))
            self.done = len(self.words)

    def number(self, text: str | None) -> list[np.ndarray]:
        """The text as word numbers; specials are negative."""
        out = []
        number = self.words.__getitem__
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                out.append(np.array([-1 - self.special[part]], np.int32))
            elif part:
                for piece in self.pre.pieces(part):
                    found = self.pre.words(piece)
                    out.append(np.fromiter(map(number, found), np.int32, len(found)))
        return out

    def ids(self, numbered: list[np.ndarray]) -> np.ndarray:
        """Ids of a numbered text."""
        out = []
        for w in numbered:
            if len(w) and w[0] < 0:
                out.append(-1 - w)
                continue
            lens = self.start[w + 1] - self.start[w]
            ends = np.cumsum(lens)
            out.append(self.flat[np.repeat(self.start[w] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        numbered = [self.number(t) for t in texts]
        self._learn()
        return [self.ids(x) for x in numbered]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _held(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Frames joined until they hold about `limit` characters, so that many words are encoded at once."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += int(frame["text"].str.len().fillna(0).sum())
        if size >= limit:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False, digests: bool = False, carry: tuple[str, ...] = (), hold_chars: int = 2_500_000) -> DataFrame:
    """Encode every whole text, then decode its ids again.

    Returns the id column, `carry`, n_tokens, and as asked: ids (array<int>), decoded (string), ids_sha256 and
    decoded_sha256 (digests of the ids as little-endian unsigned 32-bit integers and of the decoded text).
    `tokenizer` is the path of a byte-level BPE file, readable on every executor. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    through = Carried(docs, (id_col, *carry))
    made = ["n_tokens bigint"] + ["ids array<int>"] * with_ids + ["decoded string"] * with_text + ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBPE(tokenizer)
        for frame in _held(frames, hold_chars):
            ids = bpe.encode_batch([t if isinstance(t, str) else None for t in frame["text"]])
            out = frame[through.names].copy()
            out["n_tokens"] = [len(x) for x in ids]
            if with_ids:
                out["ids"] = [x.astype(np.int32) for x in ids]
            if with_text:
                out["decoded"] = [bpe.decode(x) for x in ids]
            if digests:
                out["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield out

    given = docs.select(*through.given(), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInPandas(run, ", ".join([*through.kinds(), *made])).select(*through.restored(), *[m.split(" ")[0] for m in made])
