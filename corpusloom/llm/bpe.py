"""Encoding of whole texts by a public byte-level BPE vocabulary, with a pair occurrence index.

A partition is encoded in blocks of BLOCK_CHARS characters. The distinct words of a block lie one after the other in
one array of symbols, linked to their neighbours. An index maps each pair that has a rank to all its positions; ranks are
applied in ascending order, each to all its positions at once, and only the pairs at the merged places are looked
up anew. A merge can only give rise to pairs of a higher rank, so one pass upwards is the whole encoding.

The vocabulary (50 k merges, whatever the data) is broadcast as arrays; its path is a parameter. No row leaves its
partition: there is no shuffle.

Cases: null and empty text give an empty list. Strings of special tokens in a text are ordinary text. Texts of any
length are encoded whole; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BLOCK_CHARS = 2_000_000
#: How byte_bpe files split a text before merging (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return letters


class Vocabulary:
    """bytes_: id of each byte; pairs: sorted (left << 32 | right); rank and new: rank and new id of each pair, in that order."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids, merges = model["vocab"], model["merges"]
        self.bytes_ = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.bytes_[b] = ids[letter]
        halves = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([ids[h[i]] for h in halves], np.int64) for i in (0, 1))
        new = np.array([ids[a + b] for a, b in halves], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.pairs, self.rank, self.new_of_rank = keys[order], order.astype(np.int32), new
        self.left_of_rank, self.right_of_rank = left.astype(np.int32), right.astype(np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], -1)


def _leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of ascending places of a pair (x, x), those that merge: every other one of each run, from the left."""
    joined = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
    i = np.arange(len(at))
    start = np.maximum.accumulate(np.where(joined, 0, i))
    return at[(i - start) % 2 == 0]


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all words, and the offsets of each word in them."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    sym = v.bytes_[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    ends = np.cumsum(lens)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    nxt[ends[lens > 0] - 1] = n  # n: none
    prv = np.full(n + 1, -1, np.int64)
    inner = nxt[:n] < n
    prv[nxt[inner]] = np.flatnonzero(inner)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        """Put the pairs that begin at these places into the index."""
        r = v.ranks(sym[at], sym[nxt[at]])
        at, r = at[r >= 0], r[r >= 0]
        if len(at):
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for rank, places in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if rank in index:
                    index[rank].append(places)
                else:
                    index[rank] = [places]
                    heapq.heappush(heap, rank)

    note(np.flatnonzero(inner))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        a, b = v.left_of_rank[rank], v.right_of_rank[rank]
        at = at[(sym[at] == a) & (nxt[at] < n)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:
            at = _leftmost(at, nxt)
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = v.new_of_rank[rank]
        sym[gone] = -1
        nxt[at] = after
        prv[after] = at  # prv[n] is a bin
        before = prv[at]
        both = np.concatenate([before[before >= 0], at[after < n]])
        if len(both):
            note(np.unique(both))
    live = sym >= 0
    counts = np.concatenate([[0], np.cumsum(live)])
    offsets = counts[np.concatenate([[0], ends])]
    return sym[live].astype(np.int32), offsets


def encode_block(texts: list[str | None], v: Vocabulary, split) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the offsets of each text."""
    number: dict[str, int] = {}
    words = [split(t) if t else () for t in texts]
    which = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    per_text = np.fromiter(map(len, words), np.int64, len(words))
    if not len(which):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    ids, offsets = merge_words([w.encode("utf-8") for w in number], v)
    size = np.diff(offsets)[which]
    ends = np.cumsum(size)
    take = np.repeat(offsets[which] - (ends - size), size) + np.arange(ends[-1])
    text_ends = np.concatenate([[0], np.cumsum(per_text)])
    return ids[take], np.concatenate([[0], ends])[text_ends]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id_col, ids ARRAY<INT>): one row per row of ``df``, in its partition."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, v = regex.compile(PATTERN).findall, shared.value

        def done(keys: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
            ids, offsets = encode_block(texts, v, split)
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), out], names=[id_col, "ids"])

        keys, texts, chars = [], [], 0
        for batch in batches:
            start = 0
            column = batch.column(1).to_pylist()
            for i, t in enumerate(column):
                chars += len(t or "")
                texts.append(t)
                if chars >= BLOCK_CHARS:
                    yield done([*keys, batch.column(0).slice(start, i + 1 - start)], texts)
                    keys, texts, chars, start = [], [], 0, i + 1
            if start < len(column):
                keys.append(batch.column(0).slice(start))
        if keys:
            yield done(keys, texts)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
