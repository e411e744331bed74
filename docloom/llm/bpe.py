"""Byte-level BPE of whole corpora with numpy, from a public rank file.

A batch of texts is cut by the vocabulary's own split pattern; each distinct word is encoded once and looked up afterwards.
Words to encode lie as rows of padded integer matrices, one matrix for each length bucket. Every round each row merges its
leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table, and rows without a pair left are taken out
(compaction). Words are cut beforehand between bytes that stand side by side in no vocabulary entry, in their context: no
merge can ever span such a place, so the result is the same and e.g. Chinese runs fall into characters.

Special tokens don't exist here: their strings are ordinary text. Empty and null texts have no ids (an empty list).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F

#: The split pattern that goes with the rank files, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file, a parameter of every function here; it is never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words that a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
NONE = np.int32(2**31 - 1)
#: Longer pieces (no place to cut in so many bytes) are merged one by one with a heap, whose time isn't quadratic.
LONG_PIECE = 512


class PairTable:
    """Hash table from a pair of ids to the id of their merge, open addressing with linear probing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NONE, np.int32)
        left = np.arange(len(pairs))
        at = self._home(pairs)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == -1
            spot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[spot], self.values[spot] = pairs[won], merged[won]
            lost = self.keys[at] != pairs[left]
            left, at = left[lost], (at[lost] + 1) & (self.size - 1)

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.size - 1)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge of each pair, NONE where there is none; negative ids never merge."""
        pairs = (left.astype(np.int64) << 20) | right
        out = np.full(pairs.shape, NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(pairs.ravel()[open_])
        want, flat = pairs.ravel()[open_], out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            there = self.keys[at]
            hit = there == want
            flat[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there != -1)
            open_, want, at = open_[go], want[go], (at[go] + 1) & (self.size - 1)
        return out


class ByteBPE:
    """Encoder for one rank file; ids are the ranks."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, merged = [], []
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    merged.append(rank)
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = True
            for i in range(2, len(token)):
                self.three[token[i - 2] << 16 | token[i - 1] << 8 | token[i]] = True
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.merges: dict[int, int] | None = None
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids (padded with -1) and their number for each row of a padded matrix of ids."""
        n, width = rows.shape
        out, size = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        live, ids = np.arange(n), rows.astype(np.int32)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), NONE, np.int32)
        while len(live):
            if rank.shape[1]:
                j = rank.argmin(1)
                best = rank[np.arange(len(live)), j]
                done = best == NONE
            else:
                done = np.ones(len(live), bool)
            if done.any():
                out[live[done], : ids.shape[1]] = ids[done]
                size[live[done]] = (ids[done] >= 0).sum(1)
                live, ids, rank = live[~done], ids[~done], rank[~done]
                if not len(live):
                    break
                j, best = j[~done], best[~done]
            r, cols = np.arange(len(live)), np.arange(ids.shape[1] - 1)
            shifted = np.where(cols[None, :] > j[:, None], ids[:, 1:], ids[:, :-1])
            shifted[r, j] = best
            ranks = np.where(cols[None, :-1] > j[:, None], rank[:, 1:], rank[:, :-1])
            ids, rank = shifted, ranks
            if rank.shape[1]:
                before = j > 0
                rank[r[before], j[before] - 1] = self.pairs.get(ids[r[before], j[before] - 1], ids[r[before], j[before]])
                after = j < rank.shape[1]
                rank[r[after], j[after]] = self.pairs.get(ids[r[after], j[after]], ids[r[after], j[after] + 1])
        return out, size

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        if self.merges is None:
            full = self.pairs.keys >= 0
            self.merges = dict(zip(self.pairs.keys[full].tolist(), self.pairs.values[full].tolist()))
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def _pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, flat ids) of byte pieces, through length buckets of padded matrices."""
        counts, chunks, order = np.zeros(len(starts), np.int64), [], []
        bucket = np.where(sizes <= 16, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        long = np.flatnonzero(sizes > LONG_PIECE)
        for row in long:
            done = self._merge_long(self.byte_id[data[starts[row] : starts[row] + sizes[row]]].tolist())
            counts[row] = len(done)
            chunks.append(np.array(done, np.int32))
            order.append(np.array([row]))
        bucket[long] = 0
        for width in np.unique(bucket[bucket > 0]):
            rows = np.flatnonzero(bucket == width)
            for part in np.array_split(rows, -(-len(rows) * int(width) // 2_000_000)):
                at = np.arange(width)[None, :]
                inside = at < sizes[part][:, None]
                ids = np.where(inside, self.byte_id[data[np.minimum(starts[part][:, None] + at, len(data) - 1)]], -1)
                done, n = self._merge(ids)
                counts[part] = n
                chunks.append(done[done >= 0])
                order.append(part)
        if not chunks:
            return counts, np.zeros(0, np.int32)
        # bring the flat ids from bucket order into the order of the pieces
        turn, flat = np.concatenate(order), np.concatenate(chunks)
        begin = np.zeros(len(starts), np.int64)
        begin[turn] = np.concatenate([[0], np.cumsum(counts[turn])[:-1]])
        return counts, flat[_spread(begin, counts)]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        wide = data.astype(np.int64)
        pad = np.concatenate([[0, 0], wide, [0, 0]])
        # a place before byte i is safe if no entry holds bytes i-1 and i side by side, seen with one byte of context
        spans = self.two[pad[1:-3] << 8 | pad[2:-2]] | self.three[pad[:-4] << 16 | pad[1:-3] << 8 | pad[2:-2]] | self.three[pad[1:-3] << 16 | pad[2:-2] << 8 | pad[3:-1]]
        cut = ~spans
        cut[begin] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        text = data.tobytes()
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(text[a : a + n], len(seen)) for a, n in zip(starts.tolist(), sizes.tolist())), np.int64, len(starts))
        first = np.zeros(len(seen), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        counts, flat = self._pieces(data, starts[first], sizes[first])
        offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
        new = flat[_spread(offset[which], counts[which])]
        word = np.add.reduceat(counts[which], np.searchsorted(starts, begin))
        base = len(self.flat)
        self.starts = np.concatenate([self.starts, base + np.concatenate([[0], np.cumsum(word)[:-1]])])
        self.sizes = np.concatenate([self.sizes, word])
        self.flat = np.concatenate([self.flat, new])
        for w in words:
            self.known[w] = len(self.known)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and the number under which each word is known."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self._reset()
        every = list(chain.from_iterable(words))
        fresh = [w for w in dict.fromkeys(every) if w not in self.known]
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another)."""
        n, word = self._words(texts)
        sizes = self.sizes[word]
        return _per_text(sizes, n), self.flat[_spread(self.starts[word], sizes)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        n, word = self._words(texts)
        return _per_text(self.sizes[word], n)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _per_text(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


_encoders: dict[str, ByteBPE] = {}


def encoder(vocabulary: str) -> ByteBPE:
    """The worker's encoder for a rank file, made once in each Python process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ByteBPE(vocabulary)
    return _encoders[vocabulary]


def _slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each, so that long texts don't fill the memory together."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right"))
        b = max(a + 1, b)
        yield a, b
        a = b


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, every row of ``df`` exactly once; no shuffle.

    Null and empty texts get an empty list. Equal rows stay as they are. Other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for a, b in _slices(batch, "__text"):
                part = batch.slice(a, b - a)
                n, ids = bpe.encode(part.column("__text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("__key"), lists], ["__key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {kind}, ids array<int>").withColumnRenamed("__key", key)


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` of every row and the number of its text's ids (0 for null and empty)."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary)
        for s in batches:
            yield pd.Series(bpe.count([None if x is None or x != x else x for x in s]), dtype="int64")

    return df.select(*keep, count(text).alias(name))
