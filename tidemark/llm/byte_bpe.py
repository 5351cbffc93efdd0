"""Byte-level BPE over ranks, with a hierarchical bitmap as the rank queue.

All words of a batch that are new to the worker are merged in one run. Their bytes form one linked list in which
words do not touch. Each rank has a bucket of list positions; a bitmap of 64-bit words over the ranks, and two
levels of bitmaps above it, find the lowest rank that has work by find-first-set. A bucket's entry is stale if its
position is gone or now begins another pair, and is skipped then. A word of n bytes costs O(n) queue steps, so that
words of a million bytes are no different from short ones.

Edge cases: null and empty texts have no ids; every text of any length decodes to its own bytes; rows that share a
doc_id, equal ones too, and rows with a null doc_id stay separate rows; an empty table gives no rows; other columns,
of whatever name, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import SPACED, UNUSUAL, probes

#: Words that a worker remembers, and the longest of them in characters, so that the cache is bounded in bytes.
CACHED_WORDS, LONGEST_CACHED = 600_000, 64


class RankQueue:
    """Buckets of positions by rank, and which bucket is the lowest."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Give a rank that has no bucket one."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        """Remove the lowest rank; its positions in ascending order. (-1, []) at the end."""
        if not self.top:
            return -1, []
        b = (self.top & -self.top).bit_length() - 1
        x = self.mid[b]
        a = b << 6 | (x & -x).bit_length() - 1
        x = self.low[a]
        rank = a << 6 | (x & -x).bit_length() - 1
        self.low[a] = x = x & (x - 1)
        if not x:
            self.mid[b] = x = self.mid[b] & (self.mid[b] - 1)
            if not x:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(r): base64.b64decode(t) for t, r in pairs}
        ranks = {t: r for r, t in self.tokens.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # (left id << 32 | right id) -> rank, filled as pairs are met: a pair's rank is that of its joined bytes.
        self.ranks, self.pairs = ranks, {}
        self.pattern = regex.compile(pattern)
        # The short pattern serves plain texts if it splits every plain character as the given one does.
        self.short = all(SPACED.findall(t) == self.pattern.findall(t) for t in probes())
        self.words: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return (SPACED.findall if self.short and UNUSUAL.search(text) is None else self.pattern.findall)(text)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        # One list over all words; a place of -1 after each, so that no pair spans two.
        flat = np.full(sum(map(len, data)) + len(data), -1, dtype=np.int64)
        ends = np.cumsum([len(d) + 1 for d in data]) - 1
        flat[np.delete(np.arange(len(flat)), ends)] = self.byte_ids[np.frombuffer(b"".join(data), dtype=np.uint8)]
        n, queue = len(flat), RankQueue()
        pairs, buckets, rank_of = self.pairs, queue.buckets, self.rank_of
        keys, which = np.unique(flat[:-1] << 32 | flat[1:], return_inverse=True)
        first = np.array([rank_of(k) if k >= 0 and k & 0xFFFFFFFF < 1 << 31 else -1 for k in keys.tolist()], dtype=np.int64)[which]
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[at], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            queue.open(int(first[at[a]]), at[a:b].tolist())
        ids, begins = flat.tolist(), [*first.tolist(), -1]  # begins: the rank of the pair that begins here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            rank, bucket = queue.take()
            if rank < 0:
                break
            left = rank << 32
            for k, i in enumerate(bucket):
                if begins[i] != rank:
                    continue  # stale
                gone = after[i]
                after[i] = right = after[gone]
                before[right] = i
                ids[i], ids[gone], begins[gone], lower = rank, -2, -1, False
                x = ids[right]
                if x >= 0:
                    new = pairs.get(left | x)
                    if new is None:
                        new = rank_of(left | x)
                    begins[i] = new
                    if new >= 0:
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                else:
                    begins[i] = -1
                p = before[i]
                if p >= 0 and (x := ids[p]) >= 0:
                    new = pairs.get(x << 32 | rank)
                    if new is None:
                        new = rank_of(x << 32 | rank)
                    begins[p] = new
                    if new >= 0:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            queue.open(new, [p])
                if lower:  # the merge made a pair that goes first
                    if k + 1 < len(bucket):
                        queue.open(rank, bucket[k + 1 :])
                    break
        flat = np.array(ids, dtype=np.int64)
        out = flat[flat >= 0].astype("<u4").tobytes()
        counts = np.cumsum(flat >= 0)[ends] * 4
        return [out[a:b] for a, b in zip([0, *counts[:-1].tolist()], counts.tolist(), strict=True)]

    def rank_of(self, pair: int) -> int:
        """The rank of the joined bytes of (left id << 32 | right id), or -1."""
        rank = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        if len(self.pairs) < 2_000_000:
            self.pairs[pair] = rank
        return rank

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words are merged once a batch, and the shorter ones are remembered."""
        split = [self.split(t) for t in texts]
        known = self.words
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list({w for words in split for w in words})
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            known.update(zip(part, self.merge(part), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for doc, texts in _blocks(batches):
            ids = [np.frombuffer(x, dtype="<i4") for x in bpe.encode([t or "" for t in texts])]
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of the ids in encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for doc, lists in _blocks(batches):
            data = [bpe.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in lists]
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for doc, texts in _blocks(batches):
            ids = bpe.encode([t or "" for t in texts])
            yield pa.record_batch(
                [
                    pa.array(doc, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
