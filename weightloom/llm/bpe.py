"""Byte-level BPE by ranks: encoding and decoding.

A pre-token is looked up in two tiers. A minimal perfect hash (hash and displace) over the vocabulary
resolves pre-tokens that are tokens themselves; the others go through a heap of candidate merges over
linked bytes, O(n log n) in the pre-token's bytes. What was resolved lately is remembered in two
generations of bounded number, pre-tokens over LONGEST bytes excepted, so memory doesn't grow with the corpus.

Null texts count as empty; an empty text has no ids; a very long one is encoded whole. Of equal ranks the leftmost pair merges first. Repeated rows give repeated results, extra input
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightloom.llm.common import ship, slices, spread

#: Pre-tokens in one generation of the memory.
GENERATION = 250_000
#: Bytes of the longest pre-token that is remembered.
LONGEST = 64
#: Odd multipliers that mix a hash with a displacement.
SALT, MIX, _64 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots, one displacement for each bucket.

    A key's 64-bit hash names its bucket; mixed anew with the bucket's displacement, it picks the slot.
    Buckets are placed by falling size; buckets of one key hold their slot itself, as its complement.
    """

    def __init__(self, keys: list[bytes], load: int = 4):
        n = self.n = max(1, len(keys))
        m = self.m = max(1, n // load)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("keys aren't distinct")
        bucket = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(m + 1))
        sizes = np.diff(edges)
        taken, displaced, slot_of = np.zeros(n, bool), np.zeros(m, np.int64), np.zeros(len(keys), np.int64)
        free = None
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                slots = np.array([next(free)])
                displaced[b] = ~slots[0]
            else:
                tried = 0
                while True:
                    d = np.arange(tried, tried + 64, dtype=np.uint64)[:, None]
                    table = (((hashes[members] ^ (d * np.uint64(SALT))) * np.uint64(MIX)) >> np.uint64(32)) % np.uint64(n)
                    fits = ~taken[table.astype(np.int64)].any(axis=1)
                    fits &= (np.diff(np.sort(table, axis=1), axis=1) != 0).all(axis=1)
                    if fits.any():
                        hit = int(np.argmax(fits))
                        slots = table[hit].astype(np.int64)
                        displaced[b] = tried + hit
                        break
                    tried += 64
            taken[slots] = True
            slot_of[members] = slots
        self.displaced = displaced.tolist()
        self.keys: list[bytes] = [b""] * n
        self.index = [-1] * n
        for k, slot in enumerate(slot_of.tolist()):
            self.keys[slot], self.index[slot] = keys[k], k

    def find(self, key: bytes) -> int:
        """The key's number in the list it was built from, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displaced[h % self.m]
        slot = ~d if d < 0 else ((((h ^ (d * SALT & _64)) * MIX) & _64) >> 32) % self.n
        return self.index[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int], parts: bool = False) -> list:
    """Ids of one pre-token, or its parts: the pair of the lowest rank is merged first, of equal ranks the leftmost."""
    n, rank_of = len(piece), ranks.get
    if n < 2:
        return [piece if parts else ranks[piece]] if n else []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    best = [-1] * n
    heap = []
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            best[i] = r
            heap.append(r * n + i)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        r, i = divmod(pop(heap), n)
        if best[i] != r:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        best[gone] = -1
        if end < n:
            before[end] = i
            r = rank_of(piece[i : after[end]])
            if r is None:
                best[i] = -1
            else:
                best[i] = r
                push(heap, r * n + i)
        else:
            best[i] = -1
        p = before[i]
        if p >= 0:
            r = rank_of(piece[p:end])
            if r is None:
                best[p] = -1
            else:
                best[p] = r
                push(heap, r * n + p)
    ends, i = [], 0
    while i < n:
        ends.append((i, after[i]))
        i = after[i]
    return [piece[a:b] for a, b in ends] if parts else [ranks[piece[a:b]] for a, b in ends]


class Resolved(dict):
    """Pre-token to packed ids; what is missing is resolved by the tiers, and the older generation is dropped in time."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, ids: list[int], limit: int):
        super().__init__()
        self.ranks, self.table, self.ids, self.limit, self.older = ranks, table, ids, limit, {}

    def __missing__(self, token: str) -> bytes:
        packed = self.older.get(token)
        if packed is None:
            raw = token.encode()
            k = self.table.find(raw)
            found = [self.ids[k]] if k >= 0 else merge(raw, self.ranks)
            packed = np.array(found, "<u4").tobytes()
            if len(raw) > LONGEST:
                return packed
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[token] = packed
        return packed


class Codec:
    """Encoder and decoder for a file of base64 tokens and ranks and a pre-token pattern."""

    def __init__(self, path: str, pattern: str, generation: int = GENERATION):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        keys = list(self.ranks)
        self.split = regex.compile(pattern).findall
        self.resolved = Resolved(self.ranks, PerfectHash(keys), list(self.ranks.values()), generation)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, r in self.ranks.items():
            self.tokens[r] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.resolved.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids): every text's ids as packed little-endian unsigned 32-bit integers. No shuffle, unless the input has fewer splits than cores."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole):
                ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    out = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows (key, decoded): the bytes that packed ids stand for. Null ids count as empty."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            found = [c.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.binary())], ["key", "decoded"])

    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded binary")
    return out.withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass over the texts, without moving the ids."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole):
                rows = []
                for t in b.column("text").to_pylist():
                    ids = c.encode(t or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
