"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one is a minimal perfect hash over the vocabulary that resolves whole pre-tokens; tier two merges the bytes of
the others, a heap giving the lowest rank and links giving each piece's neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Splitter, slices


#: Odd multipliers of the displacement.
STEP, MIX, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash by displacement: half of a key's 128-bit hash picks its bucket, and the bucket's stored seed
    sends all its keys to free slots of a table as large as the key set. A bucket of one key stores its slot (negative)."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4, seeds: int = 512):
        n = self.size = len(keys)
        self.buckets = max(1, n // per_bucket)
        both = np.array([divmod(xxhash.xxh128_intdigest(k), 1 << 64) for k in keys], np.uint64).reshape(n, 2)
        high, where = both[:, 0], both[:, 1] % np.uint64(self.buckets)
        order = np.argsort(where, kind="stable")
        groups = np.split(order, np.searchsorted(where[order], np.arange(1, self.buckets).astype(np.uint64)))
        self.seed, slot_key, free = [0] * self.buckets, np.full(n, -1), None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) < 2:
                if free is None:
                    free = np.flatnonzero(slot_key < 0).tolist()
                if len(group):
                    slot_key[s := free.pop()] = group[0]
                    self.seed[b] = -s - 1
                continue
            first = 0
            while True:
                tried = np.arange(first, first + seeds, dtype=np.uint64)[:, None]
                x = high[group] + tried * np.uint64(STEP)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
                slots = (x >> np.uint64(32)) % np.uint64(n)
                good = (slot_key[slots] < 0).all(1)
                lines = np.sort(slots[good], 1)
                lone = np.flatnonzero((lines[:, 1:] != lines[:, :-1]).all(1))
                if lone.size:
                    k = np.flatnonzero(good)[lone[0]]
                    slot_key[slots[k]] = group
                    self.seed[b] = first + int(k)
                    break
                first += seeds
        self.slot_key = slot_key.tolist()

    def slot(self, key: bytes) -> int:
        """The slot of a key of the set; some slot for any other."""
        high, low = divmod(xxhash.xxh128_intdigest(key), 1 << 64)
        seed = self.seed[low % self.buckets]
        if seed < 0:
            return -seed - 1
        x = high + seed * STEP & WORD
        return (((x ^ x >> 29) * MIX & WORD) >> 32) % self.size


class Vocabulary:
    """Ranks of byte strings, with the lookup of both tiers and the table for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.keys = ranks, list(ranks)
        self.rank = list(ranks.values())
        self.hash = PerfectHash(self.keys)
        self.piece = {i: k for k, i in ranks.items()}

    def whole(self, key: bytes) -> int | None:
        """The rank of key, or None: the slot's own key tells whether key belongs to the set."""
        if not self.keys:
            return None
        i = self.hash.slot_key[self.hash.slot(key)]
        return self.rank[i] if self.keys[i] == key else None

    def merged(self, data: bytes) -> list[int]:
        """Ids of data after all merges, the lowest rank first and the leftmost of equal ones."""
        n, rank_of = len(data), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that begins there: its end, the piece before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if j == 0 or j >= n or stop[j] != end:
                continue  # one of its two pieces has changed since
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank_of(data[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (h := before[i]) >= 0 and (r := rank_of(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            if (r := rank_of(data[i : stop[i]])) is None:
                raise ValueError(f"byte {data[i]} is not in the vocabulary")
            out.append(r)
            i = stop[i]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        return [r] if (r := self.whole(data)) is not None else self.merged(data)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


class Remembered(dict):
    """A pre-token's ids as bytes (32-bit, little-endian), worked out on first sight. When it is full, what has
    not been met since it was last full is forgotten."""

    def __init__(self, encode, most: int = 600_000):
        super().__init__()
        self.encode, self.most, self.older = encode, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is None:
            ids = self.encode(piece)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if b})


@lru_cache(2)
def ids_by_piece(path: str) -> Remembered:
    """Shared by the tasks that one Python worker runs in turn."""
    return Remembered(load(path).encode_piece)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of docs(doc_id, text).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (array<int>) and decoded (binary).
    A null text counts as empty: no ids, the digests of nothing. Repeated rows each give a row, a null doc_id stays
    null, other columns are ignored. One narrow pass; no shuffle.
    """
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches):
        vocabulary, split = load(ranks_path), Splitter(pattern)
        ids_of = ids_by_piece(ranks_path).__getitem__
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_hash, text_hash, n, kept, back = hashlib.sha256(), hashlib.sha256(), 0, [], []
                for pieces in split(text or ""):
                    packed = b"".join(map(ids_of, pieces))
                    ids = np.frombuffer(packed, "<u4")
                    decoded = vocabulary.decode(ids.tolist())
                    ids_hash.update(packed)
                    text_hash.update(decoded)
                    n += len(ids)
                    if with_ids:
                        kept.append(ids)
                        back.append(decoded)
                rows.append((doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest(), *((np.concatenate(kept).tolist() if kept else [], b"".join(back)) if with_ids else ())))
            columns = [list(c) for c in zip(*rows, strict=True)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kind)
