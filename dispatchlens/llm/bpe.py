"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) resolves whole pre-tokens that are
in the vocabulary, vectorised over the pre-tokens of a slice of texts. Tier
two: the other pre-tokens are merged by a heap of pair ranks over linked bytes, which is
O(n log n) also for a pre-token of megabytes; a worker remembers the short ones' ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.llm import common
from dispatchlens.llm import pretokens

# Multipliers of the second hash: odd, with well spread bits; a shift is below 2**31.
SPREAD, MIX = 0x1E3779B97, 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys in n places, two array reads a lookup."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        h = self.hashes(keys)  # short keys' from their packed form, so that whole arrays of pre-tokens can be looked up
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)  # below 0: the place itself, of a bucket's only key
        self.key = np.zeros(n, np.int64)
        members: dict[int, list[int]] = {}
        for i, b in enumerate((h % np.uint64(self.buckets)).tolist()):
            members.setdefault(b, []).append(i)
        free, h = set(range(n)), h.tolist()
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                at = [free.pop()]
                self.shift[b] = -1 - at[0]
            else:
                shift = 0
                while len({*(at := [(((h[i] ^ shift * SPREAD) * MIX & 0xFFFFFFFFFFFFFFFF) >> 32) % n for i in own])} & free) < len(own):
                    shift += 1
                self.shift[b] = shift
                free.difference_update(at)
            self.key[at] = own

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        lo, hi = pretokens.keys_of(keys)
        h = pretokens.hashes(lo, hi)
        for i in np.flatnonzero(hi == 0).tolist():
            h[i] = xxhash.xxh64_intdigest(keys[i])
        return h

    def at(self, h: np.ndarray) -> np.ndarray:
        """For each hash, the index of the one key that it can be."""
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            mixed = (h ^ np.maximum(shift, 0).astype(np.uint64) * np.uint64(SPREAD)) * np.uint64(MIX) >> np.uint64(32)
        return self.key[np.where(shift < 0, -1 - shift, (mixed % np.uint64(self.n)).astype(np.int64))]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each string, the index of the one key that it can be."""
        return self.at(self.hashes(keys))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always the lowest-ranked pair, the leftmost of equals, until none is left."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # after 0: merged away
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue  # one of the two has merged otherwise meanwhile
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Coder:
    """Encodes texts and decodes ids by a table of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.lo, self.hi = pretokens.keys_of(self.keys)
        self.ids = np.fromiter(ranks.values(), np.uint32, len(ranks))
        # the bytes of all tokens one after another, and for each id where its own begin and how many they are
        self.bytes = np.frombuffer(b"".join(self.keys), np.uint8)
        size = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
        self.begin, self.size = np.zeros((2, int(self.ids.max()) + 1), np.int64)
        self.begin[self.ids], self.size[self.ids] = np.cumsum(size) - size, size
        self.memory = None

    def __getstate__(self):
        return self.__dict__ | {"memory": None}

    def _long(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return merged(piece, self.ranks) if rank is None else [rank]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (n + 1 values)."""
        self.memory = self.memory or pretokens.Memory()
        own = pretokens.Pretokens(texts)
        at = self.hash.at(pretokens.hashes(own.lo, own.hi))
        short = own.hi != 0
        whole = short & (self.lo[at] == own.lo) & (self.hi[at] == own.hi)
        known, rest, long = np.flatnonzero(whole), np.flatnonzero(short & ~whole), np.flatnonzero(~short)
        ids, begin = self.memory.of(own.lo[rest], own.hi[rest], lambda some: [merged(own.piece(i), self.ranks) for i in rest[some].tolist()])
        groups = [(known, self.ids[at[known]], np.ones(len(known), np.int64)), (rest, ids, np.diff(begin))]
        if len(long):
            got = [self._long(own.piece(i)) for i in long.tolist()]
            groups.append((long, np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64)))
        flat, begin = pretokens.placed(len(own), groups)
        return flat, begin[own.first]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, cut = self.encode_all(texts)
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[pretokens.ranges(self.begin[ids], self.size[ids])].tobytes()


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again and return per document the columns
    ``keep``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256``; ``with_ids`` adds the ids themselves (``ids`` array of long).

    Null text counts as empty: no tokens, the digests of nothing. Rows are independent:
    repeated rows give repeated rows, an empty table none; further input columns are not
    read. The vocabulary file is read on the driver and sent with the tasks (its size does
    not depend on the data). No shuffle.
    """
    coder = docs.sparkSession.sparkContext.broadcast(Coder(read_ranks(ranks_path)))
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<long>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(column).to_pylist()
            for a, b in common.slices(sizes):
                flat, cut = own.encode_all(column.slice(a, b - a).to_pylist())
                decoded = own.decode(flat)
                end = np.concatenate(([0], np.cumsum(own.size[flat])))[cut].tolist()
                flat = flat.astype("<u4")
                got = [flat[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                out = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                out += [pa.array(np.diff(cut), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in got]), pa.array([hashlib.sha256(memoryview(decoded)[i:j]).hexdigest() for i, j in zip(end, end[1:])])]
                if with_ids:
                    out.append(pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return rows.mapInArrow(run, schema)
