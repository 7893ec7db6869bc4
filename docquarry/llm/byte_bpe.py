"""Byte-level BPE encoding and decoding by a rank file.

Two tiers.  A minimal perfect hash over the vocabulary (hash and displace: one displacement per
bucket of about two keys, one slot per key, the key itself kept in its slot to refuse
strangers) resolves pre-tokens that are entries as they stand.  Any other pre-token is merged
with a heap of (rank, place) over its linked bytes, in O(n log n) for any length.

Texts without adjacent white space are split at their blanks first: no token reaches over such
a blank, so each chunk, with the blank before it, is matched by the pattern once and kept in a
bounded table.  All other texts are matched as a whole.  The result is the same either way.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import slices

#: Chunks whose ids a worker keeps, and as many from before the table was last full.
KEPT_CHUNKS = 300_000
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")
#: Letters of which no library doubts that they are letters, and marks that end words.
_WORD = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_MARKS = (",", ".")
_EIGHT = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: ``find(key)`` is its value or None."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 2):
        n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys must be distinct")
        self.size, self.buckets = n, max(1, n // per_bucket)
        parts: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            bucket, at, step = self._hashes(key)
            parts[bucket].append((i, at, step))
        self.shift = [0] * self.buckets
        slots: list[int | None] = [None] * n
        for bucket in sorted(range(self.buckets), key=lambda b: -len(parts[b])):
            members = parts[bucket]
            if len(members) < 2:
                break
            d = 0
            while True:
                places = [self._place(at, step, d) for _, at, step in members]
                if len(set(places)) == len(places) and all(slots[p] is None for p in places):
                    break
                d += 1
            self.shift[bucket] = d
            for (i, _, _), p in zip(members, places):
                slots[p] = i
        free = (p for p in range(n) if slots[p] is None)
        for bucket in range(self.buckets):
            if len(parts[bucket]) == 1:  # a lone key names its slot
                p = next(free)
                slots[p] = parts[bucket][0][0]
                self.shift[bucket] = -p - 1
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        low = x & _EIGHT
        return low % self.buckets, x >> 64, low | 1

    def _place(self, at: int, step: int, d: int) -> int:
        return ((at + d * 0x9E3779B97F4A7C15) * step & _EIGHT) * self.size >> 64

    def find(self, key: bytes) -> int | None:
        bucket, at, step = self._hashes(key)
        d = self.shift[bucket]
        slot = -d - 1 if d < 0 else self._place(at, step, d)
        return self.values[slot] if self.keys[slot] == key else None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(token: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a pre-token: the pair of least rank is joined first, the leftmost on ties."""
    n = len(token)
    after = list(range(1, n + 1))  # start of the next part; -1: joined to the part on the left
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            stop = after[end]
            if stop - i <= longest and (r := ranks.get(token[i:stop])) is not None:
                heapq.heappush(heap, (r, i, stop))
        p = before[i]
        if p >= 0 and end - p <= longest and (r := ranks.get(token[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.table = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.match = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _token(self, raw: bytes) -> list[int]:
        i = self.table.find(raw) if len(raw) <= self.longest else None
        return merge(raw, self.ranks, self.longest) if i is None else [i]

    def _ids(self, tokens: list[str]) -> bytes:
        out: list[int] = []
        for t in tokens:
            out += self._token(t.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk and the blank before it.  A letter and a mark are never in one token, so
        a word before a stop or comma is looked up by itself."""
        if _WORD.fullmatch(chunk):
            out = self._token(b" " + chunk.encode())
            return struct.pack(f"<{len(out)}I", *out)
        if chunk[-1:] in _MARKS and _WORD.fullmatch(chunk, 0, len(chunk) - 1):
            word = chunk[:-1]
            if word not in self.kept:
                self.kept[word] = self.older.get(word) or self._chunk(word)
            return self.kept[word] + self._ids([chunk[-1]])
        return self._ids(self.match(" " + chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _UNEVEN.search(text):
            return self._ids(self.match(text))
        first, *rest = text.split(" ")
        missing = set(rest).difference(self.kept)
        if len(self.kept) + len(missing) > KEPT_CHUNKS:
            self.kept, self.older = {}, self.kept
            missing = set(rest)
        if len(missing) > KEPT_CHUNKS:
            return self._ids(self.match(text))
        kept, older = self.kept, self.older
        for c in missing:
            kept[c] = older.get(c) or self._chunk(c)
        return self._ids(self.match(first)) + b"".join(map(kept.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def bpe_round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: the id, ``token_ids`` and ``decoded`` (both binary).

    ``token_ids`` are little-endian unsigned 32-bit integers; ``decoded`` are the bytes that
    these ids stand for.  ``vocabulary`` is the path of a rank file that every executor can
    open.  Null texts count as empty and give no ids; an empty table gives none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = [bpe.encode(t) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
                    ["__id", "token_ids", "decoded"],
                )

    return rows.mapInArrow(run, "__id long, token_ids binary, decoded binary").withColumnRenamed("__id", doc_id)
