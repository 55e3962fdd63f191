"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each pair of neighbours that has a merge rank waits in the
bucket of that rank; a bitmap of three levels knows the buckets in use, and find-first-set gives the
lowest rank in three steps. Within a bucket positions leave from left to right. An entry whose pair
has changed since is stale and skipped. So a pre-token of n bytes costs O(n log n) at most, also
when it is a megabyte long. All new pre-tokens of a batch share one queue, which spreads its cost.

Texts are cut by the tokenizer's pattern; each match is encoded on its own. Frequent pre-tokens are
remembered in a table of at most ``REMEMBERED`` entries per task. Nothing is shuffled.

A null text is empty: no ids, and the digests of nothing. Decoding gives the bytes of the ids, so
decoding an encoding gives the text back. Repeated rows and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from spanveil.llm.words import slices

#: Merging takes up to 200 bytes of memory per byte of new pre-tokens, so tasks take ``SLICE`` bytes of text at a time.
REMEMBERED, LONGEST_REMEMBERED, SLICE = 400_000, 64, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes, blank, rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Buckets of positions by merge rank; ``take`` gives the lowest rank's, from left to right."""

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self.low, self.middle, self.top = [0] * words, [0] * ((words + 63) // 64), 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Open a bucket; one that is open only grows: ``buckets[rank].append``."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def take(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        middle = self.middle[a]
        word = (a << 6) + (middle & -middle).bit_length() - 1
        low = self.low[word]
        rank = (word << 6) + (low & -low).bit_length() - 1
        self.low[word] = low = low & (low - 1)
        if not low:
            self.middle[a] = middle = middle & (middle - 1)
            if not middle:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Coder:
    """Encodes and decodes by a table of ranks (ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full((257, 257), -1, np.int64)  # rank of two bytes; 256 is an end
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.first[piece[0], piece[1]] = rank
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit words. All of them wait in one queue; ends keep them apart."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data) + len(pieces) + 1
        byte = np.full(n, 256, np.int64)  # an end before the first and after each
        byte[np.arange(len(data)) + np.repeat(np.arange(len(pieces)), size) + 1] = data
        start = np.append(self.first[byte[:-1], byte[1:]], -1)
        token = np.where(byte < 256, self.single[np.minimum(byte, 255)], -1).tolist()
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), start.tolist()
        waiting = np.flatnonzero(start >= 0)
        waiting = waiting[np.argsort(start[waiting], kind="stable")]
        cuts = np.flatnonzero(np.diff(start[waiting])) + 1
        queue = self.queue
        for part in np.split(waiting, cuts):
            if len(part):
                queue.put(int(start[part[0]]), part.tolist())
        buckets, pairs, ranks, bytes_of = queue.buckets, self.pairs, self.ranks, self.bytes_of
        while (best := queue.take()) is not None:
            rank, bucket = best
            shift, lowest = rank << 32, rank
            for at, i in enumerate(bucket):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                k, h = after[j], before[i]
                token[i], token[j], rank_at[j] = rank, -2, -1
                after[i], before[k] = k, i
                other = token[k]
                if other < 0:
                    rank_at[i] = -1
                else:
                    new = pairs.get(shift | other)
                    if new is None:
                        new = pairs[shift | other] = ranks.get(bytes_of[rank] + bytes_of[other], -1)
                    rank_at[i] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.put(new, [i])
                        if new < lowest:
                            lowest = new
                other = token[h]
                if other >= 0:
                    new = pairs.get(other << 32 | rank)
                    if new is None:
                        new = pairs[other << 32 | rank] = ranks.get(bytes_of[other] + bytes_of[rank], -1)
                    rank_at[h] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            queue.put(new, [h])
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # a lower rank came up: it goes first
                    if at + 1 < len(bucket):
                        queue.put(rank, bucket[at + 1:] + buckets.pop(rank, []))
                    break
        if len(pairs) > REMEMBERED:
            pairs.clear()
        left = np.array(token)
        left = left[left != -2]
        ends = (4 * np.flatnonzero(left == -1)).tolist()
        left = left.astype("<u4").tobytes()
        return [left[a + 4:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit words."""
        cut = [self.pattern.findall(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.merge([p.encode("utf-8") for p in new])))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text",
           with_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves.

    ``vocabulary``: path of the rank file; tasks read it where they run, as it belongs to an
    installed package. Digests: ids as little-endian 32-bit words; the decoded bytes.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = given.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(read_ranks(vocabulary), pattern)
        for batch in slices(batches, "text", SLICE):
            lists = coder.encode([v or "" for v in batch.column("text").to_pylist()])
            counts = [len(ids) // 4 for ids in lists]
            digests = [hashlib.sha256(ids).hexdigest() for ids in lists]
            backs = [hashlib.sha256(coder.decode(ids)).hexdigest() for ids in lists]
            columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                       pa.array(backs, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(lists), "<i4")))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if with_ids else "")
    return given.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and the bytes of its ids; null for null ids. An unknown id raises an error."""
    given = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = given.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {r: b for b, r in read_ranks(vocabulary).items()}
        for batch in batches:
            out = [None if v is None else b"".join(bytes_of[i] for i in v) for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "bytes"])

    return given.mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)
