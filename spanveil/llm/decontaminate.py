"""Benchmark decontamination by suffix arrays of the training documents.

Each ``SLICE`` of a batch of documents is a shard. Its suffix array holds the word positions at which some test
suffix can match (those whose first words also begin one), sorted by their words to the depth of a
window. All suffixes of the test items are searched by bisection at once; the range of positions
that share a whole window with the suffix are its verbatim matches, with their places. Matches that
follow each other grow into the longest ones. Shards need no shuffle: documents are only read.

Test items are a stated query set. They travel to the tasks in blocks of at most ``BLOCK_CHARS``
characters (one item at least); each block is one pass over the documents.

Nulls and empty texts have no words. A document without words is never contaminated. Repeated ids
are judged row by row; repeated item ids count once. Other columns are left as they are. An empty
benchmark leaves every document clean. A null item id counts, as an empty name, after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanveil.llm.common import hold
from spanveil.llm.words import NOT_ALPHANUMERIC, Words, mix, slices, whole_windows, words

WINDOW, GRAM, BLOCK_CHARS = 13, 3, 16 << 20
SLICE = 1 << 20  # bytes of text in a shard
U = np.uint64


class Suffixes:
    """The suffixes of the test items: words in order, and how long the window at each place is."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        w = words(pa.array(texts, pa.large_string()), True, NOT_ALPHANUMERIC)
        size, row = np.diff(w.first), w.row
        left = w.first[1:][row] - np.arange(len(w.hash))
        need = np.minimum(window, size)[row]
        self.at = np.flatnonzero(left >= need)
        self.ids, self.item, self.depth = ids, row[self.at], need[self.at]
        self.window = window
        padded = np.concatenate([w.hash, np.zeros(window, U)])
        self.columns = [padded[self.at + d] for d in range(window)]
        self.gram = int(min(GRAM, self.depth.min())) if len(self.at) else 0
        self.starts = np.unique(self._gram(self.columns))
        # distinct windows only: equal ones are searched once
        keep = np.zeros(len(self.at), U)
        for d in range(window):
            keep = mix(keep ^ np.where(d < self.depth, self.columns[d], U(0)), d + 3)
        _, self.one, self.of = np.unique(keep, return_index=True, return_inverse=True)
        # the items of each distinct window, one after the other
        held = np.unique(self.of * max(len(ids), 1) + self.item) if len(self.at) else np.zeros(0, np.int64)
        self.holder = held % max(len(ids), 1)
        self.first = np.searchsorted(held // max(len(ids), 1), np.arange(len(self.one) + 1))

    def _gram(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), U)
        for d in range(self.gram):
            h = mix(h ^ columns[d], d)
        return h

    def array_of(self, w: Words) -> tuple[list[np.ndarray], np.ndarray]:
        """The suffix array of a shard: words by depth, and positions, in sorted order."""
        n = len(w.hash)
        padded = np.concatenate([w.hash, np.zeros(self.window, U)])
        h = self._gram([padded[d:d + n] for d in range(self.gram)])
        at = np.searchsorted(self.starts, h)
        at[at == len(self.starts)] = 0
        positions = np.flatnonzero((self.starts[at] == h) & whole_windows(w, self.gram))
        end = np.repeat(w.first[1:], np.diff(w.first))[positions]
        columns = [np.where(positions + d < end, padded[positions + d], U(0)) for d in range(self.window)]
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns], positions[order]

    def search(self, columns: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The range in the suffix array that shares each distinct window, by bisection."""
        wanted, depth = [c[self.one] for c in self.columns], self.depth[self.one]

        def bound(right: bool) -> np.ndarray:
            low, high = np.zeros(len(depth), np.int64), np.full(len(depth), n, np.int64)
            while (open_ := low < high).any():
                middle = np.minimum((low + high) // 2, n - 1)
                sign = np.zeros(len(depth), np.int8)
                for d in range(self.window):
                    todo = (sign == 0) & (d < depth)
                    if not todo.any():
                        break
                    here = columns[d][middle]
                    sign[todo & (here < wanted[d])] = -1
                    sign[todo & (here > wanted[d])] = 1
                go = open_ & ((sign < 0) | ((sign == 0) & right))
                low = np.where(go, middle + 1, low)
                high = np.where(open_ & ~go, middle, high)
            return low

        return bound(False), bound(True)

    def places(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where windows stand in a shard: distinct window, word position. A place has one per depth at most."""
        none = np.zeros(0, np.int64)
        if not len(self.at) or not len(w.hash):
            return none, none
        columns, positions = self.array_of(w)
        if not len(positions):
            return none, none
        low, high = self.search(columns, len(positions))
        window, inner = expand(high - low)
        return window, positions[low[window] + inner]

    def matches(self, window: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places by test suffix: suffix, word position, length in words."""
        order = np.argsort(self.of, kind="stable")
        first = np.searchsorted(self.of[order], np.arange(len(self.one) + 1))
        at, inner = expand(np.diff(first)[window])
        suffix = order[first[window[at]] + inner]
        return suffix, position[at], self.depth[suffix]


def expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and which time it is."""
    index = np.repeat(np.arange(len(count)), count)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)


def _scan(tests: Suffixes, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            w = words(batch.column("text"), True, NOT_ALPHANUMERIC)
            window, position = tests.places(w)
            length = tests.depth[tests.one[window]]
            row = np.searchsorted(w.first, position, side="right") - 1
            cover = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(cover, position, 1)
            np.add.at(cover, position + length, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
            n = len(batch)
            # a window counts once a row before its items are listed, however often it stands there
            seen = np.unique(row * max(len(tests.one), 1) + window)
            seen_row, seen_window = np.divmod(seen, max(len(tests.one), 1))
            at, inner = expand(np.diff(tests.first)[seen_window])
            holder = tests.holder[tests.first[seen_window[at]] + inner]
            pairs = np.unique(seen_row[at] * max(len(tests.ids), 1) + holder)
            items: list[list[str]] = [[] for _ in range(n)]
            for pair in pairs.tolist():
                items[pair // len(tests.ids)].append(tests.ids[pair % len(tests.ids)])
            longest: list[list[dict]] = [[] for _ in range(n)]
            if spans and len(window):
                suffix, position, length = tests.matches(window, position)
                row = np.searchsorted(w.first, position, side="right") - 1
                # a match whose suffix and place both follow another's continues it
                order = np.lexsort((position, position - suffix))
                s, p, k, r = suffix[order], position[order], length[order], row[order]
                new = np.ones(len(s), bool)
                new[1:] = (np.diff(s) != 1) | (np.diff(p) != 1) | (np.diff(tests.item[s]) != 0) | (np.diff(r) != 0)
                first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(s)) - 1
                for a, b in zip(first.tolist(), last.tolist()):
                    longest[r[a]].append({"item_id": tests.ids[tests.item[s[a]]], "start": int(p[a] - w.first[r[a]]),
                                          "end": int(p[b] + k[b] - w.first[r[a]])})
            columns = [batch.column("key"), pa.array(np.diff(w.first)), pa.array(n_hit, pa.int64()),
                       pa.array(items, pa.list_(pa.string()))]
            names = ["key", "n_words", "n_hit", "items"]
            if spans:
                columns.append(pa.array(longest, pa.list_(pa.struct(
                    [("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                names.append("matches")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
                            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append((r.id, r.text))
        size += len(r.text)
    if block:
        yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                      spans: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: key, n_words, n_hit, items (sorted ids), and with ``spans`` the longest matches.

    n_hit counts words inside any match of a window; with several blocks of items it is an upper
    bound unless the blocks' hits are disjoint, so ``spans`` is forced then and hits are recounted.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    blocks = list(_block_tests(benchmark, item_id, item_text, window, block_chars))
    if not blocks:
        blocks = [Suffixes([], [], window)]
    spans_needed = spans or len(blocks) > 1
    schema = f"key {kind}, n_words long, n_hit long, items array<string>" + (
        ", matches array<struct<item_id string, start long, end long>>" if spans_needed else "")
    if len(blocks) == 1:
        out = given.mapInArrow(_scan(blocks[0], spans_needed), schema)
    else:  # more items than one block: number the rows, so that passes over repeated ids can be joined
        numbered = hold(given.withColumn("nr", F.monotonically_increasing_id()), "numbered")
        out = None
        for tests in blocks:
            part = numbered.select(F.struct("key", "nr").alias("key"), "text").mapInArrow(
                _scan(tests, True), schema.replace(f"key {kind}", f"key struct<key {kind}, nr bigint>", 1))
            out = part if out is None else out.unionByName(part)
        out = out.groupBy("key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"),
            F.flatten(F.collect_list("matches")).alias("matches"))
        merged = ("aggregate(array_sort(transform(matches, m -> struct(m.start as s, m.end as e))), "
                  "named_struct('n', 0L, 'to', 0L), (a, m) -> named_struct("
                  "'n', a.n + greatest(0L, m.e - greatest(m.s, a.to)), 'to', greatest(a.to, m.e)), a -> a.n)")
        out = out.select("key.key", "n_words", F.expr(merged).alias("n_hit"), "items", "matches")
    return out.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumnRenamed("key", key)


def _block_tests(benchmark, item_id, text, window, most):
    for block in _blocks(benchmark, item_id, text, most):
        yield Suffixes([b[0] for b in block], [b[1] for b in block], window)


def contaminated(matches: DataFrame, share: int = 20) -> DataFrame:
    """Add the verdict: hit words are at least 1/share of all."""
    return matches.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns kept.

    The verdict is computed beside the row itself, so no join is needed and rows with null or
    repeated keys are judged one by one.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    judged = contaminated(benchmark_matches(packed, benchmark, "_row", "_text", spans=False))
    return judged.where(~F.col("contaminated")).select(*[F.col("_row").getField(c).alias(c) for c in names])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
