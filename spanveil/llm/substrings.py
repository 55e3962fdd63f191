"""Substring deduplication by relative Lempel-Ziv factors over indexed reference blocks.

A window is 50 consecutive words. Every window names an anchor: the leftmost place in it where the
hash of 8 words is least. Neighbouring windows mostly share their anchor; a maximal run of them is a
block. The index holds each block of every document under its anchor's hash, so any copy of a window
is found in a block of the same key, whatever stands around it.

Factoring is greedy by blocks: a block whose whole content also stands in an earlier document (one
with a smaller id) is copied from the first such document in one factor. Where only part of a block
may be copied, at the boundary of a factor, its windows are compared one by one with those of all
other contents under the key: each content is represented by all its places in its first document
(later documents copy it whole), and a minimum per window finds the first reference. Only sums and
minima meet in a group, so passages that stand in a third of all rows cost no more than their rows.

A null text has no words. Documents with a null id are kept whole and are no reference. Rows that
repeat an id are each compared with smaller ids. Texts of fewer than 50 words lose nothing. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanveil.llm.common import hold, join_checked
from spanveil.llm.words import Words, mix, slices, sums, whole_windows, windows, words

WINDOW, GRAM = 50, 8
U = np.uint64


def tags(w: Words) -> np.ndarray:
    """A hash of each row's words: tells rows with the same id apart."""
    return mix(sums(w.hash, w.first[:-1], w.first[1:]), 7).view(np.int64)


def blocks(w: Words, window: int = WINDOW, gram: int = GRAM):
    """Blocks as (row, first window, number of windows, key, content)."""
    fits = whole_windows(w, window)
    g = windows(w.hash, gram)
    width = window - gram + 1
    n = len(g) - width + 1
    if n <= 0 or not fits.any():
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64)]
    value, at, have = g, np.arange(len(g)), 1
    while have < width:  # sliding minimum by doubling; ties go to the left
        step = min(have, width - have)
        left, right = value[:len(value) - step], value[step:]
        less = right < left
        value, at = np.where(less, right, left), np.where(less, at[step:], at[:len(at) - step])
        have += step
    anchor = at[:n]
    fits = fits[:n]
    row = w.row[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
    start = np.flatnonzero(new & fits)
    ends = new | ~fits
    stop = np.append(np.flatnonzero(ends), n)
    count = stop[np.searchsorted(stop, start, side="right")] - start
    content = mix(sums(w.hash, start, start + count + window - 1)
                  ^ (count.astype(U) << U(32)) ^ (anchor[start] - start).astype(U), 9)
    return row[start], start - w.first[row[start]], count, g[anchor[start]].view(np.int64), content.view(np.int64)


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            w = words(batch.column("text"), lower=False)
            row, start, count, key, content = blocks(w, window, gram)
            doc = batch.column("doc").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(tags(w)[row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(key), pa.array(content)], ["doc", "tag", "start", "n", "key", "content"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            w = words(batch.column("text"), lower=False)
            hashes, tag = windows(w.hash, window), tags(w)
            out_row, out_at = [], []
            for r, open_blocks in enumerate(batch.column("open").to_pylist()):
                for b in open_blocks:
                    if b["tag"] == tag[r]:
                        out_row.append(np.full(b["n"], r))
                        out_at.append(np.arange(b["start"], b["start"] + b["n"]))
            if out_row:
                row, at = np.concatenate(out_row), np.concatenate(out_at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(row)), pa.array(tag[row]), pa.array(at.astype(np.int32)),
                     pa.array(hashes[w.first[row] + at].view(np.int64))], ["doc", "tag", "start", "window"])

    return run


def _parse(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            w = words(batch.column("text"), lower=False)
            tag, data = tags(w), w.data
            removed, digests, kept, factors = [], [], [], []
            for r, copies in enumerate(batch.column("copies").to_pylist()):
                a, b = w.first[r], w.first[r + 1]
                mine = sorted((c["start"], -(c["start"] + c["n"] + window - 1), c["ref"])
                              for c in copies or () if c["tag"] == tag[r])
                gone, found = np.zeros(b - a, bool), []
                for start, end, ref in mine:
                    end = -end
                    gone[start:end] = True
                    if found and found[-1]["ref"] == ref and start <= found[-1]["end"]:
                        found[-1]["end"] = max(end, found[-1]["end"])
                    elif not found or end > found[-1]["end"]:  # the next factor starts where this one ends
                        found.append({"start": max(start, found[-1]["end"]) if found else start, "end": end, "ref": ref})
                stay = np.flatnonzero(~gone) + a
                text = b" ".join([data[s:e].tobytes() for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]
                                 if gone.any() else data[w.start[a]:w.end[b - 1]].tobytes().split() if b > a else [])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text)
                factors.append(found)
            columns = [batch.column("doc"), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()),
                       pa.array(digests, pa.string()), pa.array(factors, pa.list_(pa.struct(
                           [("start", pa.int64()), ("end", pa.int64()), ("ref", pa.int64())])))]
            names = ["doc", "n_words", "n_removed", "kept_sha256", "factors"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256, factors, and kept (the words that stay).

    ``key`` must be an integer column. A factor is a span of words [start, end) and the document
    that it is copied from.
    """
    given = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    index = hold(given.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _index(window, gram), "doc long, tag long, start int, n int, key long, content long"), "blocks")
    contents = hold(index.groupBy("key", "content").agg(
        F.min(F.struct("doc", "tag", "start", "n")).alias("first"), F.max("doc").alias("last"),
        F.count("*").alias("places")), "contents")

    copied = (index.join(contents.where("first.doc < last").select("key", "content", F.col("first.doc").alias("ref")),
                         ["key", "content"]).where("ref < doc").select("doc", "tag", "start", "n", "ref"))

    open_keys = contents.groupBy("key").agg(
        F.count("*").alias("contents"), F.min("first.doc").alias("a"), F.max("first.doc").alias("b")).where(
        "contents > 1 AND a < b").select("key")
    opened = hold(contents.join(open_keys, "key", "left_semi").select("key", "content", "first.*", "places"), "opened")
    # the document is part of the join key: places in other documents, of which a content may have many, do not meet
    again = index.join(opened.where("places > 1").select("key", "content", "doc"), ["key", "content", "doc"])
    open_blocks = hold(opened.where("places = 1").select("doc", "tag", "start", "n").unionByName(
        again.select("doc", "tag", "start", "n").distinct()).groupBy("doc").agg(
        F.collect_list(F.struct("tag", "start", "n")).alias("open")), "open")
    single = hold(join_checked(given, open_blocks, "doc", "inner", "size(open)").mapInArrow(
        _windows(window), "doc long, tag long, start int, window long"), "windows")
    refs = single.groupBy("window").agg(F.min("doc").alias("ref"), F.max("doc").alias("last")).where("ref < last")
    bordering = single.join(refs, "window").where("ref < doc").select(
        "doc", "tag", "start", F.lit(1).alias("n"), "ref")

    copies = hold(copied.unionByName(bordering).groupBy("doc").agg(
        F.collect_list(F.struct("tag", "start", "n", "ref")).alias("copies")), "copies")
    return join_checked(given, copies, "doc", "left", "size(copies)").mapInArrow(
        _parse(window, with_text), "doc long, n_words long, n_removed long, kept_sha256 string, "
        "factors array<struct<start: long, end: long, ref: long>>" + ", kept string" * with_text
    ).withColumnRenamed("doc", key)
