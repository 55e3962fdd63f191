"""Exact duplicates of whole texts, by a minimal perfect hash over the digests seen before.

1. Each text, with every run of blanks as one space, becomes its SHA-256. Texts are read once; all
   else works on narrow rows of (id, row, digest).
2. The distinct digests of the earlier rows form an index. A digest's leading bits give its shard;
   shards grow in number with the digests, never in size. In a shard, digests fall on the bits of a
   level; a bit that exactly one digest falls on is its own, the others go on to the next level.
   The rank of a digest's bit among all set bits is its slot: n digests, slots 0 to n - 1. Slots hold
   the full digest, the locator (id and row) of the one that stays, and the number of rows.
3. Later rows are first added up per digest, then looked up shard by shard. A slot's digest is
   compared byte by byte: equal ones are repeats of the earlier row. All other digests are new and
   form groups of their own.
4. Rows take the verdict of their digest: values with at least 1/1000 of all rows (so at most 1,000 of
   them) by broadcast, all others by a join.

The index is a table: it can be kept, and ``look_up`` run against it for any later batch.

Null counts as the empty text. Of equal texts the earlier ones win, among them the smallest id; a
null id only wins among null ids, and of rows that share id and text the first by position stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanveil.llm.common import hold, outlive, scratch
from spanveil.llm.words import U, mix

BYTES = 32
SHARD_KEYS = 1 << 14  # distinct digests a shard holds on average
SLACK = 2             # bits a level has per digest that reaches it
HOT_SHARE = 1000
INDEX = ("shard bigint, sizes array<bigint>, bits binary, digests binary, winners array<struct<id: bigint, row: bigint>>, "
         "counts array<bigint>")
CLASSES = "digest binary, id bigint, row bigint, n bigint"


def digest_words(column: pa.ChunkedArray) -> np.ndarray:
    """A column of digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(U).reshape(-1, BYTES // 8)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys[:, 1] ^ mix(keys[:, 2], level + 1), level + 11) % U(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and the bits of all of them, for distinct keys."""
    sizes, bits = [], []
    while len(keys):
        size = SLACK * len(keys) + 1
        at = _places(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; keys that are no member get any slot, or -1."""
    slot, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    rank = np.cumsum(bits) - bits
    for level, size in enumerate(sizes):
        at = start + _places(keys[left], level, size)
        mine = bits[at]
        slot[left[mine]] = rank[at[mine]]
        left, start = left[~mine], start + size
    return slot


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    keys = digest_words(rows.column("digest"))
    sizes, bits = perfect_hash(keys)
    order = pa.array(np.argsort(slots_of(keys, sizes, bits)))
    rows = rows.take(order)
    winners = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("id", "row")], ["id", "row"])
    whole = pa.array([0, len(rows)], pa.int32())
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()]), "digests": pa.array([b"".join(rows.column("digest").to_pylist())]),
        "winners": pa.ListArray.from_arrays(whole, winners),
        "counts": pa.ListArray.from_arrays(whole, rows.column("n").combine_chunks())})


def _match(key: tuple[pa.Scalar, ...], index: pa.Table, rows: pa.Table) -> pa.Table:
    """The classes of a shard: its slots with the rows added that met them, then the new digests."""
    if not len(index):
        return rows.select(["digest", "id", "row", "n"])
    shard = {c: index.column(c)[0] for c in ("sizes", "bits", "digests", "winners", "counts")}
    sizes, counts = shard["sizes"].as_py(), shard["counts"].values.to_numpy().copy()
    bits = np.unpackbits(np.frombuffer(shard["bits"].as_py(), np.uint8), count=sum(sizes)).astype(bool)
    held = np.frombuffer(shard["digests"].as_py(), dtype=">u8").astype(U).reshape(-1, BYTES // 8)
    if len(rows):
        keys = digest_words(rows.column("digest"))
        slot = slots_of(keys, sizes, bits)
        member = (slot >= 0) & (held[np.maximum(slot, 0)] == keys).all(axis=1)
        counts[slot[member]] += rows.column("n").to_numpy()[member]  # distinct digests, distinct slots
        rows = rows.filter(pa.array(~member))
    data, winners = shard["digests"].as_py(), shard["winners"].values
    known = pa.table({
        "digest": pa.array([data[i:i + BYTES] for i in range(0, len(data), BYTES)], pa.binary()),
        "id": winners.field("id"), "row": winners.field("row"), "n": pa.array(counts, pa.int64())})
    return pa.concat_tables([known, rows.select(["digest", "id", "row", "n"]).cast(known.schema)])


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text with each run of blanks as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator of the row that wins, and the number of rows."""
    return rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("w"), F.count("*").alias("n")).select(
        "digest", "w.id", "w.row", "n")


def _sharded(classes: DataFrame, shards: int) -> DataFrame:
    return classes.withColumn("shard", F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") % shards)


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """The index of distinct digests (digest, id, row, n): one row per shard."""
    return _sharded(classes, shards).groupBy("shard").applyInArrow(_build, INDEX)


def look_up(index: DataFrame, classes: DataFrame, shards: int) -> DataFrame:
    """The classes of the index and those of a later batch together: (digest, id, row, n)."""
    return index.groupBy("shard").cogroup(_sharded(classes, shards).groupBy("shard")).applyInArrow(_match, CLASSES)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", earlier: Column | None = None) -> DataFrame:
    """Per row: key, keep_id (key of the row that stays), group_size, kept, text_sha256.

    ``earlier``: the rows that were there before, which the index is made of; without it, those
    with a key up to the middle one, so that the smallest key of equal texts always wins.
    """
    with scratch(docs.sparkSession):
        middle = docs.agg(F.percentile_approx(F.col(key).cast("bigint"), 0.5)).first()[0] if earlier is None else None
        before = F.col(key) <= F.lit(middle) if earlier is None else earlier
        rows = hold(docs.select(
            F.col(key).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.unhex(text_digest(F.col(text))).alias("digest"), F.coalesce(before, F.lit(False)).alias("before")), "digests")
        old, new = (hold(distinct_digests(rows.where(which)), "distinct") for which in ("before", "NOT before"))
        shards = 1 + max(old.count(), new.count()) // SHARD_KEYS
        index = hold(build_index(old, shards), "index")
        classes = hold(look_up(index, new, shards), "classes")

        total = rows.count()
        repeated = classes.where("n > 1").select(
            "digest", F.col("id").alias("keep_id"), F.col("row").alias("winner"), F.col("n").alias("group_size"))
        hot = F.col("group_size") * HOT_SHARE >= total
        tagged = rows.drop("before").join(F.broadcast(repeated.where(hot)), "digest", "left")
        cold = tagged.where("winner IS NULL").select("id", "row", "digest").join(repeated.where(~hot), "digest", "left")
        # a digest without a class of several rows is its own
        judged = tagged.where("winner IS NOT NULL").unionByName(cold)
        alone = F.col("winner").isNull()
        return outlive(hold(judged.select(
            F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            (alone | (F.col("winner") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")),
            "exact"))
