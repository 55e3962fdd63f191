"""The mapping that streams write: open batches, sealed segments, and manifests that say which count.

A batch writes its new entries into a folder of its own, ``job=../batch_id=../bucket=..``. Batches that
cannot be repeated any more are closed. When EVERY of them are there, one write turns them into a segment
(``segment=../bucket=..``); segments of one level that are FANOUT in number go into one of the next. So the
folders that a batch reads grow with the logarithm of the number of batches, and every entry is written
again only as often as there are levels.

A manifest names the segments and, per job, the last batch that they hold. It is created in one step, and
only one writer can create a number. What no manifest names does not count: after a crash before it the
batches still do, after one behind it the segment. Folders go one manifest later, when those who
were reading have read on. Entries that ``write_mapping`` put into the folder stay as they are.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanveil.schema import MAPPING

BUCKETS = 64
EVERY, FANOUT = 16, 4
FILE_ROWS = 1 << 20
MANIFESTS = "_manifests"
ENTRIES = f"{MAPPING}, job string, batch_id bigint, bucket int"


class State(NamedTuple):
    """What a manifest says: its number, segments by level, last batch per job, segments it replaced."""

    number: int = -1
    segments: dict[str, int] = {}
    covered: dict[str, int] = {}
    retired: list[str] = []


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    system, root = files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(root)) if system.exists(root) else []


def current(spark: SparkSession, path: str) -> State:
    """The newest manifest that was written whole."""
    for name in sorted((n for n in names(spark, f"{path}/{MANIFESTS}") if n.isdigit()), reverse=True):
        system, place = files(spark, f"{path}/{MANIFESTS}/{name}")
        stream = system.open(place)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return State(int(name), **json.loads(text))
        except (ValueError, TypeError):
            continue  # a writer fell while it wrote
    return State()


def _commit(spark: SparkSession, path: str, state: State) -> bool:
    """Write a manifest if nobody has written one of its number."""
    system, place = files(spark, f"{path}/{MANIFESTS}/{state.number:012d}")
    try:
        stream = system.create(place, False)
    except Py4JJavaError:
        if system.exists(place):
            return False
        raise
    content = json.dumps({"segments": state.segments, "covered": state.covered, "retired": state.retired})
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def batches(spark: SparkSession, path: str, covered: dict[str, int]) -> dict[str, list[int]]:
    """Per job the batches that no segment holds, in order."""
    found = {}
    for name in names(spark, path):
        if name.startswith("job="):
            job = name.removeprefix("job=")
            numbers = sorted(int(n.removeprefix("batch_id=")) for n in names(spark, f"{path}/{name}") if n.startswith("batch_id="))
            found[job] = [n for n in numbers if n > covered.get(job, -1)]
    return found


def _read(spark: SparkSession, path: str, segments: list[str], open_ones: list[tuple[str, int]]) -> DataFrame:
    empty = found = spark.createDataFrame([], ENTRIES)
    for folders, columns in (([f"{path}/job={j}/batch_id={b}" for j, b in open_ones], ENTRIES),
                             ([f"{path}/segment={s}" for s in segments], f"{ENTRIES}, segment string")):
        if folders:
            found = found.unionByName(spark.read.schema(columns).option("basePath", path).parquet(*folders).select(empty.columns))
    return found


def stream_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a mapping folder, with the job and batch that made them, and their bucket.

    Entries that ``write_mapping`` put there have no job.
    """
    now = current(spark, path)
    found = _read(spark, path, list(now.segments), [
        (job, n) for job, numbers in batches(spark, path, now.covered).items() for n in numbers])
    plain = [f"{path}/{n}" for n in names(spark, path) if n.startswith("part-")]
    if plain:
        found = found.unionByName(spark.read.schema(MAPPING).parquet(*plain).withColumns(
            {"job": F.lit(None).cast("string"), "batch_id": F.lit(None).cast("bigint"), "bucket": bucket_of("original")}))
    return found


def first_entries(entries: DataFrame) -> DataFrame:
    """One entry per original: one without a job, else that of the first job by name, its first batch."""
    rank = F.struct(F.col("job").isNotNull(), "job", "batch_id")
    return entries.groupBy("original").agg(F.min_by(F.struct("entity_type", "replacement", "job", "batch_id"), rank).alias(
        "e")).select("original", "e.*")


def stream_mapping_table(spark: SparkSession, path: str) -> DataFrame:
    """The mapping in a folder that streams have written, ready for ``write_mapping``.

    An entry made twice (by jobs that ran side by side) counts once.
    """
    return first_entries(stream_entries(spark, path)).select("original", "entity_type", "replacement")


def append(entries: DataFrame, path: str, job: str, batch_id: int) -> str:
    """Write a batch's entries, one file per bucket; gives its folder."""
    folder = f"{path}/job={job}/batch_id={batch_id}"
    entries.select("original", "entity_type", "replacement", bucket_of("original").alias("bucket")).repartition(
        "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return folder


def compact(spark: SparkSession, path: str, job: str, batch_id: int, every: int = EVERY, fanout: int = FANOUT) -> bool:
    """Seal the closed batches, if there are ``every`` of them; True if a manifest was written.

    Closed are this job's batches before ``batch_id``, and of other jobs all but the last (the only
    one that can be repeated). To be called by a job between its batches.
    """
    now = current(spark, path)
    closed = {j: [n for n in numbers if n < batch_id] if j == job else numbers[:-1]
              for j, numbers in batches(spark, path, now.covered).items()}
    if sum(map(len, closed.values())) < every:
        return False
    level, merged = 0, []
    while len(full := [s for s, at in now.segments.items() if at == level]) + 1 >= fanout:
        merged, level = merged + full, level + 1
    found = _read(spark, path, merged, [(j, n) for j, numbers in closed.items() for n in numbers])
    sealed, parts = first_entries(found), 1 + found.count() // (BUCKETS * FILE_ROWS)
    name = f"{job}-{uuid.uuid4().hex}"
    sealed.withColumn("bucket", bucket_of("original")).repartition(
        "bucket", F.pmod(F.xxhash64("original", F.lit(1)), F.lit(parts))).write.partitionBy("bucket").option(
        "maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/segment={name}")
    newest = [int(n) for n in names(spark, f"{path}/{MANIFESTS}") if n.isdigit()]
    after = State(max(newest, default=-1) + 1, {s: at for s, at in now.segments.items() if s not in merged} | {name: level},
                  now.covered | {j: numbers[-1] for j, numbers in closed.items() if numbers}, merged)
    if now.number + 1 < after.number and current(spark, path).number != now.number or not _commit(spark, path, after):
        _delete(spark, [f"{path}/segment={name}"])  # another job was faster
        return False
    _clean(spark, path, job, now, after)
    return True


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        system, place = files(spark, folder)
        system.delete(place, True)


def _clean(spark: SparkSession, path: str, job: str, before: State, after: State) -> None:
    """Remove what the manifest before the last one had replaced, and this job's segments that never counted."""
    gone = [f"{path}/segment={s}" for s in before.retired]
    named = {*after.segments, *after.retired}
    gone += [f"{path}/{n}" for n in names(spark, path) if n.startswith(f"segment={job}-") and n.removeprefix("segment=") not in named]
    for j, last in before.covered.items():
        gone += [f"{path}/job={j}/{n}" for n in names(spark, f"{path}/job={j}")
                 if n.startswith("batch_id=") and int(n.removeprefix("batch_id=")) <= last]
    gone += [f"{path}/{MANIFESTS}/{n}" for n in names(spark, f"{path}/{MANIFESTS}") if n.isdigit() and int(n) < before.number]
    _delete(spark, gone)
