"""What several operators of this folder need: tables, kept intermediate results, links to groups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HERE = "spanveil-llm"
#: Spark removes an execution's shuffle files when it ends; here each held plan runs once.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL = 256 << 10  # bytes of a table that Spark may broadcast by itself in ``small_broadcasts``
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes with the scope around it, else when the JVM ends."""
    path = f"{shared_folder(spark)}/{HERE}/{name}-{uuid.uuid4().hex}"
    system, target = _place(spark, path)
    system.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage and shuffle files end there."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    held = spark.read.schema(df.schema).parquet(path)
    held.held_at = path
    return held


def release(*frames: DataFrame | None) -> None:
    """Delete the tables of held frames that nothing will read again."""
    for df in frames:
        path = getattr(df, "held_at", None)
        if path:
            system, target = _place(df.sparkSession, path)
            system.delete(target, True)
            for scope in _scopes:
                if path in scope:
                    scope.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside go when the block ends, but for those given to ``outlive``."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            system, target = _place(spark, path)
            system.delete(target, True)


def outlive(df: DataFrame) -> DataFrame:
    """Hand a held frame of the innermost scope to the scope around that one."""
    _scopes[-1].remove(df.held_at)
    if len(_scopes) > 1:
        _scopes[-2].append(df.held_at)
    return df


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, joins broadcast sides of SMALL bytes at most: Spark builds what it broadcasts in the driver's memory.

    A held table counts as its file, which may be a small part of its rows in memory.
    """
    parsed = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    base, own = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {n: spark.conf.get(n, None) for n in (base, own)}
    used = {base: spark.conf.get(base), own: before[own] or "-1"}
    more = [n for n, v in used.items() if not v.startswith("-") and int(parsed(v)) > SMALL]
    for n in more:
        spark.conf.set(n, str(SMALL))
    try:
        yield
    finally:
        for n in more:
            spark.conf.unset(n) if before[n] is None else spark.conf.set(n, before[n])


def collect_garbage(spark: SparkSession) -> None:
    """Let go what plans that are gone have left.

    Spark drops their broadcasts when the driver collects its garbage; the JVM gives back what its heap had grown by.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (null: empty), modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours. Each step is a minimum per node (combined before the
    shuffle) and a join on the node, so a node with very many links is split like any skewed join.
    """
    def step(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"))
            least = least.select("a", F.least("a", "m").alias("m"))
            moved = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
        else:  # larger end first
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            moved = (down.join(least, "a").select(F.col("b").alias("x"), "m")
                     .unionByName(least.select(F.col("a").alias("x"), "m")))
        return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = hold(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = mark(e)
    while before[0]:
        e, last = hold(step(step(e, True), False).distinct(), "edges"), e
        release(last)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def join_checked(left: DataFrame, right: DataFrame, on, how: str, elements: str = "1",
                 most: int = 20_000) -> DataFrame:
    """Join with a held frame: broadcast it if it is small, else leave the shuffle to Spark.

    ``elements``: SQL for how many values a row of it holds; ``most`` bounds their sum.
    """
    total = right.agg(F.sum(F.expr(elements))).first()[0] or 0
    return left.join(F.broadcast(right) if total <= most else right.hint("shuffle_merge"), on, how)
