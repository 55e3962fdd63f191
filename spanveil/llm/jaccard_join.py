"""Exact Jaccard similarity join of word shingles as a metric-space join.

Documents are sets of hashed shingles under the Jaccard distance d = 1 - |x & y| / |x | y|, which
obeys the triangle inequality. Linked are sets with d <= r (r = 1 - threshold).

1. Equal sets are one point: a class with its smallest id as representative.
2. The first pivot is the empty set: it orders points by size, in bands that grow by 1 / t. Linked
   points are in one band or in neighbouring ones, so each point is replicated into the next band
   when it can reach it. Within a band, points that can be linked share a shingle among the first
   n - o + 1 of their n, o being the least overlap with any partner, in any order that is the same
   for all, and j among the first n - o + j (``shared_least`` gives j by band). Rare shingles go first (a count sketch of fixed size, filled by all documents, orders
   them). Only points that share so many of them go on: their texts are read again, and how many of
   them hold a shingle is counted exactly. The points that share one of the first n - o + 1 in the
   order of these counts form a region. Shingles of one point alone come first and are not kept.
3. Each region gets pivots, first the point with the fewest shingles of its own: of near copies one
   that is close to what they were copied from. The distances of all its points to its pivots are
   computed, which finds all links with them, and pivots leave. A distance that a small signature
   (members counted per hash bucket) shows to be over RADIUS + r is not computed: it matters to no
   rule below. Every other point belongs to the Voronoi cell of its nearest pivot when that is
   within ``RADIUS``, else to the rest of the region. By the triangle inequality a point linked with
   one of cell p is at most 2r further from p than from its own pivot, and at most RADIUS + r away
   from p: points in that window are replicated into the cell. Cells of one pivot are one.
4. In the cell of p a point x is the set D = x ^ p' of what differs from the pivot (p' is p without
   shingles that it alone has), and |x ^ y| is |Dx| + |Dy| - 2 |Dx & Dy|. So x and y are linked when w(x) + w(y) <= 2 (1 + t) |Dx & Dy|, where
   w(x) = (1 + t) |Dx| - (1 - t) |x|. With m the point of least w, all points with w(x) <= -w(m) are
   linked with m for sure, and no pair of them is made. A pair with another point shares differences:
   at least (w(x) + w(y)) / (2 + 2t) of them, thus one early in both, rarest of the cell first.
   Such pairs are compared by their differences.
5. Rests are the regions of the next round, with four times as many pivots at most. Links found so
   far join points to components; a region in which all points are of one component has no pair left
   to compare and is dropped. Pivots are taken from all but a region's largest component, so it is
   done when the others are. Rounds go on until no region is left.
6. Components of the links join the classes; each document takes its class's component.

Pairs are made with pivots, and of points that share enough of what differs from their pivot: near
copies that were changed in different places make none. Texts are read again only for points that
share a shingle among their first with another.

Lower-casing is of A-Z only. A text with fewer words than a shingle is one shingle; a null or empty
text is the empty set, linked with nothing, its own component. Repeated ids are classed row by row;
a row with a null id makes no link and takes the component of its class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanveil.llm.common import collect_garbage, components, hold, outlive, release, scratch, small_broadcasts
from spanveil.llm.words import Words, mix, slices, windows, words

U = np.uint64
SKETCH_BITS, SKETCH_PARTS = 20, 64
RADIUS = 0.35
HASHED = 1 << 20  # bytes of text whose shingles are hashed at once
PAGE_BITS, MOST_BITS = 15, 26  # bits in a page of the filter of ids (4 KB), and in all of it at most (8 MB)
BITS_PER_ID, PROBES = 16, 3


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    size = np.diff(w.first)
    hashes = windows(w.hash, k)
    short = {}
    for m in range(1, k):  # fewer words than a shingle: all of them
        rows = np.flatnonzero(size == m)
        if len(rows):
            some = windows(w.hash, m)[w.first[rows]]
            short.update(zip(rows.tolist(), some))
    out = []
    for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b - a >= k:
            out.append(np.unique(hashes[a:b - k + 1]))
        else:
            out.append(np.array([short[r]], U) if b > a else np.zeros(0, U))
    return out


def class_of(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(np.sum(mix(s, 5), dtype=U)[None] ^ U(len(s)), 6).view(np.int64)[0]) if len(s) else 0


def signature(s: np.ndarray) -> bytes | None:
    """How many members fall in each hash bucket; about n / 8 buckets, a power of two of them."""
    bits = max(3, (len(s) // 8).bit_length())
    counts = np.bincount((mix(s, 8) >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def most_common(a: bytes | None, b: bytes | None, n: int, m: int) -> int:
    """An upper bound of the members that two sets share, from their signatures."""
    if a is None or b is None:
        return min(n, m)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))  # buckets are leading bits: fold the finer signature
    x, y = x.reshape(size, -1).sum(axis=1, dtype=np.int64), y.reshape(size, -1).sum(axis=1, dtype=np.int64)
    return int(np.minimum(x, y).sum())


def band_bounds(percent: int, most: int) -> np.ndarray:
    """Least size of each band. A linked partner of a size is at most one band away."""
    out = [1, 2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return np.array([*out, max(out[-1] + 1, -(-100 * out[-1] // percent))])


def shared_least(size: int, percent: int) -> int:
    """How many of their first n - o + that many shingles linked points of a band share, by its least size."""
    return min(1 + size // 40, -(-percent * size // 100))


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        names = ["doc", "n", "cls", "sig", "part", "counts"]
        for batch in slices(batches, "text", HASHED):
            sets, kind = shingle_sets(words(batch.column("text")), k), batch.column("doc").type
            if sets:
                sketch += np.bincount((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64),
                                      minlength=1 << SKETCH_BITS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if sketch.any():
            parts = [p.astype("<u4").tobytes() for p in np.split(sketch, SKETCH_PARTS)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind), none, none, pa.nulls(len(parts), pa.binary()),
                 pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _add(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.uint64) for x in part.column("counts"))
    low = np.minimum(total, U(0xFFFFFFFF)).astype("<u4").tobytes()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([low], pa.binary())})


def _prefixes(k: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = np.frombuffer(counts.value, "<u4"), set()
        for batch in slices(batches, "text", HASHED):
            regions, classes, needs, homes = [], [], [], []
            sets = shingle_sets(words(batch.column("text")), k)
            bounds = band_bounds(percent, max([1, *map(len, sets)]))
            for s in sets:
                n, cls = len(s), class_of(s)
                if not n or cls in seen:
                    continue
                if len(seen) < 1_000_000:  # copies in the same task: their rows would be equal
                    seen.add(cls)
                count = order[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                s = s[np.argsort(count, kind="stable")]
                band, least = int(np.searchsorted(bounds, n, side="right")) - 1, -(-percent * n // 100)
                # partners of the own band and the one below; then those of the band above
                for at, partner in ((band, max(least, int(bounds[max(band - 1, 0)]))), (band + 1, int(bounds[band + 1]))):
                    if percent * partner > 100 * n:
                        continue
                    overlap = -(-percent * (n + partner) // (100 + percent))
                    need = shared_least(int(bounds[max(at - 1, 0)]), percent)
                    first = s[:n - overlap + need]
                    regions.append(mix(first, 100 + at))
                    classes.append(np.full(len(first), cls, np.int64))
                    needs.append(np.full(len(first), need, np.int32))
                    homes.append(np.full(len(first), at == band))
            if regions:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(regions).view(np.int64)), pa.array(np.concatenate(classes)),
                     pa.array(np.concatenate(needs)), pa.array(np.concatenate(homes))], ["g", "x", "need", "home"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in ("su", "sv", "nu", "nv")}
        most = [most_common(*row) for row in zip(c["su"], c["sv"], c["nu"], c["nv"])]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(most, pa.int64()),
                                          batch.column("nu"), batch.column("nv")], ["u", "v", "most", "nu", "nv"])


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """The bits of hashes in their page; the page itself is in their highest bits."""
    return [(h >> U(PAGE_BITS * i) & U((1 << PAGE_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


def _page(key: tuple[pa.Scalar, ...], ids: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PAGE_BITS, bool)
    for at in _probes(ids.column("h").to_numpy().view(U)):
        bits[at] = True
    return pa.table({"page": pa.array([key[0].as_py()], pa.int32()),
                     "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _filter(hashes: DataFrame) -> bytes:
    """A Bloom filter of 64-bit hashes (h), as big as their number asks for: MOST_BITS at most, more pass then.

    Tasks fill its pages, and only these come to the driver.
    """
    bits = min(max(PAGE_BITS, (BITS_PER_ID * hashes.count()).bit_length()), MOST_BITS)
    page = F.shiftrightunsigned("h", 64 - (bits - PAGE_BITS)).cast("int") if bits > PAGE_BITS else F.lit(0)
    out = np.zeros((1 << bits - PAGE_BITS, 1 << PAGE_BITS - 3), np.uint8)
    for r in hashes.withColumn("page", page).groupBy("page").applyInArrow(_page, "page int, bits binary").collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; all that are do."""
    extra = (len(bits) >> PAGE_BITS - 3).bit_length() - 1
    page = (h >> U(64 - extra)).astype(np.int64) << PAGE_BITS if extra else np.zeros(len(h), np.int64)
    return np.logical_and.reduce([bits[page + at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1 for at in _probes(h)])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASHED):
            sets = shingle_sets(words(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["x", "members"])

    return run


def _wanted(k: int, ids):
    """``_sets`` of the texts whose hash of the id (h) passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(ids.value, np.uint8)
        yield from _sets(k)(b.filter(pa.array(_passes(bits, b.column("h").to_numpy().view(U)))) for b in batches)

    return run


def _open(regions: DataFrame, merged: DataFrame | None) -> DataFrame:
    """Regions with pairs left to compare, each only once, with a column ``minor``.

    ``minor``: not of the largest component in the region.
    """
    if merged is None:
        rows = regions.withColumn("label", F.col("x"))
    else:
        rows = regions.join(merged.withColumnRenamed("node", "x"), "x", "left").withColumn(
            "label", F.coalesce("component", "x")).drop("component")
    parts = rows.groupBy("g", "label").agg(
        F.count("*").alias("rows"), F.max("home").alias("home"),
        F.sum(F.xxhash64("x", "home").cast("decimal(38,0)")).alias("print"))
    per = parts.groupBy("g").agg(F.max(F.struct("rows", "label")).alias("largest"), F.count("*").alias("parts"),
                                 F.max("home").alias("any_home"), F.sum("rows").alias("rows"), F.sum("print").alias("print"))
    # regions of the same points, met under several shingles, go on once
    once = per.where("parts > 1 AND any_home").groupBy("rows", "print").agg(
        F.min(F.struct("g", "largest.label")).alias("one")).select(F.col("one.g").alias("g"), F.col("one.label").alias("most"))
    return rows.join(once, "g").select(*regions.columns, (F.col("label") != F.col("most")).alias("minor"))


def _pivots(regions: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` points per region as pivots (g, p, pn), none of the largest component.

    Those with the fewest shingles of their own are the closest to what the others have in common.
    """
    salt = F.pmod(F.xxhash64("x", F.lit(most)), F.lit(most))
    return (regions.where("minor").groupBy("g", salt.alias("salt")).agg(F.min(F.struct("alone", "x", "n")).alias("m"))
            .select("g", F.col("m.x").alias("p"), F.col("m.n").alias("pn")))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                       percent: int = 85) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest id reachable by links), class_id, group_id.

    Linked are sets with 100 * |x & y| >= percent * |x | y|. Rows of one class_id have equal sets, rows
    of one group_id are linked; both are null without words. (Where ids repeat, groups may share a
    component_id.)
    """
    with scratch(docs.sparkSession), small_broadcasts(docs.sparkSession):
        return outlive(_classed(docs, key, text, shingle, percent))


def _classed(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = given.schema["doc"].dataType.simpleString()
    features = hold(given.mapInArrow(
        _features(shingle), f"doc {kind}, n long, cls long, sig binary, part int, counts binary"), "features")
    points = features.where("part IS NULL").select("doc", "n", "cls")
    classes = hold(features.where("part IS NULL AND n > 0 AND doc IS NOT NULL").groupBy("cls").agg(
        F.min("doc").alias("doc"), F.max("n").cast("int").alias("n"), F.first("sig").alias("sig")), "classes")
    links = _links(spark, given, features, classes, shingle, percent)

    merged = components(links.select(F.col("x").alias("a"), F.col("p").alias("b")))
    grouped = classes.select("cls", "doc").join(merged, F.col("cls") == F.col("node"), "left").select(
        F.col("cls").alias("c"), "doc", F.coalesce("component", "cls").alias("group_id"))
    least = grouped.groupBy("group_id").agg(F.min("doc").alias("component"))
    component = grouped.drop("doc").join(least, "group_id")
    some = points.n > 0
    return hold(points.join(component, (points.cls == component.c) & some, "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"),
        F.when(some, F.col("cls")).alias("class_id"), "group_id"), "components")


def with_class(docs: DataFrame, into: str, text: str = "text", shingle: int = 4) -> DataFrame:
    """The rows with the class of their text added, null for a text without words."""
    names = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASHED):
            classes = [class_of(s) if len(s) else None for s in shingle_sets(words(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(classes, pa.int64())], ["_row", "cls"])

    out = given.mapInArrow(run, f"_row {given.schema['_row'].dataType.simpleString()}, cls long")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], F.col("cls").alias(into))


def _links(spark: SparkSession, given: DataFrame, features: DataFrame, classes: DataFrame, k: int,
           percent: int) -> DataFrame:
    """Links (x, p) between classes, enough to connect all that links connect."""
    parts = features.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(
        _add, "part int, counts binary").collect()  # SKETCH_PARTS rows of a fixed size
    whole = b"".join(r["counts"] for r in sorted(parts, key=lambda r: r["part"]))
    counts = spark.sparkContext.broadcast(whole or bytes(4 << SKETCH_BITS))
    rows = given.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _prefixes(k, percent, counts), "g long, x long, need int, home boolean")
    group = Window.partitionBy("g")
    rows = rows.withColumns({"low": F.min("x").over(group), "high": F.max("x").over(group),
                             "any_home": F.max("home").over(group)}).where("low < high AND any_home")
    points = rows.select("g", "x", "need", "home").distinct().groupBy("x", "home").agg(
        F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select(F.col("x").alias("cls"))
    sets = hold(_shared(_fetch(given, classes, points, k)), "sets")
    regions = hold(_regions(sets, percent), "rows")

    reach, radius = 100 - percent, round(100 * RADIUS)  # r and the radius, in hundredths
    kept = 100 - radius - reach
    merged, pivots = None, 1
    while True:
        regions, last = hold(_open(regions, merged), "regions"), regions
        release(last)
        if regions.isEmpty():
            break
        chosen = hold(_pivots(regions, pivots), "pivots")
        near = regions.drop("minor").join(chosen, "g").where("x <> p")
        pairs = near.where(f"100 * least(n, pn) >= {kept} * greatest(n, pn)").select(
            F.least("x", "p").alias("u"), F.greatest("x", "p").alias("v")).distinct()
        half = lambda c: classes.select(F.col("cls").alias(c), F.col("sig").alias("s" + c), F.col("n").alias("n" + c))
        pairs = hold(pairs.join(half("u"), "u").join(half("v"), "v").mapInArrow(
            _bounds, "u long, v long, most long, nu int, nv int").where(
            f"100 * most >= {kept} * (nu + nv - most)").select("u", "v"), "pairs")
        known = hold(_distances(pairs, sets), "known")
        near = near.join(known.select("u", "v", "gap", "either"), (F.least("x", "p") == F.col("u")) & (F.greatest("x", "p") == F.col("v")), "left").select(
            *regions.drop("minor").columns, "p", F.coalesce(F.col("gap") / F.col("either"), F.lit(1.0)).alias("d"))
        near = near.join(chosen.select("g", F.col("p").alias("x")), ["g", "x"], "left_anti")  # pivots leave
        placed = hold(_next(near, reach / 100, RADIUS), "rows")
        cells = placed.where("p IS NOT NULL").groupBy("p", "x").agg(F.first("n").alias("n"), F.max("home").alias("home"))
        cells = hold(cells.join(known, (F.least("x", "p") == F.col("u")) & (F.greatest("x", "p") == F.col("v"))).select(
            "p", "x", "n", "home", (F.col("gap") - F.when(F.col("p") == F.col("u"), F.col("au")).otherwise(F.col("av"))).alias("gap"),
            "diff"), "cells")
        links = known.where(f"100 * gap <= {reach} * either").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            _cell_links(cells, percent))
        with scratch(spark):
            joined = outlive(hold(components(links if merged is None else links.unionByName(_stars(merged))), "merged"))
        release(merged, regions, chosen, pairs, known, cells)
        merged = joined
        regions = hold(placed.where("p IS NULL").drop("p"), "rows")
        release(placed)
        collect_garbage(spark)
        pivots = min(pivots * 4, 1 << 20)
    if merged is None:
        return spark.createDataFrame([], "x long, p long")
    return _stars(merged).select(F.col("a").alias("x"), F.col("b").alias("p"))


def _stars(merged: DataFrame) -> DataFrame:
    """Components as links (a, b) of each point with its component's smallest."""
    return merged.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _fetch(given: DataFrame, classes: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The sets (x, members) of some classes (cls).

    Texts are not shuffled, and their ids not sent to the driver: a filter of the ids leaves few other texts,
    which go with their classes.
    """
    wanted = hold(classes.join(points, "cls", "left_semi").select("cls", F.xxhash64("doc").alias("h")), "wanted")
    ids = given.sparkSession.sparkContext.broadcast(_filter(wanted.select("h").distinct()))
    texts = given.where("doc IS NOT NULL").select("text", F.xxhash64("doc").alias("h"))
    out = hold(texts.mapInArrow(_wanted(k, ids), "x long, members array<bigint>").join(
        wanted.select(F.col("cls").alias("x")), "x", "left_semi").dropDuplicates(["x"]), "members")
    ids.unpersist()
    return out


def _shared(sets: DataFrame) -> DataFrame:
    """(x, n, members): members that another of the sets has too, rarest first; n counts all members."""
    one = sets.select("x", F.size("members").alias("n"), F.explode("members").alias("s"))
    count = hold(one.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "counts")  # its shuffle files go
    return one.join(count, "s").groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all")).select(
        "x", "n", F.col("all.s").alias("members"))


def _regions(sets: DataFrame, percent: int) -> DataFrame:
    """Points by the shingles that a linked one must share one of: (g, x, n, alone, home)."""
    partner = f"(n + ({percent} * n + 99) div 100)"  # sizes of a point and the smallest linked one, summed
    first = f"n - ({percent} * {partner} + {99 + percent}) div {100 + percent} + 1 - alone"
    return sets.withColumn("alone", F.col("n") - F.size("members")).withColumn("first", F.expr(first).cast("int")).where(
        "first > 0").select(F.explode(F.expr("slice(members, 1, first)")).alias("g"), "x", "n", "alone", F.lit(True).alias("home"))


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with |u | v| as ``either``, |u ^ v| as ``gap``, and its shared members ``diff``.

    ``au`` and ``av`` count the members that no other set has.
    """
    half = lambda c: sets.select(F.col("x").alias(c), F.col("n").alias("n" + c), F.col("members").alias("s" + c))
    met = pairs.join(half("u"), "u").join(half("v"), "v").select(
        "u", "v", (F.col("nu") + F.col("nv")).cast("long").alias("sum"),
        (F.col("nu") - F.size("su")).alias("au"), (F.col("nv") - F.size("sv")).alias("av"),
        F.concat(F.array_except("su", "sv"), F.array_except("sv", "su")).alias("diff"),
        F.size(F.array_intersect("su", "sv")).cast("long").alias("both"))
    return met.select("u", "v", (F.col("sum") - F.col("both")).alias("either"),
                      (F.col("sum") - 2 * F.col("both")).alias("gap"), "au", "av", "diff")


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of cells (p, x, n, home, gap, diff), enough to connect all that their links connect.

    ``gap`` counts the members that are not both the point's and the pivot's, without those that the pivot
    alone has; ``diff`` are those of them that others have too.
    """
    more, less = 100 + percent, 100 - percent
    cells = cells.withColumn("w", more * F.col("gap") - less * F.col("n"))
    least = cells.groupBy("p").agg(F.min(F.struct("w", "x")).alias("m"), F.max("w").alias("high")).select(
        "p", F.col("m.w").alias("wm"), F.col("m.x").alias("m"), "high")
    cells = hold(cells.join(least, "p").withColumn("outer", F.col("w") + F.col("wm") > 0), "weighed")
    sure = cells.where("NOT outer AND x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))

    # what a linked partner shares at least: an outer point's has w >= wm, and has so many members;
    # a sure point's is an outer one
    need = F.expr(f"""CASE WHEN outer THEN w + greatest(wm, w - {2 * less} * floor(100 * n / {percent}))
                      ELSE w - wm + 1 END""")
    each = cells.where("high + wm > 0").select(
        "p", "x", "n", "home", "outer", "w", F.greatest(F.ceil(need / (2 * more)), F.lit(1)).alias("need"),
        F.explode("diff").alias("e"))
    seen = each.groupBy("p", "e").agg(F.count("*").alias("c")).where("c > 1")
    first = each.join(seen, ["p", "e"]).groupBy("p", "x", "n", "home", "outer", "w", "need").agg(
        F.sort_array(F.collect_list(F.struct("c", "e"))).alias("all"))
    first = first.select("p", "x", "n", "home", "outer", "w", "need", F.size("all").alias("size"),
                         F.posexplode("all.e").alias("i", "e")).withColumn(
        "left", F.col("size") - F.col("i")).where("left >= need").select("p", "e", "x", "n", "home", "outer", "w", "left")
    first = hold(first, "first")
    other = first.select("p", "e", *[F.col(c).alias("o" + c) for c in ("x", "n", "home", "outer", "w", "left")])
    pairs = hold(first.where("outer").join(other, ["p", "e"]).where(
        f"""x <> ox AND (NOT oouter OR x < ox) AND (home OR ohome) AND w + ow <= {2 * more} * least(left, oleft)
        AND 100 * least(n, on) >= {percent} * greatest(n, on)""").select("p", F.col("x").alias("a"), F.col("ox").alias("b")).distinct(), "pairs")
    half = lambda c: cells.select("p", F.col("x").alias(c), F.col("w").alias("w" + c), F.col("diff").alias("d" + c))
    found = pairs.join(half("a"), ["p", "a"]).join(half("b"), ["p", "b"]).where(
        F.col("wa") + F.col("wb") <= 2 * more * F.size(F.array_intersect("da", "db"))).select("a", "b")
    return sure.unionByName(found)


def _next(near: DataFrame, r: float, radius: float, slack: float = 1e-9) -> DataFrame:
    """Cells and rests of all regions: as regions, with the pivot ``p`` of a cell (null: a rest)."""
    others = [c for c in near.columns if c not in ("g", "x", "p", "d", "home")]
    own = near.groupBy("g", "x").agg(
        F.min(F.struct("d", "p")).alias("nearest"), F.first("home").alias("home"), *[F.first(c).alias(c) for c in others],
        F.sort_array(F.collect_list(F.when(F.col("d") <= radius + r + slack, F.struct("d", "p")))).alias("reached"))
    # where a point goes: its own cell (or the rest), then the cells whose windows hold it
    celled = F.col("nearest.d") <= radius
    home = F.struct(F.when(celled, F.xxhash64("g", "nearest.p")).otherwise(F.xxhash64("g", F.lit("rest"))).alias("g"),
                    F.col("home").alias("home"), F.when(celled, F.col("nearest.p")).alias("p"))
    more = F.transform(
        F.filter("reached", lambda c: (~celled | (c["p"] != F.col("nearest.p")))
                 & (~celled | (c["d"] <= F.col("nearest.d") + 2 * r + slack))),
        # a point of the rest meets those of a cell only in the cell: it is as much at home there
        lambda c: F.struct(F.xxhash64("g", c["p"]).alias("g"), (~celled & F.col("home")).alias("home"), c["p"].alias("p")))
    placed = own.select("x", *others, F.explode(F.concat(F.array(home), more)).alias("at"))
    return placed.select("at.g", "x", *others, "at.home", "at.p")
