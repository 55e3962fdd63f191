"""The prefix tree of conversations, kept as a z-fast trie in tables.

A conversation is a sequence of turns; a prefix is known by a 128-bit hash, chained turn by turn. So a
conversation is one row with the hashes of its prefixes (16 bytes a turn), and texts are read once.

1. Equal conversations are one sequence with its number of members and its smallest one.
2. Only compacted nodes are kept: branchings, ends, and the root. A node's edge covers the depths
   (top, depth]; the node is hashed under its handle, the prefix whose depth is the 2-fattest number
   there (the one divisible by the highest power of two).
3. A sequence finds its exit node by fat binary search over (l, r]: it looks up the prefix at the
   2-fattest depth; with a node found whose extent it shares, l moves down to that extent, else r moves
   up. After as many steps as the length has binary digits, l is its deepest node, and the child
   there that shares the next turn, if any, holds the depth m at which it leaves the trie.
4. Sequences go in in batches: all of a round find their exits in the same trie. Edges are cut at every
   m. Of the sequences that leave by the same next turn one becomes a leaf; the others search on
   from there in the next round. The one is arbitrary, so that rounds are few even in deep tries.
5. What depends on subtrees is summed by pointer doubling over the compacted nodes: in round k each node
   hands its sums to the ancestor 2^k above, so rounds are the logarithm of the height.
6. Edges are expanded to one row per prefix.

Every step is a join on a prefix hash or an aggregation that Spark combines first; no group of
conversations is ever gathered. The ids that end in a node are put in order by a range partitioning,
joined to pieces of bounded size in parallel, and the pieces are hashed as a stream.

Null roles and texts are empty; turns come by number (null first), equal numbers by the turn's hash.
Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. A conversation
without turns is a member of the root; without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanveil.llm.common import hold, outlive, release, scratch

ROOT = b""
FAMILY, SHARED = 20, 4
PIECE = 1 << 16  # ids in a piece
SEQUENCES = "end binary, hashes array<binary>, words array<bigint>"
NODES = "ext binary, parent binary, top int, depth int, edge array<binary>, words array<bigint>, base bigint"


def two_fattest(low: str, high: str) -> str:
    """SQL: the number in (low, high] that the highest power of two divides."""
    return f"({high} & shiftleft(-1, length(bin(CAST({low} ^ {high} AS BIGINT))) - 1))"


def turn_hash(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversations_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """One row per conversation: id, turns in order as ARRAY<STRUCT<hash, words>>."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    return rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("id"), F.col(turn).alias("turn"), turn_hash(*said).alias("hash"),
        F.regexp_count(said[1], F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words")).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "hash", "words"))),
                    lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def with_family_openings(conversations: DataFrame) -> DataFrame:
    """Each conversation c opens with the first h turns of c - c % 20, then goes on with its own after h.

    h is the CRC-32 of the id in decimal, modulo 4; a conversation lends its turns to 39 others at most.
    """
    lent = conversations.where(F.col("id") % FAMILY == 0).select(
        F.col("id").alias("of"), F.slice("turns", 1, SHARED - 1).alias("opening"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % SHARED).cast("int")
    return conversations.join(lent, F.col("id") - F.col("id") % FAMILY == F.col("of"), "left").select("id", F.concat(
        F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), h),
        F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, words, ends = [], [], []
        for turns in batch.column("turns").to_pylist():
            last, total, chain, counts = ROOT, 0, [], []
            for t in turns:
                last = hashlib.blake2b(last + t["hash"].encode(), digest_size=16).digest()
                total += t["words"]
                chain.append(last)
                counts.append(total)
            hashes.append(chain)
            words.append(counts)
            ends.append(last)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(ends, pa.binary()), pa.array(hashes, pa.list_(pa.binary())),
             pa.array(words, pa.list_(pa.int64()))], ["id", "end", "hashes", "words"])


def sequences(conversations: DataFrame) -> DataFrame:
    """id, end (hash of the whole), hashes of all prefixes, words up to the end of each."""
    return conversations.mapInArrow(_chain, f"id bigint, {SEQUENCES}")


def _joined(left: DataFrame, right: DataFrame, on: Column, how: str = "left") -> DataFrame:
    return left.join(right.hint("shuffle_merge"), on, how)


def locate(sought: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """Where sequences leave the trie. Adds m (depth), m_ext (its prefix), child, child_depth (if any).

    ``deepest`` is the depth of the trie; ``sought`` has end, hashes, size, l (depth of a node that is known to lie on the way) and l_ext.
    """
    handles = nodes.select(F.expr(f"edge[{two_fattest('top', 'depth')} - top - 1]").alias("handle"), F.col("ext").alias("h_ext"),
                           F.col("parent").alias("h_parent"), F.col("top").alias("h_top"), F.col("depth").alias("h_depth"))
    kept = [c for c in sought.columns if c not in ("l", "l_ext")]
    df = sought.withColumn("r", F.least("size", F.lit(deepest)))
    for _ in range(deepest.bit_length()):
        # a sequence whose search has ended asks for what cannot be there
        df = df.withColumn("f", F.expr(f"if(l < r, {two_fattest('l', 'r')}, 0)")).withColumn(
            "probe", F.expr("if(f > 0, hashes[greatest(f, 1) - 1], concat(end, X'00'))"))
        df = _joined(df, handles, F.col("probe") == F.col("handle"))
        df = df.withColumn("fits", F.expr("h_depth <= size AND hashes[least(h_depth, size) - 1] = h_ext"))
        df = df.select(
            *kept, F.expr("CASE WHEN fits THEN h_depth WHEN NOT fits THEN h_top ELSE l END").alias("l"),
            F.expr("CASE WHEN fits THEN h_ext WHEN NOT fits THEN h_parent ELSE l_ext END").alias("l_ext"),
            F.expr("CASE WHEN fits THEN r WHEN NOT fits THEN h_top WHEN f > 0 THEN f - 1 ELSE r END").alias("r"))
    children = nodes.select(F.expr("edge[0]").alias("first"), F.col("ext").alias("child"), F.col("depth").alias("child_depth"),
                            F.col("edge").alias("child_edge"))
    df = df.withColumn("next", F.expr("if(size > l, hashes[least(l, size - 1)], concat(end, X'00'))"))
    df = _joined(df, children, F.col("next") == F.col("first"))
    shared = F.expr("l + coalesce(size(filter(zip_with(child_edge, slice(hashes, l + 1, size(child_edge)), "
                    "(a, b) -> a = b), same -> same)), 0)")
    return df.select(*kept, shared.alias("m"), "l", "l_ext", "child", "child_depth").select(
        *kept, "m", F.expr("if(m = l, l_ext, hashes[greatest(m, 1) - 1])").alias("m_ext"), "child", "child_depth")


def _cut(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """The nodes, with edges cut at every depth at which a sequence leaves them."""
    cuts = located.where("m < child_depth").groupBy(F.col("child").alias("cut")).agg(
        F.sort_array(F.collect_set("m")).alias("cuts"))  # no more than the edge is long
    pieces = _joined(nodes, cuts, F.col("ext") == F.col("cut")).withColumn(
        "bounds", F.expr("concat(array(top), coalesce(cuts, CAST(array() AS ARRAY<INT>)), array(depth))"))
    return pieces.selectExpr(
        "inline(transform(slice(bounds, 1, size(bounds) - 1), (a, i) -> named_struct("
        "'ext', edge[bounds[i + 1] - top - 1], 'parent', if(i = 0, parent, edge[greatest(a - top, 1) - 1]), "
        "'top', a, 'depth', bounds[i + 1], 'edge', slice(edge, a - top + 1, bounds[i + 1] - a), "
        "'words', slice(words, a - top + 1, bounds[i + 1] - a), "
        "'base', if(i = 0, base, words[greatest(a - top, 1) - 1]))))")


def insert(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """The compacted nodes (but for the root) of a trie after sequences went in; both are held tables.

    ``added``: distinct sequences (end, hashes, words), which the trie may have already.
    """
    spark = added.sparkSession
    with scratch(spark):
        pending = hold(added.select("end", "hashes", "words", F.size("hashes").alias("size"), F.lit(0).alias("l"),
                                    F.lit(ROOT).alias("l_ext")).where("size > 0"), "pending")
        mine = None
        while not pending.isEmpty():
            deepest = nodes.agg(F.max("depth")).first()[0] or 0
            located = hold(locate(pending, nodes, deepest), "located")
            going = located.where("size > m").withColumn("next", F.expr("hashes[m]"))
            leaves = going.groupBy("next").agg(F.min_by(F.struct(
                F.col("end").alias("ext"), F.col("m_ext").alias("parent"), F.col("m").alias("top"), F.col("size").alias("depth"),
                F.expr("slice(hashes, m + 1, size - m)").alias("edge"), F.expr("slice(words, m + 1, size - m)").alias("words"),
                F.expr("if(m = 0, 0L, words[greatest(m, 1) - 1])").alias("base")), "end").alias("n")).select("n.*")
            leaves = hold(leaves, "leaves")
            nodes = hold(_cut(nodes, located).unionByName(leaves), "nodes")
            rest = _joined(going, leaves.select(F.col("ext").alias("end")), "end", "left_anti").select(
                "end", "hashes", "words", "size", F.col("m").alias("l"), F.col("m_ext").alias("l_ext"))
            done = pending, mine
            pending = hold(rest, "pending")
            release(*done, located, leaves)
            mine = nodes
        return outlive(mine) if mine is not None else nodes


def empty_trie(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODES)


def subtree_totals(rows: DataFrame, totals: dict[str, str]) -> DataFrame:
    """For each node (ext, parent) its values over the subtree below it, itself included.

    ``totals``: "sum" or "min" per column.
    """
    inner = [F.expr(f"{how}({name})").alias(f"{name}_below") for name, how in totals.items()]
    both = [F.expr(f"least({n}, {n}_below)" if how == "min" else f"{n} + coalesce({n}_below, 0)").alias(n)
            for n, how in totals.items()]
    with scratch(rows.sparkSession):
        state = hold(rows.select("ext", F.col("parent").alias("up"), *totals), "subtrees")
        while not (rising := state.where("up IS NOT NULL")).isEmpty():
            below = rising.groupBy(F.col("up").alias("of")).agg(*inner)
            above = rising.select(F.col("ext").alias("step"), F.col("up").alias("beyond"))
            # nothing is above the root: who is right below it asks for what cannot be there
            next_up = F.expr("if(length(up) > 0, up, concat(ext, X'00'))")
            summed = _joined(state, below, F.col("ext") == F.col("of")).withColumn("next_up", next_up)
            moved = _joined(summed, above, F.col("next_up") == F.col("step"))
            last, state = state, hold(moved.select("ext", F.col("beyond").alias("up"), *both), "subtrees")
            release(last)
        return outlive(state)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (end, id) rows to rows of up to PIECE ids, comma-joined."""
    end, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([end], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
            ["end", "first", "ids"])

    for batch in batches:
        for e, i in zip(batch.column("end").to_pylist(), batch.column("id").to_pylist()):
            if ids and (e != end or len(ids) >= PIECE):
                yield row()
                ids = []
            end = e
            ids.append(i)
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces to the SHA-256 of each end's whole list."""
    end, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for e, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if digest is not None and e == end:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((end, digest.hexdigest()))
                end, digest = e, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["end", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([digest.hexdigest()])], ["end", "sha"])


def list_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each end, ascending and comma-joined: (end, sha)."""
    ordered = members.select("end", "id").repartitionByRange("end", "id").sortWithinPartitions("end", "id")
    pieces = ordered.mapInArrow(_pieces, "end binary, first bigint, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digests, "end binary, sha string")


def prefix_nodes(members: DataFrame) -> DataFrame:
    """All nodes of the tree of ``members`` (id, end, hashes, words), a held table: see ``prefix_trie``."""
    spark = members.sparkSession
    with scratch(spark):
        classes = hold(members.groupBy("end").agg(
            F.count("*").alias("n"), F.min("id").alias("low"), F.first("hashes").alias("hashes"),
            F.first("words").alias("words")), "classes")
        trie = insert(empty_trie(spark), classes.select("end", "hashes", "words"))
        root = classes.limit(1).select(
            F.lit(ROOT).alias("ext"), F.lit(None).cast("binary").alias("parent"), F.lit(-1).alias("top"), F.lit(0).alias("depth"),
            F.array(F.lit(ROOT)).alias("edge"), F.array(F.lit(0).cast("bigint")).alias("words"), F.lit(0).cast("bigint").alias("base"))
        kids = trie.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("kids"))
        ends = classes.select("end", "n", "low").join(list_digests(members).withColumnRenamed("end", "e"), F.col("end") == F.col("e"))
        nodes = _joined(trie.unionByName(root), kids, F.col("ext") == F.col("of"))
        nodes = hold(_joined(nodes, ends, F.col("ext") == F.col("end")).select(
            "ext", "parent", "top", "depth", "words", "base", F.coalesce("kids", F.lit(0)).alias("kids"),
            F.coalesce("n", F.lit(0)).alias("n"), "low", F.col("kids").isNull().cast("bigint").alias("leaves"),
            F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("sha")), "nodes")
        counted = subtree_totals(nodes, {"n": "sum", "low": "min", "leaves": "sum"}).drop("up")
        full = hold(_joined(nodes.drop("n", "low", "leaves"), counted.withColumnRenamed("ext", "x"),
                            F.col("ext") == F.col("x")).drop("x").withColumn(
            "saved", F.expr("(n - 1) * (element_at(words, -1) - base)")), "full")
        saved = subtree_totals(full, {"saved": "sum"}).select(F.col("ext").alias("x"), F.col("saved").alias("whole"))
        full = _joined(full, saved, F.col("ext") == F.col("x")).withColumn("below", F.col("whole") - F.col("saved"))
        above = full.select(F.col("ext").alias("y"), F.col("low").alias("parent_low"))
        full = _joined(full, above, F.col("parent") == F.col("y"))
        empty = hashlib.sha256().hexdigest()
        rows = full.selectExpr("low", "n", "leaves", "kids", "sha", "parent_low", "below", "depth AS deepest", "top", (
            "posexplode(transform(words, (w, i) -> element_at(words, -1) - if(i = 0, base, words[greatest(i, 1) - 1])))"
            " AS (i, left_words)"))
        return outlive(hold(rows.select(
            F.col("low").alias("conv_id"), F.expr("CAST(top + 1 + i AS BIGINT)").alias("depth"),
            F.expr("if(i = 0, parent_low, low)").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.expr("if(top + 1 + i < deepest, 1L, kids)").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.expr("(n - 1) * left_words + below").alias("saved_tokens"),
            F.when(F.expr("top + 1 + i < deepest"), F.lit(empty)).otherwise(F.col("sha")).alias("ends_sha256")), "tree"))


def prefix_trie(rows: DataFrame, families: bool = True, **columns: str) -> DataFrame:
    """Per distinct prefix of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (of the ids that end there).

    saved_tokens: words that a cache of prefixes need not read again, in the whole subtree.
    ``families``: give conversations the opening of their family's first one (``with_family_openings``).
    """
    with scratch(rows.sparkSession):
        said = conversations_of(rows, **columns)
        members = hold(sequences(with_family_openings(said) if families else said), "members")
        return outlive(prefix_nodes(members))
