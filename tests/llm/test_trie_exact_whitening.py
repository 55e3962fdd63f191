"""The prefix trie, exact deduplication and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- prefix trie -----------------------------------------------------------------------

def turn_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), turn_key(role, text), (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def tree(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, who in members.items():
        below, stack = [], [p]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        ends = ",".join(map(str, sorted(c for c in who if len(conversations[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]),
                    sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chat(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, end string, hashes string, id bigint, ext string"
    return spark.createDataFrame([(*r, "e", "h", 1, "x") for r in rows], schema).repartition(3)


def chats(seed, n):
    rng, rows = random.Random(seed), []
    said = ["", " \t ", "hello there", "ok", "日本 語", None, "one two three"]
    for c in rng.sample(range(-30, 200), n):
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", "bot", None]), rng.choice(said)))
    rows += [(None, 0, "user", "nobody")] + rows[:3]
    return rows


@pytest.mark.parametrize("seed,n", [(1, 90), (2, 25)])
def test_trie(spark, seed, n):
    from spanveil.llm.prefix_trie import prefix_trie
    rows = chats(seed, n)
    out = prefix_trie(chat(spark, rows))
    assert tuple(out.columns) == NODE and [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == tree(rebuilt(rows))


def test_trie_long_and_hot(spark):
    """A third of all conversations are equal, one is 300 turns long, others are its beginnings."""
    from spanveil.llm.prefix_trie import conversations_of, prefix_nodes, sequences
    rows = [(c, t, "user", f"turn {t}") for c in (1, 7) for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(20, 60) for t in range(c)]
    rows += [(c, t, "bot", "same words here") for c in range(100, 125) for t in range(2)]
    out = prefix_nodes(sequences(conversations_of(chat(spark, rows))))
    plain = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        plain[c].append((role, text))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == tree(plain)


def test_trie_of_nothing(spark):
    from spanveil.llm.prefix_trie import prefix_trie
    assert prefix_trie(chat(spark, []).where("conv_id = 1")).collect() == []
    # c = 22 lends nothing and has no turn after its first h: a member of the root alone
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "hi"), (None, 1, "user", "x")]
    assert [tuple(r) for r in prefix_trie(chat(spark, rows)).collect()] == tree(rebuilt(rows))


def test_trie_grows_in_batches(spark):
    """Compacted nodes are those of all sequences at once, and each search ends where it must."""
    from spanveil.llm.prefix_trie import ROOT, empty_trie, insert, locate
    rng = random.Random(5)
    paths = {tuple(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    name = lambda p: hashlib.md5("".join(p).encode()).digest() if p else ROOT
    prefix = lambda p: [name(p[:d]) for d in range(1, len(p) + 1)]
    paths = sorted(paths)
    rng.shuffle(paths)
    frame = lambda some: spark.createDataFrame(
        [(name(p), prefix(p), list(range(1, len(p) + 1))) for p in some], "end binary, hashes array<binary>, words array<bigint>")
    trie = empty_trie(spark)
    for a in range(0, len(paths), 40):
        trie = insert(trie, frame(paths[a:a + 40]))
    nodes = {bytes(r.ext): r for r in trie.collect()}
    every = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    kept = {p for p in every if p in paths or sum(q[:-1] == p for q in every if q) != 1}
    assert set(nodes) == {name(p) for p in kept}
    for p in kept:
        top = max((d for d in range(len(p)) if d == 0 or p[:d] in kept))
        r = nodes[name(p)]
        assert (r.top, r.depth, bytes(r.parent)) == (top, len(p), name(p[:top]))
        assert [bytes(x) for x in r.edge] == prefix(p)[top:] and r.words == list(range(top + 1, len(p) + 1)) and r.base == top
    asked = [tuple(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    sought = frame(sorted(set(asked))).selectExpr("end", "hashes", "size(hashes) AS size", "0 AS l", "X'' AS l_ext")
    found = {bytes(r.end): r for r in locate(sought, trie, max(r.depth for r in nodes.values())).collect()}
    for p in set(asked):
        m = max(d for d in range(len(p) + 1) if d == 0 or p[:d] in every)
        r = found[name(p)]
        assert (r.m, bytes(r.m_ext)) == (m, name(p[:m]))
        inside = m > 0 and p[:m] not in kept
        assert (r.child is not None) == inside
        if inside:
            assert r.child_depth > m and name(p[:m]) in map(bytes, nodes[bytes(r.child)].edge)


def test_two_fattest(spark):
    from spanveil.llm.prefix_trie import two_fattest
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)] + [(0, 1 << 20), (1023, 1025)]
    df = spark.createDataFrame(pairs, "a int, b int").selectExpr("a", "b", f"{two_fattest('a', 'b')} AS f")
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: (x & -x)) if b < 100 else a < f <= b


def test_long_lists_are_hashed_in_pieces(spark, monkeypatch):
    from spanveil.llm import prefix_trie as T
    monkeypatch.setattr(T, "PIECE", 100)
    rows = [(bytes([k % 3]), i) for i, k in enumerate(random.Random(1).choices(range(9), k=3000))]
    got = {bytes(r.end): r.sha for r in T.list_digests(spark.createDataFrame(rows, "end binary, id bigint")).collect()}
    assert got == {
        e: hashlib.sha256(",".join(str(i) for k, i in rows if k == e).encode()).hexdigest() for e in {r[0] for r in rows}}


# --- exact deduplication ---------------------------------------------------------------

EXACT = "doc_id bigint, text string, row bigint, digest string, before boolean, n bigint, winner string"


def exact_rows():
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", " a b", "A b", "日本", "a b", "x" * 300_000] + [
        " ".join(rng.choices("abc", k=3)) for _ in range(200)] + ["hot"] * 150
    ids = rng.sample(range(1000), len(texts))
    ids[20] = ids[21] = ids[22]
    ids[30], ids[31] = None, None
    return [(i, t) for i, t in zip(ids, texts)]


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = defaultdict(list)
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for i in ids:
            out[sha].append((i, least, len(ids), i == least))
        seen = [r for r in out[sha] if r[3]]
        for extra in seen[1:]:  # of rows that share id and text one stays
            at = out[sha].index(extra)
            out[sha][at] = (*extra[:3], False)
    return sorted(((*r, sha) for sha, rs in out.items() for r in rs), key=repr)


def test_exact(spark):
    from spanveil.llm.exact_dedup import exact_duplicates
    rows = exact_rows()
    df = spark.createDataFrame([(i, t, 1, "d", True, 2, "w") for i, t in rows], EXACT).repartition(4)
    out = exact_duplicates(df)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == exact_brute(rows)
    assert exact_duplicates(df.limit(0)).collect() == []


def test_exact_earlier_rows_win(spark, monkeypatch):
    from spanveil.llm import exact_dedup as E
    monkeypatch.setattr(E, "SHARD_KEYS", 10)
    rows = [(i, f"text {i % 70}") for i in range(300)]
    out = E.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), earlier=F.col("doc_id") >= 200)
    for r in out.collect():
        same = [i for i, t in rows if i % 70 == r.doc_id % 70]
        assert (r.keep_id, r.group_size, r.kept) == (min(i for i in same if i >= 200), len(same), r.doc_id == r.keep_id)


def test_perfect_hash():
    from spanveil.llm.exact_dedup import perfect_hash, slots_of
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(30_000)), ">u8").astype(np.uint64).reshape(-1, 4)
    for n in (0, 1, 2, 1000, 20_000):
        sizes, bits = perfect_hash(keys[:n])
        assert sorted(slots_of(keys[:n], sizes, bits).tolist()) == list(range(n)) and bits.sum() == n
    strange = slots_of(keys[20_000:], sizes, bits)
    assert strange.max() < n and (strange >= 0).any()  # so digests must be compared


def test_index_serves_later_batches(spark):
    from spanveil.llm import exact_dedup as E
    sha = lambda i: hashlib.sha256(str(i).encode()).digest()
    frame = lambda some: spark.createDataFrame([(sha(i), i, 0, 1) for i in some], E.CLASSES)
    index = E.build_index(frame(range(0, 500)), 7)
    slots = {r.shard: r for r in index.collect()}
    assert sum(len(r.winners) for r in slots.values()) == 500
    got = {bytes(r.digest): (r.id, r.n) for r in E.look_up(index, frame(range(400, 900)).withColumn("id", -F.col("id")), 7).collect()}
    assert got == {sha(i): (i, 2) if 400 <= i < 500 else (i, 1) if i < 400 else (-i, 1) for i in range(900)}


# --- whitening -------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, x string, key string, n string"


def check_whitened(spark, rows, components=16, dims=None):
    from spanveil.llm.whitening import whiten
    df = spark.createDataFrame([(i, v, "x", "k", "n") for i, v in rows], VECTORS).repartition(3)
    out = whiten(df, components=components).collect()
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v) and (dims is None or len(v) == dims)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in good})]
    if not fit:
        assert out == []
        return []
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    exact = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n ** 3) for b in range(d)] for a in range(d)]
    cov = np.array([[float(c) for c in row] for row in exact])
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = min(components, int((values > 8 * d * 2.3e-16 * max(values)).sum()))
    assert len(out) == len(good) * rank
    if not rank:
        return []
    by = defaultdict(list)
    for r in out:
        by[r.vec_id].append(r)
    assert sorted(r.component for r in out) == sorted(list(range(1, rank + 1)) * len(good))
    trace = float(sum(exact[j][j] for j in range(d)))
    deviation = defaultdict(list)
    for i, x in good:
        deviation[i].append(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    for i, rs in by.items():
        assert sorted(int(r.deviation) for r in rs) == sorted(v for v in deviation[i] for _ in range(rank))
    for r in out:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-6 * r.explained
    # whitened: over the fit list the identity, and in the components' own directions
    of = {tuple(x): i for i, x in good}
    if all(i is not None for i in of.values()) and len({i for i, _ in good}) == len(good):
        w = np.array([[next(r.whitened for r in by[of[tuple(x)]] if r.component == k + 1) for k in range(rank)] for x in fit])
        assert np.abs(w.T @ w / n - np.eye(rank)).max() < 1e-6
        centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
        axes = centred.T @ w / n / np.sqrt(values[:rank])  # covariance with a component is its vector times sqrt(e)
        assert np.abs(cov @ axes - axes * values[:rank]).max() < 1e-6 * max(values)
        assert np.abs(centred @ axes / np.sqrt(values[:rank]) - w).max() < 1e-5
    return out


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(24, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 24)) @ mixing)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector in a third of all rows
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, []),
             (2005, [1.0, 2.0])]
    check_whitened(spark, rows, dims=24)


def test_whitening_odd_tables(spark):
    check_whitened(spark, [])
    check_whitened(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])  # one distinct vector: no variance
    check_whitened(spark, [(1, [0.5, 2.0]), (2, [0.5, 1.0]), (3, [0.5, 3.5])])  # one component
    rng = random.Random(2)
    wide = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 6, 12]) for _ in range(4)]) for i in range(40)]
    check_whitened(spark, wide)  # beyond 64 bits
    check_whitened(spark, [(None, [1.0, 2.0]), (None, [2.0, 1.0]), (5, [5.0, 5.0]), (5, [5.0, -1.0])])


def test_bit_planes():
    from spanveil.llm.whitening import LIMB, bit_planes, scatter
    rng = np.random.default_rng(2)
    y = np.column_stack([rng.integers(0, m, 1000) for m in (2, 1, 1000, 1 << 40, 1 << 53)]).astype(np.uint64)
    bits = [int(c).bit_length() for c in y.max(axis=0)]
    total = np.zeros((2 * max(bits) // LIMB + 1, 6, 6), np.int64)
    for a in (0, 300, 365):
        scatter(bit_planes(y[a:{0: 300, 300: 365, 365: 1000}[a]], bits), bits, total)
    ones = [[int(v) for v in row] + [1] for row in y]
    for i in range(6):
        for j in range(i, 6):
            got = sum(int(total[limb, i, j]) << (LIMB * limb) for limb in range(len(total)))
            assert got == sum(r[i] * r[j] for r in ones)
