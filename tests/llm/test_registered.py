"""The registered queries and the pipeline on the given tables."""

import math
import os
import sys

import duckdb
import pytest

SF, TABLES = "/root/testdata/sf0.001", ("documents", "pages", "benchmark", "labels", "conversations")
#: One row per row of which table; the nodes of a tree and the components of a vector have rows of their own.
WHOLE = {"op7": "pages", "op10": "pages", "op11": None, "op13": None}


def plain(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def names():
    from spanveil.llm import oracles, queries
    return [(n, n in oracles.oracle_sql()) for n in queries.queries()]


@pytest.mark.parametrize("name,twin", names())
def test_query(spark, name, twin):
    from spanveil.llm import oracles, queries
    df = queries.queries()[name](spark, SF)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if whole := WHOLE.get(name.split("_")[0], "documents"):
        assert len(got[1]) == con.execute(f"SELECT count(*) FROM {whole}").fetchone()[0]
    if twin:
        cur = con.execute(oracles.oracle_sql()[name])
        assert got == plain([d[0] for d in cur.description], cur.fetchall())


def test_pipeline(spark):
    import hashlib

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as P
    from test_operators import ALNUM, base_spans, components_of, low, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, frames = docs, []
    for name, stage in P.STAGES:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        if name != P.STAGES[-1][0]:
            assert after.columns == docs.columns
        frames.append((before, after))
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(frames[0][1]) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    text = {r.doc_id: r.text for r in frames[1][0].collect()}
    sets = {i: shingles(t, 5) for i, t in text.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert ids(frames[1][1]) == set(components_of(sets, links).values())
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(low(r.text))
        k = min(13, len(w))
        grams |= {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if k else set()
    clean = set()
    for r in frames[2][0].collect():
        w = ALNUM.findall(low(r.text))
        hit = {i for k in {len(g) for g in grams} for a in range(len(w) - k + 1) if tuple(w[a:a + k]) in grams for i in range(a, a + k)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(r.doc_id)
    assert ids(frames[2][1]) == clean
    assert ids(frames[3][1]) == clean and not [r for r in frames[3][1].collect() if base_spans(r.text) or r.n_chars != len(r.text)]
    said = {r.doc_id: r.text for r in frames[4][0].collect()}
    for r in frames[4][1].collect():
        assert r.decoded_sha256 == hashlib.sha256(said[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert {r.doc_id for r in P.run(spark, SF).collect()} == clean


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as P
    long = " ".join(f"wort{i} und" for i in range(60))
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !", None), (4, long, "de"), (5, long, None), (None, long, "de"), (4, long, "de"), (6, "token = abcdef0123456789", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, _lang string")
    before = df
    for name, stage in P.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
        before = stage(spark, before, SF)
    out = sorted((r.doc_id is None, r.doc_id) for r in before.collect())
    assert out == [(False, 4), (False, 6), (True, None)]


def near_rows(spark, rows):
    import corpus_pipeline as P
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted((r.doc_id, r.text) for r in P.near_duplicates(spark, df, SF).collect())


def test_pipeline_judges_rows_not_ids(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(40))
    other = [(1, say("a")), (1, say("b")), (2, say("c"))]  # one id, different texts: nothing links them
    assert near_rows(spark, other) == sorted(other)
    copies = [(1, say("a")), (5, say("a")), (5, say("b"))]  # the second row 5 is clean
    assert near_rows(spark, copies) == [(1, say("a")), (5, say("b"))]
    tied = [(3, say("a")), (3, say("a") + " end"), (3, say("b")), (4, say("a"))]
    assert len(near_rows(spark, tied)) == 2


def test_held_tables_go(spark):
    import corpus_pipeline as P
    from spanveil.llm import common

    def held():
        system, folder = common._place(spark, f"{common.shared_folder(spark)}/{common.HERE}")
        return {s.getPath().getName() for s in system.listStatus(folder)} if system.exists(folder) else set()

    before = held()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.near_duplicates(spark, docs, SF)
    assert {n.split("-")[0] for n in held() - before} == {"gone", "again"} and kept.count()  # a few ids
    assert kept.columns == docs.columns
