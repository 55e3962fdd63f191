"""Queries on tables in other shapes, and steps that have to share their work out."""

import random

import numpy as np
import pytest

from spanveil.operators import occurrences as O
from spanveil.plans import queries as registered


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_one_or_more_files(spark, tmp_path, files):
    """A table is a file or a folder of part files; streams read both whole."""
    rows = spark.range(40).selectExpr("id % 10 AS conv_id", "id AS turn", "'user' AS role", "concat('Turn ', id) AS text")
    rows.repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("stream_redaction", "stream_mapped_texts"):
        found = {(r.conv_id, r.turn) for r in registered.queries()[name](spark, str(tmp_path)).collect()}
        assert found == {(i % 10, i) for i in range(40)}, name
    assert registered.queries()["stream_mapping"](spark, str(tmp_path)).count() == 10


def test_texts_searched_together_stay_apart():
    """Texts that are searched as one: no hit crosses an end, empty and null texts keep their place."""
    rng = random.Random(5)
    texts = [None if i % 9 == 4 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for i in range(60)]
    every, lengths = O.Filter(1, O.np.full(4096, 255, dtype=O.np.uint8)), [1, 2, 7, 8, 11]
    given = [(since, some) for since, some in O.pieces(texts * 3)]
    assert [t for _, some in given for t in some] == [t or "" for t in texts * 3]
    for since, some in given:
        hits = O.hits_of(some, lengths, every, every)
        got = {(row, v): (n, at) for row, v, n, at in zip(hits.row.tolist(), hits.v, hits.n.tolist(), hits.at.tolist())}
        assert len(got) == len(hits.v) and hits.row.tolist() == sorted(hits.row.tolist())
        assert got == {(i, t[a:a + n]): (t.count(t[a:a + n]), t.find(t[a:a + n]))
                       for i, t in enumerate(some) for n in lengths for a in range(len(t) - n + 1)}


@pytest.mark.parametrize("name", ["frequency_gate", "model_recognizer", "confidence_gate", "protected_spans"])
def test_small_tables_are_searched_by_all_cores(spark, sf, name):
    """One small file is one split; what is detected in its rows is worth more tasks."""
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{sf}/supplier.parquet").rdd.getNumPartitions() < cores
    assert registered.queries()[name](spark, sf).rdd.getNumPartitions() >= cores


def test_many_small_documents_are_read_by_many_tasks(tmp_path, monkeypatch):
    from spanveil.sources import docx

    for i in range(25):
        (tmp_path / f"{i:02d}.docx").write_bytes(b"small")
    monkeypatch.setattr(docx, "MOST_FILES", 10, raising=False)
    parts = docx.DocxReader({"path": str(tmp_path)}).partitions()
    assert [len(p.paths) for p in parts] == [10, 10, 5]
    assert sorted(x for p in parts for x in p.paths) == [str(tmp_path / f"{i:02d}.docx") for i in range(25)]


def test_contexts_are_hashed_in_pieces(monkeypatch):
    """Pieces of whole words give the slots of the whole stream, and no array of hashes is as long as it."""
    from spanveil.llm import mixing

    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 32, 20_000).astype(np.uint8)
    starts = np.unique(np.concatenate([[0], rng.integers(0, 15_000, 3_000)]))  # the last word is a long one
    topic = rng.integers(0, 9, len(starts))
    whole, longest, real = mixing.contexts(symbols, starts, topic), [0], mixing.powers
    monkeypatch.setattr(mixing, "powers", lambda n: (longest.append(n), real(n))[1])
    monkeypatch.setattr(mixing, "PIECE", 700, raising=False)
    assert (mixing.contexts(symbols, starts, topic) == whole).all() and max(longest) < 8_000
    none = np.zeros(0, np.int64)
    assert mixing.contexts(symbols[:0], none, none).shape == (4, 0)


def test_scores_look_each_distinct_word_up_once(monkeypatch):
    """Scores are those of looking up every symbol; repeated words are hashed and looked up once a group."""
    from types import SimpleNamespace

    import pyarrow as pa

    from spanveil.llm import mixing

    rng = np.random.default_rng(4)
    kinds = [f"w{i}ö" * (1 + i % 3) for i in range(40)] + ["日本", "x" * 9_000]
    texts = ["", None, " ", "x" * 5_000] + [" ".join(rng.choice(kinds, 900, p=[0.0249] * 40 + [0.002] * 2)) for _ in range(12)]
    given = mixing.words(pa.array(texts))
    unique = np.unique(given.hash)
    markers = unique[::2], np.arange(len(unique[::2])) % mixing.TOPICS
    data, first, begin = mixing.byte_stream(given)
    symbols, place = mixing.symbol_stream(data)
    odds = rng.integers(-32768, 32767, mixing.OFFSETS[-1]).astype(np.int16)
    slots = mixing.contexts(symbols, place[begin], mixing.topics(given, markers))
    want = mixing.mix_scores(symbols, place[first], slots, odds) / np.log(10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["rid", "doc", "text"])
    frequent = SimpleNamespace(value=(b"", b""))
    hashed, real = [], mixing.contexts
    monkeypatch.setattr(mixing, "contexts", lambda s, *rest: (hashed.append(len(s)), real(s, *rest))[1])
    for group in (1 << 20, 3_000):
        monkeypatch.setattr(mixing, "GROUP", group, raising=False)
        got = [b.column("score").to_numpy() for b in mixing._score(frequent, SimpleNamespace(value=odds.tobytes()), markers, mixing.TABLE_BITS)([batch])]
        assert np.allclose(np.concatenate(got), want, rtol=1e-6)
        if group == 1 << 20:
            assert sum(hashed) < len(symbols) / 3


def test_words_are_counted_by_topic():
    """Counts per word and topic over several batches are those of counting one by one."""
    import pyarrow as pa

    from spanveil.llm import mixing

    rng = np.random.default_rng(5)
    texts = ["", None, "One two", "b" * 70_000] + [" ".join(f"v{i}ß" for i in rng.integers(0, 50, 300)) for _ in range(30)]
    given = mixing.words(pa.array(texts))
    unique = np.unique(given.hash)
    markers = unique[::3], np.arange(len(unique[::3])) % mixing.TOPICS
    data, _, begin = mixing.byte_stream(given)
    ends, raw, want = np.append(begin[1:], len(data)), data.tobytes(), {}
    for a, b, k in zip(begin.tolist(), ends.tolist(), mixing.topics(given, markers).tolist()):
        want[raw[a:b], k] = want.get((raw[a:b], k), 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = pa.Table.from_batches(list(mixing._count_words(markers)([batch.slice(0, 9), batch.slice(9)])))
    rows = out.to_pylist()
    assert {(r["word"], r["k"]): r["n"] for r in rows} == want and len(rows) == len(want)
    alone = pa.Table.from_batches(list(mixing._count_kinds([batch.slice(0, 9), batch.slice(9)]))).to_pylist()
    by_hash = {}
    for r in rows:
        by_hash[r["h"]] = by_hash.get(r["h"], 0) + r["n"]
    assert {r["h"]: r["n"] for r in alone} == by_hash and len(alone) == len(by_hash)


def test_word_files_are_listed_folder_by_folder(tmp_path, monkeypatch):
    """The driver holds the listing of one folder at a time, and a few bytes a file."""
    import pickle

    from spanveil.sources import docx

    want = []
    for folder in ("", "a", "a/b", "c"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for i in range(500):
            (tmp_path / folder / f"{i}\u00e9.docx").write_bytes(b"x" * (i % 3))
            want.append(str(tmp_path / folder / f"{i}\u00e9.docx"))
        (tmp_path / folder / "other.txt").write_bytes(b"")
    seen, real = [], docx.fs.LocalFileSystem

    class Files:
        def get_file_info(self, selector):
            out = real().get_file_info(selector)
            seen.append(len(out))
            return out

    monkeypatch.setattr(docx.fs, "LocalFileSystem", Files)
    parts = docx.DocxReader({"path": str(tmp_path)}).partitions()
    assert sorted(p for part in parts for p in part.paths) == sorted(want) and len(seen) == 4 and max(seen) < 510
    assert len(pickle.dumps(parts)) < 12 * len(want)
    assert [p.paths for p in docx.DocxReader({"path": str(tmp_path), "glob": "*.none"}).partitions()] == [[]]


def test_word_files_are_written_to_several_folders(spark, tmp_path, monkeypatch):
    """The folder of docx_redaction grows in folders of few files each."""
    from spanveil.plans import item_queries, queries

    monkeypatch.setattr(item_queries, "FILE_ENTRIES", 20)
    monkeypatch.setattr(queries, "_scratch", lambda spark: str(tmp_path / "files"))
    spark.range(200).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    out = queries.docx_redaction(spark, str(tmp_path))
    sizes = [len(list(f.iterdir())) for f in (tmp_path / "files").iterdir() if f.is_dir()]
    assert sum(sizes) == 200 and max(sizes) < 60 and len(sizes) > 4
    assert out.select("note_id").distinct().count() == 200 and out.where("story = 'body'").count() == 800


@pytest.mark.parametrize("step", ["_features", "_prefixes", "_sets"])
def test_shingles_are_hashed_in_small_pieces(monkeypatch, step):
    """However large a batch is, a task hashes the words of a megabyte of text (or of one row) at once."""
    from types import SimpleNamespace

    import pyarrow as pa

    from spanveil.llm import jaccard_join as J

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"w{i} " * 2_500 for i in range(300)])], ["doc", "text"])
    seen, real = [], J.words
    monkeypatch.setattr(J, "words", lambda column: (seen.append(sum(map(len, column.to_pylist()))), real(column))[1])
    more = (85, SimpleNamespace(value=bytes(4 << J.SKETCH_BITS))) if step == "_prefixes" else ()
    list(getattr(J, step)(4, *more)([batch]))
    assert sum(seen) == sum(len(t) for t in batch.column("text").to_pylist()) > 2 << 20 and max(seen) <= 1 << 20
