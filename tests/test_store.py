"""The mapping store of streams: bounded files, old entries win, crashes lose nothing."""

import pytest

from spanveil.schema import MAPPING
from spanveil.streaming import store


def frame(spark, rows):
    return spark.createDataFrame(rows, MAPPING)


def put(spark, path, job, batch, originals, tag=None):
    store.append(frame(spark, [(o, "EMAIL", f"{tag or job}-{batch}-{o}") for o in originals]).coalesce(1), path, job, batch)


def table(spark, path):
    return {r.original: r.replacement for r in store.stream_mapping_table(spark, path).collect()}


def folders(spark, path):
    open_ones = store.batches(spark, path, store.current(spark, path).covered)
    return len(store.current(spark, path).segments), sum(map(len, open_ones.values()))


def test_long_streams_read_few_folders(spark, tmp_path):
    """120 batches: segments grow with their logarithm, and no entry is lost or changed."""
    path, want, most = str(tmp_path / "map"), {}, 0
    for b in range(120):
        fresh = [f"v{b}-{i}" for i in range(3)] + ([f"v{b - 50}-0"] if b > 60 else [])  # made again: the first counts
        store.compact(spark, path, "a", b, every=8, fanout=3)
        put(spark, path, "a", b, fresh)
        for o in fresh:
            want.setdefault(o, f"a-{b}-{o}")
        segments, open_ones = folders(spark, path)
        assert open_ones <= 9 and segments <= 2 * 3
        most = max(most, segments)
        if b % 40 == 39:
            assert table(spark, path) == want
    assert most >= 3 and table(spark, path) == want
    files = [f for f in store.stream_entries(spark, path).where("bucket = 7").inputFiles()]
    assert len([f for f in files if "bucket=7/" in f]) <= 6 + 9
    there = [n for n in store.names(spark, f"{path}/job=a") if n.startswith("batch_id=")]
    assert len(there) <= 3 * 8 and len(store.names(spark, f"{path}/{store.MANIFESTS}")) <= 2


def test_crash_between_segment_and_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "map")
    for b in range(5):
        put(spark, path, "a", b, [f"v{b}", "same"])
    want = table(spark, path)
    assert want["same"] == "a-0-same"
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.compact(spark, path, "a", 5, every=4)
    assert store.current(spark, path).number == -1 and table(spark, path) == want
    # a manifest that was cut off does not count either
    system, place = store.files(spark, f"{path}/{store.MANIFESTS}/{0:012d}")
    stream = system.create(place, False)
    stream.write(bytearray(b'{"segments": {"x'))
    stream.close()
    assert store.current(spark, path).number == -1 and table(spark, path) == want
    assert store.compact(spark, path, "a", 5, every=4)
    now = store.current(spark, path)
    assert now.number == 1 and now.covered == {"a": 4} and table(spark, path) == want
    assert [n for n in store.names(spark, path) if n.startswith("segment=")] == [f"segment={s}" for s in now.segments]
    assert len([n for n in store.names(spark, f"{path}/job=a") if n.startswith("batch_id=")]) == 5  # for who still reads them


def test_open_batches_stay_open(spark, tmp_path):
    """The last batch of another job may be repeated; plain entries win over all."""
    from spanveil.sources.tables import write_mapping
    path = str(tmp_path / "map")
    write_mapping(frame(spark, [("w", "EMAIL", "old")]), path)
    for b in range(3):
        put(spark, path, "a", b, [f"a{b}", "both", "w"])
        put(spark, path, "b", b, [f"b{b}", "both"])
    assert not store.compact(spark, path, "a", 3, every=6)
    assert store.compact(spark, path, "a", 3, every=5)
    assert store.current(spark, path).covered == {"a": 2, "b": 1}
    put(spark, path, "b", 2, ["b2", "new"], tag="again")  # repeated
    got = table(spark, path)
    assert got["w"] == "old" and got["both"] == "a-0-both" and got["new"] == "again-2-new" and got["b2"] == "again-2-b2"
    assert {f"a{b}" for b in range(3)} | {f"b{b}" for b in range(3)} < set(got)


def test_two_jobs_seal_at_once(spark, tmp_path, monkeypatch):
    """Of two that seal the same batches one wins; the other's segment never counts."""
    path = str(tmp_path / "map")
    for b in range(4):
        put(spark, path, "a", b, [f"v{b}"])
    put(spark, path, "b", 0, ["x"])
    want, real = table(spark, path), store._commit

    def slow(spark_, path_, state):
        monkeypatch.setattr(store, "_commit", real)
        assert store.compact(spark_, path_, "b", 1, every=3)
        return real(spark_, path_, state)

    monkeypatch.setattr(store, "_commit", slow)
    assert not store.compact(spark, path, "a", 4, every=3)
    assert table(spark, path) == want and len(store.current(spark, path).segments) == 1


def test_stream_seals_on_its_way(spark, tmp_path, monkeypatch):
    from spanveil.streaming.redaction import redact_with_mapping
    monkeypatch.setattr(store.compact, "__defaults__", (2, 2))
    source, mapping = str(tmp_path / "in"), str(tmp_path / "map")
    for part in range(4):
        spark.createDataFrame([(f"{part}", f"see u{part}@m.com and w@m.com")], "id string, text string").coalesce(1).write.mode(
            "append").parquet(source)
    texts = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    redact_with_mapping(texts, ["id"], mapping, str(tmp_path / "out"), str(tmp_path / "state"), recognizers=["email"]).awaitTermination()
    assert store.current(spark, mapping).segments
    known = table(spark, mapping)
    assert sorted(known) == ["u0@m.com", "u1@m.com", "u2@m.com", "u3@m.com", "w@m.com"]
    out = {r.id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {f"{p}": f"see {known[f'u{p}@m.com']} and {known['w@m.com']}" for p in range(4)}
