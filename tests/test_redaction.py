"""Mapping, fakes, rewriting of texts, runs and pages; streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import patterns as P
from spanveil.functions.dictionaries import ENTITY_TYPES
from spanveil.functions.pseudonyms import GENERATORS, constant_masks, fake
from spanveil.operators.detect import detect, detect_distinct
from spanveil.operators.mapping import (
    build_mapping, extend_mapping, first_types, look_up, shared_fakes, with_replacements,
)
from spanveil.operators.redact import redact, redact_runs, replace_text, runs_text
from spanveil.operators.skew import join_salted
from spanveil.plans.redaction import redact_table
from spanveil.schema import MAPPING, SPANS


def test_fakes_have_their_shape(spark):
    df = spark.range(300).select(F.explode(F.array(*map(F.lit, (*ENTITY_TYPES, "OTHER")))).alias("t"),
                                 F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    rows = df.select("t", "v", F.expr(fake("t", "v")).alias("f")).collect()
    again = {(r.t, r.v): r.f for r in df.select("t", "v", F.expr(fake("t", "v")).alias("f")).collect()}
    other = {(r.t, r.v): r.f for r in df.select("t", "v", F.expr(fake("t", "v", 43)).alias("f")).collect()}
    shapes = {"EMAIL": P.EMAIL.python, "PHONE": P.PHONE.python, "IP_ADDRESS": P.IP_ADDRESS.python,
              "SSN": P.SSN.python, "CREDIT_CARD": P.CREDIT_CARD.python, "ORG": P.COMPANY.python,
              "DOB": r"\d\d/\d\d/(19[5-9]\d|200[0-8])", "PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+",
              "ADDRESS": r"\d+ .+, .+, \d{6}, India", "OTHER": "<REDACTED>"}
    changed = 0
    for r in rows:
        assert re.fullmatch(shapes[r.t].replace(P.COMPANY.tail, "") if r.t == "ORG" else shapes[r.t], r.f), r
        assert again[r.t, r.v] == r.f
        changed += other[r.t, r.v] != r.f
        if r.t == "CREDIT_CARD":
            digits = [int(d) for d in r.f][::-1]
            assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert changed > len(rows) * 0.85
    own = spark.sql("SELECT 1").select(F.expr(fake("'EMAIL'", "'x'", generators={
        "EMAIL": lambda h: f"left({h}, 4)"})).alias("f")).first().f
    assert re.fullmatch("[0-9a-f]{4}", own) and set(GENERATORS) == set(ENTITY_TYPES)


def test_mapping_first_type_and_existing(spark):
    spans = spark.createDataFrame(
        [(2, 0, "v", "ORG"), (1, 5, "v", "PERSON"), (1, 9, "v", "ORG"), (3, 0, "w", "EMAIL"),
         (3, 1, "W", "EMAIL")], "doc int, start int, text string, entity_type string")
    firsts = first_types(spans, ["doc"])
    assert {(r.original, r.entity_type, r.n) for r in firsts.collect()} == {
        ("v", "PERSON", 3), ("w", "EMAIL", 1), ("W", "EMAIL", 1)}
    old = spark.createDataFrame([("w", None, "kept"), ("gone", "ORG", "too")], MAPPING)
    got = {r.original: r.replacement for r in extend_mapping(firsts, old).collect()}
    assert got["w"] == "kept" and got["gone"] == "too" and len(got) == 4 and got["W"] != "kept"


def test_look_up_with_hot_value(spark):
    """One value holds a third of all rows, many values are rare, some are not mapped."""
    spans = spark.range(6000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'v' || id % 700 "
              "ELSE 'u' || id END AS text")
    mapping = spark.range(700).selectExpr(
        "'v' || id AS original", "'ORG' AS entity_type", "'f' || id AS replacement").unionByName(
        spark.createDataFrame([("hot", "ORG", "cool")], MAPPING))
    rows = look_up(spans, mapping).collect()
    assert len(rows) == 6000
    for r in rows:
        want = ("cool" if r.id % 3 == 0 else f"f{r.id % 700}" if r.id % 3 == 1 else None)
        assert r.replacement == want


def test_salts_by_measured_counts(spark):
    """100 values with 0.09 % of all rows each, others rare: partitions are alike, the join is whole."""
    rows = spark.range(200_000).selectExpr(
        "id", "CASE WHEN id % 1000 < 90 THEN 'v' || id % 1000 % 100 WHEN id % 1000 < 91 THEN NULL "
              "ELSE 'u' || id END AS v")
    table = spark.range(95).selectExpr("'v' || id AS v", "id AS fake")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_salted(rows, table, "v", least=1)
        sizes = [r["count"] for r in got.where("v IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
        out = got.agg(F.count("*"), F.count_distinct("id"), F.sum(F.expr(
            "if(fake <=> if(v LIKE 'v%', CAST(substr(v, 2) AS BIGINT), NULL), 0, 1)"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(out) == (200_000, 200_000, 0)
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64


def _random_case(rng):
    text = "".join(rng.choice("aé😀 b\n") for _ in range(rng.randint(0, 400)))
    cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 2 * rng.randint(0, 90))))
    spans = [(s, e, text[s:e], "X", 1.0, "regex") for s, e in zip(cuts[::2], cuts[1::2])]
    runs, at = [], 0
    while at < len(text):
        n = rng.choice([0, 1, 3, 20])
        runs.append((len(runs), text[at:at + n]))
        at += n
    return text, spans, runs


def _rewrite(text, spans, values):
    out, at = [], 0
    for (s, e, *_), v in zip(spans, values):
        out += [text[at:s], v]
        at = e
    return "".join(out) + text[at:]


def test_redact_texts_and_runs(spark):
    rng = random.Random(11)
    cases = [_random_case(rng) for _ in range(120)]
    data = [(i, t, s, [f"[{k}]" for k in range(len(s))], r) for i, (t, s, r) in enumerate(cases)]
    df = spark.createDataFrame(data, f"id int, text string, spans {SPANS}, fakes array<string>, "
                                     "runs array<struct<run_no:int,run_text:string>>").repartition(8)
    out = redact_runs(redact(df, fakes="fakes"), fakes="fakes").collect()
    for r in out:
        text, spans, runs = cases[r.id]
        want = _rewrite(text, spans, data[r.id][3])
        assert r.redacted == want
        assert "".join(x.run_text for x in r.redacted_runs) == want and r.replacements == len(spans)
        at = 0
        for (no, old), new in zip(runs, r.redacted_runs):
            hits = [k for k, s in enumerate(spans) if s[0] < at + len(old) and s[1] > at]
            assert new.run_no == no
            if not hits:
                assert new.run_text == old
            for k, s in enumerate(spans):
                assert (f"[{k}]" in new.run_text) == (at <= s[0] < at + len(old))
            at += len(old)


def test_same_value_same_fake_and_identity(spark):
    texts = ["Write a@b.com or a@b.com", "to a@b.com!", "nothing here", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    old = spark.createDataFrame([("zz", "ORG", "q")], MAPPING)
    detected, mapping, redacted = redact_table(df, ["id"], old)
    rows = {r.id: r.redacted for r in redacted.collect()}
    new = {r.original: r.replacement for r in mapping.collect()}
    assert rows[0] == f"Write {new['a@b.com']} or {new['a@b.com']}"
    assert rows[1] == f"to {new['a@b.com']}!" and rows[2] == texts[2]
    assert rows[3] is None and rows[4] == ""
    second = redact_table(df, ["id"], mapping)
    assert {r.original: r.replacement for r in second.mapping.collect()} == new
    assert shared_fakes(mapping).count() == 0
    stateless = {r.id: r.redacted for r in redact(detect(df)).collect()}
    assert stateless == rows


def test_replacements_come_back_to_their_text(spark):
    df = detect(spark.createDataFrame([(i, f"x{i % 3}@b.com, y{i}@c.org; z") for i in range(40)],
                                      "id int, text string")).cache()
    mapping = build_mapping(df, ["id"]).cache()
    known = {r.original: r.replacement for r in mapping.collect()}
    for r in with_replacements(df, ["id"], mapping).collect():
        assert r.fakes == [known[s.text] for s in r.spans]


def test_literal_replace(spark):
    df = spark.sql("SELECT 'abcab' AS t")
    assert df.select(replace_text(F.col("t"), {"a": "1", "ab": "a", "": "x"})).first()[0] == "1c1"


def test_runs_text(spark):
    df = spark.sql("SELECT array(named_struct('run_no', 0, 'run_text', 'a'), "
                   "named_struct('run_no', 1, 'run_text', CAST(NULL AS STRING))) AS runs")
    assert df.select(runs_text(F.col("runs"))).first()[0] == "a"


def test_distinct_detection(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot@x.com', 'n' || id % 5 || '@y.com') AS text")
    a = {(r.id, r.spans[0].text) for r in detect_distinct(df, ["id"]).collect()}
    assert a == {(r.id, r.text) for r in df.collect()}


@pytest.mark.parametrize("retry", [False, True])
def test_stream_with_mapping(spark, tmp_path, retry):
    from spanveil.streaming.redaction import mapped_batch, redact_with_mapping

    source, mapping = str(tmp_path / "in"), str(tmp_path / "map")
    masks = None if retry else constant_masks(ENTITY_TYPES)
    for part in range(2):
        spark.createDataFrame([(f"{part}-{i}", f"see u{i}@m.com and w{part}@m.com") for i in range(5)],
                              "id string, text string").write.mode("append").parquet(source)
        texts = spark.readStream.schema("id string, text string").parquet(source)
        redact_with_mapping(texts, ["id"], mapping, str(tmp_path / "out"), str(tmp_path / "state"),
                            generators=masks, recognizers=["email"]).awaitTermination()
    entries = spark.read.parquet(mapping)
    assert entries.count() == 7 == entries.select("original").distinct().count()
    out = {r.id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    known = {r.original: r.replacement for r in entries.collect()}
    assert out == {f"{p}-{i}": f"see {known[f'u{i}@m.com']} and {known[f'w{p}@m.com']}"
                   for p in range(2) for i in range(5)}
    if retry:  # the last batch once more changes nothing
        last = spark.createDataFrame([(f"1-{i}", f"see u{i}@m.com and w1@m.com") for i in range(5)],
                                     "id string, text string")
        again = mapped_batch(detect(last), 1, ["id"], mapping).collect()
        assert {r.id: r.redacted for r in again} == {k: v for k, v in out.items() if k[0] == "1"}
        assert spark.read.parquet(mapping).count() == 7


def test_stream_equals_batch(spark, tmp_path):
    from spanveil.streaming.redaction import redact_stream

    path = str(tmp_path / "in")
    spark.range(200).selectExpr("id", "'call +91 9' || lpad(id, 4, '0') || ' 12345 or x' || id || "
                                "'@m.com' AS text").repartition(3).write.parquet(path)
    stream = redact_stream(spark.readStream.schema("id bigint, text string").parquet(path))
    stream.select("id", "redacted").writeStream.format("memory").queryName("redacted_rows").trigger(
        availableNow=True).start().awaitTermination()
    batch = redact_stream(spark.read.parquet(path)).select("id", "redacted")
    assert sorted(spark.table("redacted_rows").collect()) == sorted(batch.collect())


def test_stream_mapping_starts_from_saved_and_survives_new_checkpoints(spark, tmp_path):
    from spanveil.sources.tables import write_mapping
    from spanveil.streaming.redaction import redact_with_mapping
    from spanveil.streaming.store import stream_entries, stream_mapping_table

    source, mapping = str(tmp_path / "in"), str(tmp_path / "map")
    write_mapping(spark.createDataFrame([("u1@m.com", "EMAIL", "OLD")], "original string, entity_type string, replacement string"), mapping)
    given = spark.createDataFrame([("u2@m.com", "EMAIL", "GIVEN"), ("u1@m.com", "EMAIL", "WINS")],
                                  "original string, entity_type string, replacement string")
    spark.createDataFrame([(str(i), f"see u{i}@m.com") for i in range(4)], "id string, text string").write.parquet(source)
    outs = []
    for job in range(2):
        texts = spark.readStream.schema("id string, text string").parquet(source)
        redact_with_mapping(texts, ["id"], mapping, str(tmp_path / f"out{job}"), str(tmp_path / f"state{job}"),
                            existing=given if job == 0 else None, recognizers=["email"]).awaitTermination()
        outs.append({r.id: r.redacted for r in spark.read.parquet(str(tmp_path / f"out{job}")).collect()})
    assert outs[0]["1"] == "see WINS" and outs[0]["2"] == "see GIVEN"
    assert outs[1]["1"] == "see OLD" and outs[1]["0"] == outs[0]["0"] and outs[1]["3"] == outs[0]["3"]
    entries = stream_entries(spark, mapping).collect()
    assert sorted(r.original for r in entries) == ["u0@m.com", "u1@m.com", "u2@m.com", "u3@m.com"]
    table = {r.original: r.replacement for r in stream_mapping_table(spark, mapping).collect()}
    assert {f"see {table[f'u{i}@m.com']}" for i in range(4)} == set(outs[1].values())


def test_unreadable_mapping(spark, tmp_path):
    from spanveil.sources.tables import read_mapping

    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "part-0.parquet").write_bytes(b"no parquet")
    assert read_mapping(spark, str(folder)).count() == 0
    with pytest.raises(Exception, match="parquet"):
        read_mapping(spark, str(folder), unreadable="error")


def test_many_runs_and_spans(spark):
    """10,000 runs and 5,000 spans in one paragraph, cuts inside the values, empty runs between them."""
    import time
    runs = []
    for i in range(5_000):
        runs += [(2 * i, f"Mail a{i:04d}"), (2 * i + 1, "@b.co; " if i % 7 else "")]
    text = "".join(t for _, t in runs)
    spans, at = [], 0
    for i in range(5_000):
        if i % 7:
            spans.append((at + 5, at + 15, text[at + 5:at + 15], "EMAIL", 1.0, "regex"))
        at += len(runs[2 * i][1]) + len(runs[2 * i + 1][1])
    df = spark.createDataFrame([(runs, spans)], "runs array<struct<run_no:int,run_text:string>>, spans "
                               "array<struct<start:int,end:int,text:string,entity_type:string,score:double,source:string>>")
    start = time.time()
    out = redact_runs(df).collect()[0]
    assert time.time() - start < 20
    assert out.replacements == len(spans)
    for i in range(5_000):
        first, second = out.redacted_runs[2 * i].run_text, out.redacted_runs[2 * i + 1].run_text
        if i % 7:
            assert first.startswith("Mail ") and f"a{i:04d}" not in first and second == "; "
        else:
            assert (first, second) == (f"Mail a{i:04d}", "")
