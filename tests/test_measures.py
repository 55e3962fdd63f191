"""Scores, reports, review, sources and sinks."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanveil.functions.text import casefold, is_upper, normalize, strip
from spanveil.operators import metrics as M, review as V, stats as A
from spanveil.operators.detect import detect
from spanveil.plans.scoring import score
from spanveil.schema import MAPPING, REVIEW
from spanveil.sources import tables as T
from spanveil.sources.docx import count_tables, document_runs, paragraph_runs, read_docx
from spanveil.sources.html import page_paragraphs, page_runs, rebuild_pages

SPAN = "doc int, start int, end int, entity_type string"


def test_text_functions(spark):
    values = ["  A\t b c ", "ÉCOLE 1", "straße", "ﬁne", "", "a", "123", "\x1cX\x1d"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for r in df.select("i", F.expr(strip("v")).alias("s"), F.expr(normalize("v")).alias("n"),
                       F.expr(casefold("v")).alias("c"), F.expr(is_upper("v")).alias("u")).collect():
        v = values[r.i]
        assert r.s == v.strip() and r.c == v.casefold() and r.u == v.isupper()
        assert r.n == " ".join(v.split()).casefold()


def test_exact_and_character_metrics(spark):
    rng = random.Random(2)
    texts = {d: "x" * rng.randint(20, 60) for d in range(40)}

    def spans():
        out = []
        for d, t in texts.items():
            for _ in range(rng.randint(0, 5)):
                s = rng.randint(0, len(t))
                out.append((d, s, rng.randint(s, min(len(t), s + 6)), rng.choice("AB")))
        return out

    truth = spans()
    predicted = spans() + truth[::2] + truth[:3]
    t, p = set(truth), set(predicted)
    df = [spark.createDataFrame(x, SPAN) for x in (truth, predicted)]
    got = M.exact_metrics(M.compare_spans(*df, ["doc"])).first()
    assert (got.tp, got.fp, got.fn) == (len(t & p), len(p - t), len(t - p))
    assert got.f1 == pytest.approx(2 * len(t & p) / (len(t) + len(p)))

    def labels(side):
        return {(d, i) for d, s, e, _ in side for i in range(s, e)}

    docs = spark.createDataFrame(list(texts.items()), "doc int, text string")
    acc = M.character_accuracy(M.character_counts(docs, *df, ["doc"])).first()
    total = sum(map(len, texts.values()))
    assert acc.characters == total
    assert acc.agree == total - len(labels(t) ^ labels(p))
    for sweep in (1, 7, 1000):
        assert M.character_counts(docs, *df, ["doc"], sweep=sweep).first().agree == acc.agree
    totals = {r.entity_type: (r.truth, r.predicted) for r in M.type_totals(
        M.compare_spans(*df, ["doc"])).collect()}
    assert totals["A"] == (sum(x[3] == "A" for x in t), sum(x[3] == "A" for x in p))
    bad = spark.createDataFrame([(0, 5, 999, "A")], SPAN)
    with pytest.raises(Exception, match="Invalid entity span"):
        M.character_counts(docs, bad, df[1], ["doc"]).collect()
    for span in ((0, -1, 3, "A"), (0, 6, 5, "A"), (999, 0, 1, "A")):
        with pytest.raises(Exception, match="Invalid entity span"):
            M.character_counts(docs, spark.createDataFrame([span], SPAN), df[1], ["doc"]).collect()


def test_character_accuracy_of_one_long_text(spark):
    """A text with very many spans is swept by many tasks: blocks of positions are shuffled apart."""
    n = 200_000
    docs = spark.range(1).selectExpr("CAST(id AS INT) AS doc", f"repeat('x', {5 * n}) AS text")
    side = lambda k: spark.range(n).selectExpr("0 AS doc", "CAST(5 * id AS INT) AS start", f"CAST(5 * id + {k} AS INT) AS end")
    wide = spark.createDataFrame([(0, 0, 5 * n)], "doc int, start int, end int")
    got = M.character_counts(docs, side(3), side(2), ["doc"], sweep=4096)
    assert tuple(got.first()) == (5 * n, 4 * n)
    assert tuple(M.character_counts(docs, side(3), wide, ["doc"], sweep=4096).first()) == (5 * n, 3 * n)
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(doc#" in plan and ", _block#" in plan


def test_metrics_with_nothing(spark):
    none = spark.createDataFrame([], SPAN)
    got = M.exact_metrics(M.compare_spans(none, none, ["doc"])).first()
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0)
    docs = spark.createDataFrame([(1, "")], "doc int, text string")
    assert M.character_accuracy(M.character_counts(docs, none, none, ["doc"])).first().accuracy is None


def test_scoring_of_golden_cases(spark, tmp_path):
    golden = {"documents": [
        {"id": "p", "text": "Contact Rashi Patil at rashi.patil@example.com.", "entities": [
            {"start": 8, "end": 19, "entity_type": "PERSON"},
            {"start": 23, "end": 46, "entity_type": "EMAIL"}]},
        {"id": "n", "text": "Please read section 32 of the Companies Act, 2013", "entities": []}]}
    path = tmp_path / "truth.json"
    path.write_text(json.dumps(golden, indent=1))
    docs = T.read_ground_truth(spark, str(path))
    truth = docs.select("id", F.inline("entities"))
    got = {r.metric: r.value for r in score(docs.select("id", "text"), truth, ["id"]).collect()}
    assert got["True positives"] == "1" and got["False negatives"] == "1"
    assert got["False positives"] == "0" and got["Precision"] == "1.0"
    assert got["Ground-truth entity counts"] == '{"EMAIL":1,"PERSON":1}'
    assert got["Detected entity counts"] == '{"EMAIL":1}'
    chars = 47 + 49
    assert float(got["Accuracy"]) == pytest.approx((chars - 11) / chars)


@pytest.mark.parametrize("content, message", [
    ('{"documents": []}', "non-empty"), ('{"other": 1}', "non-empty"),
    ('{"documents": [{"id": "a", "entities": []}]}', "string 'text'"),
    ('{"documents": [{"id": "a", "text": "x"}]}', "'entities' list")])
def test_bad_ground_truth(spark, tmp_path, content, message):
    path = tmp_path / "bad.json"
    path.write_text(content)
    with pytest.raises(Exception, match=message):
        T.read_ground_truth(spark, str(path)).collect()


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "t int, p int")
    got = M.binary_metrics(M.binary_counts(df, "t", "p")).first()
    assert (got.accuracy, got.precision, got.recall) == (0.6, pytest.approx(2 / 3), pytest.approx(2 / 3))
    report = {r.metric: r.value for r in M.binary_report(M.binary_metrics(
        M.binary_counts(df.where("t = 0 AND p = 0"), "t", "p"))).collect()}
    assert report["Precision"] == "0.0" and report["Accuracy"] == "1.0"
    with pytest.raises(Exception, match="both labels"):
        M.binary_counts(spark.createDataFrame([(1, None)], "t int, p int"), "t", "p").collect()


@pytest.mark.parametrize("slices", [1, 5])
def test_occurrences_by_brute_force(spark, monkeypatch, slices):
    from spanveil.operators import occurrences as O
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 200))) for _ in range(120)]
    values = sorted({texts[i][5:5 + n] for i in range(60) for n in (1, 2, 3, 7, 8, 9, 12, 30)
                     if texts[i][5:5 + n]} | {"zzz", "aa", "abab", "a" * 9})
    if slices > 1:
        monkeypatch.setattr(O, "PASS_VALUES", len(values) // slices)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(6)
    got = {r.value: r for r in V.occurrences(
        df, spark.createDataFrame([(v,) for v in values], "value string"), ["id"],
        context=True).collect()}
    for v in values:
        n = sum(t.lower().count(v.lower()) for t in texts)
        assert (got[v].occurrences if v in got else 0) == n, v
        if n:
            text = next(t for t in texts if v.lower() in t.lower())
            at = text.lower().find(v.lower())
            want = text[max(0, at - 100):at + len(v) + 100].replace("\n", " ")
            assert got[v].source_context == want


def test_value_filter_lets_few_strangers_pass(spark):
    """100,000 values: all pass, and less than one in a hundred of other strings."""
    import numpy as np
    from spanveil.operators import occurrences as O
    n = 100_000
    whole, prefix = O.build_filters(spark.range(n).selectExpr("'value number ' || id AS v"), n)
    assert whole.bits.nbytes <= n * 2 + 8192
    h = lambda words: np.array([O.Hashes(O.codes_of(w)).at(np.zeros(1, np.int64), len(w))[0] for w in words])
    assert len(whole.passes(h([f"value number {i}" for i in range(0, n, 7)]))) == len(range(0, n, 7))
    assert len(whole.passes(h([f"other number {i}" for i in range(20_000)]))) < 0.01 * 20_000
    assert len(prefix.passes(h(["value nu"]))) == 1 and len(prefix.passes(h([f"va{i:06d}" for i in range(5_000)]))) < 50


def test_hits_without_overlaps(spark):
    """Also where different substrings share a hash."""
    from spanveil.operators import occurrences as O
    every = O.Filter(1, O.np.full(4096, 255, dtype=O.np.uint8))
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 60)))
        lengths = [1, 2, 3, 9, 10]
        got = {h["v"]: (h["n"], h["at"]) for h in O.hits_in(text, lengths, every, every)}
        want = {text[i:i + n] for n in lengths for i in range(len(text) - n + 1)}
        assert got == {v: (text.count(v), text.find(v)) for v in want}
    real = O.Hashes.at
    try:
        O.Hashes.at = lambda self, starts, length: real(self, starts, length) & O.np.uint64(1)
        got = {h["v"]: (h["n"], h["at"]) for h in O.hits_in("abcabcabbaabc" * 3, [3, 8], every, every)}
    finally:
        O.Hashes.at = real
    text = "abcabcabbaabc" * 3
    assert got == {v: (text.count(v), text.find(v)) for n in (3, 8) for v in {text[i:i + n] for i in range(len(text) - n + 1)}}


def test_review_of_a_shared_replacement(spark):
    """A thousand originals with one replacement, and texts that are blank or null."""
    mapping = spark.createDataFrame([(f"name{i:04d}", "PERSON", "<P>" if i % 3 else f"<Q{i}>") for i in range(1500)], MAPPING)
    before = spark.createDataFrame([(i, f"x NAME{i:04d} y") for i in range(0, 1500, 2)] + [(9001, None), (9002, "")], "id int, text string")
    after = spark.createDataFrame([(i, "x <p> y <P><Q3>") for i in range(10)] + [(9001, None)], "id int, text string")
    rows = {r.original: r for r in V.review_sheet(mapping, before, after, ["id"]).collect()}
    assert len(rows) == 1500
    for i in range(1500):
        r = rows[f"name{i:04d}"]
        assert r.original_occurrences == (i % 2 == 0)
        assert r.replacement_occurrences == (20 if i % 3 else 10 if i == 3 else 0)


def test_review_sheet_and_metrics(spark, tmp_path):
    mapping = spark.createDataFrame([("Bob", "PERSON", "Al"), ("amy", "PERSON", "X9"),
                                     ("gone", "ORG", "n/a")], MAPPING)
    before = spark.createDataFrame([(1, "Bob, bob and AMY\r\nx"), (2, "bobbob")], "id int, text string")
    after = spark.createDataFrame([(1, "Al al x9 total"), (2, "")], "id int, text string")
    sheet = V.ordered_sheet(V.review_sheet(mapping, before, after, ["id"]))
    rows = sheet.collect()
    assert [r.original for r in rows] == ["amy", "Bob", "gone"]
    assert [r.original_occurrences for r in rows] == [1, 4, 0]
    assert [r.replacement_occurrences for r in rows] == [1, 3, 0]
    assert rows[1].source_context == "Bob, bob and AMY  x" and rows[2].source_context == ""
    T.write_review(sheet, str(tmp_path / "r"))
    back = T.read_review(spark, str(tmp_path / "r"))
    assert back.count() == 3
    with pytest.raises(Exception, match="is_actual_pii"):
        V.review_metrics(back).collect()
    filled = back.withColumn("is_actual_pii", F.when(F.col("original") == "amy", "No").otherwise("y"))
    got = V.review_metrics(filled).first()
    assert (got.reviewed, got.tp, got.fp, got.tp_occurrences, got.fp_occurrences) == (3, 2, 1, 4, 1)
    assert got.recall is None and got.accuracy is None
    report = {r.metric: r.value for r in V.review_report(V.review_metrics(filled)).collect()}
    assert report["Recall"] == "N/A (supply --missed-pii)" and "Missed PII" not in report
    full = V.review_metrics(filled, missed=2, true_negatives=5).first()
    assert full.recall == 0.5 and full.f1 == pytest.approx(4 / 7) and full.accuracy == 0.7
    empty = spark.createDataFrame([], REVIEW)
    with pytest.raises(Exception, match="empty"):
        V.review_metrics(empty).collect()
    no_mapping = spark.createDataFrame([], MAPPING)
    assert V.review_sheet(no_mapping, before, after, ["id"]).count() == 0


def test_published_review_figures(spark):
    """86 of 94 candidates right, 12 missed, 242 and 116 occurrences."""
    rows = [(f"v{i}", (242 - 85 if i == 0 else 1) if i < 86 else (116 - 7 if i == 86 else 1),
             "yes" if i < 86 else "no") for i in range(94)]
    sheet = spark.createDataFrame(rows, "original string, original_occurrences int, is_actual_pii string")
    got = V.review_metrics(sheet, missed=12).first()
    assert (got.tp_occurrences, got.fp_occurrences) == (242, 116)
    assert [round(x, 4) for x in (got.precision, got.recall, got.f1)] == [0.9149, 0.8776, 0.8958]


def test_counts_and_reports(spark, tmp_path):
    texts = ["a@b.com a@b.com 10.0.0.1", "a@b.com ipo@x.com", "a@b.com ipo@x.com", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    judged = detect(df, rejected="rejected").cache()
    spans = judged.select("id", F.inline("spans"))
    assert {(r.entity_type, r.n) for r in A.type_counts(spans).collect()} == {
        ("EMAIL", 4), ("IP_ADDRESS", 1), (None, 5)}
    assert A.rejection_counts(judged).first().n == 2
    assert A.rejection_counts(judged, distinct_by="text").first().n == 1
    report = A.detection_report(spans, A.unique_values(spans))
    values = [(r.metric, r.value) for r in report.collect()]
    assert values[:4] == [("Total entities detected", "5"), ("Unique replacements", "2"),
                          ("Detected EMAIL", "4"), ("Detected IP_ADDRESS", "1")]
    assert values[4] == ("False positives", "N/A (ground truth not supplied)") and len(values) == 10
    T.write_metrics(report, str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert back.columns == ["Metric", "Value"] and back.count() == 10
    frame = spark.createDataFrame([("Precision", "0.914893617"), ("Count", "7"), ("Small", "1.0E-5"),
                                   ("Recall", "N/A")], "metric string, value string")
    T.write_report(frame, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == [
        "PII Redaction Evaluation Report", "=" * 34, "Precision: 0.9149", "Count: 7",
        "Small: 0.0000", "Recall: N/A"]


def test_reasons_fan_out(spark):
    df = spark.sql("SELECT array(named_struct('reason', 'public_organization', 'entity_type', 'ORG', "
                   "'text', 'x'), named_struct('reason', 'protected_term', 'entity_type', 'ORG', "
                   "'text', 'x')) AS rejected")
    assert {(r.reason, r.n) for r in A.rejection_counts(df).collect()} == {
        ("public_organizations_skipped", 1), ("whitelist_hits", 2), ("whitelist", 1)}


def test_mapping_files(spark, tmp_path):
    path = str(tmp_path / "map")
    assert T.read_mapping(spark, path).count() == 0
    rows = [("b", "ORG", "2"), ("é", "ORG", "3"), ("a", "EMAIL", "1")]
    for fmt in ("parquet", "json"):
        T.write_mapping(spark.createDataFrame(rows, MAPPING), path, fmt)
        assert sorted(map(tuple, T.read_mapping(spark, path, fmt).collect())) == sorted(rows)
    legacy = tmp_path / "legacy.json"
    legacy.write_text('{"x": "y", "é": "z"}', encoding="utf-8")
    assert {(r.original, r.replacement) for r in T.read_legacy_mapping(spark, str(legacy)).collect()} == {
        ("x", "y"), ("é", "z")}
    for bad in ("[1, 2]", "not json"):
        legacy.write_text(bad)
        assert T.read_legacy_mapping(spark, str(legacy)).count() == 0
    T.write_redacted(spark.sql("SELECT 1 AS k, 'x' AS redacted"), str(tmp_path / "out"), ["k"])
    assert (tmp_path / "out" / "k=1").is_dir()


def test_statistics(spark):
    df = spark.createDataFrame([(1, "one two\n \nthree"), (2, "")], "id int, text string")
    lines = T.paragraphs(df, ["id"])
    assert [(r.para_no, r.text) for r in lines.collect()] == [(0, "one two"), (2, "three")]
    assert A.text_statistics(lines).first() == (2, 3, 12)
    html = ["<table><tr><td>1</td></tr></table>", "<table></table>", "<TABLE><tr><th>x<table><td>y</table>",
            "none"]
    df = spark.createDataFrame([(h,) for h in html], "h string")
    assert [r[0] for r in df.select(A.count_tables(F.col("h"))).collect()] == [1, 0, 2, 0]


def test_pages(spark):
    html = ("<html><style>p{x:1}</style><!-- a <b> --><body><p>Card 4111 <b>1111</b> 1111 1111</p>"
            "<script>var t='</p>';</script><p>two <i>runs</i></p> <div>\n</div>tail")
    df = spark.createDataFrame([(1, html), (2, "plain 10.0.0.1 text"), (3, "")], "id int, html string")
    rows = page_paragraphs(df, ["id"]).collect()
    assert [(r.id, r.text.strip()) for r in rows] == [
        (1, "Card 4111 1111 1111 1111"), (1, "two runs"), (1, "tail"), (2, "plain 10.0.0.1 text")]
    assert all("".join(r.pieces) == r.html for r in page_runs(df).collect())
    changed = spark.createDataFrame([(2, [(0, "new")])], "id int, redacted_runs array<struct<run_no:int,run_text:string>>")
    assert {r.id: r.redacted_html for r in rebuild_pages(df, changed, ["id"]).collect()} == {
        1: html, 2: "new", 3: ""}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _docx(path):
    def p(*texts):
        return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"

    nested = f"<w:tbl><w:tr><w:tc>{p('nested')}</w:tc></w:tr></w:tbl>"
    body = (p("Hel", "lo") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r>"
            "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
            f"<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>{p('cell')}{nested}</w:tc></w:tr>"
            f"<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p('hidden')}</w:tc></w:tr></w:tbl><w:tbl/>"
            + p("end") + "<w:sectPr><w:headerReference w:type='first' r:id='r2'/>"
            "<w:headerReference w:type='default' r:id='r1'/><w:footerReference w:type='default' r:id='r3'/>"
            "</w:sectPr>")
    root = f"xmlns:w='{W}' xmlns:r='{R}'"
    rels = "".join(f"<Relationship Id='{i}' Target='{t}'/>" for i, t in (
        ("r1", "header1.xml"), ("r2", "header2.xml"), ("r3", "/word/footer1.xml")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {root}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats"
                   f".org/package/2006/relationships'>{rels}</Relationships>")
        for name, tag in (("header1", "hdr"), ("header2", "hdr"), ("footer1", "ftr")):
            z.writestr(f"word/{name}.xml", f"<w:{tag} {root}>{p(name)}</w:{tag}>")
    path.write_bytes(out.getvalue())
    return out.getvalue()


def test_docx(spark, tmp_path):
    content = _docx(tmp_path / "one.docx")
    assert count_tables(content) == 2
    rows = list(document_runs(content))
    assert rows[:3] == [("body", 0, 0, "Hel"), ("body", 0, 1, "lo"), ("body", 1, 0, "a\tb\n")]
    (tmp_path / "sub").mkdir()
    _docx(tmp_path / "sub" / "two.docx")
    (tmp_path / "x.txt").write_text("no")
    runs = read_docx(spark, str(tmp_path))
    assert runs.select("path").distinct().count() == 2
    paras = paragraph_runs(runs.where(F.col("path").endswith("one.docx")), ["path"])
    got = [(r.story, r.text) for r in paras.orderBy("para_no").collect()]
    assert got == [("body", "Hello"), ("body", "a\tb\nlink"), ("body", "end"), ("table", "cell"),
                   ("nested table", "nested"), ("header", "header1"), ("header", "header2"),
                   ("footer", "footer1")]
    text = V.document_text(runs, ["path"], ["body", "table"]).first().text
    assert text == "Hello\na\tb\nlink\nend\ncell"


def test_docx_source_plans_partitions(spark, tmp_path):
    """Small files share a partition, large ones do not; broken files fail or are left out."""
    for i in range(9):
        _docx(tmp_path / f"{i}.docx")
    size = (tmp_path / "0.docx").stat().st_size
    runs = read_docx(spark, str(tmp_path), partitionBytes=str(size * 4))
    assert runs.rdd.getNumPartitions() == 3 and runs.select("path").distinct().count() == 9
    each = [tuple(r) for r in runs.where(F.col("path").endswith("3.docx")).orderBy("para_no", "run_no").collect()]
    assert [r[1:] for r in each] == list(document_runs((tmp_path / "3.docx").read_bytes()))
    assert read_docx(spark, str(tmp_path), partitionBytes="1").rdd.getNumPartitions() == 9
    assert read_docx(spark, f"file://{tmp_path}", glob="[12].docx").select("path").distinct().count() == 2
    (tmp_path / "broken.docx").write_bytes(b"PK no archive")
    with pytest.raises(Exception, match="broken.docx is no document"):
        read_docx(spark, str(tmp_path)).collect()
    assert read_docx(spark, str(tmp_path), mode="permissive").select("path").distinct().count() == 9
    (tmp_path / "none").mkdir()
    assert read_docx(spark, str(tmp_path / "none")).collect() == []
