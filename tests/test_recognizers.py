"""Pattern spans: equal to Python's re, also on odd characters."""

import random
import re

import pytest

from spanveil.functions import patterns as P
from spanveil.functions.regex import with_found
from spanveil.operators.recognizers import RECOGNIZERS, recognize
from spanveil.sources.tables import spread

NAMES = {n: r.pattern for n, r in RECOGNIZERS.items()}

PARTS = [
    "user@mail.com", "é", "́", "a.b+c@d-e.co", "+91 98765 43210", "9876543210", "٩٨٧٦٥٤٣٢١٠",
    "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "123-45-6789", "4111 1111 1111 1111", "²", "_", " ",
    "Date of Birth: 1/2/1990", "DOB-01-02-90", "born on 3/4/85", "dob 1/1/2000", "bırth", "ſtate: x",
    "Our Company Acme Steel Private Limited", "Acme Pvt. Ltd. ", "Foo LLP", "Foo-Bar Inc.", "limited",
    "Registered Office: 12 MG Road, Pune, India", "Residential Address - A\r\nB State C", ";", "\n",
    "\n \n", "\r\n", "Village: Foo", "PIN Code: 411001", "District - X\rY", "İndia", " ", "  ", "x",
    "\u0001", "\u0002", "😀", " ", "Corporate Office Pune PIN 4", "Talu\u212aa: a", "Reg\u0131stered Off\u0130ce: a, Ind\u0131a", "\u017ftate: y", "-", ".", "8",
]


def _texts():
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", "\n", ";", ""])
                    for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def _expected(text, pattern):
    return [(m.start("v"), m.end("v"), m.group("v")) for m in re.finditer(pattern.python, text)]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = _texts()
    return texts, spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)


def test_matches_equal_python(mixed):
    texts, df = mixed
    rows = with_found(df, "text", {n: (p, "true") for n, p in NAMES.items()}).collect()
    hits = 0
    for row in rows:
        for name, pattern in NAMES.items():
            got = [(s["start"], s["end"], s["text"]) for s in row[name]]
            want = _expected(texts[row.id], pattern)
            assert got == want, (name, texts[row.id])
            hits += len(want)
    assert hits > 1000


def test_hints_hold_back_no_match(mixed):
    """Texts that a hint keeps from the pattern have no match."""
    texts, df = mixed
    for row in recognize(df, output="found").collect():
        got = {}
        for s in row.found:
            got.setdefault(s["entity_type"], 0)
            got[s["entity_type"]] += 1
        want = {}
        for name, pattern in NAMES.items():
            n = len(_expected(texts[row.id], pattern))
            if n:
                kind = RECOGNIZERS[name].entity_type
                want[kind] = want.get(kind, 0) + n
        assert got == want, texts[row.id]


def test_documents_equal_python(spark, sf):
    df = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rows = recognize(df, names=["email", "ip", "card"], output="found").collect()
    n = 0
    for row in rows:
        got = sorted((s["start"], s["end"], s["text"], s["entity_type"]) for s in row.found)
        want = sorted((*hit, RECOGNIZERS[name].entity_type) for name in ("email", "ip", "card")
                      for hit in _expected(row.text, NAMES[name]))
        assert got == want
        n += len(got)
    assert n > 10


def test_validity(find):
    kept, dropped = find(["10.0.0.1 10.01.0.1 256.1.1.1 1.2.3.4",
                          "4111111111111111 4111111111111112 5500-0055-5555-5559"])
    assert [s["text"] for s in kept[0]] == ["10.0.0.1", "1.2.3.4"]
    assert [s["reason"] for s in dropped[0]] == ["invalid_ip"] * 2
    assert [s["text"] for s in kept[1]] == ["4111111111111111", "5500-0055-5555-5559"]
    assert [(s["text"], s["reason"]) for s in dropped[1]] == [("4111111111111112", "invalid_card")]


def test_many_matches_in_one_text(find):
    """More matches than one block of the prefix sums."""
    text = "; ".join(f"10.{i % 256}.{i // 256}.7" for i in range(3000))
    kept, _ = find([text], recognizers=["ip"])
    assert len(kept[0]) == 3000
    assert all(text[s["start"]:s["end"]] == s["text"] for s in kept[0])


def test_patterns_have_python_form():
    for p in NAMES.values():
        re.compile(p.python)
    assert re.search(P.COMPANY_SUFFIX.python, "Unlimited")


def test_mails_in_runs_equal_python(spark, find):
    """Dense runs of the characters of mail addresses: every start, end and neighbour."""
    rng = random.Random(11)
    parts = ["a", "b.co", "@", "@x.com", "%", "+", "-", ".", "_", " ", "é", "ab9", "@y.c", "z@q.org", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    found, _ = find(texts, recognizers=["email"])
    pattern = re.compile(P.EMAIL.python)
    for i, t in enumerate(texts):
        want = [(m.start("v"), m.end("v")) for m in pattern.finditer(t)]
        assert [(s["start"], s["end"]) for s in found[i]] == want, t


def test_mail_pattern_is_linear(find):
    import time

    find(["x@y " + "a" * 100], recognizers=["email"])
    start = time.perf_counter()
    find(["x@y " + "a" * 200_000, "a@" * 60_000, "%" * 200_000 + "@x.com", "a.b" * 60_000 + " @"], recognizers=["email"])
    assert time.perf_counter() - start < 8


def _awkward():
    """Long runs, long blanks, labels and forms in all neighbourhoods."""
    rng = random.Random(11)
    org = ["A1" * 30, "Aa", "b.C", "-D", "Limited", "Ltd", "Ltd.", "Private", "Pvt.", "LLP", "Inc", "Corporation", "&", "(X)",
           "Limited-B", "Including", "of", "Limiteds", "É", "x", "A'"]
    blanks = [" ", "  ", "\n", "\u00a0", " " * 40, "\t \n ", "", ", "]
    office = ["Registered Office", "registered  office", "Branch\nOffice", "Residential Address", "India", "(India", "xIndia",
              "State", "PIN", "PIN  Code", "Village", "Taluka.", "a", "bc", ":", "-", ";", "::", "12 Road, ", "z" * 150, "; "]
    dob = ["dob", "born on", "date of birth", ":", "-", "1/2/90", "11-12-1990", "x"]
    fields = ["Village", "District", "PIN", "Code", ":", "-", "a", "b;", "Pune"]
    out = []
    for words in (org, office, dob, fields):
        out += ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(1, 16))) for _ in range(1200)]
    return out + ["Registered Office" + a + b + "India" + c for a in ("", " ", "  ", "\n\n") for b in ("", ":", ": ", ":  ", "-\n", ": :")
                  for c in ("", ";", " x", "\n \n", "y")]


def test_awkward_texts_equal_python(spark):
    texts = _awkward()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    hits = dict.fromkeys(NAMES, 0)
    for row in with_found(df, "text", {n: (p, "true") for n, p in NAMES.items()}).collect():
        for name, pattern in NAMES.items():
            got = [(s["start"], s["end"], s["text"]) for s in row[name]]
            assert got == _expected(texts[row.id], pattern), (name, texts[row.id])
            hits[name] += len(got)
    assert min(hits[n] for n in ("org", "address_office", "address_field", "dob")) > 100, hits


LONG = {
    "capitals in a run": "Including " + "A1" * 100_000 + " Limite Limited",
    "runs with forms": ("B-C" * 10 + " Limite ") * 6_000 + "Ltd",
    "forms without names": "limited Ltd LLP " * 12_000 + "Limited",
    "blanks": "Acme" + " " * 200_000 + "Limite Ltd",
    "many blanks": ("Acme" + " " * 400) * 500 + "Ltd",
    "label and blanks": "Registered Office" + " " * 200_000 + "Limited India ;",
    "labels": "Registered Office " * 11_000 + "Limited",
    "labels and places": "Branch Office India India " * 8_000 + "Limited",
    "lines": "Registered Office: a India" + "\n" + " " * 200_000 + "Limited x",
    "birth": "dob 1-1-1 Limited" + ("dob" + " " * 2_000) * 100 + "1-1",
    "fields": ("State" + " " * 2_000) * 100 + "Limited: 1",
}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_long_texts_take_linear_time(spark, kind):
    import time
    df = spark.createDataFrame([(LONG[kind],)], "text string").cache()
    assert df.count() == 1
    recognize(df, names=["org", "address_office", "address_field", "dob"]).collect()
    start = time.time()
    recognize(df, names=["org", "address_office", "address_field", "dob"]).collect()
    assert time.time() - start < 4  # a loaded machine included


def test_strip_takes_linear_time(spark):
    import time
    from pyspark.sql import functions as F
    from spanveil.functions.text import strip
    df = spark.createDataFrame([(" \u00a0a" + " " * 200_000 + "b\t\n",), ("",), (" \u2003 ",), ("x",)], "text string")
    start = time.time()
    assert [r[0].replace(" " * 200_000, "_") for r in df.select(F.expr(strip("text"))).collect()] == ["a_b", "", "", "x"]
    assert time.time() - start < 4
