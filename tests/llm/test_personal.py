"""Personal data against the plain patterns, span by span."""

import hashlib
import os
import random
import re
import time

import pytest

from loomwork.llm.personal import BASE_KINDS, luhn, masked, mod97, personal_data
from loomwork.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "nothing here 12 and 34", "a@b.c@d.e f@g h@i.j.k. .@-.- @x.y z@", "é.x@ü.de x@y.de", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.002.3.255 1..2.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 x4111111111111111y", "4111  1111 1111 1111", "+1 (487) 555-7209 ++49 30 1234567- +1 +12 +123456789 +1)2(3456789012345678",
    "🙂 mail: a.b%c+d-e@mail.example.com\n🙂 +49 (0) 30-123.456 7", "5" * 400 + "." + "6" * 400 + ".7.8", "1 " * 13, "0000000000000000 1234-5678-9012-3452",
]


def proposed(kind, text):
    for m in re.finditer(PATTERNS[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
            continue
        if kind == "phone" and not 9 <= len(digits) <= 15:
            continue
        yield kind, m.start(), m.end()


def base_spans(text):
    return [s for k in BASE_KINDS for s in proposed(k, text or "")]


def noisy(rng):
    return "".join(rng.choice(["@", ".", "a", "b-", "+", "1", "23", "456", "7890", " ", "-", "(", ")", "é", "\n", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "%"]) for _ in range(rng.randint(0, 60)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return TEXTS + [noisy(rng) for _ in range(600)]


def test_base_spans(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "n long, text string, spans int").repartition(3)
    got = {r["n"]: r for r in personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"] if s["kind"] in BASE_KINDS] == base_spans(t), t
        assert got[i]["text"] == t and all(0 <= s["score"] <= 1 for s in got[i]["spans"])
    assert personal_data(df.limit(0)).collect() == []


def test_scored_kinds(spark):
    rows = {
        "My IBAN is DE89 3704 0044 0532 0130 00, thanks": [("iban", 11, 38)],
        "GB82WEST12345698765432 or DE89370400440532013001": [("iban", 0, 22)],
        "part XX89370400440532013000 DE8937040044053201300": [],
        "social security no. 123-45-6789": [("ssn", 20, 31)],
        "the code 123-45-6789 alone": [], "ssn 000-12-3456 ssn 666-12-3456 ssn 900-12-3456 ssn 123-00-4567": [],
        "Tel. (030) 123-4567 büro": [("local_phone", 5, 19)], "Seite 030 123-4567": [], "page, phone 030 123-4567": [],
    }
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for r in personal_data(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == rows[r["text"]], r["text"]


def test_context_moves_the_score(spark):
    df = spark.createDataFrame([("visa 4111 1111 1111 1111",), ("number 4111 1111 1111 1111",), ("order 4111 1111 1111 1111",)], "text string")
    assert [r["spans"][0]["score"] for r in personal_data(df).collect()] == [1.0, 0.7, 0.4]


def test_checksums():
    assert luhn(b"4111111111111111") and not luhn(b"4111111111111112") and luhn(b"79927398713")
    assert mod97(b"DE89370400440532013000") and not mod97(b"DE89370400440532013010")


def test_masked(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a é@b x@y.de, +49 30 1234567.", "plain", None])], "n long, text string")
    assert [r["text"] for r in sorted(masked(df).collect())] == ["a é@b [email], [phone].", "plain", None]


def test_query(spark, texts, tmp_path):
    rows = [(None if i % 50 == 3 else i, t, "x") for i, t in enumerate(texts)] + [(7, texts[6], "x")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = sorted((tuple(r[:6]) for r in QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, t, _ in rows:
        spans = base_spans(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *(sum(s[0] == k for s in spans) for k in BASE_KINDS), hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_all_documents(spark, data):
    docs = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    for r in QUERIES["op12_personal_data"](spark, data).collect():
        spans = base_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[0] == k for s in spans) for k in BASE_KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)


def test_long_runs_take_linear_time(spark):
    df = spark.createDataFrame([(c * 3_000_000,) for c in ("a", "7", "a@", "1.", "+1", "1 ", "(0")], "text string")
    began = time.time()
    assert len(personal_data(df, columns=[]).collect()) == 7
    assert time.time() - began < 90
