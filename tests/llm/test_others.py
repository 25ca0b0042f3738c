"""The other operators against brute force on small rows: hot keys, nulls, ties, empty tables, clashing columns."""

import base64
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontaminate as dc
from loomwork.llm import mixing, quality_rules, warc
from loomwork.llm.decontaminate import contamination
from loomwork.llm.line_crf import Crf, _forward_backward, fit_line_quality, line_quality
from loomwork.llm.mixing import mixed
from loomwork.llm.quality_rules import judged
from loomwork.llm.sharding import shards
from loomwork.llm.toxicity import fit_toxicity, toxicity

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    long = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 25)))) for i in range(12)]
    return [*long, (12, long[0][1]), (13, "Only Four-words. here"), (14, "solo"), (15, ""), (16, None), (None, long[3][1])]


@pytest.mark.parametrize("per_pass", [250_000, 3])
def test_contamination(spark, items, monkeypatch, per_pass):
    monkeypatch.setattr(dc, "WINDOWS_PER_PASS", per_pass)
    rng = random.Random(4)
    docs = []
    for i in range(40):
        w = [f"v{rng.randint(0, 99)}" for _ in range(30)]
        if i % 3 == 0:
            piece = (items[i % 12][1]).split()
            k = rng.randint(0, len(piece) - 10)
            w[10:10] = piece[k:k + rng.choice((9, 10, 12))]
        docs.append((i, " ".join(w).upper() if i % 2 else ", ".join(w), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "a solo, b", 1), (103, "only four words here only FOUR words here", 1), (None, "solo solo", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    want = {}
    for i, t, _ in docs:
        w, hit, names = re.findall(PLAIN, lower(t)), set(), set()
        for item, text in items:
            b = re.findall(PLAIN, lower(text))
            n = min(10, len(b))
            found = {k for j in range(len(b) - n + 1) if n for k in range(len(w) - n + 1) if w[k:k + n] == b[j:j + n]}
            if found:
                hit |= {k + x for k in found for x in range(n)}
                names |= {str(item)} if item is not None else set()
        want[i] = (len(w), len(hit), sorted(names))
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == want
    none = contamination(df, spark.createDataFrame([], "item_id long, text string"), list_items=False)
    assert {r["n_hit"] for r in none.collect()} == {0}


def test_rules(spark):
    rng = random.Random(2)
    rows = [(i, "Some words of every kind come here. " + " ".join(f"Word{rng.randint(0, 999)} and" for _ in range(40)), 7) for i in range(30)]
    rows += [(100 + i, " ".join(f"t{rng.randint(0, 999)}###" for _ in range(60)), 7) for i in range(6)]
    rows += [(200, None, 7), (201, "", 7), (202, "few words only", 7), (203, "again and again we go on " * 30, 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in judged(df).collect()}
    assert all(got[i]["kept"] for i in range(30)) and not any(got[100 + i]["kept"] for i in range(6))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (200, 201, 202, 203, None))
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        shingles = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        covered = {k + x for k, s in enumerate(shingles) if shingles.count(s) > 1 for x in range(5)}
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(covered), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
    assert judged(df.limit(0)).collect() == []


def test_posterior_is_what_the_votes_say(spark):
    names = [f"vote_{r.name}" for r in quality_rules.RULES]
    model = quality_rules.VoteModel(0.8, [(0.1, 0.6, 0.5, 0.2)] * len(names))
    row = spark.createDataFrame([[-1, 1] + [0] * (len(names) - 2)], names).select(model.posterior(names).alias("p")).first()
    good, bad = 0.8 * 0.1 * 0.6 * 0.3 ** 7, 0.2 * 0.5 * 0.2 * 0.3 ** 7
    assert row["p"] == pytest.approx(good / (good + bad))
    assert model.accuracy()[0] == pytest.approx((6 / 7, 5 / 7))


def test_expectation_maximisation_finds_the_accuracies(spark):
    """Votes drawn from known rates: rates, share and kinds are found again although no document says what it is."""
    rng = random.Random(3)
    rates = [(0.02, 0.9, 0.6, 0.2), (0.05, 0.7, 0.8, 0.1), (0.1, 0.5, 0.4, 0.3), (0.02, 0.6, 0.7, 0.2), (0.04, 0.8, 0.5, 0.4)]
    names, counts = [f"v{i}" for i in range(5)], {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        pattern = tuple(rng.choices((-1, 1, 0), (b, g, 1 - b - g))[0] for b, g in ((r[:2] if good else r[2:]) for r in rates))
        counts[pattern] = counts.get(pattern, 0) + 1
    model = quality_rules.fit_votes(spark.createDataFrame([(*p, n) for p, n in counts.items()], [*names, "n"]), names, 60)
    assert model.good == pytest.approx(0.7, abs=0.02)
    assert np.allclose(model.rates, rates, atol=0.04)


def test_the_posterior_decides_not_one_vote(spark):
    """Kept differs from all-must-pass in both directions: a bad vote is outvoted, and bad evidence below no single threshold adds up."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda n: "The " + " ".join(word() for _ in range(n)) + "."
    good = ["\n".join(line(20) for _ in range(6)) for _ in range(200)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(20)]
    again = line(9)
    one_bad = ["\n".join([line(40), line(40), again, again])]  # a third of the lines are copies, all else is well
    rows = [(i, t) for i, t in enumerate(good + junk + one_bad)]
    got = {r["doc_id"]: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string"), columns=["doc_id"]).collect()}
    votes = {i: [r[f"vote_{x.name}"] for x in quality_rules.RULES] for i, r in got.items()}
    assert all(got[i]["kept"] for i in range(200)) and not any(got[200 + i]["kept"] for i in range(20))
    assert -1 in votes[220] and got[220]["kept"] and not got[220]["base_failed"]
    # abstentions weigh too: with no bad vote at all, a document that few rules vouch for may go
    model = quality_rules.VoteModel(0.6, [(0.01, 0.95, 0.3, 0.2)] * 9)
    names = [f"v{i}" for i in range(9)]
    row = spark.createDataFrame([[0] * 9], names).select(model.posterior(names).alias("p")).first()
    assert row["p"] < 0.5


def test_rules_keep_foreign_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", [1], "y", "z")], "doc_id long, text string, _text string, _words array<int>, _lines string, _packed string")
    row = judged(df).first()
    assert (row["doc_id"], row["text"], row["_text"], row["_words"], row["_lines"], row["_packed"]) == (1, "a b", "x", [1], "y", "z")
    long = spark.createDataFrame([(1, "word " * 400_000)], "doc_id long, text string")
    assert [(r["n_words"], r["base_failed"]) for r in judged(long, columns=["doc_id"]).collect()] == [(400_000, True)]


def test_shards(spark):
    rows = [(i, "hot" if i % 3 else None, 0) for i in range(3000)] + [(None, "x", 0), (None, "x", 0), (5, "hot", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shards(df, n=8).collect()
    assert len(got) == len(rows)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and 200 < sum(r["grown_shard"] == 8 for r in got) < 480
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in got)
    heavy = shards(df, n=2, weights=[1.0, 3.0]).collect()
    assert 0.7 < sum(r["shard"] == 1 for r in heavy) / len(heavy) < 0.8
    assert shards(df.limit(0)).collect() == []


def test_shards_keep_foreign_columns(spark):
    df = spark.createDataFrame([(i, "t", i, i + 1, i + 2, i + 3) for i in range(50)], "doc_id long, text string, _key long, _id long, _part long, `_at` long")
    got = shards(df, n=4).collect()
    assert len(got) == 50 and all((r["_key"], r["_id"], r["_part"], r["_at"]) == (r["doc_id"], r["doc_id"] + 1, r["doc_id"] + 2, r["doc_id"] + 3) for r in got)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(50, 150), rng.choice(["a", "a", "a", "b"]), rng.choice(["en", "en", None]), 1) for i in range(4000)] + [(None, None, None, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    share = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("absent", 0.2)], "category string, target double")
    got = mixed(df, targets={"source": share, "lang": spark.createDataFrame([("en", 0.5), (mixing.MISSING, 0.5)], "category string, target double")}).collect()
    assert len(got) == len(rows)
    total = sum(r["weight"] * r["tokens"] for r in got)
    assert sum(r["weight"] * r["tokens"] for r in got if r["source"] == "b") / total == pytest.approx(0.5, abs=1e-3)
    assert sum(r["weight"] * r["tokens"] for r in got if r["lang"] == "en") / total == pytest.approx(0.5, abs=1e-3)
    picked = [r for r in got if r["sampled"]]
    assert sum(r["tokens"] for r in picked if r["source"] == "b") / sum(r["tokens"] for r in picked) == pytest.approx(0.5, abs=0.06)
    assert max(r["probability"] for r in got) == 1.0
    assert mixed(df.limit(0)).collect() == []


def test_archives(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\ny", "copy" if i % 3 == 0 else "é" * rng.randint(0, 3000), 5) for i in range(200)]
    rows += [(500, None, None, 5), (501, "u", "", 5), (None, "u", "copy", 5), (502, "u", "z" * 3_000_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, part int")
    folder = warc.archive_folder(spark)
    got = warc.read_archives(spark, warc.write_archives(df, folder), folder).collect()
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), last[h or ""] if last[h or ""] != i else None) for i, _, h, _ in rows}
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got} == want
    bodies = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(r["payload"] == (bodies[r["page_id"]] if r["record_type"] == "response" else b"") for r in got)


def test_damaged_archives():
    good = warc._member(warc._record(1, "u", b"payload", None))
    assert [p for _, p in warc.read_records(io.BytesIO(good * 2))] == [b"payload"] * 2
    wrong = warc._record(1, "u", b"payload", None).replace(b"payload\r\n", b"paylord\r\n")
    for bad in (good[:-9], warc._member(wrong), warc._member(b"junk\r\n\r\n"), warc._member(warc._record(1, "u", b"p", None) + b"more")):
        with pytest.raises((warc.ArchiveError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def labelled(spark, name):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), name


def test_line_quality_on_held_out_rows(spark):
    docs, labels, _ = labelled(spark, "quality")
    model = fit_line_quality(docs, labels)
    rows = line_quality(docs.join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id"), model, columns=["doc_id", "quality"]).toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.98
    odd = line_quality(spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "\n\n", 0), (None, "One line.", 0)], "doc_id long, text string, score int"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and len({r["score"] for r in odd[:3]}) == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels, _ = labelled(spark, "toxic")
    truth = labels.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", F.col("toxic").alias("truth"))
    rows = toxicity(docs.join(truth, "doc_id"), fit_toxicity(docs, labels), columns=["truth"]).select("expected_severity", "grade", "truth").toPandas()
    assert auc(rows["expected_severity"].to_numpy(), rows["truth"].to_numpy()) > 0.7
    assert rows[rows["truth"] == 0]["grade"].gt(0).mean() < 0.01
    empty = fit_toxicity(docs.limit(0), labels.limit(0))
    assert [r["toxic"] for r in toxicity(docs.limit(3), empty, columns=["doc_id"]).collect()] == [False] * 3


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    u, t = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    p, pair = _forward_backward(u, np.ones((1, 4), bool), t)
    paths = [[(k >> i) & 1 for i in range(4)] for k in range(16)]
    weight = np.array([math.exp(sum(u[0, i] * y for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))) for path in paths])
    weight /= weight.sum()
    assert np.allclose(p[0], weight @ np.array(paths))
    want = np.zeros((2, 2))
    for w, path in zip(weight, paths):
        for a, b in zip(path, path[1:]):
            want[a, b] += w
    assert np.allclose(pair[0], want)
    assert len(Crf(np.zeros(3), t).flat()) == 9
