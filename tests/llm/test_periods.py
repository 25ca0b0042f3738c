"""Periodic runs against the definition, word by word."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loomwork.llm import periods as pd_
from loomwork.llm.periods import periodic_runs
from loomwork.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(ws):
    """All longest stretches of smallest period q and at least max(6, 4 q) words: for each q, stretches of equal words q apart."""
    found = {}
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                # a stretch that a smaller period also covers was found before
                if not any(s <= i and e >= j + q and q % p == 0 for (s, e), p in found.items()):
                    found[i, j + q] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(ws, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in drop)


def random_text(rng):
    out = []
    while len(out) < rng.randint(1, 120):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, rng.choice((2, 4, 9, 20))))]
        n = rng.choice((1, 1, 3, 4, 5, 9)) * len(unit) + rng.randint(0, len(unit))
        out += (unit * 12)[:n]
    return rng.choice((" ", "\n", " \t ")).join(out)


def test_runs(spark):
    rng = random.Random(11)
    texts = [None, "", "  \n ", "a", "a a a a a", "a a a a a a", "ab " * 8, "x " + "a b c " * 4 + "a", "no repeat in this text at all", "a b a b a b a b b b b b b b"]
    texts += [random_text(rng) for _ in range(500)]
    texts += [" ".join(["é🙂", "b"] * 3000), "w " * 20_000, " ".join(f"u{i % 2500}" for i in range(10_003))]
    df = spark.createDataFrame([(i if i % 7 else None, i, t, 3) for i, t in enumerate(texts)], "doc_id long, n long, text string, runs int").repartition(3)
    got = {r["n"]: r for r in periodic_runs(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = re.findall(WORD, t or "")
        found = [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]]
        want = brute_runs(ws) if len(ws) < 5000 else {6000: [(0, 6000, 2)], 20_000: [(0, 20_000, 1)], 10_003: [(0, 10_003, 2500)]}[len(ws)]
        assert found == want, t and t[:300]
        assert got[i]["n_words"] == len(ws) and got[i]["collapsed"] == collapsed(ws, found) and got[i]["text"] == t
    assert sum(bool(r["runs"]) for r in got.values()) > 100
    assert periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, min_words=5)


def test_range_successor():
    rng = np.random.default_rng(3)
    for n in (1, 2, 37, 500):
        values = rng.permutation(n)
        tree = pd_.WaveletTree(values)
        low = rng.integers(0, n, 300)
        high = np.minimum(n, low + rng.integers(0, n + 1, 300))
        least = rng.integers(0, n + 1, 300)
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == want


def test_suffix_array():
    rng = np.random.default_rng(4)
    row = np.sort(rng.integers(0, 6, 300))
    code = row * 10 + rng.integers(0, 3, 300)
    first, last = np.searchsorted(row, row), np.searchsorted(row, row, "right")
    order, dyadic = pd_.suffix_array(code, first, last)
    suffix = [tuple(code[i:last[i]]) for i in range(300)]
    assert [suffix[i] for i in order] == sorted(suffix)
    for b, m, lo, hi in zip(dyadic.start, dyadic.size, dyadic.low, dyadic.high):
        assert sorted(order[lo:hi]) == [i for i in range(300) if suffix[i][:m] == suffix[b][:m]]


def row_of(doc_id, text):
    """The result row from the rules of the query alone."""
    ws = re.findall(WORD, text or "")
    if doc_id is not None and ws:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(ws)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = brute_runs(ws)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            digest(collapsed(ws, found)), len(ws))


def test_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice((None, i)), random_text(rng), "en") for i in range(150)] + [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(1, 200))), "de") for i in range(150, 400)]
    rows += [(500, None, "x"), (501, "", "x"), (None, None, None), (160, "a b", "x"), (160, "a b", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = sorted((row_of(r[0], r[1]) for r in rows), key=str)
    assert got == want


def test_query_on_all_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 20000").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, data).collect()}
    assert len(got) >= len(docs)
    assert all(got[d] == row_of(d, t) for d, t in docs)
