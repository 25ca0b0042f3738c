"""Tokenizer alignment against sets of ends and plain counters."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import alignment as al
from loomwork.llm.alignment_queries import TOKENIZERS
from loomwork.llm.queries import QUERIES

A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
PLAIN = Tokenizer.from_file(A_FILE)
PLAIN.encode_special_tokens = True
TEXTS = [None, "", " ", "a", "Hello world, hello worlds!", "<|endoftext|> and <s>", "naïve café 日本語 🙂🙃", "tabs\tand\n\nnew  lines   ", "▁ a low line", "ﬁne",
         "zero\x00byte", "0123456789 " * 20, "antidisestablishmentarianism " * 3, "the the the the", "<0x41> A"]


@pytest.fixture(scope="module")
def encoders():
    return al.Encoders(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


def groups_of(encoders, text):
    """Groups by the intersection of two sets of ends; None where the tokens do not give the text back."""
    if not text:
        return None
    a, b = PLAIN.encode(" " + text, add_special_tokens=False).ids, encoders.b.encode(text)
    a_bytes = [encoders.a_vocabulary.pieces[i].as_py() for i in a]
    b_bytes = [encoders.b_vocabulary.pieces[i].as_py() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    ends = [{int(e): k + 1 for k, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (a_bytes, b_bytes)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0][end], ends[1][end]
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def test_groups(spark, encoders):
    rng = random.Random(5)
    texts = [*TEXTS, *["".join(rng.choice("abc \né🙂the") for _ in range(rng.randint(1, 60))) for _ in range(60)], "long " + "wörd of a text " * 5_000, TEXTS[4]]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, _text string").repartition(3)
    got = {r["doc_id"]: r for r in al.aligned(df, A_FILE, B_FILE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = groups_of(encoders, t) or []
        r = got[i]
        assert r["text"] == t and r["_text"] == "x"
        assert [(list(g["a"]), list(g["b"])) for g in r["groups"]] == want, t and t[:80]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (sum(len(g[0]) for g in want), sum(len(g[1]) for g in want), len(want))
        assert {(x["a_id"], x["b_id"]): x["n"] for x in r["links"]} == Counter((a[-1], b[-1]) for a, b in want)
    assert got[5]["n_a"] > 5 and got[0]["n_a"] == got[1]["n_a"] == 0


def test_gallop():
    rng = np.random.default_rng(1)
    long, begin, end, short, rank = [], [], [], [], []
    base = at = 0
    for n, m in ((1, 1), (5, 900), (700, 3000), (64, 64), (512, 40_000)):
        values = np.sort(rng.choice(10 * m, m, replace=False)) + base
        some = np.sort(rng.choice(np.append(values[:-1], values[:-1] - 1), min(n, m) - 1)) if m > 1 else values[:0]
        some = np.unique(np.append(some, values[-1]))
        long.append(values), short.append(some), rank.append(np.arange(len(some)))
        begin.append(np.full(len(some), at)), end.append(np.full(len(some), at + m))
        base, at = values[-1] + 10, at + m
    long, begin, end, short, rank = map(np.concatenate, (long, begin, end, short, rank))
    place = al.gallop(short, rank, long, begin, end)
    assert (long[place] >= short).all() and (place >= begin).all() and ((place == begin) | (long[place - 1] < short)).all()
    none = np.zeros(0, np.int64)
    assert len(al.gallop(none, none, long, none, none)) == 0


def counted(encoders, texts):
    """The result rows from plain counters over all links."""
    groups = [groups_of(encoders, t) or [] for t in texts]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    n = Counter(x for l in links for x in l)
    best = Counter()
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    rows = []
    for g, l in zip(groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(l), sum(n[x] == best[x[1]] for x in l), sum(n[x] for x in l),
                     hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


def test_query(spark, encoders, tmp_path):
    texts = [*TEXTS, *["the same hot text of all" for _ in range(100)], "the", "The", " the"]
    rows = [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)] + [(3, "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = QUERIES["op11_tokenizer_alignment"](spark, str(tmp_path)).collect()
    want = [(r[0], *c) for r, c in zip(rows, counted(encoders, [r[1] for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_on_all_documents(spark, data, encoders):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: c for r, c in zip(docs, counted(encoders, [r[1] for r in docs]))}
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_tokenizer_alignment"](spark, data).collect()}
    assert got == want


def test_empty_table_and_rows_without_links(spark):
    df = spark.createDataFrame([], "doc_id long, text string, groups int")
    rows = al.aligned(df, A_FILE, B_FILE)
    assert rows.columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "groups", "links"] and rows.collect() == []
    scored = al.scored_alignment(rows.select("doc_id", "links"))
    assert scored.columns == ["doc_id", "n_best", "count_sum"] and scored.collect() == []
    some = al.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_FILE, B_FILE)
    some = al.scored_alignment(some.select("doc_id", F.lit(5).alias("n_best"), "links"))
    assert sorted(map(tuple, some.collect())) == [(1, 0, 0), (2, 0, 0)]


def test_links_are_bounded_by_the_vocabularies(encoders):
    """The bound that lets the pair table travel: one token of a link is the end of the other."""
    a, b = ([p.as_py() for p in v.pieces] for v in (encoders.a_vocabulary, encoders.b_vocabulary))
    count_a, count_b = Counter(a), Counter(b)
    longer_a = sum(count_b[x[i:]] for x in a for i in range(len(x)))
    longer_b = sum(count_a[x[i:]] for x in b for i in range(1, len(x)))
    assert longer_a + longer_b < 500_000
