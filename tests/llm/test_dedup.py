"""Duplicate finders against brute force, on small texts with hot groups, nulls, ties and clashing columns."""

import itertools
import random
import re

import pyarrow as pa
import pytest

from loomwork.llm import chunks, words
from loomwork.llm.chunks import repeated_passages
from loomwork.llm.components import lowest_reachable
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.suffixes import repeated_spans

WORD = r"[^\x20\x09-\x0D]+"


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, share):
    return " ".join("x" + w if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base, other = text_of(rng, 200), text_of(rng, 80)
    rows = [(i, base) for i in range(40)]
    rows += [(100 + i, edited(rng, base, 0.03)) for i in range(40)]
    rows += [(200 + i, edited(rng, base, 0.07)) for i in range(20)]
    rows += [(300 + i, text_of(rng, 60) + " " + other + " " + text_of(rng, 60)) for i in range(10)]
    rows += [(400 + i, text_of(rng, rng.randint(1, 12))) for i in range(20)]
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, "ONE two"), (505, " \t\n "), (506, base.upper()),
             (None, base), (507, text_of(rng, 30000))]
    return rows


def sets(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, corpus):
    df = spark.createDataFrame([(t, i, i, "z") for i, t in corpus], "text string, doc_id long, v long, key string")
    got = {(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    s = {i: sets(t) for i, t in corpus if i is not None}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got.pop(None)[1] is None
    assert got == {i: (len(s[i]), find(i)) for i in s}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["v"]: r["root"] for r in lowest_reachable(spark.createDataFrame(links, "a long, b long")).collect() if r["v"] is not None}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 140)}, 200: 199}


def windows(corpus, n):
    held = {}
    for i, t in corpus:
        w = re.findall(WORD, t or "")
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k:k + n]), set()).add(i)
    return held


def test_suffixes(spark, corpus):
    corpus = [r for r in corpus if r[0] is not None]
    df = spark.createDataFrame([(i, t, "c") for i, t in corpus], "doc_id long, text string, anchor string")
    found = repeated_spans(df).collect()
    wanted = {i for ids in windows(corpus, 50).values() if len(ids) > 1 for i in ids}
    assert {r["doc_id"] for r in found} == wanted
    texts = {i: re.findall(WORD, t or "") for i, t in corpus}
    for r in found:
        assert r["n_words"] >= 50 and r["first_word"] + r["n_words"] <= len(texts[r["doc_id"]]) and r["other_id"] != r["doc_id"]


def test_chunks_find_passages(spark, corpus):
    corpus = [r for r in corpus if r[0] is not None]
    found = repeated_passages(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    wanted = {i for ids in windows(corpus, 50).values() if len(ids) > 1 for i in ids}
    assert wanted <= {r["doc_id"] for r in found}
    assert not {r["doc_id"] for r in found} & {i for i, t in corpus if t is None or i >= 400 and i not in (506,)}
    kept_first = [r for r in found if r["doc_id"] == 0]
    assert sum(r["removable_bytes"] for r in kept_first) == 0
    texts = {i: (t or "").encode() for i, t in corpus}
    for r in found:
        part = texts[r["doc_id"]][r["start"]:r["start"] + r["n_bytes"]]
        assert len(part) == r["n_bytes"] >= chunks.MIN_BYTES


def pieces(text):
    block = next(words.blocks(pa.array([text])))
    ends = chunks.cuts(block)
    return [text.encode()[i:j] for i, j in zip([0, *ends[:-1]], ends)]


def test_chunks_resist_insertions():
    base = text_of(random.Random(3), 900)
    a, b = pieces(base), pieces("new words first " + base[:2000] + " inserted " + base[2000:])
    assert b"".join(a) == base.encode() and max(map(len, a)) <= chunks.MAX_CHUNK
    assert len(set(a) - set(b)) <= 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for find in (near_duplicates, repeated_passages, repeated_spans):
        assert find(empty).collect() == []
