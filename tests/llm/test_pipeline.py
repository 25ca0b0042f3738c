"""Stages of the pipeline on odd rows."""

import os
import random

import pytest

import corpus_pipeline as p
from loomwork.llm import decontaminate as dc
from loomwork.llm.decontaminate import contamination


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, "The " + words(rng, 60) + ".\n" + "A " + words(rng, 30), "en", "web", 400) for i in range(30)]
    out += [(50, out[3][1], "en", "web", 400), (51, out[3][1], None, None, None), (60, None, "en", "web", 0), (61, "", "en", "web", 0), (62, words(rng, 60_000), "de", "book", None)]
    return out + [(None, out[5][1], "en", "web", 400), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_rows_stay_once(spark, rows, tmp_path):
    once = spark.createDataFrame(rows, SCHEMA)
    doubled = once.unionByName(once).repartition(4)
    want = sorted(map(tuple, p.near_dedup(spark, once, "").collect()), key=str)
    got = sorted(map(tuple, p.near_dedup(spark, doubled, "").where("doc_id is not null").collect()), key=str)
    assert got == [r for r in want if r[0] is not None]
    assert {r[0] for r in want} == {*range(30), 60, 61, 62, None} and p.near_dedup(spark, doubled, "").where("doc_id is null").count() == 4


def test_stages_on_odd_rows(spark, rows, tmp_path):
    spark.createDataFrame([(1, rows[7][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = p.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {60, 61} & {r["doc_id"] for r in good.collect()} == set()
    clean = p.decontaminate(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in rows if r[0] != 7), key=str)
    mixed = p.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() <= len(rows)
    assert p.shard(spark, docs, str(tmp_path)).count() == len(rows)
    empty = docs.limit(0)
    assert all(f(spark, empty, str(tmp_path)).collect() == [] for _, f in p.STAGES)


def test_one_block_of_windows_a_task(spark, monkeypatch):
    monkeypatch.setattr(dc, "WINDOWS_PER_PASS", 15)
    rng = random.Random(1)
    items = [(i, words(rng, 20)) for i in range(5)]
    docs = spark.createDataFrame([(i, words(rng, 10) + " " + items[i % 5][1]) for i in range(20)], "doc_id long, text string")
    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string"), list_items=False)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    assert {r["n_hit"] for r in found.collect()} == {20}
