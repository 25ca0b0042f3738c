"""Cases in which an operator once did less than its whole job."""

import random

import pytest

from pyspark.sql import functions as F

from loomwork.llm import suffixes
from loomwork.llm.suffixes import repeated_spans
from loomwork.llm.toxicity import fit_toxicity, toxicity


def test_toxic_recall_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = labels.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", F.col("toxic").alias("truth"))
    rows = toxicity(docs.join(truth, "doc_id"), fit_toxicity(docs, labels), columns=["truth", "lang"]).toPandas()
    recall = rows[rows["truth"] == 1].groupby("lang")["toxic"].mean()
    assert set(recall.index) == {"de", "en", "es", "fr"} and recall.min() >= 0.8, recall
    assert rows[rows["truth"] == 0]["toxic"].mean() < 0.01


def test_stem_of_few_toxic_rows(spark):
    rng = random.Random(1)
    plain = [f"w{rng.randint(0, 500)}" for _ in range(40)]
    rows = [(i, " ".join(rng.sample(plain, 8) + ([f"бранноеслово{i}"] if i % 50 == 0 else [])), int(i % 50 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(1, " ".join(plain[:8]) + " бранноесловечко"), (2, " ".join(plain[:8]))], "doc_id long, text string")
    assert {r["doc_id"]: r["toxic"] for r in toxicity(new, model).collect()} == {1: True, 2: False}


def passages_between(seed):
    """A 51-word passage in two documents, and others that hold all but its first two words, then their own."""
    rng = random.Random(seed)
    new = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for p in range(20):
        passage = new(51)
        rows += [(1000 * p + k, " ".join(new(70) + passage + new(70))) for k in (1, 2)]
        rows += [(1000 * p + 10 + k, " ".join(new(70) + passage[2:] + new(70))) for k in range(30)]
        wanted |= {1000 * p + 1: (70, 51, 1000 * p + 2), 1000 * p + 2: (70, 51, 1000 * p + 1)}
    return rows, wanted


def test_truncated_holders_hide_no_passage(spark):
    rows, wanted = passages_between(3)
    found = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["first_word"], r["n_words"], r["other_id"]) for r in found} == wanted


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_groups_over_many_tasks(spark, monkeypatch, most):
    """A passage of a third of all rows, cut into parts; some rows share a longer passage with one other row far away."""
    monkeypatch.setattr(suffixes, "GROUP_ROWS", most)
    rng = random.Random(6)
    new = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**9)}" for _ in range(n)]
    hot, rows = new(60), []
    long = {k: new(20) for k in range(5)}
    for i in range(300):
        tail = long[i % 50] if i % 50 < 5 and i in range(50) or i >= 250 and i % 50 < 5 else new(20)
        rows.append((i, " ".join(new(30) + hot + tail + new(30))))
    rows += [(1000 + i, " ".join(new(100))) for i in range(300)]
    for width in ("8", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        found = {r["doc_id"]: (r["first_word"], r["n_words"]) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
        assert found == {i: (30, 80 if i % 50 < 5 and (i < 50 or i >= 250) else 60) for i in range(300)}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
