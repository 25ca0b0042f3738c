"""Every query of the subpackage against its SQL, and the SQL-free ones against their own rules, on the smallest tables."""

import pytest
from compare import compare

from loomwork.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, data, name):
    line = compare(spark, duck, data, name, QUERIES[name], ORACLES[name])
    assert line.startswith("ok"), line


def test_pipeline_agrees_with_sql(spark, duck, data):
    import corpus_pipeline as p
    line = compare(spark, duck, data, "pipeline", p.run, p.ORACLE_SQL)
    assert line.startswith("ok"), line


def test_stages_in_order():
    import corpus_pipeline as p
    assert [n for n, _ in p.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "mixing_to_targets", "rendezvous_sharding"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert rows and {r["doc_id"] for r in rows} <= set(ids)
    if name.startswith(("op2_", "op10_")):
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
