"""From raw documents to training shards: quality, near duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.decontaminate import contamination
from loomwork.llm.decontaminate_queries import contamination_sql
from loomwork.llm.dedup_queries import components_sql
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.mixing import mixed
from loomwork.llm.quality_queries import judged_sql
from loomwork.llm.quality_rules import MIN_POSTERIOR, judged
from loomwork.llm.sampling_queries import mixed_sql, sharded_sql
from loomwork.llm.sharding import shards
from loomwork.session import stage

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base conditions and that the weighed rules hold for good.

    Null and empty texts go. Texts are judged whole; equal texts fare alike; nulls elsewhere and an empty table do not matter.
    """
    return judged(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the lowest id.

    Rows that repeat an id are one document: of those with the same text one stays. Rows without an id are linked with
    nothing and stay. Texts without words stay, texts are compared whole, an empty table gives an empty one.
    """
    surplus = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)
    again = stage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts and rows without an id stay; texts are read whole; repeated rows fare alike; an empty benchmark keeps all.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items, list_items=False).where("n_hit = 0").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares.

    A missing source or language is a category of its own, a null text counts one token; equal ids draw alike, so repeated
    rows stay or go together; only the length of a text matters; an empty table gives an empty one.
    """
    return mixed(docs).where("sampled").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it.

    A null id is a key of its own, equal ids share a shard, ties of places are settled by the row; a null text has 16 bytes; an
    empty table gives an empty one.
    """
    return shards(docs).drop("text_crc32")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
          ("mixing_to_targets", mix), ("rendezvous_sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


_ALL = ", ".join(DOCUMENTS)
ORACLE_SQL = f"""WITH good AS (WITH RECURSIVE {judged_sql("documents")}
  SELECT {_ALL} FROM documents JOIN judged USING (doc_id) WHERE NOT base_failed AND posterior >= {MIN_POSTERIOR}),
single AS (SELECT {_ALL} FROM good JOIN ({components_sql("good")}) USING (doc_id) WHERE kept),
clean AS (SELECT {_ALL} FROM single JOIN ({contamination_sql("single")}) USING (doc_id) WHERE NOT contaminated),
sample AS (WITH {mixed_sql("clean")} SELECT {_ALL} FROM mixed WHERE sampled),
{sharded_sql("sample", _ALL)}
SELECT {_ALL}, size, law, shard, slot, grown_shard FROM sharded"""
