"""Queries of mixing and sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import mixing
from loomwork.llm.mixing import DIMENSIONS, ROUNDS, TEMPER, mixed
from loomwork.llm.registry import query, table
from loomwork.llm.sharding import SHARDS, shards


def sharded_sql(source: str, columns: str = "doc_id") -> str:
    """Common table expressions that end in ``sharded``."""
    rank = "list_extract(list_sort([(('0x' || substr(md5(doc_id::VARCHAR || ':' || i), 1, 13))::BIGINT, -i) FOR i IN range({n})]), -1)[2]"
    return f"""sharded0 AS (SELECT {columns}, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, 'key' AS law,
  (-({rank.format(n=SHARDS)}))::INTEGER AS shard, (-({rank.format(n=SHARDS + 1)}))::INTEGER AS grown_shard FROM {source}),
sharded AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id::VARCHAR COLLATE C) - 1 AS slot FROM sharded0)"""


#: CRC-32 of UTF-8 text: the table of the reflected polynomial by its rule, then a fold over the bytes.
SQL_CRC = """crc_bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)]),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), crc_table)"""


@query("op7_rendezvous_sharding", f"""WITH RECURSIVE {SQL_CRC}, {sharded_sql('documents')}
SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM sharded LEFT JOIN crc USING (doc_id)""")
def rendezvous_sharding(spark, folder):
    return shards(table(spark, folder, "documents"), columns=["doc_id"])


def mixed_sql(source: str) -> str:
    """Common table expressions that end in ``mixed``: topic, tokens, weight, probability, sampled by doc_id."""
    topic = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, c in mixing.TOPICS) + f" ELSE '{mixing.DEFAULT_TOPIC}' END"
    parts = [f"""mx AS (SELECT *, {topic} AS topic, greatest(coalesce(strlen(text), 0), 1) AS tokens,
  coalesce(source, '{mixing.MISSING}') AS _s, coalesce(lang, '{mixing.MISSING}') AS _l FROM {source}),
cells AS (SELECT _s AS source, _l AS lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS weight FROM mx GROUP BY ALL)"""]
    for d in DIMENSIONS:
        parts.append(f"goal_{d} AS (SELECT {d} AS category, pow(sum(tokens), {TEMPER}::DOUBLE) AS p FROM cells GROUP BY {d})")
        parts.append(f"target_{d} AS (SELECT category, p / (SELECT sum(p) FROM goal_{d}) * (SELECT sum(tokens) FROM cells) AS goal FROM goal_{d})")
    last = "cells"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            new = f"cells_{r}_{d}"
            parts.append(f"""{new} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * goal / have AS weight FROM {last} c
  JOIN (SELECT {d} AS category, sum(weight * tokens) AS have FROM {last} GROUP BY {d}) m ON m.category = c.{d} JOIN target_{d} t ON t.category = c.{d})""")
            last = new
    parts.append(f"""mixed AS (SELECT mx.*, w.weight, w.weight / (SELECT max(weight) FROM {last}) AS probability,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE
    < w.weight / (SELECT max(weight) FROM {last}) AS sampled
  FROM mx JOIN {last} w ON w.source = _s AND w.lang = _l AND w.topic = mx.topic)""")
    return ",\n".join(parts)


@query("op4_mixing_to_targets", f"""WITH {mixed_sql('documents')}
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, sampled FROM mixed""")
def mixing_to_targets(spark, folder):
    rows = mixed(table(spark, folder, "documents"), columns=["doc_id", "source", "lang"])
    return rows.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")
