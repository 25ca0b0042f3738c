"""Query of the tokenizer alignment."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loomwork.llm.alignment import aligned, scored_alignment
from loomwork.llm.registry import query, table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark, folder):
    rows = aligned(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", columns=["doc_id"], written=True)
    digests = rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                          F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "links")
    return scored_alignment(digests).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
