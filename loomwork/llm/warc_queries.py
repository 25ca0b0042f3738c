"""Query of the web archives."""

from __future__ import annotations

from loomwork.llm.registry import query, table
from loomwork.llm.warc import archive_folder, read_archives, write_archives
from loomwork.session import stage

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("op8_warc_round_trip", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, octet_length(body) AS payload_bytes, array_to_string([substr('{_DIGITS}', 1 + (('0x' || substr(h, 1 + (5 * i) // 4, 2) || '0')::INTEGER
         >> (7 - (5 * i) % 4)) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN r USING (h)""")
def warc_round_trip(spark, folder):
    target = archive_folder(spark)
    archives = stage(write_archives(table(spark, folder, "pages"), target), "archives")
    return read_archives(spark, archives, target).drop("url", "payload")
