"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm.quality_rules import BASE_FAILED, FEATURES, ITERATIONS, MIN_POSTERIOR, PRIOR_GOOD, PRIOR_WEIGHT, RULES, START, judged
from loomwork.llm.registry import SQL_BLANK_WORD, query, table


def features_sql(source: str) -> str:
    """DuckDB text of the feature columns by doc_id."""
    return f"""
fw AS (SELECT doc_id, coalesce(regexp_extract_all(text, {SQL_BLANK_WORD}), []) AS w,
       [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, {SQL_BLANK_WORD})] AS l FROM {source}),
fs AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM fw)),
fr AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM fs
       WHERE (doc_id, s) IN (SELECT (doc_id, s) FROM fs GROUP BY doc_id, s HAVING count(*) > 1)) GROUP BY doc_id),
features AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
       length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
       length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[A-Z]', '', 'g')) AS n_capitals,
       len(list_distinct(w)) AS n_distinct_words FROM fw LEFT JOIN fr USING (doc_id))"""


def judged_sql(source: str) -> str:
    """Common table expressions that end in ``judged``: features, votes, posterior and verdict by doc_id."""
    n = range(len(RULES))
    w = PRIOR_WEIGHT
    cast = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{i}" for i, r in enumerate(RULES))
    rates = ("bg", "gg", "bb", "gb")  # bad and good votes on good documents, then on bad ones
    odds = "ln(good) - ln(1 - good)" + "".join(
        f" + CASE v{i} WHEN -1 THEN least(0, ln(bg{i}) - ln(bb{i})) WHEN 1 THEN greatest(0, ln(gg{i}) - ln(gb{i})) "
        f"ELSE ln(1 - bg{i} - gg{i}) - ln(1 - bb{i} - gb{i}) END" for i in n)
    start = ", ".join(f"{x}::DOUBLE AS {r}{i}" for i in n for r, x in zip(rates, START))
    step = ", ".join(
        f"(sum(CASE WHEN v{i} = {vote} THEN {share} ELSE 0 END) + {x * w}::DOUBLE) / (sum({share}) + {w}::DOUBLE)"
        for i in n for x, vote, share in zip(START, (-1, 1, -1, 1), ("pg", "pg", "n - pg", "n - pg")))
    keys = ", ".join(f"v{i}" for i in n)
    return f"""{features_sql(source)},
cast_votes AS (SELECT *, {cast}, ({BASE_FAILED}) AS base_failed FROM features),
patterns AS (SELECT {keys}, count(*) AS n FROM cast_votes WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS it, {PRIOR_GOOD}::DOUBLE AS good, {start} UNION ALL
       SELECT it + 1, (sum(pg) + {PRIOR_GOOD * w}::DOUBLE) / (sum(n) + {w}::DOUBLE), {step}
       FROM (SELECT *, n / (1 + exp(-({odds}))) AS pg FROM em, patterns WHERE it < {ITERATIONS}) GROUP BY it),
judged AS (SELECT *, 1 / (1 + exp(-({odds}))) AS posterior FROM cast_votes, (SELECT * FROM em WHERE it = {ITERATIONS}))"""


_COLUMNS = ", ".join(FEATURES[:5])


@query("op1_quality_rules", f"""WITH RECURSIVE {judged_sql('documents')}
SELECT doc_id, {_COLUMNS}, base_failed, NOT base_failed AND posterior >= {MIN_POSTERIOR} AS kept, round(posterior, 6) AS posterior FROM judged""")
def quality_rules(spark, folder):
    scored = judged(table(spark, folder, "documents"), columns=["doc_id"])
    return scored.select("doc_id", *FEATURES[:5], "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
