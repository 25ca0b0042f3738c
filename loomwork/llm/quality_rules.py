"""Weakly supervised document quality: rules vote or abstain, expectation maximisation weighs them.

Everything here is built-in DataFrame functions; the only thing that reaches the driver is a few sums a rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import keep, stage, staging


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where the condition (SQL over the feature columns) holds, abstains elsewhere; bad goes first."""

    name: str
    bad: str
    good: str


#: Conditions use integers only, so they mean the same in any SQL engine. Features: see ``with_features``. Rules look at
#: overlapping evidence (symbols by words and by characters, repeats by words, lines and vocabulary), so that a rule's
#: errors show where the others disagree with it.
RULES = (
    Rule("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    Rule("symbol_chars", "100 * n_symbols > 4 * word_chars", "100 * n_symbols <= word_chars"),
    Rule("repeats", "100 * n_repeat_words > 15 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 2"),
    Rule("vocabulary", "n_words >= 20 and 100 * n_distinct_words < 30 * n_words", "100 * n_distinct_words >= 50 * n_words"),
    Rule("word_length", "word_chars > 9 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 8 * n_words"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    Rule("case", "400 * n_capitals < word_chars", "200 * n_capitals between word_chars and 20 * word_chars"),
    Rule("length", "n_words < 20", "n_words >= 50"),
)
#: A document below these fails whatever the rules say; the others are what the rules are weighed on.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
MIN_POSTERIOR = 0.5
ITERATIONS = 20
#: Where the share of good documents starts, and as how many documents of each kind the start keeps counting.
PRIOR_GOOD, PRIOR_WEIGHT = 0.9, 10.0
#: How often a rule votes bad and good, on good and on bad documents, at the start.
START = (0.01, 0.9, 0.4, 0.5)

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct_words"]
_WINDOW = 5


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words in five-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Only texts that have a repeated window sort them with their places.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), (n_words - _WINDOW).cast("int"))

    def windows(h: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(_WINDOW)]))

    def covered(placed: Column) -> Column:
        last = F.size(placed) - 1
        twice = F.filter(placed, lambda x, k: (
            ((k > 0) & (F.get(placed, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
            | ((k < last) & (F.get(placed, F.least(k + 1, last))["h"] == x["h"]))))
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
            lambda s, i: F.struct((i + _WINDOW).alias("end"), (s["n"] + (i + _WINDOW) - F.greatest(i, s["end"])).alias("n")))["n"]

    def counted(v: Column) -> Column:
        placed = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) < F.size(v), _with(placed, covered)).otherwise(F.lit(0).cast("bigint"))

    return F.when(n_words >= _WINDOW, _with(_with(hashes, windows), counted)).otherwise(F.lit(0).cast("bigint"))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FEATURES``, all bigint; a null text counts as empty.

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
    n_dup_lines: lines with a word that equal an earlier line. Characters are code points.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blank = text
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\x09-\\x0D]", " ")) != "")
    base = docs.withColumns({"_words": words, "_lines": lines, "_packed": F.replace(blank, F.lit(" "), F.lit(""))})
    n_words = F.size("_words").cast("bigint")
    return base.withColumns({
        "n_words": n_words, "word_chars": F.length("_packed").cast("bigint"),
        "n_symbols": (F.length("_packed") - F.length(F.regexp_replace("_packed", "[#*$%&|<>]", ""))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": _repeat_words(F.col("_words"), n_words), "n_lines": F.size("_lines").cast("bigint"),
        "n_capitals": (F.length("_packed") - F.length(F.regexp_replace("_packed", "[A-Z]", ""))).cast("bigint"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("bigint"),
    }).drop("_words", "_lines", "_packed")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One column per rule: -1 bad, 0 abstains, 1 good."""
    return [F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END").alias(f"vote_{r.name}") for r in rules]


@dataclass
class VoteModel:
    """Share of good documents, and for each rule how often it votes (bad, good) on good and (bad, good) on bad documents."""

    good: float
    rates: list[tuple[float, float, float, float]]

    def weights(self) -> list[tuple[float, float, float]]:
        """What a bad vote, an abstention and a good vote of each rule add to the log odds; no vote speaks against what it says."""
        return [(min(0.0, math.log(bg) - math.log(bb)), math.log(1 - bg - gg) - math.log(1 - bb - gb), max(0.0, math.log(gg) - math.log(gb)))
                for bg, gg, bb, gb in self.rates]

    def accuracy(self) -> list[tuple[float, float]]:
        """Share of right votes among those cast, on good and on bad documents."""
        return [(gg / (bg + gg), bb / (bb + gb)) for bg, gg, bb, gb in self.rates]

    def log_odds(self, names: list[str]) -> Column:
        """Logarithm of good to bad; rules are taken as independent within each kind of document.

        The weights are one array, which is data to the generated code: it is compiled once for all steps.
        """
        flat = [w for three in self.weights() for w in three] + [math.log(self.good) - math.log(1 - self.good)]
        table = F.array(*[F.lit(w) for w in flat])
        total = F.get(table, F.lit(len(flat) - 1))
        for i, name in enumerate(names):
            total = total + F.get(table, F.col(name) + F.lit(3 * i + 1))
        return total

    def posterior(self, names: list[str]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(names)))


def fit_votes(patterns: DataFrame, names: list[str], iterations: int = ITERATIONS) -> VoteModel:
    """Expectation maximisation over vote patterns (``names`` and ``n``, the documents with that pattern).

    There are at most 3 to the number of rules patterns whatever the number of documents; a step sums over them and
    brings three rows a rule to the driver. The start counts as ``PRIOR_WEIGHT`` documents; without documents it is the result.
    """
    model = VoteModel(PRIOR_GOOD, [START] * len(names))
    for _ in range(iterations):
        cast = patterns.select((model.posterior(names) * F.col("n")).alias("_g"), "n", F.posexplode(F.array(*names)).alias("rule", "vote"))
        sums = {(r["rule"], r["vote"]): (r["g"], r["n"]) for r in cast.groupBy("rule", "vote").agg(F.sum("_g").alias("g"), F.sum("n").alias("n")).collect()}
        seen = [[sums.get((i, v), (0.0, 0)) for v in (-1, 0, 1)] for i in range(len(names))]  # three votes a rule
        good, n = (float(sum(x[k] for x in seen[0])) for k in (0, 1))
        rates = []
        for bad_vote, _, good_vote in seen:
            each = (bad_vote[0], good_vote[0], bad_vote[1] - bad_vote[0], good_vote[1] - good_vote[0])
            rates.append(tuple((x + s * PRIOR_WEIGHT) / (w + PRIOR_WEIGHT) for x, s, w in zip(each, START, (good, good, n - good, n - good))))
        model = VoteModel((good + PRIOR_GOOD * PRIOR_WEIGHT) / (n + PRIOR_WEIGHT), rates)
    return model


def judged(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
           iterations: int = ITERATIONS) -> DataFrame:
    """``docs`` (all columns, or those named) with features, votes, ``base_failed``, ``posterior`` and ``kept``.

    Texts are read once: features and the wanted columns are written, the rules vote on the features, expectation
    maximisation over all documents that pass the base conditions estimates how often each rule is right, and a document
    is kept when it passes them and its posterior probability of being good is at least ``MIN_POSTERIOR``; no single vote
    decides. Nulls in other columns do not matter; a null or empty text has no words and fails; a text is read whole
    however long, and its words are held in memory at once; ties of votes are settled by their weights; repeated rows are
    judged alike; an empty table gives an empty result. Columns of ``docs`` that clash with result names are replaced;
    any other name may be used.
    """
    names = [f"vote_{r.name}" for r in rules]
    made = {*FEATURES, *names, "base_failed", "posterior", "kept"}
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in made]
    given = [f"_c{i}" for i in range(len(wanted))]
    with staging(docs.sparkSession):
        slim = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(wanted, given)], F.col(f"`{text_col}`").alias("_text"))
        seen = keep(stage(with_features(slim, "_text").drop("_text"), "features"))
        patterns = stage(seen.where(f"not ({BASE_FAILED})").select(*votes(rules)).groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns")
        model = fit_votes(patterns, names, iterations)
    scored = seen.select("*", *votes(rules)).withColumns({"base_failed": F.expr(BASE_FAILED), "posterior": model.posterior(names)})
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR))
    results = [c for c in scored.columns if c not in given]
    return scored.select(*given, *results).toDF(*wanted, *results)
