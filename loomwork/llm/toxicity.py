"""Toxicity grades from a cumulative-link ordinal regression over words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.training import held_out, training_rows
from loomwork.llm.words import PLAIN_WORDS, Block, blocks, int_lists, mix, prefix_hashes, signed, words
from loomwork.session import stage, staging

#: Most labelled documents that a model is fitted on.
MAX_TRAINING_ROWS = 16000
#: Beside whole words, their beginnings of these many characters are pieces, so that forms and compounds of a stem add up.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A piece is a feature for each of these numbers of its places in a text that the text reaches.
LEVELS = (1, 2, 4)
GRADES = 3
#: A feature takes part if chance would give its share among toxic training rows with a probability below exp(-16)
#: (Chernoff bound): 8 rows, all toxic, at a base rate of 0.11, whatever the number of training rows.
MIN_EVIDENCE = 16.0
#: Toxic training rows with at least this many distinct words that hold a piece which speaks for toxicity are of the upper grade.
SEVERE_WORDS = 3
#: Bytes of texts whose feature counts are summed before they travel.
COUNT_BYTES = 1 << 21
STEPS, RATE, RIDGE = 300, 0.05, 1e-4


def pieces(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, row and hash of every piece of every word of every text: the word itself and its beginnings."""
    block = block.lower()
    w = words(block, PLAIN_WORDS)
    found = [(np.arange(len(w.hash)), w.hash), *[prefix_hashes(block, w, n) for n in PREFIXES]]
    at = np.concatenate([x for x, _ in found])
    return at, w.row[at], np.concatenate([mix(h + np.uint64(i)) for i, (_, h) in enumerate(found)])


def _reached(row: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece and level of every feature, from the row and piece of every place."""
    if not len(row):
        return row, piece, np.zeros(0, np.int8)
    order = np.lexsort((piece, row))
    row, piece = row[order], piece[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])))
    times = np.diff(first, append=len(row))
    each = [first[times >= n] for n in LEVELS]
    at = np.concatenate(each)
    return row[at], piece[at], np.repeat(np.arange(len(LEVELS), dtype=np.int8), [len(x) for x in each])


@dataclass
class OrdinalModel:
    """Weights of the levels of pieces (in order of their hash), shared by all thresholds, and the ordered thresholds between grades."""

    pieces: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def value(self, block: Block) -> np.ndarray:
        """Sum of the weights of the features of every text."""
        _, row, piece = pieces(block)
        hit, column = _places(self.pieces, piece)
        cell, times = np.unique(row[hit] * max(1, len(self.pieces)) + column, return_counts=True)
        row, column = np.divmod(cell, max(1, len(self.pieces)))
        return sum((np.bincount(row, np.where(times >= n, self.weights[column, k], 0.0), len(block)) for k, n in enumerate(LEVELS)), np.zeros(len(block)))

    def at_least(self, value: np.ndarray) -> np.ndarray:
        """Probability of each grade above 0 or more: logistic of value minus threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - value[:, None], -500, 500)))


def _places(known: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``piece`` are in ``known`` (sorted), and where there. A bit table leaves most others out beforehand."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(44)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(piece >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, piece[hit]), max(0, len(known) - 1))
    same = known[at] == piece[hit] if len(known) else np.zeros(0, bool)
    return hit[same], at[same]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> rows and toxic rows of every feature, summed over a block."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(0), limit=COUNT_BYTES):
            _, row, piece = pieces(block)
            row, piece, level = _reached(row, piece)
            order = np.lexsort((level, piece))
            row, piece, level = row[order], piece[order], level[order]
            if not len(row):
                continue
            first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (level[1:] != level[:-1])))
            toxic = np.add.reduceat(label[block.first + row].astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(piece[first])), pa.array(level[first]), pa.array(np.diff(first, append=len(row)).astype(np.int64)), pa.array(toxic)],
                names=["piece", "level", "n", "t"])


def indicators(rows: DataFrame) -> pd.DataFrame:
    """(piece, level, toxic_side) of the features whose share among toxic rows of (text, label) stands out, counted over all rows at once."""
    base = rows.agg(F.avg("label")).first()[0]
    if base is None or not 0 < base < 1:
        return pd.DataFrame({"piece": np.zeros(0, np.int64), "level": np.zeros(0, np.int8), "toxic_side": np.zeros(0, bool)})
    p, b = F.col("t") / F.col("n"), F.lit(float(base))

    def part(share, of):
        return F.when(share > 0, share * F.log(share / of)).otherwise(0.0)

    counts = rows.select("text", "label").mapInArrow(_counted, "piece bigint, level tinyint, n bigint, t bigint").groupBy("piece", "level").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t"))
    chosen = counts.where(F.col("n") * (part(p, b) + part(1 - p, 1 - b)) >= MIN_EVIDENCE).select("piece", "level", (p > b).alias("toxic_side"))
    return pd.DataFrame(chosen.collect(), columns=chosen.columns).astype({"piece": np.int64, "level": np.int8, "toxic_side": bool})


def _features(known: np.ndarray, strong: np.ndarray):
    """(label, text) -> label, places of the features of the text (piece times levels plus level), and how many distinct
    words hold a piece that speaks for toxicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                word, row, piece = pieces(block)
                hit, column = _places(known, piece)
                at, column, level = _reached(row[hit], column)
                order = np.argsort(at, kind="stable")
                feature = (column * len(LEVELS) + level)[order]
                speaks = np.unique(word[_places(strong, piece)[0]])  # the first pieces are the words, in order
                many = _distinct(row[speaks], piece[speaks], len(block))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), int_lists(feature.astype(np.int64), np.searchsorted(at[order], np.arange(len(block) + 1))), pa.array(many)],
                    names=["label", "features", "many"])

    return run


def _distinct(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Number of distinct values of each row."""
    return np.bincount(np.unique(np.stack([row.astype(np.uint64), value]), axis=1)[0].astype(np.int64), minlength=n_rows)


def fit_ordinal(row: np.ndarray, column: np.ndarray, n_w: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood with a ridge of P(grade >= k) = logistic(weights of the features - threshold k)."""
    share = np.array([(y >= k).mean() for k in range(1, GRADES)])
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    # the first threshold and the logarithms of the steps to the next ones keep the thresholds in order
    theta = np.concatenate([np.zeros(n_w), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        cuts = theta[n_w] + np.concatenate([[0], np.cumsum(np.exp(theta[n_w + 1:]))])
        value = np.bincount(row, theta[column], len(y))
        above = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(np.clip(cuts - value[:, None], -500, 500))), np.zeros(len(y))])
        at = np.arange(len(y))
        p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
        slope = above * (1 - above)
        by_value = (slope[at, y] - slope[at, y + 1]) / p
        by_cut = np.zeros(GRADES - 1)
        for k in range(1, GRADES):
            by_cut[k - 1] = (np.where(y == k, -slope[:, k], 0) + np.where(y == k - 1, slope[:, k], 0)).dot(1 / p)
        steps = [by_cut[k:].sum() * np.exp(theta[n_w + k]) for k in range(1, GRADES - 1)]
        grad = np.concatenate([np.bincount(column, by_value[row], n_w) - RIDGE * len(y) * theta[:n_w], [by_cut.sum()], steps]) / max(1, len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = theta[n_w] + np.concatenate([[0], np.cumsum(np.exp(theta[n_w + 1:]))])
    return theta[:n_w], cuts


def _fit(n_w: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        toxic = rows["label"].to_numpy(np.int64)
        y = toxic * (1 + (rows["many"].to_numpy() >= SEVERE_WORDS))
        sizes = rows["features"].map(len).to_numpy()
        column = np.concatenate([np.zeros(0, np.int64), *rows["features"]]).astype(np.int64)
        weights, cuts = fit_ordinal(np.repeat(np.arange(len(rows)), sizes), column, n_w, y)
        return pd.DataFrame({"weights": [weights.tolist()], "thresholds": [cuts.tolist()]})

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_rows: int = MAX_TRAINING_ROWS) -> OrdinalModel:
    """Model fitted on at most ``max_rows`` labelled documents (label 0 or 1).

    Features are chosen once over all of them; one task fits their weights, on the features of each document only. Rows
    whose key is held out are not used. Without labelled rows no text is toxic.
    """
    with staging(docs.sparkSession):
        rows = stage(training_rows(docs, labels, id_col, text_col, label_col, max_rows).where("label in (0, 1)").select("label", "text"), "training")
        chosen = indicators(rows)
        known = np.unique(chosen["piece"].to_numpy(np.int64).view(np.uint64))
        strong = np.unique(chosen["piece"][chosen["toxic_side"].to_numpy(bool)].to_numpy(np.int64).view(np.uint64))
        n_w = len(known) * len(LEVELS)
        fitted = rows.mapInArrow(_features(known, strong), "label int, features array<bigint>, many bigint").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
            _fit(n_w), "weights array<double>, thresholds array<double>").collect()
    if not fitted:
        return OrdinalModel(known, np.zeros((0, len(LEVELS))), np.arange(10.0, 10.0 + GRADES - 1))
    return OrdinalModel(known, np.array(fitted[0]["weights"]).reshape(-1, len(LEVELS)), np.array(fitted[0]["thresholds"]))


def _score(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                above = model.at_least(model.value(block))
                grade = (above >= 0.5).sum(axis=1)
                rest = batch.slice(block.first, len(block)).columns[1:]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array(grade.astype(np.int32))],
                    names=[*batch.schema.names[1:], "_severity", "_p", "_grade"])

    return run


def toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those named) with expected_severity, p_toxic, grade and toxic.

    The expected severity is the sum of the probabilities of grade 1 or more and grade 2 or more; ``toxic`` says that
    grade 1 or more is likelier than not. Every piece of the whole text counts, wherever it stands, by the
    levels that its number of places reaches. Null
    and empty texts have no words and keep the base rate; repeated rows score alike; an empty table gives an empty
    result; columns that clash with the result names are replaced.
    """
    made = ("expected_severity", "p_toxic", "grade", "toxic")
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in made]
    plain = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(wanted)])
    schema = plain.drop("_text").schema.add("_severity", "double").add("_p", "double").add("_grade", "integer")
    return plain.mapInArrow(_score(model), schema).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(wanted)], F.col("_severity").alias("expected_severity"), F.col("_p").alias("p_toxic"),
        F.col("_grade").alias("grade"), (F.col("_grade") > 0).alias("toxic"))


def held_out_column(id_col: str = "doc_id"):
    return held_out(F.col(id_col)).alias("held_out")
