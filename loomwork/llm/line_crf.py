"""Document quality from a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.training import held_out, training_rows
from loomwork.llm.words import BLANK_WORDS, Block, blocks, hash_pieces, words

#: Most labelled documents that a model is fitted on.
MAX_TRAINING_ROWS = 8000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
THRESHOLD = 0.3

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_CLOSE = np.isin(np.arange(256), list(b".!?\":;)"))
#: Features that a line also takes from the line before and the line after.
_NEIGHBOUR = slice(1, 9)
_OWN = 13
WIDTH = _OWN + 2 * 8 + 2


@dataclass
class Lines:
    """Lines of a block: features, words per line, and the first line of each row (one entry more)."""

    x: np.ndarray
    weight: np.ndarray
    offsets: np.ndarray


def line_features(block: Block) -> Lines:
    """Features of every line that has a word; lines are separated by a line feed."""
    w = words(block, BLANK_WORDS)
    empty = np.zeros((0, WIDTH))
    if not len(w.hash):
        return Lines(empty, np.zeros(0), np.zeros(len(block) + 1, np.int64))
    feeds = np.cumsum(block.data == 10)
    line = feeds[w.start]
    first = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(w.row, prepend=-1) != 0))
    n = np.diff(np.append(first, len(line)))
    row = w.row[first]
    offsets = np.searchsorted(row, np.arange(len(block) + 1))
    length = w.end - w.start

    def per_word(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[block.data])])
        return sums[w.end] - sums[w.start]

    def per_line(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first).astype(float)

    letters, chars = per_line(per_word(_LETTER)), per_line(length)
    same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])])
    index = np.repeat(np.arange(len(first)), n)
    order = np.lexsort((w.hash, index))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (index[order][1:] != index[order][:-1])
    distinct = np.bincount(index[order], fresh, len(first))
    last = w.end[first + n - 1] - 1
    content = np.add.reduceat(w.hash * (np.arange(len(w.hash), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64) + np.uint64(3)), first)
    seen = pd.DataFrame({"r": row, "c": content.view(np.int64)}).duplicated().to_numpy()
    own = np.column_stack([
        np.ones(len(first)), np.minimum(per_line(per_word(_SYMBOLS)) / n, 2), np.minimum(per_line(per_word(np.arange(256) == 124)) / n, 1),
        per_line(per_word(_UPPER)) / np.maximum(letters, 1), np.minimum(per_line(per_word(np.arange(256) == 33)) / n, 2), per_line(same) / n,
        1 - distinct / n, per_line(per_word(_DIGIT)) / chars, np.minimum(chars / n / 10, 2),
        np.log1p(n) / 6, _CLOSE[block.data[last]], seen, 1 - letters / chars])
    x = np.zeros((len(first), WIDTH))
    x[:, :_OWN] = own
    joined = np.flatnonzero(row[1:] == row[:-1])
    x[joined + 1, _OWN:_OWN + 8] = own[joined, _NEIGHBOUR]
    x[joined, _OWN + 8:_OWN + 16] = own[joined + 1, _NEIGHBOUR]
    x[joined + 1, -2] = 1
    x[joined, -1] = 1
    return Lines(x, n.astype(float), offsets)


@dataclass
class Crf:
    """Weights of a good against a bad line, weights of neighbouring labels, and the link from text share to probability."""

    w: np.ndarray
    t: np.ndarray
    a: float = 0.0
    b: float = 1.0

    def flat(self) -> list[float]:
        return [*self.w, *self.t.ravel(), self.a, self.b]

    @staticmethod
    def of(values) -> Crf:
        v = np.asarray(values, float)
        return Crf(v[:WIDTH], v[WIDTH:WIDTH + 4].reshape(2, 2), v[-2], v[-1])


def _groups(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of similar numbers of lines together: rows, line numbers (padded), and which of them exist."""
    n = np.diff(offsets)
    for size in np.unique(np.ceil(np.log2(np.maximum(n, 1)))):
        rows = np.flatnonzero((n > 0) & (np.ceil(np.log2(np.maximum(n, 1))) == size))
        if len(rows):
            at = np.arange(n[rows].max())
            inside = at < n[rows][:, None]
            yield rows, np.where(inside, offsets[rows][:, None] + at, 0), inside


def _forward_backward(u: np.ndarray, inside: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good per line, and expected counts of neighbouring labels per row; ``u`` scores good against bad."""
    rows, width = u.shape
    step = np.exp(t - t.max())
    psi = np.stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))], axis=2)
    alpha, beta = np.zeros((rows, width, 2)), np.ones((rows, width, 2))
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for i in range(1, width):
        a = (alpha[:, i - 1] @ step) * psi[:, i]
        alpha[:, i] = np.where(inside[:, i, None], a / a.sum(1, keepdims=True), alpha[:, i - 1])
    for i in range(width - 2, -1, -1):
        b = (beta[:, i + 1] * psi[:, i + 1]) @ step.T
        beta[:, i] = np.where(inside[:, i + 1, None], b / b.sum(1, keepdims=True), 1.0)
    both = alpha * beta
    marginal = both[:, :, 1] / both.sum(2)
    pair = alpha[:, :-1, :, None] * step * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair = pair / np.maximum(pair.sum((2, 3), keepdims=True), 1e-300) * inside[:, 1:, None, None]
    return marginal, pair.sum(1)


def text_share(lines: Lines, model: Crf) -> np.ndarray:
    """Length-weighted mean of the good marginals of each row; one half for a row without words."""
    share = np.full(len(lines.offsets) - 1, 0.5)
    u = lines.x @ model.w
    for rows, at, inside in _groups(lines.offsets):
        p, _ = _forward_backward(u[at], inside, model.t)
        weight = lines.weight[at] * inside
        share[rows] = (p * weight).sum(1) / weight.sum(1)
    return share


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_crf(lines: Lines, label: np.ndarray) -> Crf:
    """Maximum likelihood with a ridge; every line carries the label of its document, every document counts once."""
    model = Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    n = np.maximum(np.diff(lines.offsets), 1)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    groups = list(_groups(lines.offsets))
    for step in range(1, STEPS + 1):
        model.w, model.t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        u = lines.x @ model.w
        grad = -RIDGE * theta * len(label)
        for rows, at, inside in groups:
            p, pair = _forward_backward(u[at], inside, model.t)
            y = label[rows]
            gap = (y[:, None] - p) * inside / n[rows][:, None]
            grad[:WIDTH] += np.einsum("rl,rlf->f", gap, lines.x[at] * inside[:, :, None])
            seen = np.zeros_like(pair)
            seen[np.arange(len(rows)), y, y] = n[rows] - 1
            grad[WIDTH:] += ((seen - pair) / n[rows][:, None, None]).sum(0).ravel()
        grad /= max(1, len(label))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.w, model.t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    z = _logit(text_share(lines, model))
    coef = np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(coef[0] + coef[1] * z)))
        design = np.column_stack([np.ones_like(z), z])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * len(label) * np.eye(2) / 10
        coef = coef + np.linalg.solve(curve, design.T @ (label - p) - 1e-4 * len(label) * (coef - [0, 1]))
    model.a, model.b = float(coef[0]), float(coef[1])
    return model


def _one_block(texts: pd.Series) -> Block:
    return next(blocks(pa.array(texts, pa.string()), limit=1 << 62))


def _fit_part(rows: pd.DataFrame) -> pd.DataFrame:
    model = fit_crf(line_features(_one_block(rows["text"])), rows["label"].to_numpy(np.int64))
    return pd.DataFrame({"n": [len(rows)], "values": [model.flat()]})


def fit_line_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                     max_rows: int = MAX_TRAINING_ROWS) -> Crf:
    """Field fitted on at most ``max_rows`` labelled documents: eight parts are fitted apart and averaged by size.

    Rows whose key is held out are not used. Without labelled rows the field is indifferent: every text gets one half.
    """
    parts = training_rows(docs, labels, id_col, text_col, label_col, max_rows).where("label in (0, 1)").groupBy("part").applyInPandas(
        _fit_part, "n bigint, values array<double>").collect()
    if not parts:
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    return Crf.of(np.average([p["values"] for p in parts], axis=0, weights=[p["n"] for p in parts]))


def _score(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                z = _logit(text_share(line_features(block), model))
                score = 1 / (1 + np.exp(-(model.a + model.b * z)))
                rest = batch.slice(block.first, len(block)).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*batch.schema.names[1:], "_score"])

    return run


def line_quality(docs: DataFrame, model: Crf, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those named) with ``score``, the probability that the text is good, and ``predicted``.

    Marginals of a line being good come from the forward-backward pass over the whole text; their mean, weighted by
    words, passes the calibrated link. Nulls and texts without words score like an undecided text; repeated rows score
    alike; an empty table gives an empty result; columns that clash with the result names are replaced.
    """
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in ("score", "predicted")]
    plain = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(wanted)])
    schema = plain.drop("_text").schema.add("_score", "double")
    return plain.mapInArrow(_score(model), schema).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(wanted)], F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out_column(id_col: str = "doc_id"):
    return held_out(F.col(id_col)).alias("held_out")
