"""Parameter search that learns from earlier trials.

``adaptive_search`` proposes parameters where good trials are dense and bad ones are not. ``halving_search`` starts many trials
on a small part of the rows and lets the best go on with more of them; the parts are cut by the hash of the row key, so
every part holds the smaller ones and does not depend on the partitioning.
"""

from __future__ import annotations

import json
import math
import random
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import key_bucket
from loomwork.operators.tune import SPACES, draw_params, grid_search, random_search, scorer

#: Share of the finished trials that counts as good, and candidates a proposal is chosen from.
GOOD_SHARE, CANDIDATES = 0.25, 32
#: Shares of the rows that trials see one after the other, and the share of trials that goes on.
RUNGS, SURVIVORS = (1 / 9, 1 / 3, 1.0), 1 / 3
#: Seed of the parts; it differs from that of the folds, or a part would lie in few folds.
PART_SEED = 43


class _Density:
    """How dense a group of trials is around a value of one parameter, with one trial's weight spread over the whole range."""

    def __init__(self, values, seen: list):
        self.values, self.seen = values, seen
        if isinstance(values, tuple):
            self.low, self.high = float(values[0]), float(values[1])
            self.width = max((self.high - self.low) / max(2.0, math.sqrt(len(seen) + 1) * 2), 1e-12)
        else:
            self.weights = [1 + seen.count(v) for v in values]

    def at(self, value) -> float:
        if not isinstance(self.values, tuple):
            return self.weights[self.values.index(value)] / sum(self.weights)
        bumps = sum(math.exp(-((float(value) - float(s)) / self.width) ** 2 / 2) / (self.width * math.sqrt(2 * math.pi)) for s in self.seen)
        return (bumps + 1 / max(self.high - self.low, 1e-12)) / (len(self.seen) + 1)

    def draw(self, rng: random.Random):
        if not isinstance(self.values, tuple):
            return rng.choices(self.values, self.weights)[0]
        at = rng.randrange(len(self.seen) + 1)
        value = rng.uniform(self.low, self.high) if at == len(self.seen) else min(max(rng.gauss(float(self.seen[at]), self.width), self.low), self.high)
        return round(value) if all(isinstance(v, int) for v in self.values) else value


def _text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def propose(space: dict, finished: list[tuple[dict, float]], taken: list[dict], rng: random.Random, larger: bool = True) -> dict | None:
    """New parameters for which the density of good trials is largest against that of the others.

    ``taken`` are parameters that are not proposed again. None when all candidates are taken, as in a space that is used up.
    """
    ranked = sorted(finished, key=lambda t: -t[1] if larger else t[1])
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good = {n: _Density(v, [p[n] for p, _ in ranked[:cut]]) for n, v in space.items()}
    rest = {n: _Density(v, [p[n] for p, _ in ranked[cut:]]) for n, v in space.items()}
    used, best, most = {_text(p) for p in taken}, None, -math.inf
    for _ in range(CANDIDATES):
        params = {n: d.draw(rng) for n, d in good.items()}
        ratio = sum(math.log(good[n].at(v)) - math.log(rest[n].at(v)) for n, v in params.items())
        if ratio > most and _text(params) not in used:
            best, most = params, ratio
    return best


def adaptive_search(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, n: int = 10, seed: int = 42,
                    space: dict | None = None, start: int | None = None, parallelism: int = 4, **options) -> DataFrame:
    """(trial, params, score, best, proposed): ``start`` random trials (a third of ``n``, two at least), then rounds of proposals.

    The trials of a round run together and do not know each other's scores. Fewer than ``n`` trials when the space has no more.
    """
    space, rng = space or SPACES[kind][name], random.Random(seed)
    score, larger = scorer(kind, name, train, valid, **options)
    trials = draw_params(space, min(n, start or max(2, n // 3)), seed)
    first, scores, at = len(trials), [], 0
    with ThreadPool(max(1, parallelism)) as pool:
        while True:
            scores += pool.map(score, trials[at:])
            at = len(trials)
            finished = list(zip(trials, scores))
            while len(trials) < min(n, at + parallelism):
                params = propose(space, finished, trials, rng, larger) or _untried(space, trials, seed)
                if params is None:
                    break
                trials.append(params)
            if len(trials) == at:
                break
    best = (max if larger else min)(range(len(trials)), key=lambda i: scores[i]) if trials else -1
    rows = [(i, _text(p), scores[i], i == best, i >= first) for i, p in enumerate(trials)]
    return train.sparkSession.createDataFrame(rows, "trial int, params string, score double, best boolean, proposed boolean")


def _untried(space: dict, trials: list[dict], seed: int) -> dict | None:
    used = {_text(p) for p in trials}
    return next((p for p in draw_params(space, len(trials) + 1, seed) if _text(p) not in used), None)


def rung_rows(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The part of the rows whose key hash is below ``share``; larger shares hold the smaller ones."""
    return df if share >= 1 else df.where(key_bucket([F.col(k) for k in keys], PART_SEED) < share)


def halving_search(kind: str, name: str, train: DataFrame, valid: DataFrame | None = None, *, keys: list[str], n: int = 9, seed: int = 42,
                   space: dict | None = None, rungs: tuple[float, ...] = RUNGS, survivors: float = SURVIVORS, parallelism: int = 4,
                   **options) -> DataFrame:
    """(rung, share, rows, trial, params, score, kept, best): a row per trial and rung it reached.

    On every rung the trials are fitted on the rung's part of the training rows and judged on all held-out rows; the best
    ``survivors`` of them, one at least, go on, the earlier trial where scores are equal. The last rung has all rows and decides.
    """
    if list(rungs) != sorted(set(rungs)) or rungs[-1] < 1 or rungs[0] <= 0:
        raise ValueError("rungs are rising shares that end with 1")
    score, larger = scorer(kind, name, train, valid, keys=keys, **options)
    trials = draw_params(space or SPACES[kind][name], n, seed)
    bucket = key_bucket([F.col(k) for k in keys], PART_SEED)
    sizes = train.agg(*[F.count_if((bucket < share) | F.lit(share >= 1)).alias(f"r{i}") for i, share in enumerate(rungs)]).first()
    alive, rows = list(range(len(trials))), []
    with ThreadPool(max(1, parallelism)) as pool:
        for i, share in enumerate(rungs):
            scores = pool.map(lambda t: score(trials[t], lambda df: rung_rows(df, keys, share)), alive)
            order = sorted(zip(alive, scores), key=lambda t: (-t[1] if larger else t[1], t[0]))
            stay = [t for t, _ in order[:max(1, math.ceil(survivors * len(order)))]] if i < len(rungs) - 1 else [t for t, _ in order[:1]]
            rows += [(i, float(share), sizes[i], t, _text(trials[t]), s, t in stay, i == len(rungs) - 1 and t in stay) for t, s in zip(alive, scores)]
            alive = sorted(stay)
    return train.sparkSession.createDataFrame(rows, "rung int, share double, rows bigint, trial int, params string, score double, kept boolean, best boolean")


#: Searches by the name that a run's ``tune`` setting gives.
SEARCHES = {"random": random_search, "grid": grid_search, "adaptive": adaptive_search, "halving": halving_search}
