"""Operator 9: soft-membership mixing to target domain weights.

A softmax classifier over hashed words, fitted on a bounded sample of the labelled rows
(``SAMPLE`` documents by smallest id hash, the documented bound), gives every document its domain
posteriors. Nonnegative document rates r are then fitted by projected-gradient least squares on
|sum_i r_i t_i p_i / T - goal|^2: every rate starts at 1 and a step is r_i = max(0, r_i - step * s_i * gap . p_i),
with one aggregation of the domain totals a step. s_i = sum_k p_ik^2 / sum_j t_j p_jk^2 is a fixed scale of the
document's own, so that a document of a rare domain moves as fast as its domain needs; a positive scale by row
leaves the projection and the minimum as they are. The step is the inverse of the largest eigenvalue of the
scaled domain matrix, so the objective falls in every step; every ``WRITE_EVERY`` steps the rates are written.
Targets that no rates can meet (a domain of which no document is sure enough) are approached for ``STEPS`` steps
and the gap left is warned of. ``max_rate`` bounds the rates where it is given (projection on [0, max_rate]); without it a rare
domain is repeated as often as its target asks. A target of None leaves its domain free. Copies are
floor(rate + u) with u uniform from the id's hash, so expected totals match the targets.

Domains from the labels table: clean (quality 1, not toxic), low (quality 0, not toxic), toxic.
Defined cases: null or empty text has no tokens, its prior as posterior and rate as others; rows
repeating a doc_id get the same copies; labels with nulls are skipped, repeated labels count by row;
with no usable labels all posteriors are equal; an empty table gives no rows; other columns
are never read by the fit and pass through ``mix``.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

DOMAINS = ("clean", "low", "toxic")
TARGETS = (0.90, 0.08, 0.02)
SAMPLE, BUCKETS, GROWTH = 4000, 4096, 1.05
STEPS, WRITE_EVERY = 150, 10  # gradient steps at most; steps after which the rates are written
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = ".,;:!?()[]\"'"
_N_SHAPE = 4


class TargetsMissed(UserWarning):
    """No rates bring the domains to their targets within the tolerance."""


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted distinct hashed word features, shape ratios, number of words)."""
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, np.int64), np.zeros(_N_SHAPE), 0
    ids = np.unique(np.fromiter((zlib.crc32(w.strip(_STRIP).lower().encode("utf-8", "surrogatepass")) % BUCKETS
                                 for w in set(words)), dtype=np.int64))
    n = len(text)
    shape = np.array([sum(map(str.isupper, words)) / len(words), sum(text.count(c) for c in "#*$%&|<>") / len(words),
                      sum(text.count(c) for c in "!?") / len(words), n / len(words) / 10])
    return ids, np.minimum(shape, 5.0), len(words)


class Softmax:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 150, l2: float = 1e-4):
        self.w = np.zeros((BUCKETS + _N_SHAPE, len(DOMAINS)), dtype=np.float64)
        self.b = np.zeros(len(DOMAINS))
        if not len(y):
            return
        x = np.zeros((len(rows), BUCKETS + _N_SHAPE), dtype=np.float32)
        for i, (ids, shape) in enumerate(rows):
            x[i, ids] = 1.0
            x[i, BUCKETS:] = shape
        onehot = np.eye(len(DOMAINS))[y]
        m = np.zeros_like(self.w)
        v = np.zeros_like(self.w)
        for step in range(1, steps + 1):
            z = x @ self.w.astype(np.float32) + self.b
            err = self._soft(z) - onehot
            g = x.T @ err.astype(np.float32) / len(y) + l2 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.b -= 0.5 * err.mean(0)

    @staticmethod
    def _soft(z):
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def posterior(self, ids: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return self._soft(self.w[ids].sum(0) + shape @ self.w[BUCKETS:] + self.b)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Features and domains of at most ``sample`` labelled documents, smallest id hash first."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", domain.alias("domain"), F.xxhash64("doc_id").alias("h"))
    def feats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fs = [featurise(t) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "domain": pdf["domain"], "ids": [f[0].astype("int32") for f in fs], "shape": [f[1] for f in fs]})

    small = ids.orderBy("h", "domain").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    rows = got.mapInPandas(feats, "h long, domain int, ids array<int>, shape array<double>").orderBy("h", "domain").collect()
    return [(np.array(r["ids"], dtype=np.int64), np.array(r["shape"])) for r in rows], np.array([r["domain"] for r in rows], dtype=int)


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """doc_id, _row (hash of id and text), tokens, p_<domain> of every row."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, row, text in zip(pdf["doc_id"], pdf["_row"], pdf["text"]):
                ids, shape, n = featurise(text)
                rows.append((doc_id, row, n, *model.posterior(ids, shape)))
            yield pd.DataFrame(rows, columns=["doc_id", "_row", "tokens", *(f"p_{d}" for d in DOMAINS)]).astype({"doc_id": "Int64"})

    schema = "doc_id long, _row long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), "text").mapInPandas(score, schema)


class Rates(NamedTuple):
    """The fitted rates: what a document's posteriors are worth, step by step."""
    weights: tuple[float, ...]  # s_i = sum_k weights_k p_ik^2
    gradients: tuple[tuple[float, ...], ...]  # step * gap of every step taken
    max_rate: float | None = None


def _rate(rates: Rates, start=None, done: int = 0):
    """A row's rate: from 1 (or from ``start``, the rate after ``done`` steps) through its steps, each projected on
    the rates that are allowed. The steps are one literal that is folded, so the expression keeps its size."""
    start = F.lit(1.0) if start is None else start
    steps = rates.gradients[done:]
    if not steps:
        return start
    p = [F.col(f"p_{d}") for d in DOMAINS]
    scale = sum((F.lit(w) * x * x for w, x in zip(rates.weights, p)), F.lit(0.0))

    def move(rate, g):
        at = F.greatest(F.lit(0.0), rate - scale * sum((g[i] * x for i, x in enumerate(p)), F.lit(0.0)))
        return at if rates.max_rate is None else F.least(F.lit(float(rates.max_rate)), at)

    return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in steps]), start, move)


def solve_rates(soft: DataFrame, targets=TARGETS, growth: float = GROWTH, tolerance: float = 1e-4,
                max_rate: float | None = None) -> Rates:
    """The rates' steps; ``soft`` must be a written table. Ends when every gap is below ``tolerance`` (a share of
    the tokens), or when a step moves no total by a hundredth of it or ``STEPS`` are taken (``TargetsMissed``)."""
    if max_rate is not None and max_rate < 1:
        raise ValueError("max_rate must be at least 1, where the rates start")
    k = len(DOMAINS)
    free = np.array([t is None for t in targets])
    goal = growth * np.array([t or 0.0 for t in targets])
    p, t = [F.col(f"p_{d}") for d in DOMAINS], F.col("tokens")
    first = soft.agg(F.sum(t), *[F.sum(t * x * x) for x in p]).first()
    total = float(first[0] or 0)
    if not total:
        return Rates((0.0,) * k, (), max_rate)
    square = np.array(first[1:], dtype=float) / total
    weights = tuple(float(1 / q) if q > 0 and not f else 0.0 for q, f in zip(square, free))
    scale = sum((F.lit(w) * x * x for w, x in zip(weights, p)), F.lit(0.0))
    upper = soft.withColumn("_s", scale).agg(*[F.sum(F.col("_s") * t * p[i] * p[j]) for i in range(k) for j in range(i, k)]).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = np.array(upper, dtype=float) / total
    gram = gram + np.triu(gram, 1).T
    gram[free, :] = gram[:, free] = 0.0
    top = float(np.linalg.eigvalsh(gram)[-1])
    step = 1 / top if top > 0 else 0.0

    rates, last, done = Rates(weights, (), max_rate), None, 0
    state = soft.select("tokens", *p, F.lit(1.0).alias("_r"))
    while True:
        if len(rates.gradients) - done == WRITE_EVERY:
            state = materialise(state.withColumn("_r", _rate(rates, F.col("_r"), done)), "rates")
            done = len(rates.gradients)
        share = np.array(state.withColumn("_r", _rate(rates, F.col("_r"), done)).agg(
            *[F.sum(F.col("_r") * t * x) for x in p]).first(), dtype=float) / total
        gap = np.where(free, 0.0, share - goal)
        if np.abs(gap).max() < tolerance:
            return rates
        if len(rates.gradients) == STEPS or (last is not None and np.abs(gap - last).max() < tolerance / 100):
            break
        last = gap
        rates = rates._replace(gradients=(*rates.gradients, tuple(float(step * g) for g in gap)))
    warnings.warn(TargetsMissed("token shares by document token that rates leave over (+) or short (-) of the goal: " + ", ".join(
        f"{d} {g:+.6f} of {x:.6f}" for d, g, x, f in zip(DOMAINS, gap, goal, free) if not f)), stacklevel=2)
    return rates


def _rates(docs: DataFrame, labels: DataFrame, targets, sample: int, max_rate: float | None) -> DataFrame:
    model = Softmax(*labelled_sample(docs, labels, sample))
    soft = materialise(posteriors(docs, model), "soft")
    rates = solve_rates(soft, targets, max_rate=max_rate)
    u = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return soft.withColumn("rate", _rate(rates)).withColumn("n_copies", F.floor(F.col("rate") + u).cast("long"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets=TARGETS, sample: int = SAMPLE,
                 max_rate: float | None = None) -> DataFrame:
    """doc_id, tokens, posteriors, rate, n_copies."""
    return _rates(docs, labels, targets, sample, max_rate).drop("_row")


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS, sample: int = SAMPLE,
        max_rate: float | None = None) -> DataFrame:
    """The rows, each repeated n_copies times by its own text's rate; columns as they came."""
    rates = _rates(docs, labels, targets, sample, max_rate).where("n_copies > 0").select(
        F.col("_row").alias("_key"), F.col("n_copies").alias("_copies")).dropDuplicates(["_key"])
    row = docs.select(F.struct(*docs.columns).alias("_all"), F.xxhash64("doc_id", "text").alias("_key"))
    joined = row.join(rates, "_key").select("_all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return joined.select("_all.*")
