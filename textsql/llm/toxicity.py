"""Operator 11: toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence is toxic with
``p = sigmoid(bias + weights of its distinct words and their stems)``, and the bag by noisy-or with a leak:
``P = 1 - (1 - leak) * product(1 - p)``. The leak is the chance of a label without any offending sentence
(label noise), so that long clean documents aren't pushed over the threshold by their length. All are
fitted to document labels alone by proximal gradient steps on the bags' log-likelihood; an L1 penalty leaves
few weights, and sentences with p of at least 0.5 are returned as offending, with offsets.

Fitting takes at most ``SAMPLE`` labelled documents (those of smallest text hash) and the words and stems that
at least ``MIN_DF`` of them hold; scoring takes every whole text. The sample is bounded by its rows; its sentences
leave the executors as word numbers.

Defined cases: a null or empty text has no sentence and scores the leak; null labels are ignored, and a
doc_id labelled more than once counts as toxic if any label says so; rows repeating a doc_id are scored
each by its own text; a null doc_id is scored, never learnt from and not held out; without any labelled
document (or with one class only) every score is the share of toxic ones, 0 without any; an empty
table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, MIN_DF, STEPS, RATE, L1 = 8000, 5, 200, 0.3, 1e-4
OFFENDING, STEM = 0.5, 5
SLICE = 1 << 19  # words that a gradient step holds at once
SCORES = "doc_id long, score double, sentences array<struct<start: int, end: int, score: double>>"
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\W\d_]+")


def features(sentence: str) -> set[str]:
    """Distinct words in lower case, and the stem (first ``STEM`` letters and ``~``) of each longer one."""
    words = set(_TOKEN.findall(sentence.lower()))
    return words | {w[:STEM] + "~" for w in words if len(w) > STEM}


@dataclass
class Model:
    bias: float = 0.0
    leak: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def sentence(self, text: str) -> float | None:
        """Probability of one sentence, None without a word."""
        found = features(text)
        return _sigmoid(self.bias + math.fsum(self.weights.get(f, 0.0) for f in found)) if found else None

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(document's probability, offending sentences as (start, end, p))."""
        clean, bad = math.log1p(-self.leak), []
        for m in _SENTENCE.finditer(text or ""):
            p = self.sentence(m.group())
            if p is not None:
                clean += math.log1p(-p)
                if p >= OFFENDING:
                    bad.append((m.start(), m.end(), p))
        return -math.expm1(clean), bad


def _sigmoid(z: float) -> float:
    """Kept below one, so that its complement has a logarithm."""
    return min(1 / (1 + math.exp(-z)) if z > -500 else 0.0, 1 - 1e-12)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``size`` documents that may be learnt from; texts aren't shuffled."""
    key = F.xxhash64("doc_id", "text").alias("h")
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = (docs.where(~held_out()).select("doc_id", key).join(known, "doc_id").select("h", "toxic")
             .dropDuplicates(["h"]).orderBy("h").limit(size))
    # at most ``size`` hashes go out; rows that repeat both id and text are one
    return docs.select(key, "text").join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("h", "text", "toxic")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.col("doc_id").isNull())


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Vocabulary and bags are made by Spark; the driver gets word numbers of the bounded sample."""
    from .common import materialise

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [[sorted(f) for s in _SENTENCE.findall(t or "") if (f := features(s))] for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "toxic": pdf["toxic"], "bag": bags})

    bags = materialise(labelled_sample(docs, labels, size).mapInPandas(
        split, "h long, toxic int, bag array<array<string>>"), "toxicity_bags")
    words = bags.select(F.explode(F.array_distinct(F.flatten("bag"))).alias("word")).groupBy("word").count()
    vocab = [r["word"] for r in words.where(F.col("count") >= MIN_DF).select("word").orderBy("word").collect()]
    number = {w: i for i, w in enumerate(vocab)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[[number[w] for w in s if w in number] for s in bag] for bag in pdf["bag"]]
            yield pd.DataFrame({"h": pdf["h"], "toxic": pdf["toxic"], "n": [list(map(len, b)) for b in out],
                                "words": [[w for s in b for w in s] for b in out]})

    rows = bags.mapInPandas(encode, "h long, toxic int, n array<int>, words array<int>").orderBy("h").toPandas()
    toxic, n, numbers = rows["toxic"].to_numpy(), list(rows["n"]), list(rows["words"])
    del rows
    bias, leak, w = fit_bags(toxic, n, numbers, len(vocab))
    return Model(bias, leak, {vocab[i]: float(w[i]) for i in np.flatnonzero(w)})


def fit_bags(toxic: np.ndarray, n: list, words: list, n_words: int, steps: int = STEPS) -> tuple[float, float, np.ndarray]:
    """(bias, leak, weights) by proximal Adam steps on the mean log-likelihood of noisy-or with a leak.

    ``n[d]`` holds the number of known words of each sentence of bag d, ``words[d]`` the words in that order.
    """
    y = np.asarray(toxic, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return -1000.0, float(y.mean()) if len(y) else 0.0, np.zeros(n_words)  # the leak alone
    bag = np.repeat(np.arange(len(y)), [len(x) for x in n])
    size = np.concatenate([np.asarray(x, np.int64) for x in n])
    word = np.concatenate([np.asarray(x, np.int32) for x in words])
    ends = np.concatenate([[0], np.cumsum(size)])
    parts = []  # (first sentence, end, first word, end): at most SLICE words, or one sentence, at a time
    while not parts or parts[-1][1] < len(size):
        a = parts[-1][1] if parts else 0
        b = max(min(a + 1, len(size)), int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
        parts.append((a, b, ends[a], ends[b]))
    theta = np.zeros(n_words + 2)  # weights, bias, logit of the leak
    theta[-2], theta[-1] = -5.0, math.log(0.02 / 0.98)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.full(len(size), theta[-2])
        for a, b, i, j in parts:
            z[a:b] += np.bincount(np.repeat(np.arange(b - a), size[a:b]), theta[word[i:j]], b - a)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -500, 500))), 1e-15, 1 - 1e-12)
        leak = 1 / (1 + math.exp(-theta[-1]))
        clean = np.bincount(bag, np.log1p(-p), len(y)) + math.log1p(-leak)
        # d log-likelihood / d z of a sentence is p times this factor of its bag
        pull = np.where(y, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0)
        dz = p * pull[bag]
        g = np.zeros_like(theta)
        g[-2:] = dz.sum(), leak * pull.sum()
        for a, b, i, j in parts:
            g[:-2] += np.bincount(word[i:j], np.repeat(dz[a:b], size[a:b]), n_words)
        g /= len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
        scale = rate / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-4)
        theta += scale * m / (1 - 0.9 ** t)
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - scale[:-2] * L1, 0)
    return float(theta[-2]), float(1 / (1 + math.exp(-theta[-1]))), theta[:-2]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending sentences (code points of the text, end exclusive, and the sentence's score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.score(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [s for s, _ in found],
                                "sentences": [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences, learnt from the labels of documents not held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
