"""Operator 12: hard negatives by rotated one-bit codes with deterministic error intervals.

Every vector is turned by one fixed random rotation and stored as its signs (one bit a component), its length
and the alignment ``a`` of its direction ``o`` with its code vector ``x = signs / sqrt(dim)``. An anchor ``q``
(turned too) is quantised to ``BITS`` bits a component; with the bit planes of the anchor, popcounts
give ``<q, x>`` up to the length of the quantisation error. As ``o = a x + r`` with ``r`` at right angles to ``x`` and
of length ``sqrt(1 - a^2)``, Cauchy-Schwarz bounds the rest: ``<q, o>`` lies within
``a <q, x> +- sqrt(|q|^2 - <q, x>^2) sqrt(1 - a^2)``. The bound is certain, so a row whose interval misses all that
could still enter a list is left out without loss; all other rows are scored in integers.

Codes are written once. Anchors go out in chunks of at most ``CHUNK_BYTES``; a chunk meets all rows where
they lie, block by block, without a shuffle of rows; only the best ``k`` a task and list are shuffled. One
round finds the positives, the next the negatives in their score bands.

Defined cases: rows with a null vec_id or label, a null or empty vector, a null or non-finite component, or one beyond
``2^27 / 256`` (its products would leave a long) take no part; vectors of another length than the anchor's aren't
compared; zero vectors take part with score 0; rows repeating a vec_id count each as a row of its own (a row
is no partner of itself alone); equal scores rank by vec_id; anchors without positives, positives without negatives
in their band and empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K, LOW_PCT, SCALE = 5, 80, 256
BITS, SEED = 6, 20240
CHUNK_BYTES, BLOCK_PAIRS, EXACT_PAIRS = 8 << 20, 1 << 20, 1 << 15
LIMIT = 1 << 27  # largest integer component
CODES = "vec_id long, label long, dim int, ints binary, code binary, norm double, align double"
HITS = "slot int, other long, score long"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, alignments) of integer vectors."""
    turned = x.astype(np.float64) @ rotation(x.shape[1])
    norm = np.sqrt((turned * turned).sum(1))
    signs = turned >= 0
    align = np.abs(turned).sum(1) / np.sqrt(x.shape[1]) / np.where(norm > 0, norm, 1)
    return _pack(signs), norm, np.minimum(align, 1)


class Anchors:
    """A chunk of anchors, quantised to bit planes."""

    def __init__(self, ints: np.ndarray):
        self.ints, dim = ints, ints.shape[1]
        turned = ints.astype(np.float64) @ rotation(dim)
        low = turned.min(1)
        step = (turned.max(1) - low) / ((1 << BITS) - 1)
        levels = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
        self.planes = [_pack((levels >> b) & 1) for b in range(BITS)]
        self.low, self.step, self.sum, self.root = low, step, levels.sum(1), np.sqrt(dim)
        error = turned - (low[:, None] + step[:, None] * levels)
        self.norm, self.error = np.sqrt((turned * turned).sum(1)), np.sqrt((error * error).sum(1))
        self.dim = dim

    def interval(self, code: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of every row (first axis) with every anchor."""
        ones = np.bitwise_count(code).sum(1).astype(np.int64)
        dot = np.zeros((len(code), len(self.low)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                dot += np.bitwise_count(code[:, w, None] & plane[None, :, w]).astype(np.int64) << b
        # <q, x> for signs s = 2 bit - 1: low * sum(s) + step * sum(levels * s)
        c = (self.low * (2 * ones - self.dim)[:, None] + self.step * (2 * dot - self.sum)) / self.root
        sure = np.maximum(np.abs(c) - self.error, 0)
        rest = np.sqrt(np.maximum(self.norm ** 2 - sure * sure, 0)) * np.sqrt(np.maximum(1 - align ** 2, 0))[:, None]
        slack = align[:, None] * self.error + rest + 1e-7 * self.norm + 1e-9
        mid = align[:, None] * c
        return norm[:, None] * (mid - slack), norm[:, None] * (mid + slack)


class Best:
    """The first ``k`` (score descending, id ascending) of each list, fed block by block."""

    def __init__(self, lists: int, k: int):
        self.k, self.floor = k, np.full(lists, -np.inf)  # a list's k-th score once it is full
        self.rows = np.empty((0, 3), np.int64)  # list, score, id

    def add(self, slot: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        ok = score >= self.floor[slot]
        new = np.stack([slot[ok], score[ok], other[ok]], 1)
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]] if len(rows) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        place = np.arange(len(rows)) - start
        self.rows = rows[place < self.k]
        full = place == self.k - 1
        self.floor[rows[full, 0]] = rows[full, 1]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"slot": self.rows[:, 0].astype("int32"), "other": self.rows[:, 2], "score": self.rows[:, 1]})


def _ints(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int32).reshape(-1, dim).astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame], dim: int, wide: int):
    """Rows of a task in blocks, with their vectors and codes."""
    size = max(1, BLOCK_PAIRS // max(1, wide))
    for pdf in batches:
        for i in range(0, len(pdf), size):
            p = pdf.iloc[i:i + size]
            code = np.frombuffer(b"".join(p["code"]), np.uint64).reshape(len(p), -1)
            yield p, _ints(p["ints"], dim), code, p["norm"].to_numpy(), p["align"].to_numpy()


def _scores(rows: np.ndarray, may: np.ndarray, anchors: np.ndarray):
    """(rows, anchors, integer scores) of the marked pairs, a bounded number at a time."""
    r, a = np.nonzero(may)
    for i in range(0, len(r), EXACT_PAIRS):
        x, y = r[i:i + EXACT_PAIRS], a[i:i + EXACT_PAIRS]
        yield x, y, np.einsum("ij,ij->i", rows[x], anchors[y])


def prepare(vectors: DataFrame, label: Column) -> DataFrame:
    """Rows that take part, with integer vectors and stored codes; ``row`` tells repeated rows apart."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups: dict[int, list] = {}
            for vec_id, own, vec in zip(pdf["vec_id"], pdf["label"], pdf["embedding"]):
                v = np.array([np.nan if c is None else c for c in vec], dtype=np.float64)
                v = np.floor(SCALE * v)
                if len(v) and (np.abs(v) < LIMIT).all():  # false for NaN and infinity
                    groups.setdefault(len(v), []).append((vec_id, own, v.astype(np.int32)))
            for dim, rows in groups.items():
                x = np.stack([r[2] for r in rows])
                code, norm, align = encode(x)
                yield pd.DataFrame({"vec_id": [r[0] for r in rows], "label": [r[1] for r in rows], "dim": np.int32(dim),
                                    "ints": [r.tobytes() for r in x], "code": [c.tobytes() for c in code],
                                    "norm": norm, "align": align})

    rows = vectors.select("vec_id", "embedding", label.cast("long").alias("label")).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return materialise(rows.mapInPandas(make, CODES).withColumn("row", F.monotonically_increasing_id()), "codes")


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks; a task hands on ``k`` rows a slot at most."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, anchors: pd.DataFrame, dim: int, k: int) -> DataFrame:
    ints, label, own = _ints(anchors["ints"], dim), anchors["label"].to_numpy(), anchors["row"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, best = Anchors(ints), Best(len(ints), k)
        for p, x, code, norm, align in _blocks(batches, dim, len(ints)):
            _, high = q.interval(code, norm, align)
            may = (high >= best.floor) & (p["label"].to_numpy()[:, None] == label) & (p["row"].to_numpy()[:, None] != own)
            ids = p["vec_id"].to_numpy()
            for r, a, s in _scores(x, may, ints):
                best.add(a, s, ids[r])
        yield best.frame()

    return _first(rows.mapInPandas(run, HITS), k)


def _negatives(rows: DataFrame, anchors: pd.DataFrame, pairs: pd.DataFrame, dim: int, k: int, low_pct: int) -> DataFrame:
    """``pairs``: anchor (its place in ``anchors``), rank and positive_score; a list is numbered k * anchor + rank - 1."""
    ints, label = _ints(anchors["ints"], dim), anchors["label"].to_numpy()
    top = np.full((len(ints), k), -1, np.int64)  # no list has a negative score: its band would be empty
    top[pairs["anchor"].to_numpy(), pairs["rank"].to_numpy() - 1] = pairs["positive_score"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, best = Anchors(ints), Best(top.size, k)
        for p, x, code, norm, align in _blocks(batches, dim, len(ints)):
            low, high = q.interval(code, norm, align)
            need = np.maximum(best.floor.reshape(top.shape), low_pct * top / 100)
            may = np.zeros(low.shape, bool)
            for j in range(k):
                may |= (high >= need[:, j]) & (low <= top[:, j]) & (top[:, j] >= 0)
            may &= p["label"].to_numpy()[:, None] != label
            ids = p["vec_id"].to_numpy()
            for r, a, s in _scores(x, may, ints):
                t = top[a]
                i, j = np.nonzero((low_pct * t <= 100 * s[:, None]) & (s[:, None] <= t) & (t >= 0))
                best.add(a[i] * k + j, s[i], ids[r[i]])
        yield best.frame()

    return _first(rows.mapInPandas(run, HITS), k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, k: int = K, low_pct: int = LOW_PCT,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``anchor`` and ``label`` are expressions over the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    codes = prepare(vectors, F.col("label") if label is None else label)
    anchors = codes.where(anchor)
    out = None
    # a few rows: one per vector length
    for dim, n in sorted(map(tuple, anchors.groupBy("dim").count().collect())):
        rows = codes.where(F.col("dim") == dim).drop("dim")
        chunks = max(1, -(-n * dim * 12 // chunk_bytes))
        for c in range(chunks):
            mine = rows.where(anchor).where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c)
            # about chunk_bytes: the anchors of one round, sorted so that their places are the same in both
            pdf = mine.select("row", "vec_id", "label", "ints").toPandas().sort_values(["vec_id", "row"], ignore_index=True)
            if not len(pdf):
                continue
            found = materialise(_positives(rows, pdf, dim, k), "positives")
            pairs = found.select(F.col("slot").alias("anchor"), "rank", F.col("score").alias("positive_score"), "other").toPandas()
            lists = spark.createDataFrame(pd.DataFrame({
                "slot": (pairs["anchor"] * k + pairs["rank"] - 1).astype("int32"), "anchor_id": pdf["vec_id"].to_numpy()[pairs["anchor"]],
                "positive_id": pairs["other"], "positive_rank": pairs["rank"].astype("int32"), "positive_score": pairs["positive_score"]}),
                "slot int, anchor_id long, positive_id long, positive_rank int, positive_score long")
            got = _negatives(rows, pdf, pairs, dim, k, low_pct).join(F.broadcast(lists), "slot").select(
                "anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"),
                F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            got = materialise(got, "negatives") if chunks > 1 else got
            out = got if out is None else out.unionByName(got)
    empty = ("anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, "
             "positive_score long, negative_score long")
    return spark.createDataFrame([], empty) if out is None else out


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
