"""Operator 3: embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one and split into halves; each half has its own codebook, and a cell
of the product grid is a pair of codewords. A query visits cells in order of the smallest distance
a neighbour there can have: to lie nearer to codeword i than to its own, a vector must cross the
plane between both, so cell (i, j) is at least sqrt(h_i^2 + h_j^2) away. The traversal ends at the
radius that belongs to the cosine, so its recall target of one is met by geometry. Cells
met from both sides are visited once, and pairs in them are verified in double precision.

Equal vectors of a label form one class (counts are weighted); dense cells are cut into blocks, and
a block returns link counts and a spanning forest, never its pairs. Codebooks are fitted on a
bounded sample (``SAMPLE`` vectors by smallest id hash); every vector is indexed.

Defined cases: null, empty or zero vectors, null labels and null or non-finite components link with
nothing; vectors of another length than the query link with nothing; rows repeating a vec_id
are kept; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, salted_lookup

MIN_COSINE, SAMPLE, CELL, BLOCK = 0.98, 20_000, 512, 1024


def _valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for vec_id, vec, label in zip(pdf["vec_id"], pdf["embedding"], pdf["label"]):
            v = None if vec is None else np.array([np.nan if c is None else c for c in vec], dtype=np.float64)
            ok = v is not None and len(v) > 0 and not pd.isna(label) and bool(np.isfinite(v).all()) and bool(v.any())
            key = hashlib.sha256(repr(int(label)).encode() + b":" + (v + 0.0).tobytes()).digest()[:16] if ok else None
            out.append((vec_id, None if pd.isna(label) else int(label), key, v.tolist() if ok else None))
        yield pd.DataFrame(out, columns=["vec_id", "label", "key", "vec"]).astype({"vec_id": "Int64", "label": "Int64"})


def _unit(vecs) -> np.ndarray:
    x = np.array(list(vecs), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from a deterministic farthest-point start."""
    centres = [x[0]]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and gap.max() > 0:
        centres.append(x[int(gap.argmax())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = _sq(x, c).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def _plane_gap(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own codeword, squared distance to the plane towards every other codeword)."""
    d = _sq(x, c)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(_sq(c, c), 0))[own]
    gap = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / np.where(apart > 0, 2 * apart, 1)
    return own, np.where(apart > 0, gap, 0) ** 2


def visit_cells(x: np.ndarray, books, radius2: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own cell of each vector, and the cells it visits in order of their least distance."""
    half = books[0].shape[1]
    own1, g1 = _plane_gap(x[:, :half], books[0])
    own2, g2 = _plane_gap(x[:, half:], books[1])
    width = len(books[1])
    cells = []
    for a, b in zip(g1, g2):
        o1, o2 = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        s1, s2 = a[o1], b[o2]
        # row by row the second codebook is read up to the radius that the first leaves over
        upto = np.searchsorted(s2, radius2 - s1, side="right")
        rows = np.repeat(np.arange(len(s1)), upto)
        cols = np.concatenate([np.arange(n) for n in upto]) if upto.any() else np.empty(0, int)
        order = np.argsort(s1[rows] + s2[cols], kind="stable")
        cells.append((o1[rows] * width + o2[cols])[order])
    return own1 * width + own2, cells


def _search(min_cosine: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "n", "to"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in cols})
        q, t = _unit(left["vec"]), _unit(right["vec"])
        qi, ti = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
        hit = (q @ t.T >= min_cosine) & (qi[:, None] != ti[None])
        within = (left["own"].to_numpy() == right["own"].iloc[0])[:, None]
        out = []
        nq = hit @ right["copies"].to_numpy(np.int64)
        nt = (hit & ~within).T @ left["copies"].to_numpy(np.int64)
        out.append(pd.DataFrame({"id": qi[nq > 0], "n": nq[nq > 0], "to": None}))
        out.append(pd.DataFrame({"id": ti[nt > 0], "n": nt[nt > 0], "to": None}))
        lq, lt, big = qi.copy(), ti.copy(), np.iinfo(np.int64).max
        rows, cs = hit.any(1), hit.any(0)
        while rows.any():  # labels sink to the smallest id of each connected part of the block
            nlq = np.minimum(lq, np.where(hit, lt[None], big).min(1))
            nlt = np.minimum(lt, np.where(hit, nlq[:, None], big).min(0))
            if (nlq == lq).all() and (nlt == lt).all():
                break
            lq, lt = nlq, nlt
        out.append(pd.DataFrame({"id": qi[rows], "n": 0, "to": lq[rows]}))
        out.append(pd.DataFrame({"id": ti[cs], "n": 0, "to": lt[cs]}))
        return pd.concat([o.astype("Int64") for o in out])[cols]

    return run


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = materialise(vectors.select("vec_id", "embedding", "label").mapInPandas(
        _valid, "vec_id long, label long, key binary, vec array<double>"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    member = materialise(salted_lookup(rows.select("vec_id", "key"), classes, "key", "vec_id"), "member")
    reps = rows.join(member.where("vec_id = rep").select("vec_id", "rep", "copies"), "vec_id").select(
        "rep", "copies", "label", F.size("vec").alias("dim"), "vec").dropDuplicates(["rep"])
    reps = materialise(reps, "reps")
    # a few rows: one per vector length
    dims = [r["dim"] for r in reps.select("dim").distinct().collect()]
    found = spark.createDataFrame([], "id long, n long, to long")
    for dim in dims:
        found = found.unionByName(_links(reps.where(F.col("dim") == dim).drop("dim"), dim, min_cosine, sample))
    found = materialise(found, "found")
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("`to` IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    totals = counts.join(comp, "id", "full").select(F.col("id").alias("rep"), "n", "component")
    res = salted_lookup(member, totals, "rep", "vec_id")
    component = F.coalesce("component", "rep", "vec_id")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return res.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _links(reps: DataFrame, dim: int, min_cosine: float, sample: int) -> DataFrame:
    half = max(1, dim // 2) if dim > 1 else 1
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    k = max(1, int(np.ceil(np.sqrt(largest / CELL))))
    drawn = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vec").collect()
    x = _unit([r["vec"] for r in drawn])
    books = (fit_codebook(x[:, :half], k), fit_codebook(x[:, half:], k) if dim > 1 else np.zeros((1, 0)))
    radius2 = 2 - 2 * min_cosine + 1e-9

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, cells = visit_cells(_unit(pdf["vec"]), books, radius2)
                # links are symmetric: of two cells that see each other only the lower one asks
                yield pdf.assign(own=own, cells=[c[c >= o] for o, c in zip(own, cells)])

    indexed = materialise(reps.mapInPandas(
        index, "rep long, copies long, label long, vec array<double>, own long, cells array<long>"), "indexed")
    per_cell = indexed.groupBy("label", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nt"))
    asked = indexed.select("label", "own", F.explode("cells").alias("cell")).groupBy("label", "own", "cell").count()
    grid = asked.withColumnRenamed("own", "src").join(per_cell.withColumnRenamed("own", "cell"), ["label", "cell"]).select(
        "label", "src", "cell", "nt", F.ceil(F.col("count") / BLOCK).cast("int").alias("nq"))
    grid = materialise(grid, "grid")
    rep_hash = F.xxhash64("rep")
    queries = indexed.withColumn("cell", F.explode("cells")).withColumn("src", F.col("own")).drop("cells").join(
        grid, ["label", "src", "cell"]).withColumn("qb", F.pmod(rep_hash, F.col("nq")).cast("int")).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), F.col("nt") - 1))).select("label", "src", "cell", "qb", "tb", "rep", "copies", "own", "vec")
    targets = indexed.drop("cells").withColumn("cell", F.col("own")).join(
        grid, ["label", "cell"]).withColumn("tb", F.pmod(rep_hash, F.col("nt")).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("label", "src", "cell", "qb", "tb", "rep", "copies", "own", "vec")
    key = ["label", "src", "cell", "qb", "tb"]
    queries, targets = queries.toDF(*queries.columns), targets.toDF(*targets.columns)  # own column ids on each side
    return queries.groupBy(*key).cogroup(targets.groupBy(*key)).applyInPandas(_search(min_cosine), "id long, n long, to long")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(e) > 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = c.vec_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""
