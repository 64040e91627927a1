"""Operator 2: near-duplicate documents by SuperMinHash signatures, banding, exact check, union-find.

Every shingle draws a random permutation step by step: at step j it offers ``j + r`` to one slot of
the signature, and steps end as soon as no slot could still improve (values of step j are >= j).
All shingles of a block of documents take a step together in numpy. Bands of ``ROWS`` slots give
buckets; with 40 bands of 6 a pair at similarity 0.8 shares a bucket with probability 1 - 6e-6.

Documents with equal shingle sets form one class first; only one row of each class is banded.
Links are looked for in rounds: every bucket that still holds several components names a leader, members of other
components are checked against it, what links is united, and members that have met their leader's component need
no further check there. So after the first round almost all of a group of copies is one component
and moves no more. Members that stay apart for ``LEADERS`` rounds are then checked across components, so no link
that could join two components is skipped while no group is expanded into all its pairs. A pair
is dropped unconfirmed only where a bitmap of its sets proves it too far apart. Links are
confirmed on full shingle sets (64-bit hashes); groups come from distributed star contraction.

Every row stands for itself, known by hashes of its id and text (two of 64 bits), so an id may come with several texts.
Defined cases: null or empty texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; rows repeating a doc_id are linked each by its own text; null ids link like others,
and a component's id is its smallest id that is not null; an empty table gives no rows; extra columns
are never read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, connected_components, materialise, salted_lookup

SHINGLE, THRESHOLD_PCT, ROWS, BANDS, LEADERS = 5, 80, 6, 40, 2
BLOCK = 200_000  # shingles that step together
PAIRS_PER_SALT = 500
BITMAP_WORDS = 16  # 64-bit words of the bitmap over the top bits of a set's hashes
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, dtype=_U)
    if len(words) < size:
        shingles = {b" ".join(words)}
    else:
        shingles = set(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(s) for s in shingles), dtype=_U, count=len(shingles)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def superminhash(hashes: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of elements ``hashes`` belonging to documents ``doc``."""
    sig = np.full((n_docs, m), np.inf)
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint16), (len(hashes), 1))
    rows = np.arange(len(hashes))
    for j in range(m):
        bits = _mix(hashes + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = (bits >> _U(32)).astype(np.float64) / 2.0**32
        k = j + ((bits & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, doc * m + slot, j + r)
        # early stop: the next step offers at least j + 1, useless once every slot is below it
        open_docs = sig.max(axis=1) > j + 1
        live = open_docs[doc]
        if not live.all():
            hashes, doc, rows = hashes[live], doc[live], rows[live]
            if not len(hashes):
                break
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band (the band's number is part of the key)."""
    n, m = sig.shape
    vals = sig.view(_U).reshape(n, m // rows, rows)
    key = np.broadcast_to(_mix(np.arange(1, m // rows + 1, dtype=_U)), (n, m // rows)).copy()
    for i in range(rows):
        key = _mix(key ^ vals[:, :, i]) + _U(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of 64 * BITMAP_WORDS equal ranges of hashes the set meets, as 64-bit words."""
    met = np.zeros(64 * BITMAP_WORDS, dtype=bool)
    met[(hashes >> _U(64 - met.size.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(met).view(np.int64)


def most_shared(n_a: str, n_b: str, bits_a: str, bits_b: str):
    """Upper bound of an intersection's size: each range that only one set meets holds at least one
    element outside the other set."""
    def alone(x: str, y: str):
        words = [F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP_WORDS)]
        return functools.reduce(lambda p, q: p + q, words)

    return F.least(F.col(n_a) - alone(bits_a, bits_b), F.col(n_b) - alone(bits_b, bits_a))


def _signatures(shingle: int, rows: int, bands: int):
    m = rows * bands

    def flush(sets: list[np.ndarray]) -> list[np.ndarray]:
        full = [i for i, s in enumerate(sets) if len(s)]
        out = [np.empty(0, dtype=np.int64)] * len(sets)
        if full:
            sig = None
            hashes = np.concatenate([sets[i] for i in full])
            doc = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
            for at in range(0, len(hashes), BLOCK):
                part = superminhash(hashes[at:at + BLOCK], doc[at:at + BLOCK], len(full), m) if len(hashes) <= BLOCK \
                    else _chunk(hashes[at:at + BLOCK], doc[at:at + BLOCK], len(full), m)
                sig = part if sig is None else np.minimum(sig, part)
            for i, key in zip(full, band_keys(sig, rows)):
                out[i] = key
        return out

    def _chunk(hashes, doc, n, m):
        used, local = np.unique(doc, return_inverse=True)
        part = np.full((n, m), np.inf)
        part[used] = superminhash(hashes, local, len(used), m)
        return part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, sets, size, start = pdf["doc_id"], [], 0, 0
            for i, text in enumerate(pdf["text"]):
                s = shingle_hashes(text, shingle)
                sets.append(s)
                size += len(s)
                if size >= BLOCK // 2 or i == len(pdf) - 1:
                    yield pd.DataFrame({
                        "doc_id": ids.iloc[start:i + 1].astype("Int64").values,
                        "k1": pdf["k1"].values[start:i + 1], "k2": pdf["k2"].values[start:i + 1],
                        "n_shingles": [len(x) for x in sets],
                        "set_id": [hashlib.sha256(x.tobytes()).hexdigest()[:32] if len(x) else None for x in sets],
                        "keys": flush(sets),
                        "bits": [bitmap(x) for x in sets]})
                    sets, size, start = [], 0, i + 1

    return run


def row_keys() -> dict[str, F.Column]:
    """Two hashes that tell rows of different ids or texts apart."""
    return {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")}


def _full_sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["set_id"].values,
                                "elements": [shingle_hashes(t, shingle).view(np.int64) for t in pdf["text"]]})
    return run


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, pct: int) -> DataFrame:
    """Keep the (a, b) pairs of classes whose full shingle sets reach the similarity. ``b`` may be hot: its
    set is repeated once per PAIRS_PER_SALT pairs it takes part in."""
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    asked = reps.select("set_id", "k1", "k2").join(ids, "set_id", "left_semi")
    texts = docs.select("text", *[c.alias(k) for k, c in row_keys().items()]).join(asked, ["k1", "k2"]).dropDuplicates(["set_id"])
    sets = materialise(texts.mapInPandas(_full_sets(shingle), "id string, elements array<long>"), "sets")
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    right = degree.join(sets, F.col("b") == F.col("id")).select(
        "b", F.col("elements").alias("eb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = salted_lookup(pairs, degree, "b", "a", "inner").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    left = salted.join(sets, F.col("a") == F.col("id")).select("a", "b", "salt", F.col("elements").alias("ea"))
    both = left.join(right, ["b", "salt"])
    inter = F.size(F.array_intersect("ea", "eb"))
    return both.where(100 * inter >= pct * (F.size("ea") + F.size("eb") - inter)).select("a", "b")


def _placed(shared: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Bucket members with their component, in the buckets that still hold several components; of those,
    members of the largest component (main) are the ones to be met, the others the ones that ask."""
    if comp is None:
        placed = shared.withColumn("c", F.col("set_id"))
    else:
        placed = shared.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    placed = placed.select("key", "set_id", "n", "met", "c")
    per_comp = placed.groupBy("key", "c").agg(F.count("*").alias("m"), F.max("met").alias("met"))
    main = per_comp.groupBy("key").agg(F.max_by("c", F.struct("m", "met", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    return materialise(salted_lookup(placed, main, "key", "set_id", "inner"), "placed")


def near_classes(docs: DataFrame, shingle: int, threshold_pct: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows with set_id, (set_id, component) of linked classes)."""
    keyed = docs.select("doc_id", "text", *[c.alias(k) for k, c in row_keys().items()])
    signed = materialise(keyed.mapInPandas(
        _signatures(shingle, rows, bands),
        "doc_id long, k1 long, k2 long, n_shingles long, set_id string, keys array<long>, bits array<long>"), "signed")
    chosen = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2", "set_id")
    reps = materialise(signed.join(chosen, ["k1", "k2", "set_id"], "left_semi").dropDuplicates(["set_id"]).select(
        "set_id", "k1", "k2", F.col("n_shingles").alias("n"), "keys", "bits"), "reps")
    exploded = reps.select("set_id", "n", F.explode("keys").alias("key"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = salted_lookup(exploded, buckets, "key", "set_id", "inner")
    # a set that meets many others is likely their common source, and so a good leader
    met = shared.groupBy("set_id").agg(F.sum("m").alias("met"))
    shared = materialise(shared.drop("m").join(met, "set_id").select("key", "set_id", "n", "met"), "shared")

    def similar_size(x: str, y: str):
        return 100 * F.least(x, y) >= threshold_pct * F.greatest(x, y)

    comp, tried = None, None
    for turn in range(LEADERS):
        # members outside the main component ask a leader: one of the main component, in odd turns one of their own;
        # first the set that meets most others, later any
        placed = _placed(shared, comp)
        order = F.xxhash64("set_id", F.lit(turn)) if turn > 1 else -F.col("met")
        of_main = F.col("c") == F.col("main")
        best = F.when(of_main if turn % 2 == 0 else ~of_main, F.struct(order.alias("o"), "set_id", "n", "c"))
        lead = placed.groupBy("key").agg(F.min(best).alias("l")).select(
            "key", F.col("l.set_id").alias("leader"), F.col("l.n").alias("n_leader"), F.col("l.c").alias("c_leader"))
        asks = salted_lookup(placed.where("c <> main"), lead, "key", "set_id", "inner").where("c <> c_leader").where(
            similar_size("n", "n_leader"))
        star = asks.select(F.col("set_id").alias("a"), F.col("leader").alias("b")).distinct()
        star = materialise(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "star")
        tried = star if tried is None else tried.unionByName(star)
        comp = _unite(comp, _confirm(star, reps, docs, shingle, threshold_pct) if not star.isEmpty() else None)
    placed = _placed(shared, comp)
    bits = reps.select("set_id", "bits").join(placed.select("set_id").distinct(), "set_id", "left_semi")
    placed = materialise(placed.join(bits, "set_id"), "placed")
    out = placed.where("c <> main").select("key", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"),
                                           F.col("bits").alias("xa"))
    every = placed.select("key", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("bits").alias("xb"))
    shared_most = most_shared("na", "nb", "xa", "xb")
    cross = out.join(every, "key").where("ca <> cb").where(similar_size("na", "nb")).where(
        100 * shared_most >= threshold_pct * (F.col("na") + F.col("nb") - shared_most)).select("a", "b").distinct()
    cross = materialise(cross.join(tried, ["a", "b"], "left_anti"), "cross")
    comp = _unite(comp, _confirm(cross, reps, docs, shingle, threshold_pct) if not cross.isEmpty() else None)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "id string, component string")
    return signed, comp.withColumnRenamed("id", "set_id")


def _unite(comp: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """Components after new links; unchanged, without a job more, where nothing links."""
    if links is None or (links := materialise(links, "links")).isEmpty():
        return comp
    known = links if comp is None else links.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return materialise(connected_components(known), "components")


def _grouped(docs: DataFrame, shingle: int, threshold_pct: int, rows: int, bands: int) -> DataFrame:
    """Every row (doc_id, k1, k2, n_shingles, group): rows of one group are near copies; a text without words has no group."""
    signed, comp = near_classes(docs, shingle, threshold_pct, rows, bands)
    group = salted_lookup(signed.select("doc_id", "k1", "k2", "n_shingles", "set_id"), comp, "set_id", "k1")
    return materialise(group.withColumn("group", F.coalesce("component", "set_id")).drop("component", "set_id"), "grouped")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT,
                    rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    grouped = _grouped(docs, shingle, threshold_pct, rows, bands)
    least = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    return salted_lookup(grouped, least, "group", "k1").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT,
                         rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id (null ones last), and every row without words;
    columns as they came. Of rows that repeat id and text any one may stay."""
    grouped = _grouped(docs, shingle, threshold_pct, rows, bands)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    stays = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min(at).alias("s")).select(
        F.col("s.k1").alias("_k1"), F.col("s.k2").alias("_k2"), F.lit(True).alias("_stays"))
    row = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(f"_{k}") for k, c in row_keys().items()])
    words = F.coalesce(F.col("_row.text").rlike(WORD), F.lit(False))
    chosen = row.where(words).join(stays, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return row.where(~words).select("_row.*").unionByName(chosen.select("_row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b USING (x)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node AND r.root < u.b)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, min(root) = n.doc_id AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
