"""Operators 11 to 13: learning from bags, exact hard negatives, runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from textsql.llm import negatives, runs, toxicity

from tests.named import SF_SMALL


# ---- operator 13 ----

def brute_runs(w, k, least):
    out = {}
    for q in range(1, len(w) // k + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, k * q):
                out.setdefault((i, j + q - i), q)  # a smaller period came first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 50))]
        if w and rng.random() < 0.6:
            at = rng.randrange(len(w))
            w[at:at] = w[at:at + rng.randint(1, 7)] * rng.randint(2, 8)
        assert runs.find_runs(w) == brute_runs(w, 4, 6)
        assert sorted(runs.runs_of(w, 2), key=lambda r: (r[0], r[2])) == brute_runs(w, 2, 2)


def test_stretches_keep_runs_whole():
    w = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8, 3, 3, 3, 1, 7])
    assert list(runs.stretches(w, 4)) == [(1, 9)]


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 4, 6)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_runs_query_matches_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 9000")
    folded = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    odd = spark.createDataFrame([(folded, None), (folded, "  "), (folded, "é"), (folded, "a b " * 40), (None, "x " * 9), (5, "a a " * 6),
                                 (6, "p q p q p q p q r r r r r r")], "doc_id long, text string")
    docs = docs.unionByName(odd).unionByName(awkward.where("length(text) < 9000 OR text IS NULL").select("doc_id", "text"))
    got = runs.digests(runs.periodic_runs(runs.fold_texts(docs)))
    want = sorted((expected_row(*r) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[1] for r in want)
    assert runs.digests(runs.periodic_runs(runs.fold_texts(docs.limit(0)))).count() == 0


def test_very_long_text_is_one_run(spark, awkward):
    long = spark.createDataFrame([(1, "a b c " * 40000)], "doc_id long, text string")
    row = runs.periodic_runs(long).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 120000, 3)] and row["collapsed"] == "a b c"
    assert runs.periodic_runs(awkward).count() == awkward.count()


# ---- operator 12 ----

def brute_negatives(rows, k=5):
    use = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or not vec or any(x is None or not np.isfinite(x) for x in vec):
            continue
        use.append((vec_id, np.floor(256 * np.array(vec, np.float64)).astype(int).tolist(), (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (anchor, v, own) in enumerate(use):
        if anchor % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), other, label) for j, (other, w, label) in enumerate(use) if j != i and len(w) == len(v)]
        ranked = sorted(scores, key=lambda s: (-s[0], s[1]))
        for ps, positive, _ in [s for s in ranked if s[2] == own][:k]:
            band = [s for s in ranked if s[2] != own and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            out += [(anchor, positive, r, n, ps, ns) for r, (ns, n, _) in enumerate(band, 1)]
    return sorted(out)


def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 70))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] / 8 + rng.normal(size=70) * 0.03)], i % 3) for i in range(900)]
    rows += [(1000 + i, rows[i % 2][1], i % 3) for i in range(60)]  # ties
    rows += [(2000, [0.0] * 70, 1), (2001, None, 1), (2002, [], 1), (2003, [1.0, None], 0), (2004, [float("nan")] * 70, 0),
             (2100, rows[4][1], None), (2200, [1.0, 2.0], 1), (2201, [1.0, 2.5], 1), (2202, [1.0, 2.0], 2), (None, rows[0][1], 0),
             (300, rows[300][1], 0), (2300, [float("inf")] * 70, 1), (7, rows[0][1], 2), (-100, rows[100][1], 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, row string")


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 4000])
def test_hard_negatives_match_brute_force(spark, chunk_bytes):
    rows, df = vectors(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 100 == 0, label, chunk_bytes=chunk_bytes)
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.drop("positive_rank").collect())) == want and len(want) > 100
    if chunk_bytes > 1 << 20:
        assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, label).count() == 0


def test_intervals_hold_every_score_and_prune():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-300, 300, size=(400, 96)), rng.integers(-300, 300, size=(30, 96))
    q[:10] = x[:10] + rng.integers(-20, 20, size=(10, 96))
    low, high = negatives.Anchors(q).interval(*negatives.encode(x))
    exact = x @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    near = np.sort(exact, axis=0)[-1]
    assert (high[:, :10] < near[:10]).mean() > 0.5  # most rows can't reach the near copy's score


# ---- operator 11 ----

BAD, FINE = ["grobble", "snarkel", "vexhead"], [f"plain{i}" for i in range(60)]


def bags(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(FINE, k=8)) for _ in range(rng.randint(1, 30))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(BAD) + " " + rng.choice(FINE)
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_bags_teach_sentences(spark):
    docs, labels = bags(600, 1)
    odd = [(9000, None), (9001, ""), (None, "you grobble"), (9002, " ".join(FINE) + ". " + "plain1 plain2. " * 5000), (9003, "İ x. a snarkel!")]
    extra = [(1, 1, None), (None, 1, 1), (9100, 0, 1), (3, 1, labels[3][2])]
    df = spark.createDataFrame([(*r, 1.0, "b") for r in docs + odd + docs[:2]], "doc_id long, text string, score double, toxic string")
    lab = spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(docs) + len(odd) + 2 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 80 and all(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth)
    texts = dict(docs + odd)
    for r in got:
        for s in r["sentences"]:
            assert any(b in texts[r["doc_id"]][s["start"]:s["end"]] for b in BAD)
    by = {r["doc_id"]: r for r in got}
    assert by[9000]["predicted"] == by[9001]["predicted"] == by[9002]["predicted"] == 0
    assert by[9003]["predicted"] == 1 and not by[None]["held_out"]


def test_score_is_noisy_or_of_sentences():
    m = toxicity.Model(bias=-2.0, leak=0.1, weights={"bad": 3.0, "worse": 1.0})
    p = [1 / (1 + np.exp(2)), 1 / (1 + np.exp(-1))]
    score, where = m.score("good day. BAD bad day\n...")
    assert np.isclose(score, 1 - 0.9 * (1 - p[0]) * (1 - p[1])) and [(a, b) for a, b, _ in where] == [(9, 21)]
    assert np.isclose(m.score(None)[0], 0.1)


def test_gradient_of_the_bags_rises_to_the_optimum():
    y, n, words = [1, 1, 0, 0, 0], [[1, 1], [1], [1], [1, 1], [1]], [[0, 1], [0], [1], [1, 1], [1]]
    bias, leak, w = toxicity.fit_bags(np.array(y), n, words, 2, steps=600)
    assert w[0] > 5 and w[0] + bias > 1 and bias < -2 and leak < 0.1
    assert toxicity.fit_bags(np.array([0, 0]), [[], []], [[], []], 2)[1] == 0.0


def test_held_out_labels_and_columns_change_nothing(spark):
    docs, labels = bags(150, 2)
    df = spark.createDataFrame([(*r, "en", "s1") for r in docs], "doc_id long, text string, lang string, source string")
    other = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("q"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(d, x).select("doc_id", "score").collect())) for d, x in ((df, lab), (other, turned)))
    assert a == b
    none = toxicity.toxicity(df, lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.toxicity(df.limit(0), lab).count() == 0
