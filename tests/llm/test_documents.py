"""Document operators against brute force, on awkward rows and empty tables."""

import bisect
import re
import warnings

import numpy as np
import pytest
from textsql.llm import licenses, minhash, mixing, packing, pii, quality, substrings

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = W.findall((text or "").lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_match_brute_force(spark, awkward):
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(awkward, shingle=2).where("doc_id IS NOT NULL").collect()}
    docs = {r["doc_id"]: shingle_set(r["text"], 2) for r in awkward.collect() if r["doc_id"] is not None}
    comp = {d: d for d in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if docs[a] and docs[b] and 100 * len(docs[a] & docs[b]) >= 80 * len(docs[a] | docs[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in rows.items()} == {
        d: (len(docs[d]), comp[d], comp[d] == d) for d in docs}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1100).astype(np.uint64)
    a, b = pool[:1000], pool[100:]
    sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 240)
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.1


def test_members_missed_by_their_leaders_are_found(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[:30 + i] if i < 10 else words[:39])) for i in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert {r["component_id"] for r in got} == {0}


def test_rows_with_one_id_link_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(4, a), (9, b), (4, b + " more"), (9, c), (7, c + " tail"), (None, a + " end"), (None, None), (5, ""), (5, " "), (8, a), (8, a), (None, c)]
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, place int, group string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df.repartition(3), shingle=2).collect())
    assert got == sorted([(4, 39, 4, True), (9, 39, 4, False), (4, 40, 4, True), (9, 39, 7, False), (7, 40, 7, True), (0, 40, 4, False),
                          (0, 0, 0, True), (5, 0, 5, True), (5, 0, 5, True), (8, 39, 4, False), (8, 39, 4, False), (0, 39, 7, False)])
    kept = minhash.drop_near_duplicates(df.repartition(3), shingle=2)
    assert kept.columns == df.columns
    # a row for each group of near copies (a, b, c), and the three without words
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.where("text LIKE '%4%'").collect()) == [(4, a), (4, b + " more"), (7, c + " tail")]
    assert kept.count() == 6 and minhash.drop_near_duplicates(df.limit(0)).count() == 0
    nulls = df.where("doc_id IS NULL AND text IS NOT NULL")
    assert minhash.drop_near_duplicates(nulls.unionByName(nulls)).count() == 2


def brute_repeat(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {p for i in at for p in range(i, i + 8)}
    return len(hit)


def test_quality_counts(spark):
    a = "the cat sat on a mat with the dog and then "
    texts = [a * 3, "a b\na b\n\nc", None, "", a, "x " * 50, "# $ a|b <c>", "é ñ 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(df).collect():
        text = texts[r["doc_id"]] or ""
        words, lines = W.findall(text), [x for x in text.split("\n") if W.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), brute_repeat(words))


def test_quality_filter_keeps_columns(awkward):
    kept = quality.quality_filter(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3}


def test_quality_filter_judges_each_row(spark):
    good = "the cat sat on a mat with the dog and then it went to see that it is for you and me today"
    rows = [(None, good), (1, good), (1, "short"), (2, None), (3, good), (3, good)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int")
    assert sorted((r["doc_id"] or 0, r["text"], r["n_words"]) for r in quality.quality_filter(df).collect()) == [
        (0, good, 9), (1, good, 9), (3, good, 9), (3, good, 9)]


def test_line_dedup_keeps_first_and_offsets(spark):
    line = "this line has more than ten words and it repeats across documents"
    docs = [(1, f"start\n{line}\nend"), (2, f"{line.upper()}\nmore"), (3, f"{line}\n{line}"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substrings.removed_spans(df).collect()}
    n = len(line)
    assert got == {1: "", 2: f"0:{n}", 3: f"0:{n},{n + 1}:{2 * n + 1}", 4: "", 5: ""}
    assert {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df).collect()} == {
        1: docs[0][1], 2: "more", 3: "", 4: None, 5: ""}


def test_passage_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(11)

    def words(n):
        return list(rng.choice([f"w{i}" for i in range(5000)], n))

    said, other, short = words(70), words(55), words(49)
    wrapped = "\n".join(" ".join(said[i:i + 6]) for i in range(0, 70, 6))
    line = " ".join(words(12))
    texts = [" ".join(words(9) + said + words(30)), "İ é😀 " + " ".join(words(20) + said + words(11)).upper(), " ".join(words(3)) + "\n" + wrapped + "\nend",
             " ".join(words(5) + short + words(5)), " ".join(words(5) + short + words(5)), f"a\n{line}\nb", f"{line}\nc " + "  ".join(other),
             " ".join(words(300) + other + said), None, "", " ".join(words(10) * 9)]
    docs = list(enumerate(texts)) + [(None, " ".join(words(4) + other))]
    seen, want = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        hit = set()
        at = [(m.start(), m.end(), m.group().lower()) for m in W.finditer(text or "")]
        for i in range(len(at) - 49):
            run = tuple(w for _, _, w in at[i:i + 50])
            if run in seen:
                hit |= set(range(at[i][0], at[i + 49][1]))
            seen.add(run)
        for m in re.finditer("[^\n]+", text or ""):
            if len(m.group().split()) >= 10:
                if (m.group().lower(),) in seen:
                    hit |= set(range(*m.span()))
                seen.add((m.group().lower(),))
        want[doc_id] = hit
    got = {r["doc_id"]: r for r in substrings.removed_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    spans = {d: [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x] for d, r in got.items()}
    assert {d: {c for a, b in s for c in range(a, b)} for d, s in spans.items()} == want
    assert all(r["removed_chars"] == len(want[d]) and r["n_removed"] == len(spans[d]) for d, r in got.items())
    assert all(want[d] for d in (1, 2, 6, 7, 10)) and not any(want[d] for d in (None, 0, 3, 4, 5, 8, 9))


def test_passages_among_alike_surroundings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [list(rng.choice(["a", "b", "c", "dd"], 40)) for _ in range(6)]

    def text():
        parts = [base[rng.integers(6)][rng.integers(20):][:rng.integers(5, 30)] for _ in range(rng.integers(1, 5))]
        return "".join(w + rng.choice([" ", "\n", "  "], p=[0.8, 0.1, 0.1]) for p in parts for w in p)

    docs = [(int(rng.integers(40)), text()) for _ in range(80)] + [(None, text()), (None, text()), (41, "x y " * 30), (42, None)]
    docs += docs[:5]
    rows = []
    for doc_id, t in docs:
        at = [(m.start(), m.end(), m.group()) for m in W.finditer(t or "")]
        rows += [(doc_id, at[i][0], at[i + 5][1], tuple(w for _, _, w in at[i:i + 6])) for i in range(len(at) - 5)]
    first, want = {}, set()
    for doc_id, start, _, run in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        first.setdefault(run, (doc_id, start))
    for doc_id, start, end, run in rows:
        if (doc_id, start) != first[run]:
            want |= {(doc_id, c) for c in range(start, end)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.repeated_passages(df, 6).collect()
    assert {(r["doc_id"], c) for r in got for c in range(r["start"], r["end"])} == want
    # whole copies are told by their surroundings: none of their runs is digested
    sizes, keep = {}, substrings.materialise
    monkeypatch.setattr(substrings, "materialise", lambda f, name: (out := keep(f, name), sizes.update({name: out.count()}))[0])
    said = " ".join(f"w{i}" for i in rng.permutation(300))
    copies = spark.createDataFrame([(i, said) for i in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substrings.removed_passages(copies).collect()}
    assert got == {0: ""} | {i: f"0:{len(said)}" for i in range(1, 4)} and sizes["runs"] == 0


def test_license_scan(spark):
    t = dict(licenses.TEMPLATES)
    docs = [(1, "Some words here. " + t["MIT"] + " more words"), (2, None), (3, "licensed under nothing at all today"),
            (4, t["GPL-3.0"].upper().replace(" ", "\n")), (5, " ".join(t.values()))]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(
        spark.createDataFrame(docs, "doc_id long, text string"), licenses.template_table(spark)).collect()}
    assert got == {(1, "MIT"), (4, "GPL-3.0")} | {(5, name) for name in t}


def test_license_wordings(spark):
    gnu = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
           "the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
    docs = [(1, gnu.format("program", "General Public License", 3), "GPL-3.0"), (2, gnu.format("program", "General Public License", 2), "GPL-2.0"),
            (3, gnu.format("library", "Lesser General Public License", 2.1), "LGPL-2.1"),
            (4, gnu.format("program", "Affero General Public License", 3), "AGPL-3.0"),
            (5, "# SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0-only"), (6, "(c) 2020 Somebody. All rights reserved.", "All-rights-reserved"),
            (7, "This page is under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
            (8, "This is free and unencumbered software released into the public domain.", "Unlicense"),
            (9, "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "LGPL-3.0"), (10, "see creativecommons.org/licenses/by/4.0/", "CC-BY-4.0"),
            (11, "all rights that were reserved", None), (12, "rights reserved", None)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(df, licenses.template_table(spark)).collect()}
    assert got == {(i, name) for i, _, name in docs if name}


def test_license_shingle_in_running_text_is_retrieved(spark):
    said = [f"released under the licence{i} terms" for i in range(12000)]
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} {x} e{i} f{i} g{i} h{i}") for i, x in enumerate(said)], "doc_id long, text string")
    found = licenses.scan_licenses(df, licenses.template_table(spark, [(f"L{i}", x) for i, x in enumerate(said)]))
    assert found.where("license = concat('L', doc_id)").count() == found.count() == 12000


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    keep = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
            lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m)),
            lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15)
    return [(k, *m.span()) for k, p in enumerate(BASE) for m in re.finditer(p, text) if keep[k](m.group())]


@pytest.mark.parametrize("text", [
    "a@b.co, c@d@e.f.g @x.y a.b@c", "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+49 (151) 234-5678 +1 2 +1-800-555-0199.", "é😀 x@y.zz +44 20 7946 0958", "", "@@@ +++ 1.2.3."])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_base_spans_random():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab01.@+- ("), 40))
        assert pii.base_spans(text) == brute_pii(text)


def test_pii_model_and_redaction(spark, awkward):
    assert min(pii.fit()[2]) > 0.9
    df = spark.createDataFrame([(1, "mail a@b.co or call me (555) 123-4567 now", 9), (2, None, None), (3, "born 1984-10-12", 15)],
                               "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [
        (1, "mail [EMAIL] or call me [PHONE] now", 35), (2, None, None), (3, "born 1984-10-12", 15)]
    assert pii.find_pii(awkward).count() == awkward.count()
    pii.base_spans("1" * 300_000 + "a" * 300_000 + "@")


def test_packing_is_whole(spark, awkward):
    rows = [r.asDict() for r in packing.pack(awkward).collect()]
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(rows) == packing.tokenise(awkward).count()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in awkward.collect()}


def test_plan_covers_histogram():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 5000)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    used, n = {}, 0
    for pattern, count in packing.plan_patterns(hist):
        assert sum(pattern) <= 2048 and count > 0
        n += count
        for x in pattern:
            used[x] = used.get(x, 0) + count
    gaps = []  # plain best-fit decreasing over the pieces
    for x in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, gaps.pop(at) - x if at < len(gaps) else 2048 - x)
    assert used == hist and n <= 1.02 * len(gaps)


def test_mixing_meets_targets_and_learns(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(600):
        kind = ("good", "junk", "rude")[i % 3]
        docs.append((i, " ".join(rng.choice([f"{kind}{j}" for j in range(20)] + [f"w{j}" for j in range(50)], 60))))
        if i < 400:
            labels.append((i, int(kind != "junk"), int(kind == "rude")))
    df = spark.createDataFrame(docs + [(1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mixing_rates(df, lab).toPandas()
    held = rows[(rows.doc_id >= 400) & (rows.doc_id < 600)]
    p = held[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert (p.argmax(1) == held.doc_id.to_numpy() % 3).mean() > 0.95
    share = [(rows.rate * rows.tokens * rows[f"p_{d}"]).sum() / rows.tokens.sum() for d in mixing.DOMAINS]
    assert np.allclose(share, mixing.GROWTH * np.array(mixing.TARGETS), atol=0.01) and (rows.rate >= 0).all()


@pytest.mark.parametrize("rare", [0.01, 0.0003])
@pytest.mark.parametrize("sure", [1.0, 0.95])
def test_mixing_meets_targets_of_a_rare_domain(spark, rare, sure):
    rng = np.random.default_rng(7)
    kind = rng.permutation(np.repeat([0, 1, 2], [int(20000 * (0.88 - rare)), int(20000 * rare), 2400]))
    p = np.full((len(kind), 3), (1 - sure) / 2)
    p[np.arange(len(kind)), kind] = sure
    # the soft rest of every other document weighs more than a rare domain: it goes below its goal of low and toxic
    p[kind == 0] = p[kind == 0] * (0.02 if sure < 1 else 1)
    p[kind == 0, 0] = 1 - p[kind == 0, 1:].sum(1)
    rows = [(i, 100, *map(float, x)) for i, x in enumerate(p)]
    soft = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    got = soft.withColumn("rate", mixing._rate(mixing.solve_rates(soft))).toPandas()
    share = (got.rate.to_numpy()[:, None] * p).mean(0)
    assert np.abs(share - mixing.GROWTH * np.array(mixing.TARGETS)).max() < 1e-4 and (got.rate >= 0).all()


def test_mixing_reports_targets_out_of_reach(spark):
    rows = [(i, 100, 0.9, 0.01, 0.09) for i in range(50)] + [(i, 100, 0.5, 0.02, 0.48) for i in range(50, 99)]
    soft = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    with pytest.warns(mixing.TargetsMissed, match="low -0.07"):
        dual = mixing.solve_rates(soft)
    got = soft.withColumn("rate", mixing._rate(dual)).toPandas()
    p = got[["p_clean", "p_low", "p_toxic"]].to_numpy()
    goal = mixing.GROWTH * np.array(mixing.TARGETS)
    gap = (got.rate.to_numpy()[:, None] * p).mean(0) - goal
    best = p[0] * max(0, p[0] @ goal) / (p[0] @ p[0]) - goal  # only the first kind of document is of use here
    assert np.allclose(gap, best, atol=1e-4)


def test_mixing_is_projected_gradient_on_the_rates(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([3, 0.4, 0.3], 400)
    t = rng.integers(0, 300, 400)
    soft = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p))],
                                 "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    soft = mixing.materialise(soft.coalesce(1), "soft")
    for targets, top in (((0.8, 0.12, 0.08), None), ((0.72, 0.18, 0.1), 1.5), ((0.85, None, 0.06), 3.0)):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", mixing.TargetsMissed)
            got = soft.withColumn("rate", mixing._rate(mixing.solve_rates(soft, targets, max_rate=top))).orderBy("doc_id").toPandas().rate.to_numpy()
        # the same steps on a vector of all rates, with the step size found by the power method
        on = np.array([x is not None for x in targets])
        goal = mixing.GROWTH * np.array([x or 0 for x in targets])
        a = p * t[:, None] / t.sum()
        scale = (p**2 * on / (a * p).sum(0)).sum(1)
        v = np.ones(3)
        for _ in range(2000):
            v = on * (a.T @ (scale * (p @ (on * v))))
            top_value, v = np.linalg.norm(v), v / np.linalg.norm(v)
        r, last = np.ones(400), None
        for _ in range(mixing.STEPS):
            gap = on * (a.T @ r - goal)
            if np.abs(gap).max() < 1e-4 or (last is not None and np.abs(gap - last).max() < 1e-6):
                break
            r, last = np.clip(r - scale * (p @ gap) / top_value, 0, top), gap
        assert np.allclose(got, r, atol=1e-6) and got.min() >= 0 and (top is None or got.max() <= top)


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (minhash.near_duplicates(none), quality.score(none), substrings.removed_spans(none), pii.find_pii(none),
                packing.pack(none), mixing.mixing_rates(none, lab), licenses.scan_licenses(none, licenses.template_table(spark))):
        assert out.count() == 0


def test_repeats_are_cut_from_the_rows_own_text(spark):
    line = "one line of ten words or more that every text repeats for sure"
    other = "a wholly different text of the same id whose first characters must stay as they are"
    rows = [(1, f"{line}\nend"), (2, other), (2, f"{line}\ntail"), (None, f"head\n{line}"), (3, None)]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, removed_spans string, t int")
    out = substrings.remove_repeats(df.repartition(3))
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["removed_spans"], r["t"]) for r in out.collect())
    n = len(line)
    # a null id ranks first and keeps its line
    assert got == sorted([(0, f"head\n{line}", "", 7), (1, "end", f"0:{n}", 7), (2, other, "", 7), (2, "tail", f"0:{n}", 7), (3, "", "", 7)])


def test_packing_encodes_as_the_tokenizer_does(spark):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a<|endoftext|>b", "plain words", "", None, "<|endoftext|>", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packing.tokenise(df).collect())
    want = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = sorted(r[1] for r in got if r[0] == i)
        assert cuts[0] == 0 and all(b - a == 2048 for a, b in zip(cuts[1:], [*cuts[2:], len(ids)])) if len(ids) > 2048 else cuts == [0]
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            want.append((i, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())))
    assert got == sorted(want)


def test_mix_takes_clashing_columns_and_repeated_ids(spark):
    good, bad = "the cat sat on a mat and the dog went to see it ", "zz## $$ %% qq "
    docs = [(i, (good if i % 2 else bad) * (2 + i % 3)) for i in range(60)] + [(1, bad * 3), (None, good), (2, None), (3, good * 2), (3, good * 2)]
    df = spark.createDataFrame([(*r, 5, "d", "k") for r in docs], "doc_id long, text string, n_copies int, _d string, _k string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = mixing.mix(df, labels, targets=(0.7, 0.3, 0.0))
    assert out.columns == df.columns and out.where("n_copies = 5 AND _d = 'd' AND _k = 'k'").count() == out.count() > 0
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= set(docs)
    assert mixing.mix(df.limit(0), labels).count() == 0


def test_added_spans_never_overlap_chosen_ones():
    text = "ids " + ".".join(f"10.0.0.{i}" for i in range(30)) + "@example.org and +49 30 1234567 or 030 1234567"
    base, every = pii.all_spans(text, pii.fit())
    added = [s for s in every if s not in base]
    for _, a, b in added:
        assert not any(a < y and x < b for _, x, y in [*base, *(s for s in added if s[1:] != (a, b))])


def test_kept_word_ids_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 40)
    monkeypatch.setattr(packing, "KEPT_WORDS", 30)
    enc = packing.WordIds(packing.default_tokenizer())
    assert enc.by_word
    texts = ["it's the dog's, they'll '' 's 're x'tyz \"'s", "a  b\n\n c \r\n\td\x0b 　e f g \x1c\x85h", "", " ", "\n", None,
             "naïve café العربية 中文字 १२ ½Ⅷ ʼ́ \U0001f469‍\U0001f469 \U00010100﻿",
             "one<|endoftext|> two", "word " * 60, "x" * 200 + " " * 90 + "y", "-- 12345 3.14 __init__ <b>&amp;</b>"]
    for text in texts * 2:
        want = enc.tok.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want, text
    given, whole = [], enc._whole
    monkeypatch.setattr(enc, "_whole", lambda t: (given.append(t), whole(t))[1])
    enc.encode("harbour ferry harbour ferry")
    enc.encode("harbour ferry harbour ferry")
    assert sorted("".join(given).split()) == ["ferry", "harbour"] + ["harbour"] and len(given) == 1  # first without its space
