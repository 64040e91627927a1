"""Embeddings, pages, conversations and the pipeline."""

import hashlib

import numpy as np
from textsql.llm import chat, embeddings, warc

from tests.named import SF_SMALL


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] + rng.normal(size=8) * 0.12)], i % 3) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, rows[0][1], 0), (702, None, 1), (703, [0.0] * 8, 1), (704, [float("nan")] * 8, 1),
             (705, [1.0, None] * 4, 1), (706, rows[0][1], None), (707, [1.0, 2.0], 0), (708, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    usable = {i: (np.array(v, float), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (x, a) in usable.items():
        for j, (y, b) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    comp = {i: i for i in links}
    for _ in range(30):
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    assert sum(map(len, links.values())) > 100
    assert got == {i: (len(links[i]), comp[i]) for i in links}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_warc_round_trip_and_determinism(spark, tmp_path):
    big = "é" * 80
    rows = [(3, "http://c\r\nX: y", big), (1, "http://a", "tiny"), (2, "http://b", "tiny"), (4, None, big), (5, "u", None), (6, "v", "\r\n\r\nWARC/1.1" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums = []
    for name in ("one", "two"):
        files = warc.write_warc(df, str(tmp_path / name), roll_bytes=300, shards=2)
        sums.append(sorted((r["file"], r["sha256"]) for r in files.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 1
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "one")).collect()}
    for page_id, url, html in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(data), hashlib.sha256(data).hexdigest(), url or "")
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if page_id == 4 else ("response", None))
    empty = str(tmp_path / "none")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_repeated_pages_lose_no_payload(spark, tmp_path):
    a, b, c = "alpha " * 30, "beta " * 30, "gamma " * 30
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (7, "v", b), (5, "w", b), (9, "x", c), (9, "x", c), (9, "x", "tiny"), (9, "x", "tiny"),
            (None, "n", c), (None, "n", "only null " * 20), (None, "m", "only null " * 20), (2, "x", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, owner int")
    warc.write_warc(df.repartition(4), str(tmp_path / "w"), shards=3)
    got = [r.asDict() for r in warc.read_warc(spark, str(tmp_path / "w")).collect()]
    assert len(got) == len(rows)
    kinds = sorted(((r["page_id"] or 0), r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(1, sha(a), "response", None), (5, sha(a), "revisit", 1), (5, sha(b), "response", None), (5, sha(b), "revisit", 5), (7, sha(b), "revisit", 5),
            (9, sha(c), "response", None), (9, sha(c), "revisit", 9), (9, sha("tiny"), "response", None), (9, sha("tiny"), "response", None),
            (0, sha(c), "revisit", 9), (0, sha("only null " * 20), "response", None), (0, sha("only null " * 20), "revisit", None), (2, sha(None), "response", None)]
    assert sorted(map(repr, kinds)) == sorted(map(repr, want))
    bodies = {r["payload_digest"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert {sha(t) for _, _, t in rows} == set(bodies) and all(hashlib.sha256(v).hexdigest() == k for k, v in bodies.items())


def test_chat_round_trip(spark):
    nasty = "a\\n<|im_end|>\n<|im_start|>assistant\nx \\"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", "\n\n  hi 😀<|" + nasty), (1, 2, "assistant", None), (1, 3, "assistant", "last "),
            (2, 1, None, "b"), (2, 0, "sys\ntem", None), (2, 1, None, "b"), (None, None, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    for r in out.collect():
        turns = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"]))
        assert chat.parse(r["formatted"]) == [(ro, x) for _, ro, x in turns]
        loss = "".join(chat.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"])
        assert loss == "".join(x for _, ro, x in turns if ro == "assistant")
        assert len(r["ids"]) == len(r["loss_mask"])
    assert chat.digests(out).count() == 3 and chat.format_conversations(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = cp.table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, docs = docs, cp.materialise(stage(spark, docs, SF_SMALL), name)
        if name != "packing":
            assert docs.columns == columns and docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert docs.where("offset + length > 2048").count() == 0 and docs.count() > 0
