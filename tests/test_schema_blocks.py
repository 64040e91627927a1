"""The chain from a catalog to the prompt's schema block."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from textsql.operators import schema_blocks as SB
from textsql.sources import catalog as C


def small_catalog():
    """A harbour with a chain of references, a table without columns, and an archive that fits whole."""
    return [
        {"db_id": "harbour", "table_names_original": ["berth", "vessel", "crew member", "empty", "cargo"],
         "column_names_original": [[-1, "*"], [0, "berth_no"], [0, "depth"], [1, "vessel_no"], [1, "berth_no"], [2, "crew no"],
                                   [2, "vessel_no"], [4, "cargo_no"], [4, "tonnes"], [4, "vessel_no"]],
         "column_types": ["text", "number", "number", "number", "number", "number", "number", "number", "", "number"],
         "primary_keys": [1, 3, 5, 7], "foreign_keys": [[4, 1], [6, 3], [9, 3]]},
        {"db_id": "archive", "table_names_original": ["paper"], "column_names_original": [[-1, "*"], [0, "title"]],
         "column_types": ["text", "text"], "primary_keys": [], "foreign_keys": []}]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "tables.json"
    path.write_text(json.dumps(small_catalog()))
    return C.read_raw_catalog(spark, str(path), multiline=True)


def rendered(tables, kept, fks):
    """The text whose length is budgeted: FK lines only between kept tables, sample text unframed."""
    parts = []
    for i, name, cols, sample in tables:
        if i not in kept:
            continue
        lines = [*cols, *[line for a, b, line in fks if a == i and b in kept]]
        parts.append(f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n);" if cols else f"CREATE TABLE {name} ();")
        if sample is not None:
            parts.append(sample)
    return "\n\n".join(parts)


TABLES = [(0, "berth", ["  berth_no NUMBER PRIMARY KEY", "  depth NUMBER"], "7 12"),
          (1, "vessel", ["  vessel_no NUMBER PRIMARY KEY", "  berth_no NUMBER"], None),
          (2, '"crew member"', ['  "crew no" NUMBER PRIMARY KEY', "  vessel_no NUMBER"], None),
          (3, "empty", [], ""),
          (4, "cargo", ["  cargo_no NUMBER PRIMARY KEY", "  tonnes TEXT", "  vessel_no NUMBER"], "1 2 3 4 5 6")]
FKS = [(1, 0, "  FOREIGN KEY (berth_no) REFERENCES berth(berth_no)"), (2, 1, "  FOREIGN KEY (vessel_no) REFERENCES vessel(vessel_no)"),
       (4, 1, "  FOREIGN KEY (vessel_no) REFERENCES vessel(vessel_no)")]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("harbour", 0, [["7", "12"]]), ("harbour", 3, []), ("harbour", 4, [["1", "2", "3"], ["4", "5", "6"]])]
    return spark.createDataFrame(rows, "db_id string, table_index int, rows array<array<string>>")


def test_every_table_is_kept_and_rendered(raw, samples):
    t = {(r.db_id, r.table_index): r for r in SB.rendered_tables(raw, samples).collect()}
    assert len(t) == 6 and t["harbour", 3].ddl == "CREATE TABLE empty ();" and t["harbour", 3].sample_block == ""
    assert t["harbour", 4].ddl == rendered(TABLES, {4, 1}, FKS).split("\n\n")[1]
    assert t["harbour", 0].doc == "berth berth_no depth 7 12"
    assert t["harbour", 4].sample_block.split("\n")[1:3] == ["  cargo_no  tonnes  vessel_no", "  1         2       3        "]


def test_size_of_any_kept_set_is_its_rendered_length(spark, raw, samples):
    dbs = SB.database_rows(raw, SB.rendered_tables(raw, samples)).where("db_id = 'harbour'")
    sets = [[i for i in range(5) if m >> i & 1] for m in range(32)]
    df = dbs.withColumn("kept", F.explode(F.from_json(F.lit(json.dumps(sets)), "array<array<bigint>>")))
    for r in df.select("kept", SB.kept_size(F.col("kept"), F.col("tabs"), F.col("fks")).alias("chars")).collect():
        assert r.chars == len(rendered(TABLES, set(r.kept), FKS)), r.kept


def test_choice_by_budget(spark, raw, samples):
    q = spark.createDataFrame([(1, "harbour", "how many tonnes of cargo"), (2, "archive", "x"), (3, "harbour", "zzz"), (4, "gone", "x")],
                              "question_id long, db_id string, question string")
    whole = len(rendered(TABLES, set(range(5)), FKS))
    got = {r.question_id: r for r in SB.schema_blocks(raw, q, samples, budget_chars=whole).collect()}
    assert sorted(got) == [1, 2, 3] and all(r.whole for r in got.values())
    assert got[1].tables == [0, 1, 2, 3, 4] and got[1].chars == whole and got[1].schema_block.count("CREATE TABLE") == 5
    got = {r.question_id: r for r in SB.schema_blocks(raw, q, samples, budget_chars=whole - 1, min_tables=1).collect()}
    # one ordered pass: cargo reaches vessel by the last key, too late for the keys before it
    assert not got[1].whole and got[1].tables == [1, 4] and got[2].whole
    assert got[3].tables == [0, 1, 2, 4]  # nothing matches: the first table, and all keys follow in order
    assert got[1].chars == len(rendered(TABLES, {1, 4}, FKS))
    assert "REFERENCES berth(berth_no)" in got[1].schema_block  # rendering shows every key of a kept table


def test_closure_against_a_plain_pass(spark):
    from textsql.operators.linking import closed_sets

    rng = random.Random(4)
    fks, seeds, want = [], [], {}
    for db in range(30):
        keys = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(0, 14))]
        fks += [(str(db), i, a, b) for i, (a, b) in enumerate(keys)]
        seed = {rng.randrange(9) for _ in range(rng.randint(1, 3))}
        seeds += [(db, str(db), s) for s in seed]
        for a, b in keys:
            if a in seed or b in seed:
                seed |= {a, b}
        want[db] = sorted(seed)
    edges = spark.createDataFrame(fks, "db_id string, pos long, from_table long, to_table long")
    got = closed_sets(spark.createDataFrame(seeds, "question_id long, db_id string, table_index long"), edges)
    assert {r.question_id: r.tables for r in got.collect()} == want


def test_catalog_lists_need_no_shuffle(spark):
    """a catalog row holds its database, so DDL is built where the row is read, columns and keys in list order."""
    from textsql.sources.catalog import catalog_table_lists

    rows = [{**db, "column_names_original": [[str(x) for x in pair] for pair in db["column_names_original"]]} for db in small_catalog()]
    t = catalog_table_lists(spark.createDataFrame(rows, C.RAW_CATALOG_SCHEMA))
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    got = {(r.db_id, r.table_index): r for r in t.collect()}
    assert [c.column_name for c in got["harbour", 4].columns] == ["cargo_no", "tonnes", "vessel_no"]
    assert got["harbour", 3].columns == [] and [f.to_table_name for f in got["harbour", 2].fks] == ["vessel"]


def test_blocks_leave_no_checkpoint(spark, raw, samples, tmp_path, monkeypatch):
    """rendered tables are kept once, compressed; nothing is written as an uncompressed checkpoint."""
    import textsql.session as session

    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    monkeypatch.setattr(session, "cut_lineage", lambda df: pytest.fail("checkpoint"))
    q = spark.createDataFrame([(1, "harbour", "cargo")], "question_id long, db_id string, question string")
    assert len(SB.schema_blocks(raw, q, samples, budget_chars=10).collect()) == 1
    assert sorted({p.name.split("-")[0] for p in tmp_path.iterdir()}) == ["chosen", "tables", "terms"]


def test_small_databases_score_alike(spark):
    """F1: scores of databases that fit in a row are those of the joined postings, with repeated tables, words and
    questions, and with texts and indexes that are null."""
    from textsql.operators.linking import bm25_scores

    rng = random.Random(9)
    words = ["quay", "berth_no", "crane", "Berth", "tide", "pier 7", "no"]
    docs = [(str(db), rng.choice([0, 1, 2, 3, None]), None if rng.random() < .1 else " ".join(rng.choices(words, k=rng.randrange(9))))
            for db in range(12) for _ in range(rng.randrange(1, 7))] + [(None, 0, "quay")]
    asked = [(i % 9, str(rng.randrange(14)), " ".join(rng.choices(words + ["none"], k=4))) for i in range(30)] + [(99, "0", "")]
    corpus = spark.createDataFrame(docs, "db_id string, table_index int, text string")
    q = spark.createDataFrame(asked, "question_id long, db_id string, question string")
    got, want = ({(r.question_id, r.db_id, r.table_index): r.score for r in bm25_scores(corpus, q, small_databases=s).collect()}
                 for s in (True, False))
    assert len(want) > 20 and got == pytest.approx(want, abs=1e-12)


def test_many_question_terms_are_joined(spark, monkeypatch):
    from textsql.operators import linking

    corpus = spark.createDataFrame([("a", 0, "quay tide"), ("a", 1, None), ("a", 1, "tide tide pier"), ("b", 0, "quay")],
                                   "db_id string, table_index int, text string")
    q = spark.createDataFrame([(1, "a", "tide pier"), (2, "a", "quay"), (3, "b", "x")], "question_id long, db_id string, question string")
    in_row = {tuple(r)[:3]: r.score for r in linking.bm25_scores(corpus, q).collect()}
    monkeypatch.setattr(linking, "ROW_TERMS", 0)
    assert len(in_row) == 3 and in_row == pytest.approx({tuple(r)[:3]: r.score for r in linking.bm25_scores(corpus, q).collect()}, abs=1e-12)


def test_catalog_is_read_once(spark, raw, samples, monkeypatch):
    """sizes come from what was rendered; the catalog and the choice's inputs are not read again for them."""
    tables = SB.rendered_tables(raw, samples)
    rows = {r.db_id: r for r in SB.database_rows(None, tables).collect()}
    assert [(f.pos, f.a, f.b) for f in rows["harbour"].fks] == [(0, 1, 0), (1, 2, 1), (2, 4, 1)] and rows["archive"].fks == []
    twice = SB.rendered_tables(raw, samples.unionByName(samples.where("table_index = 0")))
    rows = {r.db_id: r for r in SB.database_rows(raw, twice).collect()}
    assert len(rows["harbour"].tabs) == 6 and len(rows["harbour"].fks) == 3
