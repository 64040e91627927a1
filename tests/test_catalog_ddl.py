from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.named import TRAM_CATALOG
from textsql.functions import ddl as D
from textsql.sources import catalog as C


@pytest.fixture()
def tram_raw(spark, tmp_path):
    p = tmp_path / "tables.json"
    p.write_text(json.dumps([TRAM_CATALOG]))
    return C.read_raw_catalog(spark, str(p), multiline=True)


def test_catalog_columns(tram_raw):
    cols = C.catalog_columns(tram_raw).orderBy("flat_index").collect()
    assert [(r.table_index, r.table_name, r.column_name, r.column_type, r.is_primary) for r in cols] == [
        (0, "depot", "no", "number", True), (0, "depot", "district", "text", False), (1, "tram car", "fleet_no", "number", True),
        (1, "tram car", "seats", "number", False), (1, "tram car", "built", "time", False), (1, "tram car", "depot_no", "number", False),
        (2, "line", "line_no", "number", False), (2, "line", "fleet_no", "number", False)]


def test_catalog_fks(tram_raw):
    fk = C.catalog_fks(tram_raw).orderBy("pos").collect()
    assert [(r.pos, r.from_table, r.from_column, r.to_table, r.to_column, r.to_table_name) for r in fk] == [
        (0, 1, "depot_no", 0, "no", "depot"), (1, 2, "fleet_no", 1, "fleet_no", "tram car")]


def test_tables_without_columns_stay(spark, tmp_path):
    raw = dict(TRAM_CATALOG, table_names_original=["depot", "tram car", "line", "closed"])
    p = tmp_path / "t.json"
    p.write_text(json.dumps([raw]))
    tables = C.catalog_tables(C.read_raw_catalog(spark, str(p), multiline=True)).collect()
    assert [(r.table_index, r.table_name) for r in tables] == [(0, "depot"), (1, "tram car"), (2, "line"), (3, "closed")]


def test_fk_touching_sentinel_dropped(spark, tmp_path):
    raw = dict(TRAM_CATALOG, foreign_keys=[[0, 1]])
    p = tmp_path / "t.json"
    p.write_text(json.dumps([raw]))
    assert C.catalog_fks(C.read_raw_catalog(spark, str(p), multiline=True)).count() == 0


def test_unequal_lists_raise(spark, tmp_path):
    raw = dict(TRAM_CATALOG, column_types=["text"])
    p = tmp_path / "t.json"
    p.write_text(json.dumps([raw]))
    with pytest.raises(Exception, match="differ in length"):
        C.catalog_columns(C.read_raw_catalog(spark, str(p), multiline=True)).collect()


def test_read_examples_positions(spark, tmp_path):
    p = tmp_path / "dev.json"
    texts = ["which depot?", "a line\nbreak", "ünïcode"]
    p.write_text(json.dumps([{"db_id": "trams", "question": t, "query": f"SELECT {i}"} for i, t in enumerate(texts)]))
    got = [(r.question_id, r.question, r.query) for r in C.read_examples(spark, str(p)).orderBy("question_id").collect()]
    assert got == [(i, t, f"SELECT {i}") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("name", "want"), [
    ("depot", "depot"), ("tram car", '"tram car"'), ('"as given"', '"as given"'), ("", '""'), ('6" gauge', '"6"" gauge"'),
    ("2nd_line", '"2nd_line"'), ("über_2", "über_2"), ("a-b", '"a-b"'),
])
def test_quote_ident(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(D.quote_ident("n")).first()[0] == want


def test_create_table_text(spark, tram_raw):
    cols = C.catalog_columns(tram_raw).filter("table_index = 1").orderBy("flat_index")
    lines = cols.agg(F.collect_list(D.column_line("column_name", "column_type", "is_primary")).alias("l"))
    fk = F.array(D.fk_line(F.lit("depot_no"), F.lit("depot"), F.lit("no")))
    got = lines.select(D.create_table(F.lit("tram car"), "l", fk)).first()[0]
    assert got == ('CREATE TABLE "tram car" (\n  fleet_no NUMBER PRIMARY KEY,\n  seats NUMBER,\n  built TIME,\n'
                   "  depot_no NUMBER,\n  FOREIGN KEY (depot_no) REFERENCES depot(no)\n);")
    empty = spark.range(1).select(D.create_table(F.lit("yard 7"), F.array().cast("array<string>"), F.lit(None))).first()[0]
    assert empty == 'CREATE TABLE "yard 7" ();'


def test_sample_rows_block_text(spark):
    df = spark.createDataFrame([(["fleet_no", "d"], [["101", "Harbour"], ["7", "Old Town"], ["1234567890", ""]])],
                               "h array<string>, r array<array<string>>")
    got = df.select(D.sample_rows_block("h", "r")).first()[0]
    assert got.split("\n") == ["/* sample rows:", "  fleet_no    d       ", "  101         Harbour ", "  7           Old Town",
                               "  1234567890          ", "*/"]
    none = df.select(D.sample_rows_block("h", F.array().cast("array<array<string>>"))).first()[0]
    assert none == ""


def test_cell_text(spark):
    df = spark.createDataFrame([(None,), ("a\tb\nc",), ("x" * 50,)], "v string")
    got = [r[0] for r in df.select(D.cell_text("v", 40)).collect()]
    assert got == ["NULL", "a b c", "x" * 39 + "…"]


def test_table_documents_and_schema_block(spark, tram_raw):
    from textsql.operators.linking import render_schema_blocks, table_documents

    cols = C.catalog_columns(tram_raw)
    docs = {r.table_index: r.text for r in table_documents(cols).collect()}
    assert docs == {0: "depot no district", 1: "tram car fleet_no seats built depot_no", 2: "line line_no fleet_no"}
    blocks = spark.createDataFrame([("trams", 0, "first", ""), ("trams", 2, "third", None), ("trams", 1, "second", "rows of it")],
                                   "db_id string, table_index long, ddl string, sample_block string")
    kept = spark.createDataFrame([(7, "trams", 2), (7, "trams", 1), (7, "trams", 0), (8, "trams", 2)],
                                 "question_id long, db_id string, table_index long")
    got = {r.question_id: r.schema_block for r in render_schema_blocks(kept, blocks).collect()}
    assert got == {7: "first\n\nsecond\n\nrows of it\n\nthird", 8: "third"}
