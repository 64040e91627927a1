"""From a catalog to the prompt's schema block (A1, A2, P3, P4, W3, SURVEY 2.11).

A database is one row: its tables with their sizes and its FK list, as arrays (a catalog file holds the same as one
object). The size of a kept set is the tables' own text plus the FK lines whose two ends are both kept, plus a
blank line between parts, so a choice is sized without rendering it. Databases that fit the budget
whole keep every table and are never scored; the others are scored by BM25 and closed over their FK list in
the row. Only then are the kept tables rendered, with all their FK lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ddl import column_line, create_table, fk_line, sample_rows_block
from ..sources.catalog import catalog_table_lists
from ..session import stored
from .linking import MIN_TABLES_KEPT, SCHEMA_BUDGET_CHARS, bm25_scores, fold_closure, render_schema_blocks, top_tables

_FKS = "array<struct<pos:bigint,a:bigint,b:bigint,chars:bigint>>"


def rendered_tables(raw: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per table of the catalog, those without columns too: db_id, table_index, table_name, headers, ddl
    (with all FK lines), sample_block, doc (the BM25 document), base_chars, parts, db_fks (the FK list of the catalog row,
    at its first table).

    ``samples``: (db_id, table_index, rows array<array<string>>), rows as cell text; a table with a row in it
    counts its sample text as a part of its own when it is sized, even an empty one.
    """
    key = ["db_id", "table_index"]
    parts = {"column": lambda name, kind, primary: {"name": name, "line": column_line(name, kind, primary)},
             "fk": lambda f: {"line": fk_line(f["from_column"], f["to_table_name"], f["to_column"])}}
    if samples is not None:  # joined by database, where a catalog row still holds all of its tables
        lists = samples.groupBy("db_id").agg(F.collect_list(F.struct("table_index", "rows")).alias("__samples"))
        t = catalog_table_lists(raw.join(lists, "db_id", "left"), "__samples", **parts)
        own = F.transform(F.filter("__samples", lambda s: s["table_index"] == F.col("table_index")), lambda s: s["rows"])
        t = t.select("*", F.posexplode_outer(own).alias("__nth", "__rows"))  # a repeated sample repeats its table
    else:
        t = catalog_table_lists(raw, **parts).select(
            "*", F.lit(0).alias("__nth"), F.lit(None).cast("array<array<string>>").alias("__rows"))
    # lists that are used more than once are columns of their own, so that each is built once a row
    t = t.select(
        *key, "table_name", "__rows", F.when(F.coalesce("__nth", F.lit(0)) == 0, F.transform("db_fks", lambda f: F.struct(
            f["pos"].alias("pos"), f["from_table"].cast("long").alias("a"), f["to_table"].cast("long").alias("b"),
            (F.length(f["line"]) + 2).cast("long").alias("chars")))).alias("db_fks"),  # a line and the comma and break before it
        F.transform("columns", lambda c: c["name"]).alias("headers"),
        F.transform("columns", lambda c: c["line"]).alias("__lines"),
        F.transform("fks", lambda f: f["line"]).alias("__fk_lines"),
        F.array_join(F.flatten("__rows"), " ").alias("__sample_text"))
    return t.select(
        *key, "table_name", "headers",
        create_table("table_name", "__lines", "__fk_lines").alias("ddl"),
        F.when(F.size("headers") > 0, sample_rows_block("headers", "__rows")).otherwise("").alias("sample_block"),
        F.concat_ws(" ", "table_name", F.array_join("headers", " "), "__sample_text").alias("doc"),
        (F.length(create_table("table_name", "__lines", F.array().cast("array<string>"))) +
         F.coalesce(F.length("__sample_text"), F.lit(0))).cast("long").alias("base_chars"),
        F.when(F.col("__rows").isNull(), 1).otherwise(2).alias("parts"), "db_fks")


def database_rows(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """(db_id, tabs, fks): a database's tables with their sizes, and its FK list with each line's own size.

    tables: ``rendered_tables`` of ``raw``; the FK lists were resolved there and come with the first tables, so that the
    catalog is not read again."""
    return tables.groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("table_index").cast("long").alias("table_index"), "base_chars", F.size("headers").alias("n_cols"), "parts"))).alias("tabs"),
        F.array_sort(F.flatten(F.collect_list("db_fks"))).cast(_FKS).alias("fks"))


def kept_size(kept: Column, tabs: Column, fks: Column) -> Column:
    """Length of the rendered text of the kept tables, an FK line counting where both its ends are kept."""
    inside = F.filter(tabs, lambda t: F.array_contains(kept, t["table_index"]))
    zero = F.lit(0).cast("long")
    own = F.aggregate(inside, zero, lambda n, t: n + t["base_chars"])
    parts = F.aggregate(inside, zero, lambda n, t: n + t["parts"])
    edges = F.aggregate(F.filter(fks, lambda f: F.array_contains(kept, f["a"]) & F.array_contains(kept, f["b"])), zero,
                        lambda n, f: n + f["chars"])
    return own + edges + 2 * F.greatest(parts - 1, zero)


def choose_tables(questions: DataFrame, dbs: DataFrame, docs: DataFrame, budget_chars: int = SCHEMA_BUDGET_CHARS,
                  min_tables: int = MIN_TABLES_KEPT) -> DataFrame:
    """(question_id, db_id, whole, tables, chars). ``whole`` databases fit as they are; of the others the FK
    closure of the ``min_tables`` best tables is kept (more seeds can only make it larger).

    questions: (question_id, db_id, question); dbs: ``database_rows``; docs: (db_id, table_index, text).
    A question whose database is not in the catalog gives no row.
    """
    every = F.transform("tabs", lambda t: t["table_index"])
    sized = dbs.withColumn("whole", kept_size(every, F.col("tabs"), F.col("fks")) <= budget_chars)
    # sized once; scoring, ranking and the choice read what is written here
    q = stored(questions.select("question_id", "db_id", "question").join(sized, "db_id"), "chosen-sized")
    over = q.where(~F.col("whole")).select("question_id", "db_id", "question")
    seeds = top_tables(bm25_scores(docs, over, small_databases=True), docs, over, k=max(min_tables, 1)).groupBy("question_id").agg(
        F.collect_list(F.col("table_index").cast("long")).alias("seeds"))
    kept = F.when(F.col("whole"), every).otherwise(F.array_sort(fold_closure(F.col("seeds"), F.col("fks"))))
    out = q.drop("question").join(seeds, "question_id", "left").withColumn("tables", kept)
    return out.select("question_id", "db_id", "whole", "tables", kept_size(F.col("tables"), F.col("tabs"), F.col("fks")).alias("chars"))


def schema_blocks(raw: DataFrame, questions: DataFrame, samples: DataFrame | None = None,
                  budget_chars: int = SCHEMA_BUDGET_CHARS, min_tables: int = MIN_TABLES_KEPT) -> DataFrame:
    """The whole chain: (question_id, db_id, whole, tables, chars, schema_block)."""
    tables = stored(rendered_tables(raw, samples), "tables")  # read by sizing, scoring and rendering
    chosen = stored(choose_tables(questions, database_rows(raw, tables),
                                  tables.select("db_id", "table_index", F.col("doc").alias("text")), budget_chars, min_tables), "chosen")
    kept = chosen.select("question_id", "db_id", F.explode("tables").alias("table_index"))
    return chosen.join(render_schema_blocks(kept, tables), "question_id", "left").withColumn(
        "schema_block", F.coalesce("schema_block", F.lit("")))
