"""Schema catalogs and examples.

The catalog file is the Spider ``tables.json`` layout: one object per database with parallel
arrays (tables, flat ``[table_index, column_name]`` pairs starting with the ``[-1, "*"]``
sentinel, column types, primary keys and FK pairs as flat column indexes). It is read with an
explicit schema and exploded with positions; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.ddl import cell_text
from .lines import read_array

RAW_CATALOG_SCHEMA = StructType([
    StructField("db_id", StringType(), False),
    StructField("table_names_original", ArrayType(StringType()), True),
    # [int, str] pairs: read as strings, the index cast afterwards.
    StructField("column_names_original", ArrayType(ArrayType(StringType())), True),
    StructField("column_types", ArrayType(StringType()), True),
    StructField("primary_keys", ArrayType(LongType()), True),
    StructField("foreign_keys", ArrayType(ArrayType(LongType())), True),
])

EXAMPLE_SCHEMA = StructType([
    StructField("db_id", StringType(), True),
    StructField("question", StringType(), True),
    StructField("query", StringType(), True),
])


def read_raw_catalog(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A1 read side: JSON lines, or one JSON array with ``multiline=True`` (read in splits)."""
    if multiline:
        return read_array(spark, path, RAW_CATALOG_SCHEMA)
    return spark.read.schema(RAW_CATALOG_SCHEMA).json(path)


def catalog_tables(raw: DataFrame) -> DataFrame:
    """A1: one row per table, in list order: (db_id, table_index, table_name). A table without columns is one too."""
    return raw.select("db_id", F.posexplode("table_names_original").alias("table_index", "table_name"))


def _fields(**values: Column) -> Column:
    return F.named_struct(*[x for name, value in values.items() for x in (F.lit(name), value)])


def _checked(lists: Column) -> Column:
    return F.when(F.size("column_names_original") != F.size("column_types"),
                  F.raise_error(F.concat(F.lit("catalog lists differ in length for "), F.col("db_id")))).otherwise(lists)


def _is_primary(i: Column) -> Column:
    return F.coalesce(F.array_contains("primary_keys", i.cast("bigint")), F.lit(False))


def column_list() -> Column:
    """A catalog row's real columns in list order, resolved by array indexing in the row."""
    pairs, names, types = F.col("column_names_original"), F.col("table_names_original"), F.col("column_types")
    real = F.filter(F.transform(pairs, lambda p, i: _fields(t=p[0].cast("int"), i=i, name=p[1])),
                    lambda c: c["t"] != -1)
    return _checked(F.transform(real, lambda c: _fields(
        table_index=c["t"],
        table_name=F.element_at(names, c["t"] + 1),
        flat_index=c["i"].cast("bigint"),
        column_name=c["name"],
        column_type=F.element_at(types, c["i"] + 1),
        is_primary=_is_primary(c["i"]))))


def catalog_columns(raw: DataFrame) -> DataFrame:
    """A1: one row per real column: (db_id, table_index, table_name, flat_index, column_name,
    column_type, is_primary). Unequal pair/type list lengths fail the job. ``catalog_tables`` lists the
    tables themselves, those without columns too."""
    return raw.select("db_id", F.inline(column_list()))


def fk_list() -> Column:
    """A catalog row's FK pairs resolved to tables and columns, in list order without those that touch the sentinel."""
    pairs, names = F.col("column_names_original"), F.col("table_names_original")

    def ends(fk, pos):
        src, dst = F.element_at(pairs, fk[0].cast("int") + 1), F.element_at(pairs, fk[1].cast("int") + 1)
        return _fields(pos=pos.cast("bigint"), from_table=src[0].cast("int"), from_column=src[1],
                       to_table=dst[0].cast("int"), to_column=dst[1])

    real = F.filter(F.transform("foreign_keys", ends), lambda f: (f["from_table"] != -1) & (f["to_table"] != -1))
    return F.transform(real, lambda f: _fields(
        pos=f["pos"], from_table=f["from_table"], from_column=f["from_column"], to_table=f["to_table"],
        to_column=f["to_column"], to_table_name=F.element_at(names, f["to_table"] + 1)))


def catalog_fks(raw: DataFrame) -> DataFrame:
    """A2: FK flat-index pairs resolved to (table, column) names, list order kept in ``pos``;
    pairs touching the sentinel are dropped. Resolution is array indexing in the same row."""
    return raw.select("db_id", F.inline(fk_list()))


def catalog_table_lists(raw: DataFrame, *more: str, column=None, fk=None) -> DataFrame:
    """A1 and A2 by table: (db_id, table_index, table_name, columns, fks), the rows of ``catalog_columns`` and
    ``catalog_fks`` as arrays in list order, and the columns ``more`` of ``raw`` as they are. A catalog row holds all
    of its database, so nothing is shuffled. A null db_id names no database whose keys could be followed.

    ``column(name, type, is_primary)`` and ``fk(entry)`` name the fields to build of a column and of an FK pair (given
    together, instead of all fields, each built once a catalog row); the database's whole FK list is then added
    at its first table as ``db_fks``."""
    types, names = F.col("column_types"), F.col("table_names_original")
    if column is None:
        columns, fks = column_list(), fk_list()
    else:  # the sentinel has no table's index, so it is left behind with the row
        columns = _checked(F.transform("column_names_original", lambda p, i: _fields(
            table_index=p[0].cast("int"), **column(p[1], F.element_at(types, i + 1), _is_primary(i)))))
        fks = F.transform(fk_list(), lambda f: _fields(pos=f["pos"], from_table=f["from_table"], to_table=f["to_table"], **fk(f)))
    lists = raw.select("db_id", names, *more, columns.alias("__cols"), F.when(F.col("db_id").isNotNull(), fks).alias("__fks"))
    none = {c: F.array().cast(lists.schema[c].dataType) for c in ("__cols", "__fks")}

    def table(name, at):  # only its own columns and keys leave the row
        whole = {} if column is None else {"db_fks": F.when(at == 0, F.col("__fks"))}
        return _fields(table_index=at, table_name=name,
                       columns=F.coalesce(F.filter("__cols", lambda c: c["table_index"] == at), none["__cols"]),
                       fks=F.coalesce(F.filter("__fks", lambda f: f["from_table"] == at), none["__fks"]), **whole)

    t = lists.select("db_id", *more, F.inline(F.transform(names, table)))
    return t.select("db_id", "table_index", "table_name", *more, "columns", "fks", *([] if column is None else ["db_fks"]))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A3: a JSON array of examples; question_id = position in the array, whatever the number of tasks
    that read it."""
    return read_array(spark, path, EXAMPLE_SCHEMA, "question_id")


def sample_rows(table: DataFrame, order_cols, n: int = 3, cell_truncate: int = 40,
                group_cols=()) -> DataFrame:
    """The first ``n`` rows (by an explicit order) of a table -- or of every group of a
    long table -- with every cell as cell text (P5). Group-limited window: Spark keeps the top
    n per group map-side before the shuffle."""
    cols = [c for c in table.columns if c not in group_cols]
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        t = table.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    else:
        t = table.orderBy(*order_cols).limit(n).withColumn("__r", F.lit(None).cast("int"))
    return t.select(*group_cols, "__r", F.array(*[cell_text(F.col(c), cell_truncate) for c in cols]).alias("cells"))


def corpus_check(examples: DataFrame, schemas: DataFrame, data_dbs: DataFrame) -> DataFrame:
    """A16 + G14 + J7 + J8: example count, distinct databases, databases without a schema or
    without data, examples whose database has a schema. One row.

    Examples are first counted per database (partial aggregate); the schema and data flags are
    semi-join style left joins at database granularity; one global aggregate finishes."""
    per_db = examples.groupBy("db_id").agg(F.count(F.lit(1)).alias("__n"))
    flags = (per_db
             .join(schemas.select("db_id").distinct().withColumn("__s", F.lit(True)), "db_id", "left")
             .join(data_dbs.select("db_id").distinct().withColumn("__d", F.lit(True)), "db_id", "left"))
    has_s, has_d = F.coalesce(F.col("__s"), F.lit(False)), F.coalesce(F.col("__d"), F.lit(False))
    return flags.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n_examples"),
        F.count(F.lit(1)).alias("n_dbs"),
        F.count_if(~has_s).alias("n_dbs_without_schema"),
        F.count_if(~has_d).alias("n_dbs_without_data"),
        F.coalesce(F.sum(F.when(has_s, F.col("__n"))), F.lit(0)).cast("bigint").alias("n_examples_with_schema"),
    )


__all__ = [
    "RAW_CATALOG_SCHEMA", "read_raw_catalog", "catalog_columns", "catalog_fks", "catalog_tables", "catalog_table_lists", "read_examples",
    "sample_rows", "corpus_check", "IntegerType",
]


def first_examples(examples: DataFrame, n: int | None = None, order_col: str = "question_id") -> DataFrame:
    """All examples, or the first ``n`` by id (a limit is the feature here)."""
    return examples if n is None else examples.orderBy(order_col).limit(n)
