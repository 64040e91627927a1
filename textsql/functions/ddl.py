"""Schema rendering Columns (P1-P5): identifiers, column lines, CREATE TABLE, sample-row blocks,
cell text. Per-table arrays (columns, FKs, sample rows) are bounded by the catalog, so rendering
is higher-order array functions over one row per table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# --- fixed values -----------------------------------------------------------------------------
BARE_IDENT_RE = r"^\p{L}[\p{L}\p{N}_]*$"
NULL_CELL = "NULL"
ELLIPSIS = "…"
CELL_TRUNCATE = 40
SAMPLE_ROWS = 3
# ----------------------------------------------------------------------------------------------


def quote_ident(name: Column | str) -> Column:
    """P1: '' -> ``""``; already double-quoted -> unchanged; letter then letters/digits/_ ->
    bare; otherwise wrapped in double quotes with inner quotes doubled."""
    n = col_(name)
    return (
        F.when(n == "", F.lit('""'))
        .when(n.startswith('"') & n.endswith('"'), n)
        .when(n.rlike(BARE_IDENT_RE), n)
        .otherwise(F.concat(F.lit('"'), F.replace(n, F.lit('"'), F.lit('""')), F.lit('"')))
    )


def column_line(name: Column | str, ctype: Column | str, is_primary: Column | str) -> Column:
    """``  name TYPE[ PRIMARY KEY]`` (empty type -> TEXT)."""
    t = col_(ctype)
    typ = F.when(t.isNull() | (t == ""), F.lit("TEXT")).otherwise(F.upper(t))
    pk = F.when(F.coalesce(col_(is_primary), F.lit(False)), F.lit(" PRIMARY KEY")).otherwise(F.lit(""))
    return F.concat(F.lit("  "), quote_ident(name), F.lit(" "), typ, pk)


def fk_line(from_column: Column, to_table: Column, to_column: Column) -> Column:
    return F.concat(F.lit("  FOREIGN KEY ("), quote_ident(from_column), F.lit(") REFERENCES "),
                    quote_ident(to_table), F.lit("("), quote_ident(to_column), F.lit(")"))


def create_table(table_name: Column | str, column_lines: Column | str, fk_lines: Column | str) -> Column:
    """CREATE TABLE with column lines then FK lines, comma-separated; no columns ->
    ``CREATE TABLE t ();``. Lines are ``array<string>`` already in order."""
    cl, fl = col_(column_lines), F.coalesce(col_(fk_lines), F.array().cast("array<string>"))
    body = F.array_join(F.concat(cl, fl), ",\n")
    name = quote_ident(table_name)
    return F.when(F.size(cl) == 0, F.concat(F.lit("CREATE TABLE "), name, F.lit(" ();"))).otherwise(
        F.concat(F.lit("CREATE TABLE "), name, F.lit(" (\n"), body, F.lit("\n);")))


def cell_text(value: Column | str, cell_truncate: int = CELL_TRUNCATE) -> Column:
    """P5: NULL -> 'NULL'; newline/tab -> space; longer than the limit -> first limit-1
    characters plus an ellipsis."""
    s = F.translate(col_(value).cast("string"), "\n\t", "  ")
    cut = F.concat(F.substring(s, 1, cell_truncate - 1), F.lit(ELLIPSIS))
    return F.when(s.isNull(), F.lit(NULL_CELL)).when(F.length(s) > cell_truncate, cut).otherwise(s)


def sample_rows_block(headers: Column | str, rows: Column | str) -> Column:
    """Fixed-width commented block; width per column = longest of header and cells; every
    cell (the last too) is left-justified to its width; columns joined by two spaces.

    ``headers``: array<string>; ``rows``: array<array<string>> (already cell text). No rows ->
    ''."""
    h, r = col_(headers), col_(rows)
    n = F.size(h)

    def cells(row: Column) -> Column:  # as many as there are headers; a shorter row is looked up past its end, as an error or null
        return F.coalesce(F.when(F.size(row) < n, F.concat(row, F.array(F.element_at(row, n)))).when(
            F.size(row) > n, F.slice(row, 1, n)).otherwise(row), F.array().cast("array<string>"))

    def fmt(row: Column, widths: Column) -> Column:
        padded = F.zip_with(row, widths, lambda cell, width: F.rpad(cell, width, " "))
        return F.concat(F.lit("  "), F.array_join(padded, "  "))

    widths = F.aggregate(r, F.transform(h, lambda name: F.length(name)), lambda w, row: F.zip_with(
        w, cells(row), lambda a, cell: F.greatest(a, F.length(cell))))
    # as the variable of a lambda the widths are computed once, not once a cell
    lines = F.transform(F.array(widths), lambda w: F.concat(
        F.array(F.lit("/* sample rows:"), fmt(h, w)), F.transform(r, lambda row: fmt(cells(row), w)), F.array(F.lit("*/"))))[0]
    return F.when(F.coalesce(F.size(r), F.lit(0)) <= 0, F.lit("")).otherwise(F.array_join(lines, "\n"))
