"""Small string Columns shared by every module.

Spark's ``trim`` removes spaces only; the pipeline strips *all* whitespace the way Python's
``str.strip()`` does, so we trim with an explicit character set (``btrim``/``rtrim`` with a
set argument, no regex, JVM-side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# Characters Python's str.isspace() accepts, in code-point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class understood by both Java regex and RE2.
PY_WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ----------------------------------------------------------------------------------------------


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``s.strip()``."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def strip_semicolons(c: Column | str) -> Column:
    """``s.rstrip(';')``."""
    return F.rtrim(col_(c), F.lit(";"))


def clean_sql(c: Column | str) -> Column:
    """``s.strip().rstrip(';').strip()``; NULL stays NULL."""
    return py_strip(strip_semicolons(py_strip(c)))


def is_blank(c: Column | str) -> Column:
    """NULL or whitespace only."""
    return F.coalesce(py_strip(c), F.lit("")) == F.lit("")


def count_substr(s: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal ``needle`` (Python ``str.count``)."""
    removed = F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("bigint")


def remove_first(s: Column, needle: str) -> Column:
    """``s.replace(needle, '', 1)``."""
    pos = F.instr(s, needle)
    head = s.substr(F.lit(1), pos - F.lit(1))
    tail = s.substr(pos + F.lit(len(needle)), F.length(s) + F.lit(1))
    return F.when(pos == 0, s).otherwise(F.concat(head, tail))
