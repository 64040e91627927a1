"""Result-set comparison (P14, X2, S1): did the prediction return gold's rows, as a multiset?

Input shape: one row per *result row*, keyed by the comparison key (e.g. ``question_id`` or
``(run, question_id)``), with the row's cells as ``array<string>``.

Plan at scale
-------------
1. Both sides are tagged (gold +1 / prediction +1 in separate counters) and unioned -- no join.
2. One aggregation keyed by ``(key, row)`` counts each side (map-side partial aggregation, so a
   statement returning the same row a billion times ships one row per task). The shuffle is
   hashed on the row *and* the key, so one question with a huge result is spread over all
   partitions (the hot-key case).
3. ``bool_and(count_gold == count_pred)`` grouped by key -- again a partial aggregate.

Two shuffles in total, both pre-combined; a full outer join of two count tables would add a
third and a sort-merge on array keys.

Row order never matters, duplicates do, NULL equals ``''`` (P14). Keys present on only one side
are compared against an empty multiset. Keys that should be compared but have no rows at all
on either side (empty = empty) are supplied through ``keys`` and come out ``True``; a side whose
statement failed is handled by the caller (failure means no match).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast


def normalize_row(*cells: Column | str) -> Column:
    """Cells -> ``array<string>``, NULL -> ``''``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cells]
    return F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def normalize_row_array(row: Column | str) -> Column:
    """P14 for an existing ``array<string>`` whose elements may be NULL."""
    r = F.col(row) if isinstance(row, str) else row
    return F.transform(r, lambda x: F.coalesce(x, F.lit("")))


def multiset_equal(
    gold_rows: DataFrame,
    pred_rows: DataFrame,
    key: Sequence[str] | str = "question_id",
    row_col: str = "row",
    keys: DataFrame | None = None,
    out_col: str = "exec_match",
) -> DataFrame:
    """One row per key with ``out_col`` = the two row multisets are equal."""
    key = [key] if isinstance(key, str) else list(key)
    g = gold_rows.select(*key, normalize_row_array(row_col).alias("__row"), F.lit(1).alias("__g"), F.lit(0).alias("__p"))
    p = pred_rows.select(*key, normalize_row_array(row_col).alias("__row"), F.lit(0).alias("__g"), F.lit(1).alias("__p"))
    counts = g.unionByName(p).groupBy(*key, "__row").agg(F.sum("__g").alias("__ng"), F.sum("__p").alias("__np"))
    verdict = counts.groupBy(*key).agg(F.bool_and(F.col("__ng") == F.col("__np")).alias(out_col))
    if keys is None:
        return verdict
    # Keys with no rows on either side: empty == empty.
    return keys.select(*key).join(verdict, on=key, how="left").select(
        *key, F.coalesce(F.col(out_col), F.lit(True)).alias(out_col)
    )


def multiset_digest(rows: DataFrame, key: str, row_col: str = "row") -> DataFrame:
    """Order-free digest of each key's rows: their number and commutative sums of two row hashes.

    Every column is a sum, so partial aggregates do almost all the work and a key with a huge result
    ships one row per task. Hash halves keep the sums inside a long for 2^31 rows a key."""
    row = normalize_row_array(row_col)
    h = rows.select(key, F.xxhash64(row).alias("__a"), F.xxhash64(F.lit(1), row, F.size(row)).alias("__b"))
    parts = [F.sum(part).alias(f"__{i}") for i, part in enumerate(
        x for c in ("__a", "__b") for x in (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)))]
    return h.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *parts).select(
        key, F.struct("n_rows", *[f"__{i}" for i in range(4)]).alias("digest"))


def multiset_classes(rows: DataFrame, ids: DataFrame, key: str, row_col: str = "row") -> tuple[DataFrame, DataFrame | None]:
    """S1 for any number of result sets at once: (key, class_id), equal classes for equal multisets.

    Digests sort the keys into classes; the rows of classes with several members are then counted per
    (class, row), where all members must have the same count. So every row is read twice, whatever the
    number of pairs. Classes that fail (two different results with one digest) come back as the
    second value, None if there are none. ``ids`` lists the keys; one without rows is an empty result.
    """
    digests = ids.select(key).distinct().join(multiset_digest(rows, key, row_col), key, "left")
    digests = cut_lineage(digests)
    groups = digests.groupBy("digest").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("__members"))
    classes = cut_lineage(digests.join(groups, digests["digest"].eqNullSafe(groups["digest"])).select(
        key, "class_id", "__members"))
    several = maybe_broadcast(classes.where("__members > 1"), max_rows=100_000, row_bytes=160)
    per = rows.select(key, normalize_row_array(row_col).alias("__row")).join(several, key).groupBy(
        "class_id", "__members", "__row", key).agg(F.count(F.lit(1)).alias("__n"))
    bad = per.groupBy("class_id", "__members", "__row").agg(
        F.count(F.lit(1)).alias("__k"), F.min("__n").alias("__low"), F.max("__n").alias("__high")).where(
        "__k <> __members OR __low <> __high").select("class_id").distinct()
    bad = cut_lineage(bad)
    return classes.select(key, "class_id"), None if bad.isEmpty() else bad


def multiset_equal_pair(a: DataFrame, b: DataFrame) -> bool:
    """S1 for a single pair of small results (tests): ``exceptAll`` both ways plus counts."""
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
