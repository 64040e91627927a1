"""Exact global ranks without a single-partition window.

``exact_rank`` sorts with range partitioning (Spark samples the key to cut ranges, so a hot
value of the first key is still split by the tie-break columns), numbers rows inside each
sorted partition, and adds the row counts of all earlier partitions. The per-partition count
table has one row per partition -- its size is bounded by the partition count, not the data --
so the prefix sum over it is a tiny single-partition window and its broadcast is size-safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def exact_rank(df: DataFrame, order: list[Column | str], rank_col: str = "rank") -> DataFrame:
    """1-based dense position of every row in ``order`` (which must be a total order)."""
    return _numbered(df.orderBy(*order), rank_col)


def _numbered(df: DataFrame, rank_col: str) -> DataFrame:
    """1-based number of every row in the order of partitions and of rows in them."""
    tagged = df.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__mid"))
    # Materialise once in the shared checkpoint folder so the counts and the rows agree.
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", "__m0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (
        tagged.join(F.broadcast(offsets), on="__pid")
        .withColumn(rank_col, (F.col("__off") + F.col("__mid") - F.col("__m0") + 1).cast("bigint"))
        .drop("__pid", "__mid", "__m0", "__off")
    )


def seeded_key(id_col: str, seed: int) -> Column:
    """Key of a reproducible pseudo-random order: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def integer_key(id_col: str) -> Column:
    """Sixteen hex digits that sort like the integer itself, negative ones first."""
    return F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def flag_first(df: DataFrame, key: Column, k: int | Callable[[int], int], flag: str, digits: int = 4) -> DataFrame:
    """Adds ``flag``: the row is among the first ``k`` (or ``k(number of rows)``) by ``key``, a string.

    No row is sorted or moved. A histogram of the key's first ``digits`` characters (16^4 groups of hex
    keys, summed map-side) names the bucket that holds the k-th key; only that bucket is looked at
    again, with more characters, until it ends at a bucket's end. The cutoff is a literal then, and
    rows are compared with it. Rows whose keys tie at the cutoff can't be told apart by it: they alone
    are numbered, so that exactly ``k`` rows are flagged. A null key comes first.
    """
    key = F.coalesce(key, F.lit(""))
    keys = df.select(key.alias("__k"))
    prefix, left, level = "", None, 0
    while True:
        level += digits
        part = F.substring("__k", 1, level)
        counts = sorted((r["p"], r["n"]) for r in keys.where(F.col("__k").startswith(prefix)).groupBy(
            part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # bounded by the key's alphabet
        if left is None:
            n = sum(c for _, c in counts)
            left = k(n) if callable(k) else k
            if left <= 0 or left >= n:
                return df.withColumn(flag, F.lit(left > 0))
        for prefix, c in counts:  # noqa: B007 - the bucket that holds the k-th key stays
            if left <= c:
                break
            left -= c
        if left == c:
            return df.withColumn(flag, F.substring(key, 1, level) <= prefix)
        if len(prefix) < level:  # all of the key is used up: ``left`` of the rows that have it
            tied = _numbered(df.where(key == prefix), flag).withColumn(flag, F.col(flag) <= left)
            return df.where(key != prefix).withColumn(flag, key < prefix).unionByName(tied)


def running_sum(df: DataFrame, part_cols: list[str], order_cols: list[str], value: Column,
                out_col: str = "running_before", n_ranges: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` per ``part_cols`` in ``order_cols`` order (a total order).

    Skew-proof prefix sum: a range partitioning on (part, order) splits even a partition key
    holding a third of all rows into many ranges; each (key, range) piece is summed locally by a
    window whose partition is at most one range, and the per-piece totals -- one row per
    (key, range), bounded by the range count -- are prefix-summed and joined back.
    """
    spark = df.sparkSession
    n = n_ranges or max(2 * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    tagged = (df.withColumn("__v", value).repartitionByRange(n, *part_cols, *order_cols)
              .select("*", F.spark_partition_id().alias("__pid")))
    tagged = cut_lineage(tagged)
    w_in = Window.partitionBy(*part_cols, "__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("__in", F.coalesce(F.sum("__v").over(w_in), F.lit(0.0)))
    totals = tagged.groupBy(*part_cols, "__pid").agg(F.sum("__v").alias("__t"))
    w_off = Window.partitionBy(*part_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*part_cols, "__pid", F.coalesce(F.sum("__t").over(w_off), F.lit(0.0)).alias("__off"))
    return (local.join(offs, on=[*part_cols, "__pid"])
            .withColumn(out_col, F.col("__off") + F.col("__in"))
            .drop("__pid", "__in", "__off", "__v"))
