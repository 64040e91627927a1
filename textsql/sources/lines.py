"""Text files whose lines keep their order: line-aligned file sets (A5, A8) and split JSON arrays (A1, A3).

Spark cuts a large text file into splits. A split is read in order by one task, so a line's number is its
number inside the split plus the lines of the file's earlier splits: a table of one row per split, never one
pass over the file. Nothing here gathers a file in one task.

Line-aligned sets. ``write_aligned`` sorts rows once, numbers them, and writes each named line column to a
folder of its own, cut into the same parts of ``rows_per_file`` lines. Parts go to a fresh folder; a manifest of
(commit, folder, part, first_line, n_lines), one small file that appears by a rename, is the commit. A retry
replaces what was there, an attempt that died leaves files that no manifest names, and ``read_aligned`` reads the
newest commit, refusing parts whose line counts differ from the manifest's.

JSON arrays. ``read_array`` reads the file as pieces that end with ``}``. Each piece carries the parity of its
quotes and its change of depth, for a start outside and inside of a string; prefix sums of these over pieces and
splits tell which braces end an element, and how many elements end before it. Elements must be objects.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import exact_rank
from ..session import maybe_broadcast, scratch_path

MANIFEST = "commit long, folder string, part long, first_line long, n_lines long"
_SPLIT = ("_file", "_block")
_DEPTH_CHARS = r"[^\[\]{}]"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split_lines(spark: SparkSession, path: str | list[str], line_sep: str, *extra: str, schema: str = "value string") -> DataFrame:
    """value, the file, the split's first byte and an id that grows by 1 inside a split; written out, so that
    everything derived from it sees the same splits."""
    raw = spark.read.schema(schema).option("lineSep", line_sep).text(path)
    return _written(raw.select("value", *extra, F.col("_metadata.file_path").alias("_file"),
                               F.col("_metadata.file_block_start").alias("_block"),
                               F.monotonically_increasing_id().alias("_mid")), "lines")


def _before(value: Column, *keys: str) -> Column:
    """Sum of ``value`` over the earlier splits of a file."""
    w = Window.partitionBy(*keys, "_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


# ----------------------------------------------------------------------------------------------
# Line-aligned sets
# ----------------------------------------------------------------------------------------------

def _all_of(key: str) -> WindowSpec:
    """All splits of a file or part, in their order."""
    return Window.partitionBy(key).orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_aligned(df: DataFrame, order: Sequence[str], lines: dict[str, Column], path: str,
                  rows_per_file: int = 1_000_000) -> int:
    """Writes ``lines`` (name -> text column) in ``order`` below ``path`` and commits them; the commit's number.

    Rows that tie in ``order`` are ordered by their lines. A null line is an empty one; a line that holds a line
    feed fails the job, since it would shift all lines behind it. Without rows an empty set is committed."""
    spark = df.sparkSession
    whole = {n: F.when(F.contains(c, F.lit("\n")), F.raise_error(F.lit(f"line feed in a line of {n}"))).otherwise(
        F.coalesce(c, F.lit(""))) for n, c in lines.items()}
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], *[c.alias(n) for n, c in whole.items()])
    ranked = _written(exact_rank(rows, [*keys, *lines], "_line").drop(*keys), "aligned").withColumn(
        "part", F.floor((F.col("_line") - 1) / rows_per_file).cast("long"))
    folder = f"attempt-{uuid.uuid4().hex[:12]}"
    for name in lines:
        parts = ranked.select("part", "_line", name).repartition("part").sortWithinPartitions("part", "_line")
        parts.select("part", F.col(name).alias("value")).write.partitionBy("part").option("lineSep", "\n").text(
            f"{path}/{folder}/{name}")
    last = _manifest(spark, path)
    commit = 1 + ((last.agg(F.max("commit")).first()[0] or 0) if last is not None else 0)
    entries = ranked.groupBy("part").agg(F.min("_line").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("part"), F.lit(1).cast("long").alias("first_line"), F.lit(0).cast("long").alias("n_lines")))
    entries.select(F.lit(commit).cast("long").alias("commit"), F.lit(folder).alias("folder"), "part", "first_line", "n_lines").coalesce(
        1).write.mode("append").json(f"{path}/manifest")
    return commit


def read_aligned(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """line_no (from 1) and a column per name: the newest committed set, paired by line number."""
    manifest = _manifest(spark, path)
    newest = manifest.agg(F.max(F.struct("commit", "folder"))).first()[0] if manifest is not None else None
    if newest is None:
        raise FileNotFoundError(f"no committed line set below {path}")
    entries = manifest.where(F.col("commit") == newest["commit"]).where("part >= 0").select("part", "first_line", "n_lines")
    if entries.isEmpty():
        return spark.createDataFrame([], "line_no long, " + ", ".join(f"`{n}` string" for n in names))
    out = None
    for name in names:
        got = _split_lines(spark, f"{path}/{newest['folder']}/{name}", "\n", "part", schema="value string, part long")
        splits = got.groupBy("part", *_SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
        splits = splits.withColumn("_off", _before(F.col("_n"), "part")).withColumn(
            "_all", F.sum("_n").over(_all_of("part")))
        # the manifest leads: a part whose file is gone fails too
        base = entries.join(splits, "part", "left").select(
            *_SPLIT, "_m0", F.when(F.coalesce(F.col("_all"), F.lit(0)) != F.col("n_lines"), F.raise_error(F.concat(
                F.lit(f"part of {name} has other lines than its manifest: "), F.col("part").cast("string")))).otherwise(
                F.col("first_line") + F.col("_off")).alias("_base"))
        lines = got.join(maybe_broadcast(base, row_bytes=200), list(_SPLIT)).select(
            (F.col("_base") + F.col("_mid") - F.col("_m0")).alias("line_no"), F.col("value").alias(name))
        out = lines if out is None else out.join(lines, "line_no", "full")
    return out


# ----------------------------------------------------------------------------------------------
# JSON arrays
# ----------------------------------------------------------------------------------------------

def _depth(text: Column) -> Column:
    """Opened minus closed brackets of ``text`` (without escapes) outside of its strings."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*("|$)', ""), _DEPTH_CHARS, "")
    return 2 * F.length(F.regexp_replace(bare, r"[\]}]", "")) - F.length(bare)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, position, element) of every element of the JSON arrays in ``path``, one array a file."""
    pieces = _split_lines(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    in_split = Window.partitionBy(*_SPLIT).orderBy("_mid")
    until = in_split.rowsBetween(Window.unboundedPreceding, 0)
    marked = pieces.withColumn("_p", plain).select(
        *_SPLIT, "_mid", "value", (F.length("_p") - F.length(F.replace("_p", F.lit('"')))).alias("_q"),
        # the piece's own closing brace counts where the piece ends outside of a string
        _depth(F.concat("_p", F.lit("}"))).alias("_out"), _depth(F.concat(F.lit('"'), "_p", F.lit("}"))).alias("_in"))
    odd = F.sum("_q").over(until) - F.col("_q")
    marked = marked.withColumn("_odd", odd % 2).select(
        *_SPLIT, "_mid", "value", ((F.col("_odd") + F.col("_q")) % 2).alias("_open"),
        F.sum(F.when(F.col("_odd") == 0, F.col("_out")).otherwise(F.col("_in"))).over(until).alias("_d0"),
        F.sum(F.when(F.col("_odd") == 0, F.col("_in")).otherwise(F.col("_out"))).over(until).alias("_d1"))
    marked = _written(marked, "pieces")
    splits = marked.groupBy(*_SPLIT).agg(F.max_by(F.struct("_open", "_d0", "_d1"), "_mid").alias("_e"))
    splits = splits.withColumn("_s", (_before(F.col("_e._open")) % 2).cast("int"))
    splits = splits.withColumn("_d", _before(F.when(F.col("_s") == 0, F.col("_e._d0")).otherwise(F.col("_e._d1"))))
    # the closing bracket and the brace that no piece had at the end of the file
    final = F.max_by(F.col("_d") + F.when(F.col("_s") == 0, F.col("_e._d0")).otherwise(F.col("_e._d1")), "_block").over(
        _all_of("_file"))
    splits = splits.withColumn("_d", F.when(final == -1, F.col("_d")).otherwise(
        F.raise_error(F.concat(F.lit("not an array of objects, or cut off: "), "_file"))))
    depth = F.col("_d") + F.when(F.col("_s") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    outside = (F.col("_open") + F.col("_s")) % 2 == 0
    placed = marked.join(maybe_broadcast(splits.drop("_e"), row_bytes=200), list(_SPLIT)).select(
        *_SPLIT, "_mid", "value", (outside & (depth == 1)).cast("long").alias("_end"), depth.alias("_depth"))
    ends = placed.groupBy(*_SPLIT).agg(F.sum("_end").alias("_n"))
    ends = ends.withColumn("_first", _before(F.col("_n"))).drop("_n")
    numbered = placed.join(maybe_broadcast(ends, row_bytes=200), list(_SPLIT)).withColumn(
        "position", F.col("_first") + F.sum("_end").over(until) - F.col("_end"))
    whole = numbered.groupBy("_file", "position").agg(
        F.max("_end").alias("_done"), F.array_sort(F.collect_list(F.struct("_block", "_mid", "value"))).alias("_v"))
    text = F.regexp_replace(F.concat(F.array_join(F.col("_v.value"), "}"), F.lit("}")), r"^﻿?[\s\[,]*", "")
    # what follows the last element closes the array and holds nothing else
    tail = F.regexp_like(F.array_join(F.col("_v.value"), "}"), F.lit(r"^﻿?[\s\[]*\]?\s*$"))
    # (repeated here: a filter of the caller's may be evaluated before the one below)
    checked = F.when((F.col("_done") == 1) & text.startswith("{"), text).when((F.col("_done") == 0) & tail, F.lit(None)).otherwise(
        F.raise_error(F.concat(F.lit("not an array of objects at element "), F.col("position").cast("string"))))
    return whole.where((F.col("_done") == 1) | ~tail).select(F.col("_file").alias("file"), "position", checked.alias("element"))


def read_array(spark: SparkSession, path: str | list[str], schema: StructType, position_col: str | None = None) -> DataFrame:
    """The fields of ``schema`` of every element, with its position in its array where a name for it is given."""
    rows = array_elements(spark, path).select("position", F.from_json("element", schema).alias("_x"))
    return rows.select(*([F.col("position").alias(position_col)] if position_col else []), "_x.*")
