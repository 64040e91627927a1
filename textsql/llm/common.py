"""Shared pieces: table readers, scratch tables, salted joins and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsql.session import scratch_path

# Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: work is done once and a lost
    executor never forces it to be redone."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once inside one expression (evaluated a single time per row)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt_of: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (unique ``key``) with every right row repeated under each salt,
    so that one hot key on the left spreads over SALTS shuffle partitions."""
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(a, b) links -> (id, component), component = smallest id reachable; only linked ids appear.

    Alternating large-star / small-star rounds until the edge set no longer changes. Each round
    is written out, so the plan never grows; the hot centre of a star is salted on its join and
    its minimum is pre-aggregated before the shuffle. An empty input gives an empty result.
    """
    cur = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    rounds = 0
    while True:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_lookup(sym, low, "u", "v", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                             F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = materialise(nxt.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        rounds += 1
        same = _fingerprint(nxt) == _fingerprint(cur)
        cur = nxt
        if same or (max_rounds and rounds >= max_rounds):
            break
    comp = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = comp.select(F.col("component").alias("id"), "component").distinct()
    return comp.select(F.col("u").alias("id"), "component").unionByName(roots)


def _fingerprint(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
               F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]
