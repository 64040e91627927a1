"""Training-set preparation: mode assignment (W4), split (W5), length batches (W6), length filter
(F4), direct-only subset (F5), prompts and chat records (P7-P9), JSONL reading (A4).

Exact shares ("exactly round(share * n) rows") are a comparison with the k-th key, which
``ranking.flag_first`` finds by histograms of hash prefixes: no row is sorted or moved. Batches need
every rank; those come from ``exact_rank`` (range-partitioned sort + per-partition offsets).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.prompts import SYSTEM_PROMPT, assistant_completion, chat_messages, token_estimate, user_prompt
from .ranking import exact_rank, flag_first, integer_key, seeded_key

# --- fixed values -----------------------------------------------------------------------------
REASONING_SHARE = 0.4
VAL_SPLIT = 0.05
SPLIT_SEED = 42
MODE_SEED = 0
MAX_TRAIN_TOKENS = 1024
# ----------------------------------------------------------------------------------------------


def assign_modes(examples: DataFrame, share: float = REASONING_SHARE, seed: int = MODE_SEED,
                 id_col: str = "question_id") -> DataFrame:
    """Exactly ``round(share * n)`` (half-even) examples get ``reasoning``, the rest
    ``direct``, chosen by a seeded hash order. Adds ``mode``."""
    flagged = flag_first(examples, seeded_key(id_col, seed), lambda n: int(round(share * n)), "__first")
    return flagged.withColumn("mode", F.when(F.col("__first"), "reasoning").otherwise("direct")).drop("__first")


def train_val_split(rows: DataFrame, split: float = VAL_SPLIT, seed: int = SPLIT_SEED,
                    id_col: str = "question_id", head: bool = False) -> DataFrame:
    """``max(1, int(n * split))`` rows go to validation, picked by a seeded shuffle (or the
    first rows by integer id with ``head=True``). Adds ``split`` in {train, val}."""
    key = integer_key(id_col) if head else seeded_key(id_col, seed)
    flagged = flag_first(rows, key, lambda n: max(1, int(n * split)), "__first")
    return flagged.withColumn("split", F.when(F.col("__first"), "val").otherwise("train")).drop("__first")


def length_batches(prompts: DataFrame, length_col: str, batch_size: int, id_col: str = "question_id") -> DataFrame:
    """Length-sorted fixed-size batches (ties by id). Adds ``batch_id`` and ``position``."""
    ranked = exact_rank(prompts, [F.col(length_col), F.col(id_col)], "position")
    return ranked.withColumn("batch_id", F.floor((F.col("position") - 1) / batch_size).cast("bigint"))


def training_text(system: Column, user: Column, completion: Column) -> Column:
    """F4 input: system, user and completion joined by blank lines."""
    return F.concat_ws("\n\n", system, user, completion)


def length_filter(records: DataFrame, text: Column, max_tokens: int = MAX_TRAIN_TOKENS,
                  tokens: Column | None = None) -> DataFrame:
    """adds ``n_tokens`` (default estimate: characters / 4) and ``keep`` (n <= max).

    A real tokenizer plugs in as ``tokens`` (e.g. a ``pandas_udf`` over the text, U2)."""
    n = tokens if tokens is not None else token_estimate(text)
    return records.withColumn("n_tokens", n).withColumn("keep", F.col("n_tokens") <= max_tokens)


def length_filter_counts(filtered: DataFrame) -> DataFrame:
    """F4 report: how many records the length filter kept and dropped (one row)."""
    return filtered.agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def tokenizer_counter(count_fn):
    """U2 hook: wrap ``count_fn(list[str]) -> list[int]`` (e.g. a sub-word tokenizer's batch
    encode) as an Arrow-batched ``pandas_udf`` token counter for ``length_filter(tokens=...)``.
    The tokenizer runs on the executors, one Arrow batch at a time."""
    @F.pandas_udf("long")
    def _count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_fn(texts.fillna("").tolist()), dtype="int64")

    return _count


def direct_only(traces: DataFrame, blank_reasoning: bool = False) -> DataFrame:
    """drop reasoning-mode rows, or (variant) keep them and blank the reasoning."""
    if blank_reasoning:
        return traces.withColumn("reasoning", F.lit(None).cast("string"))
    return traces.filter(F.col("mode") != "reasoning")


def chat_record(traces: DataFrame) -> DataFrame:
    """One chat record (system, user, assistant) per trace."""
    user = user_prompt("schema_block", "question", "mode")
    asst = assistant_completion("sql", F.when(F.col("mode") == "reasoning", F.col("reasoning")))
    return traces.select("question_id", chat_messages(user, asst, F.lit(SYSTEM_PROMPT)).alias("messages"))


def read_jsonl(spark, path: str, schema: StructType | str, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """A4: JSON lines with an explicit schema (blank lines are skipped by the reader); malformed
    lines land in ``corrupt_col`` for quarantine instead of failing the job."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if corrupt_col not in schema.fieldNames():
        from pyspark.sql.types import StringType, StructField

        schema = StructType([*schema.fields, StructField(corrupt_col, StringType(), True)])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt_col).json(path))
