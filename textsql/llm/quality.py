"""Operator 5: quality rules compiled into one Spark projection (no user functions).

``RULES`` is the threshold table: each line names a ratio, its lower and upper bound. Base counts
and ratios are built-in expressions over the whole text.

Defined cases: null or empty text has no words, so it fails the base rule; a text of white space
likewise; repeated rows get the same verdict each; clashing extra columns pass through
``score`` untouched because only ``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
# Common words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that it for on with as be by this are "
              "der die und das in den von zu ist mit nicht ein eine auf für "
              "le la les de et des du que en un une est pour dans qui "
              "el los las y del se con por una es no al lo como").split()
# ratio, lowest allowed, highest allowed
RULES = (
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", 0.0, 0.3),
    ("stop_word_ratio", 0.01, 1.0),
    ("dup_line_ratio", 0.0, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows found at least twice: sort (window, position), mark windows
    equal to a neighbour, and add up the positions that the marked windows cover."""
    def window_at(i):
        return F.concat_ws(" ", *[words[i + k] for k in range(WINDOW)])

    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                                     lambda i: F.struct(window_at(i).alias("w"), i.alias("i"))))

    def covered(s):
        n = F.size(s)
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (
            ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["w"] == s[k]["w"]))
            | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["w"] == s[k]["w"]))))
        starts = F.sort_array(F.transform(hit, lambda k: s[k]["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"])

    # equal windows have equal hashes: without a repeated hash nothing repeats, and no text is sorted
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).when(
        let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(pairs, covered))


def score(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id -> base counts, ratios, base_failed, kept (one projection, no shuffle), and the ``carry`` columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    stop = F.lit("|".join(sorted(set(STOP_WORDS))))
    stop_re = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), stop, F.lit(r")(?=[.,;:!?]*(?:[\x20\x09-\x0D]|$))"))
    base = docs.select(
        "doc_id", *carry,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_count(F.lower(text), stop_re).cast("long").alias("n_stop_words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"))
    n = F.size("_words").cast("long")
    counted = base.select(
        "doc_id", *carry, n.alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"),
        let(F.col("_words"), _repeat_words).cast("long").alias("n_repeat_words"),
        "n_stop_words", F.col("_l.n").alias("n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / n_lines,
    }
    verdict = F.lit(True)
    for name, low, high in RULES:
        verdict = verdict & ratios[name].between(low, high)
    return counted.select("*", failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that pass, each by its own text whatever its id, with the columns they came with."""
    row = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return score(row, carry=("_row",)).where("kept").select("_row.*")


COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()

_ALT = "|".join(sorted(set(STOP_WORDS)))
ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT rid, unnest(range(0, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) > 8),
g AS (SELECT rid, i, array_to_string(ws[i + 1:i + 8], ' ') AS win FROM u),
h AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM h) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
c AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, greatest(len(ls), 1) AS n_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_full_match(lower(x), '({_ALT})[.,;:!?]*'))) AS n_stop
  FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
    greatest(n_words, 1) AS d FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / d BETWEEN {RULES[0][1]} AND {RULES[0][2]} AND n_symbols / d BETWEEN {RULES[1][1]} AND {RULES[1][2]}
  AND n_stop / d BETWEEN {RULES[2][1]} AND {RULES[2][2]} AND n_dup_lines / n_lines BETWEEN {RULES[3][1]} AND {RULES[3][2]} AS kept
FROM f
"""
