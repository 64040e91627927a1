"""Operator 6: line dedup. Units (lines) are normalised, digested, grouped globally; the earliest
ranked occurrence stays and the others are removed, with their original offsets retained.

Normalised: lower case, white space collapsed, trimmed. Units below ``MIN_WORDS`` words are never
removed. Rank: smallest (doc_id, start). Offsets are code points, end exclusive, in the original
text. Digests are 128 bits of SHA-256.

Defined cases: null or empty texts have no units and lose nothing; a document keeps the first of
its own repeated lines; rows that repeat doc_id and text share a rank and all stay; a null doc_id
ranks first; an empty table gives no rows; extra columns are never read.

``removed_passages`` adds what whole lines miss: every run of ``PASSAGE_WORDS`` words (lower case, split at
white space, so line breaks and line lengths do not matter) that occurs at an earlier rank goes too, wherever
in a line it stands. Each run selects the smallest hash of its half runs (by its own words alone, so equal runs select
equal hashes), and the runs that select one half run are taken as one. Where a selected hash repeats with a second
64-bit hash of all words of its runs, the runs of all but the first go without being digested; only runs of half runs that repeat
among different words are digested, 128 bits each, and grouped, so the result is that of digesting every run. Every removed word stands at an earlier
rank in the same run or line; a text that repeats with a period keeps its first period.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted_lookup

MIN_WORDS, PASSAGE_WORDS = 10, 50
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def line_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, start, end, digest) of every line of at least ``min_words`` words; ``t`` is the text's hash."""
    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, t, text in zip(pdf["doc_id"], pdf["t"], pdf["text"]):
                at = 0
                for line in (text or "").split("\n"):
                    norm = _SPACE.sub(" ", line).strip(" ").lower()
                    if norm.count(" ") + 1 >= min_words:
                        out.append((doc_id, t, at, at + len(line), hashlib.sha256(norm.encode()).digest()[:16]))
                    at += len(line) + 1
            yield pd.DataFrame(out, columns=["doc_id", "t", "start", "end", "digest"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInPandas(
        units, "doc_id long, t long, start long, end long, digest binary")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, start, end) of every unit that repeats an earlier ranked one. The minimum per
    digest is pre-aggregated before its shuffle; a hot line is salted on the way back."""
    keyed = materialise(line_units(docs, min_words), "units")
    rank = F.struct("doc_id", "start", "t")
    first = keyed.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = salted_lookup(keyed.withColumn("rank", rank), first.select("digest", "first"), "digest", "rank", "inner")
    return again.where(~F.col("rank").eqNullSafe(F.col("first"))).select("doc_id", "t", "start", "end")


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every doc_id with its removed spans (sorted start:end, comma-joined) and their total length."""
    spans = repeated_units(docs, min_words).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_s"))
    ids = docs.select("doc_id").distinct()
    some = F.coalesce(F.col("_s"), F.array().cast("array<struct<start:long,end:long>>"))
    return ids.join(spans, ids["doc_id"].eqNullSafe(spans["doc_id"]), "left").select(
        ids["doc_id"], some.alias("_s")).select(
        "doc_id", F.size("_s").cast("long").alias("n_removed"),
        F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("removed_chars"),
        F.array_join(F.transform("_s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with repeated lines cut out of ``text`` (their line breaks go with them) and
    the cut spans of the original in ``removed_spans`` (a column of that name is replaced). Every row loses
    lines of its own text only, whatever other texts its doc_id has."""
    spans = repeated_units(docs, min_words).groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_s")).select(
        F.col("doc_id").alias("_d"), F.col("t").alias("_t"),
        F.array_join(F.transform("_s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("_spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or not s:
                return t
            out, at = [], 0
            for a, b in (map(int, x.split(":")) for x in s.split(",")):
                out.append(t[at:a])
                at = b + 1
            return "".join(out) + t[at:]
        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    row = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_h"))
    joined = row.join(spans, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    cols = [cut("_row.text", "_spans").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c != "removed_spans"]
    return joined.select(*cols, F.coalesce("_spans", F.lit("")).alias("removed_spans"))


def word_hashes(text: str | None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of every lower-cased word; offsets are code points of ``text``."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a few letters are longer in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate([[False], ~((code == 32) | ((code >= 9) & (code <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    letters = _mix(code[inside[1:-1]].astype(np.uint64) + np.uint64((seed + 1) << 32))
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(len(letters)) - np.repeat(first, size)
    return start, end, _mix(np.add.reduceat(letters * _powers(int(size.max()), _BASE[seed])[at], first))


_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of every ``length`` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(len(words), _BASE[seed]), dtype=np.uint64)])
    return _mix((sums[length:] - sums[:n]) * _powers(n, pow(_BASE[seed], -1, 1 << 64)))


def _winners(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of ``length`` words, the position of its smallest half-run hash; the half-run hashes."""
    part = (length + 1) // 2
    h = run_hashes(words, part)
    wide, n = length - part + 1, len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), h
    return np.concatenate([np.arange(i, min(i + 100_000, n)) + np.lib.stride_tricks.sliding_window_view(
        h[i:i + 100_000 + wide - 1], wide).argmin(1) for i in range(0, n, 100_000)]), h


def _selected(text: str | None, length: int) -> tuple[np.ndarray, ...]:
    """Of every winnowed half run: the characters that the runs which select it cover (start, end), its hash, and a
    second hash of all their words. The runs that select one half run follow each other."""
    start, end, words = word_hashes(text)
    won, h = _winners(words, length)
    first = np.flatnonzero(np.diff(won, prepend=-1))
    last = np.append(first[1:], len(won)) - 1
    if not len(first):
        return start[:0], end[:0], h[:0], h[:0]
    other = word_hashes(text, 1)[2] * _powers(len(words), _BASE[1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(other, dtype=np.uint64)])
    around = (sums[last + length] - sums[first]) * _powers(len(words), pow(_BASE[1], -1, 1 << 64))[first]
    place = (won[first] - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return start[first], end[last + length - 1], h[won[first]], _mix(around ^ _mix(place + np.uint64(1)))


def repeated_passages(docs: DataFrame, length: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, start, end) of spans that together cover just the runs of ``length`` words that occur at an earlier rank."""
    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_selected(t, length) for t in pdf["text"]]
            start, end, h, around = (np.concatenate([g[i] for g in got] or [[]]) for i in range(4))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").repeat([len(g[0]) for g in got]).values,
                                "start": start.astype("int32"), "end": end.astype("int32"),
                                "h": h.astype("uint64").view("int64"), "around": around.astype("uint64").view("int64")})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text, places in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["places"]):
                start, end, words = word_hashes(text)
                won = _winners(words, length)[0]
                first = np.flatnonzero(np.diff(won, prepend=-1))  # of the runs that select one half run
                run = np.flatnonzero(np.repeat(np.isin(start[first], places), np.diff(np.append(first, len(won)))))
                if not len(run):
                    continue
                yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(run), dtype="Int64"),
                                    "start": start[run], "end": end[run + length - 1],
                                    "d1": run_hashes(words, length)[run].view("int64"),
                                    "d2": run_hashes(word_hashes(text, 1)[2], length, 1)[run].view("int64")})

    texts = docs.select("doc_id", "text")
    marks = materialise(texts.mapInPandas(select, "doc_id long, start int, end int, h long, around long"), "marks")
    # the joins shuffle both sides by the hash alone, so that a hot one is split among tasks when they run
    often = materialise(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    marks = materialise(marks.join(often, "h"), "repeated")
    # equal surroundings: the runs of all but the first repeat the first one's, word for word
    alike = marks.groupBy("h", "around").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") < F.col("first.end")))
    marks = materialise(marks.join(alike.select("h", F.col("around").alias("_a"), "first"), "h").where(
        "around = _a").select("doc_id", "start", "end", "h", later.alias("later")), "ranked")
    # the first ones of different surroundings may share some of their runs: those are compared one by one
    left = marks.where("NOT later")
    shared = materialise(left.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    places = left.join(shared, "h").groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("start").alias("places"))
    runs = materialise(texts.join(places, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "text", "places").mapInPandas(
        digest, "doc_id long, start long, end long, d1 long, d2 long"), "runs")
    rank = F.struct("doc_id", "start")
    first = runs.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = runs.join(first.select("d1", F.col("d2").alias("_d2"), "first"), "d1").where("d2 = _d2")
    return again.where(~rank.eqNullSafe(F.col("first"))).select("doc_id", "start", "end").unionByName(
        marks.where("later").select("doc_id", F.col("start").cast("long"), F.col("end").cast("long")))


def removed_passages(docs: DataFrame, min_words: int = MIN_WORDS, length: int = PASSAGE_WORDS) -> DataFrame:
    """As ``removed_spans``, of repeated lines and repeated runs of words; spans that meet are merged."""
    both = repeated_units(docs, min_words).drop("t").unionByName(repeated_passages(docs, length))
    # a document's spans come as start * 2^32 + end; sorted so, those that meet are merged
    spans = both.groupBy("doc_id").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("_s"))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, packed in zip(pdf["doc_id"].astype("Int64"), pdf["_s"]):
                at = np.sort(packed)
                start, end = at >> 32, np.maximum.accumulate(at & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                first, last = start[new], end[np.concatenate([new[1:], [len(at)]]) - 1]
                rows.append((doc_id, len(new), int((last - first).sum()), ",".join(map("{}:{}".format, first, last))))
            yield pd.DataFrame(rows, columns=["_d", "n_removed", "removed_chars", "spans"]).astype({"_d": "Int64"})

    found = spans.mapInPandas(merged, "_d long, n_removed long, removed_chars long, spans string")
    ids = docs.select("doc_id").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(
        "doc_id", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed_chars", zero).alias("removed_chars"), F.coalesce("spans", F.lit("")).alias("spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d),
o AS (SELECT doc_id, (coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)), 0))::BIGINT AS s,
  length(ls[k]) AS n, trim(regexp_replace(lower(ls[k]), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM u),
w AS (SELECT * FROM o WHERE length(norm) - length(replace(norm, ' ', '')) + 1 >= 10),
r AS (SELECT doc_id, s, s + n AS e FROM w QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, s) > 1)
SELECT d.doc_id, count(r.s)::BIGINT AS n_removed, coalesce(sum(r.e - r.s), 0)::BIGINT AS removed_chars,
  coalesce(string_agg(r.s || ':' || r.e, ',' ORDER BY r.s), '') AS spans
FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
