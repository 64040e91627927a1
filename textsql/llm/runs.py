"""Operator 13: periodic runs of words by a suffix automaton with link-cut access.

Words are appended to the suffix automaton of their stretch one by one. Its suffix links form a tree
in which the path from the newest prefix to the root holds all its suffixes; appending a word
recolours that path with the new end. The tree is kept in splay-tree paths (link-cut access), each of
one colour, the last end of its states. So an access meets the path in segments: a segment with
last end ``e`` and longest state ``L`` says that the ``L`` words ending at ``e`` end at the new
position too, and no longer suffix does. A distance ``d = new - e`` of at most ``L`` is a square of
period ``d`` (its smallest, as ``e`` is the last end), which is extended to the right into its run.

Before that, stretches are cut at words that cannot lie in a run: a run of exponent ``k`` holds each of
its words ``k`` times, so a word found fewer times in its stretch separates, again and again until
nothing changes. This keeps every run whole and leaves the automaton the repetitive parts only.

A task holds one text and the automaton of one stretch. Defined cases: null, empty and blank texts have no words,
no runs and an empty collapsed text; every row gives a row, repeated doc_ids and null ones too; runs
that overlap are all returned, and a word is dropped if any of them drops it; an empty table gives no
rows; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

MIN_EXPONENT, MIN_LENGTH = 4, 6
FLUSH_CHARS = 1 << 24  # collapsed texts held before they are handed on
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def stretches(ids: np.ndarray, copies: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the parts in which every word is found at least ``copies`` times."""
    pos, part = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(pos):
        _, where, count = np.unique(part * (int(ids.max()) + 1) + ids[pos], return_inverse=True, return_counts=True)
        stay = count[where] >= copies
        pos, old = pos[stay], part[stay]
        part = np.cumsum(np.concatenate([[0], (np.diff(pos) > 1) | (np.diff(old) != 0)])) if len(pos) else pos
        if stay.all():
            break
    cuts = np.flatnonzero(np.diff(part)) + 1 if len(pos) else []
    for block in np.split(pos, cuts):
        if len(block):
            yield int(block[0]), int(block[-1]) + 1


def runs_of(word: list[int], min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_exponent`` (2 or more) periods."""
    # suffix automaton: transitions, suffix link and longest length of each state
    step, link, size, last = [{}], [-1], [0], 0
    # paths of the suffix-link tree as splay trees by depth; ``up`` of a splay root is its path's parent
    low, high, up, colour = [-1], [-1], [-1], [-1]
    end_of: dict[int, int] = {}
    found = []

    def state(length: int, out: dict) -> int:
        step.append(out)
        link.append(-1)
        size.append(length)
        low.append(-1)
        high.append(-1)
        up.append(-1)
        colour.append(-1)
        return len(size) - 1

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if low[p] == x:
            low[p] = c = high[x]
            high[x] = p
        else:
            high[p] = c = low[x]
            low[x] = p
        if c >= 0:
            up[c] = p
        up[p], up[x] = x, g
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
            else:
                colour[x] = colour[p]
        else:
            colour[x] = colour[p]

    def splay(x: int) -> None:
        while (p := up[x]) >= 0 and (low[p] == x or high[p] == x):
            g = up[p]
            if g >= 0 and (low[g] == p or high[g] == p):
                rotate(p if (low[g] == p) == (low[p] == x) else x)
            rotate(x)

    for i, c in enumerate(word):
        new = state(i + 1, {})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        elif size[q := step[p][c]] == size[p] + 1:
            link[new] = q
        else:
            clone = state(size[p] + 1, dict(step[q]))
            link[clone] = link[q]
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            link[q] = link[new] = clone
            # the clone's strings ended where q's did: it joins q's path right above q
            splay(q)
            low[clone] = low[q]
            if low[q] >= 0:
                up[low[q]] = clone
            low[q], up[clone] = clone, q
        up[new] = link[new]
        last = new
        # access: every path met on the way to the root gives one segment of old last ends
        below, x = -1, new
        while x >= 0:
            splay(x)
            old = colour[x]
            if old >= 0:
                d = i - old
                if d * (min_exponent - 1) <= size[x] and i >= end_of.get(d, 0):
                    e = i + 1
                    while e < len(word) and word[e] == word[e - d]:
                        e += 1
                    end_of[d] = e
                    start = i - size[x] - d + 1
                    found.append((start, e - start, d))
                if high[x] >= 0:
                    colour[high[x]] = old
            high[x] = below
            if below >= 0:
                up[below] = x
            below, x = x, up[x]
        colour[below] = i
    return found


def find_runs(words: list, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs of a list of words, by start and period."""
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    out = []
    for first, end in stretches(ids, min_exponent):
        if end - first >= min_length:
            out += [(first + s, n, p) for s, n, p in runs_of(ids[first:end].tolist(), min_exponent)
                    if n >= max(min_length, min_exponent * p)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start and period), collapsed (the text keeping each run's first period only)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()  # bytes split at the six ASCII white-space characters
                runs = find_runs(words, min_exponent, min_length)
                keep = np.ones(len(words), bool)
                for start, length, period in runs:
                    keep[start + period:start + length] = False
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                rows.append({"doc_id": doc_id, "n_words": len(words), "collapsed": b" ".join(kept).decode("utf-8", "replace"),
                             "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs]})
                held += len(rows[-1]["collapsed"])
                if held > FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, SCHEMA)


def fold_texts(docs: DataFrame) -> DataFrame:
    """The query's texts: where crc32(doc_id) ends in 0, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def folded(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    fold = let(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), folded)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), fold).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's runs and collapsed texts."""
    more = "a.length * b.period > b.length * a.period"
    same = "a.length * b.period = b.length * a.period"
    best = F.expr(f"array_sort(runs, (a, b) -> CASE WHEN {more} THEN -1 WHEN NOT ({same}) THEN 1 "
                  "WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END "
                  "WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END)")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.withColumn("top", F.get(best, F.lit(0)))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
