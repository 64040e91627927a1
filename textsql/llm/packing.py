"""Operator 10: best-fit packing by exact-complement hashing.

Documents are tokenised once into pieces (id 0 closes each document; only longer ones are cut, the
shorter piece first). Packing works on the histogram of piece lengths, whose size is bounded by the
capacity, never on pieces: for the longest length left, an index of single, pair and triple sums
names lengths that fill the gap exactly, and they are consumed under their availability counts.
What no combination fills goes best-fit decreasing. The plan (patterns x counts) is bounded by the
capacity too; pieces find their slot by the distributed rank of their length.

A byte-level BPE encodes each word of its own split by itself, so a task keeps the ids of words it has met
and gives the tokenizer only new ones (``WordIds``); the ids are those of encoding whole texts.

Defined cases: null or empty text is the single id 0; equal lengths rank by (doc_id, piece), repeated
rows share doc_id and are ranked among themselves arbitrarily but each gets its own slot; an empty
table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
KEPT_WORDS, KEPT_CHARS = 400_000, 32  # words of a generation that a worker keeps, and their longest
STRETCH = 1 << 20  # characters of a text that are split into words at once
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordIds:
    """Encodes texts as the tokenizer does. The words of its split are matched here with the classes of
    characters (letter, number, space, other) that the tokenizer itself shows, learnt in blocks of 256 as texts
    bring them; new words go to the tokenizer in one call, a line each. Two generations of words are kept. Texts
    that name an added token, and all texts of a tokenizer that splits otherwise, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        form = json.loads(self.tok.to_str())
        split, model = form.get("pre_tokenizer") or {}, form["model"]
        self.by_word = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                        and model["type"] == "BPE" and not model.get("dropout") and not form.get("truncation")
                        and not form.get("padding") and not form.get("normalizer") and not form.get("post_processor"))
        self.added = [t["content"] for t in form.get("added_tokens") or []]
        self.blocks: set[int] = set()
        self.classes: dict[str, list[int]] = {"letter": [], "number": [], "space": []}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.by_word:
            self.newline = self._whole("\n")
            self.by_word = len(self.newline) == 4
            self._learn_blocks({0})

    def _whole(self, text: str) -> bytes:
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn_blocks(self, blocks: set[int]) -> None:
        def joins(text: str) -> bool:
            return len(self.tok.pre_tokenizer.pre_tokenize_str(text)) == 1

        for code in (c for b in blocks for c in range(b << 8, (b + 1) << 8) if not 0xD800 <= c < 0xE000):
            char = chr(code)
            kind = "letter" if joins("a" + char) else "number" if joins("1" + char) else None if joins("!" + char) else "space"
            if kind:
                self.classes[kind].append(code)
        self.blocks |= blocks
        self.spaces = set(map(chr, self.classes["space"]))

        def ranges(codes: list[int]) -> str:
            at = np.sort(np.array(codes))
            cut = np.flatnonzero(np.diff(at) > 1)
            return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, -1]]))

        le, nu, sp = (ranges(self.classes[k]) for k in ("letter", "number", "space"))
        self.words = re.compile(f" [{le}]+|[{le}]+| ?[{nu}]+|'(?:[stmd]|re|ve|ll)| ?[^{le}{nu}{sp}]+|[{sp}]+(?![^{sp}])|[{sp}]+").findall
        self.break_ = re.compile(f"(?<=[^{sp}])[{sp}]")

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words: one line each; words of spaces, which would run into a line break, alone."""
        lines = [w for w in words if w[-1] not in self.spaces]
        raw = self._whole("".join(w + "\n" for w in lines))
        ends = np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.newline, "<u4")[0]).tolist()
        ids = {w: raw[4 * (a + 1):4 * b] for w, a, b in zip(lines, [-1, *ends], ends)}
        return ids | {w: self._whole(w) for w in words if w[-1] in self.spaces}

    def _stretch(self, text: str) -> bytes:
        words = self.words(text)
        ids = list(map(self.kept.get, words))
        if None in ids:
            missing = {w for w, i in zip(words, ids) if i is None}
            found = {w: self.older[w] for w in missing if w in self.older}
            found |= self._encode_words([w for w in missing if w not in found])
            ids = [found[w] if i is None else i for w, i in zip(words, ids)]
            self.kept.update((w, i) for w, i in found.items() if len(w) <= KEPT_CHARS)
            if len(self.kept) >= KEPT_WORDS:
                self.kept, self.older = {}, self.kept
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if not self.by_word or any(t in text for t in self.added):
            return self._whole(text)
        if not text.isascii():
            new = {ord(c) >> 8 for c in set(text)} - self.blocks
            if new:
                self._learn_blocks(new)
        out, at = [], 0
        while len(text) - at > STRETCH:  # no word goes on from a character that is no space to one that is
            cut = self.break_.search(text, at + STRETCH)
            if cut is None:
                break
            out.append(self._stretch(text[at:cut.start()]))
            at = cut.start()
        return b"".join([*out, self._stretch(text[at:])])


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder: its words last from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``keep_ids`` adds the ids themselves as ``ids``."""
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_ids(path).encode, bytes(4)
        for pdf in batches:
            out, ids_out = [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.frombuffer(encode(text) + end, dtype="<u4")
                head = len(ids) % capacity if len(ids) > capacity else len(ids)
                cuts = [0, *range(head or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    ids_out.append(ids[a:b].astype("int32"))
            res = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
            if keep_ids:
                res["ids"] = ids_out
            yield res

    return docs.select("doc_id", "text").mapInPandas(pieces, PIECE_SCHEMA + (", ids array<int>" if keep_ids else ""))


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) covering the histogram exactly. Exact triples
    can use up short lengths that best fit needs later, so the plan is made with sums of up to one,
    two and three lengths and the one with the fewest sequences is taken."""
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    rest: Counter = Counter()

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        n = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * n
        done.append((pattern, n))

    def complement(first: int) -> tuple[int, ...] | None:
        """Lengths that with ``first`` fill a sequence exactly, fewest and longest first."""
        gap = capacity - first
        free = left.copy()
        free[first] -= 1
        if gap == 0:
            return ()
        if free[gap] > 0:
            return (gap,)
        have = np.flatnonzero(free[:gap + 1] > 0)[::-1]
        have = have[have > 0]

        def pair(total: int, avail) -> tuple[int, int] | None:
            a = np.flatnonzero(avail[:total] > 0)
            a = a[(a > 0) & (a * 2 >= total)]
            b = total - a
            ok = (avail[b] > 0) & ((a != b) | (avail[a] > 1))
            return (int(a[ok][-1]), int(b[ok][-1])) if ok.any() else None

        found = pair(gap, free) if most > 1 else None
        if found:
            return found
        for a in have if most > 2 else ():
            free[a] -= 1
            found = pair(gap - int(a), free) if gap > a else None
            free[a] += 1
            if found:
                return (int(a), *found)
        return None

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            fill = complement(length)
            if fill is None:
                rest[length] = int(left[length])
                left[length] = 0
            else:
                take((length, *fill))
    # best-fit decreasing over groups of equal open sequences
    by_gap: dict[int, list[list]] = {}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            gap = next((g for g in range(length, capacity) if by_gap.get(g)), None)
            if gap is None:
                per = capacity // length
                full, over = divmod(n, per)
                for k, m in ((per, full), (over, 1 if over else 0)):
                    if m:
                        by_gap.setdefault(capacity - k * length, []).append([(length,) * k, m])
                n = 0
                continue
            pattern, m = by_gap[gap].pop()
            used = min(m, n)
            if m > used:
                by_gap[gap].append([pattern, m - used])
            by_gap.setdefault(gap - length, []).append([(*pattern, length), used])
            n -= used
    done += [(p, m) for groups in by_gap.values() for p, m in groups]
    return done


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` must be repeatable (a written table)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base = [], 0
    rank_at: Counter = Counter()
    for pattern, n in plan_patterns(histogram, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, rank_at[length], rank_at[length] + n, base, offset))
            rank_at[length] += n
            offset += length
        base += n
    # distributed rank: range-sort on length (hot lengths split by a hash), then per-partition counts
    parts = spark.sparkContext.defaultParallelism * 4
    sort_key = F.xxhash64("doc_id", "piece")
    cols = pieces.columns
    ordered = pieces.withColumn("_h", sort_key).repartitionByRange(parts, "length", "_h", "start")
    ordered = ordered.sortWithinPartitions("length", "_h", "start").withColumn("_p", F.spark_partition_id())
    ordered = ordered.withColumn("_n", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ranked")
    runs = ordered.groupBy("length", "_p").agg(F.min("_n").alias("_first"), F.count("*").alias("_c"))
    # one row per (length, partition): at most lengths + partitions rows, ranked per length
    from pyspark.sql import Window
    before = F.coalesce(F.sum("_c").over(
        Window.partitionBy("length").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("length", "_p", (before - F.col("_first")).alias("_shift"))
    slot_df = spark.createDataFrame(slots, "length long, _lo long, _hi long, _base long, offset long")
    # (run x slot range) overlaps are cut on the driver-sized tables' scale: ranges per length
    per_len = slot_df.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi", "_base", "offset"))).alias("_slots"))
    placed = ordered.join(F.broadcast(runs), ["length", "_p"]).withColumn("_rank", F.col("_n") + F.col("_shift"))
    placed = placed.join(F.broadcast(per_len), "length")
    slot = F.element_at(F.filter("_slots", lambda s: (s["_lo"] <= F.col("_rank")) & (F.col("_rank") < s["_hi"])), 1)
    placed = placed.withColumn("_slot", slot)
    return placed.select(*cols, (F.col("_slot._base") + F.col("_rank") - F.col("_slot._lo")).alias("sequence_id"),
                         F.col("_slot.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return assign(materialise(tokenise(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
