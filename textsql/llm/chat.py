"""Operator 7: chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line break becomes ``\\n``. Both
are undone on reading, so no text can forge a control string. The rendered string is encoded
once with offsets; tokens that meet an assistant span (found by binary search in the sorted turn
spans) carry loss, and the characters under loss are the intersections of both kinds of spans.

Defined cases: null text or role is empty; turns order by (turn, role, text), null turns first;
rows repeating a turn stay as turns; a null conv_id is a conversation; an empty table gives no rows;
extra columns are never read. A conversation must fit into a task, as it is encoded as one string.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (sorted) spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per token whether it meets a span, and the merged characters of spans under such tokens."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), dtype=bool), []
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    a, b = offsets[:, 0], offsets[:, 1]
    first = np.searchsorted(ends, a, side="right")  # first span that ends behind the token's start
    mask = (first < len(spans)) & (starts[np.minimum(first, len(spans) - 1)] < b)
    chars: list[tuple[int, int]] = []
    for lo, hi, at in zip(a[mask], b[mask], first[mask]):
        while at < len(spans) and starts[at] < hi:
            s, e = max(int(lo), int(starts[at])), min(int(hi), int(ends[at]))
            if s < e:
                if chars and s <= chars[-1][1] and chars[-1][0] >= starts[at]:
                    chars[-1] = (chars[-1][0], max(e, chars[-1][1]))
                else:
                    chars.append((s, e))
            at += 1
    return mask, chars


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, formatted, ids, loss_mask (per token), loss_spans (characters, end exclusive)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for pdf in batches:
            rows = []
            for conv_id, turns in zip(pdf["conv_id"], pdf["turns"]):
                text, spans = render([(t["role"], t["text"]) for t in turns])
                enc = tok.encode(text, add_special_tokens=False)
                off = np.array(enc.offsets, dtype=np.int64).reshape(-1, 2)
                if len(off):  # offsets may leave out leading blanks: each token starts where the last ended
                    off[1:, 0] = np.minimum(off[1:, 0], np.maximum.accumulate(off[:, 1])[:-1])
                    off[0, 0] = 0
                mask, chars = loss_mask(off, spans)
                rows.append((conv_id, text, enc.ids, mask.tolist(), [{"start": s, "end": e} for s, e in chars]))
            yield pd.DataFrame(rows, columns=["conv_id", "formatted", "ids", "loss_mask", "loss_spans"]).astype({"conv_id": "Int64"})

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInPandas(encode, "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, "
                                       "loss_spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the output back: turns, loss text and lengths."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv_id, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"]):
                turns = parse(text)
                flat = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((conv_id, len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                              "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
