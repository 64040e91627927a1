"""Operator 8: personal data by candidate gradient boosting.

High-recall generators propose overlapping spans (the four base formats plus written-out e-mail
addresses and bare digit groups). Spans that pass a base format's checks always stay. The others
are scored by boosted depth-two trees over format and context features, and those above the
calibrated threshold of their kind are added where they overlap no chosen span.

The trees are fitted here, on candidates of a small generated set of labelled sentences (size and
seed are parameters); the threshold of each kind is the lowest one that reaches ``PRECISION`` on the
held-out third of it. Scans are linear in the text, however long a run of digits or letters is.

Defined cases: null or empty text has no spans; rows repeating a doc_id are scanned one by one; an
empty table gives no rows; ``redact`` keeps all other columns and sets ``n_chars`` (if present) to
the new length; null text stays null.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, SHRINK = 0.97, 40, 0.3
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts where its digit run starts, and a digit run is never given back: same spans, linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+"
                      r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}+)+")
_GROUPS = re.compile(r"(?<![0-9A-Za-z+.,-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])")
# Words that announce a kind.
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "server", "host"),
        "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax", "reach")}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base formats, by kind then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """High-recall proposals beyond the base formats; kinds may overlap on one span."""
    out = []
    if "at)" in text or "at]" in text or "at}" in text:
        out += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGITS.search(text):
        for m in _GROUPS.finditer(text):
            out += [(2, *m.span()), (3, *m.span())]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _DIGITS.findall(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before = text[max(0, start - 30):start].lower()
    return [kind, end - start, len(digits), len(groups), max(groups), min(groups), span.count("-"), span.count("."),
            span.count(" "), span.count("("), float(luhn("".join(digits))) if digits else 0.0,
            float("at)" in span or "at]" in span or "at}" in span), float("dot" in span),
            *[float(any(c in before for c in CUES[k])) for k in KINDS],
            float(before[-2:].strip() in (":", "=", "")), float(text[end:end + 1].isalpha())]


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of generated sentences with the truth known by construction."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8)))
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    rows, truth = [], []
    for _ in range(n):
        case = rnd.randrange(8)
        cue = ""
        if case == 0:
            kind, span = 0, f"{word()} (at) {word()} (dot) com" if rnd.random() < .5 else f"{word()}[at]{word()}.org"
        elif case == 1:
            kind, cue = 3, rnd.choice(CUES["phone"]) + rnd.choice((": ", " "))
            span = rnd.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}"))
        elif case == 2:
            kind, cue = 2, rnd.choice(CUES["card"]) + ": "
            span = "-".join(num(4) for _ in range(4))
        else:
            kind, cue = -1, word() + " "
            span = rnd.choice((f"{rnd.randint(1900, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", num(rnd.randint(7, 12)),
                               f"{num(3)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)} {num(2)} {num(3)} {num(2)}",
                               f"{num(4)}-{num(4)}"))
        text = f"{word()} {word()} {cue}{span} {word()}."
        for k, a, b in candidates(text):
            rows.append(features(text, k, a, b))
            truth.append(float(k == kind))
    return np.array(rows), np.array(truth)


class BoostedTrees:
    """Logistic boosting of depth-two regression trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, shrink: float = SHRINK):
        cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25)))]
        side = np.array([x[:, f] <= c for f, c in cuts])
        self.trees, score = [], np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6

            def best(rows):
                gl, hl = (side * (g * rows)).sum(1), (side * (h * rows)).sum(1)
                gr, hr = (g * rows).sum() - gl, (h * rows).sum() - hl
                k = int(np.argmax(gl**2 / (hl + 1) + gr**2 / (hr + 1)))
                return k, shrink * gl[k] / (hl[k] + 1), shrink * gr[k] / (hr[k] + 1)

            root, _, _ = best(np.ones(len(y)))
            left, right = best(side[root]), best(~side[root])
            self.trees.append((cuts[root], (cuts[left[0]], *left[1:]), (cuts[right[0]], *right[1:])))
            score += np.where(side[root], np.where(side[left[0]], left[1], left[2]),
                              np.where(side[right[0]], right[1], right[2]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x))
        for (f, c), ((lf, lc), a, b), ((rf, rc), d, e) in self.trees:
            s += np.where(x[:, f] <= c, np.where(x[:, lf] <= lc, a, b), np.where(x[:, rf] <= rc, d, e))
        return 1 / (1 + np.exp(-s))


@functools.lru_cache(maxsize=4)
def fit(n: int = 3000, seed: int = 7, precision: float = PRECISION):
    """(trees, threshold per kind, held-out precision and recall)."""
    x, y = _labelled(n, seed)
    test = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees(x[~test], y[~test])
    p, truth, kind = trees.predict(x[test]), y[test] > 0, x[test][:, 0]
    limits = []
    for k in range(len(KINDS)):
        pk, tk = p[kind == k], truth[kind == k]
        ok = [t for t in np.linspace(0.5, 0.99, 50) if (pk >= t).any() and tk[pk >= t].mean() >= precision]
        limits.append(float(ok[0]) if ok else 2.0)
    chosen = p >= np.array(limits)[kind.astype(int)]
    return trees, tuple(limits), (float(truth[chosen].mean()), float(chosen[truth].mean()))


def all_spans(text: str, model) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind then start."""
    trees, limits, _ = model
    base = base_spans(text)
    extra = candidates(text)
    if not extra:
        return base, base
    scores = trees.predict(np.array([features(text, *c) for c in extra]))
    cover: list[tuple[int, int]] = []  # the text that chosen spans cover, as disjoint intervals in order
    for a, b in sorted((a, b) for _, a, b in base):  # base spans of different kinds may overlap
        if cover and a < cover[-1][1]:
            cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
        else:
            cover.append((a, b))
    added = []
    for score, span in sorted(zip(scores, extra), key=lambda t: (-t[0], t[1])):
        at = bisect.bisect_left(cover, (span[2],))
        if score >= limits[span[0]] and not (at and cover[at - 1][1] > span[1]):
            added.append(span)
            cover.insert(at, span[1:])
    return base, sorted(base + added)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: base counts, digest of base spans, all spans (code points, end exclusive)."""
    model = fit()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                base, every = all_spans(text or "", model)
                n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((doc_id, *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """Every chosen span replaced by ``[KIND]``; overlapping spans merge under the first one's kind."""
    model = fit()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = sorted((a, b, k) for k, a, b in all_spans(text, model)[1]) if text else []
            if spans:
                parts, at = [], 0
                for a, b, k in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    cols = docs.columns
    res = docs.withColumn("text", clean("text"))
    if "n_chars" in cols:
        res = res.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return res.select(*cols)
