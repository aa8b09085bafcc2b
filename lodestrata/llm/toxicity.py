"""Toxicity (operator 6): cumulative-link ordinal regression over sparse text features.

Grades come from the labels: 0 for rows labelled clean; rows labelled toxic are graded 1 to 3
by the share of their words that are distinctive of toxic rows (thirds of that share). One
weight vector is shared across three ordered thresholds: P(grade > j) = sigmoid(w.x - theta_j).
The result is the expected severity, sum_j P(grade > j). Features are words and word beginnings of 4 to 6
letters (inflected abuse shares its stem) that occur in 2 % of the toxic rows and are e^2.5 times as frequent there; exact copies
in the sample count once. As abuse may be a small part of a long text, every window of 32 words
that holds a feature is scored and the greatest expected severity counts. The fit reads at most
``bound`` labelled rows (8,000, a parameter) of at most ``most_bytes`` each (128 KB, a parameter).

Cases. Null, empty or word-less text: severity 0. A text without a feature has the severity of the thresholds alone. No
labels, or labels of one kind: severity 0 throughout. Labels of a null doc_id are not used; documents with a null
doc_id are graded. Repeated rows keep their rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_batches

WINDOW, BOUND, MOST_BYTES, GRADES, SCALE, RARE, ODDS = 32, 8000, 1 << 17, 4, 0.5, 0.02, 2.5
#: P(grade > 0) from which a document counts as toxic.
TOXIC_FROM = 0.5


def parts_of(word: str) -> list[str]:
    """The word, and its beginnings, marked as such."""
    return [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


def windows(hits: list[tuple[int, tuple[int, ...]]], n: int) -> list[list[int]]:
    """The distinct features of each half-overlapping window that holds any. hits: (position, features)."""
    found: dict[int, set[int]] = {}
    last = max(0, -(-(n - WINDOW // 2) // (WINDOW // 2)) - 1)
    for at, ids in hits:
        k = at // (WINDOW // 2)
        for w in {min(k, last), max(0, k - 1)}:
            found.setdefault(w, set()).update(ids)
    return [sorted(found[w]) for w in sorted(found)]


class Features:
    """Selected features of words, through a bounded cache."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.known = index, {}

    def hits(self, words: list[str]) -> list[tuple[int, tuple[int, ...]]]:
        known, out = self.known, []
        for i, w in enumerate(words):
            ids = known.get(w)
            if ids is None:
                if len(known) > 300_000:
                    known.clear()
                ids = known[w] = tuple(self.index[p] for p in parts_of(w) if p in self.index)
            if ids:
                out.append((i, ids))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ordinal(rows: list[tuple[list[int], int]], dim: int, epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by AdaGrad on the cumulative logits."""
    w, seen = np.zeros(dim), np.full(dim, 1e-6)
    theta, theta_seen = np.array([0.5, 1.5, 2.5]), np.full(GRADES - 1, 1e-6)
    for _ in range(epochs):
        for x, grade in rows:
            g = sigmoid(w[x].sum() * SCALE - theta) - (grade > np.arange(GRADES - 1))
            step = g.sum() * SCALE + l2 * w[x]
            seen[x] += step * step
            w[x] -= rate * step / np.sqrt(seen[x])
            theta_seen += g * g
            theta = np.maximum.accumulate(theta + rate * g / np.sqrt(theta_seen))
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, most_bytes: int = MOST_BYTES) -> dict | None:
    named = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    n = max(1, named.count())
    share = min(1.0, bound / n)
    named = named.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).limit(bound)
    found = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(named), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic").collect()
    words = ((WORD.findall((r["text"] or "").lower()), r["toxic"]) for r in found)
    rows = sorted({(tuple(w), bool(t)): (w, bool(t)) for w, t in sorted(words)}.values())
    n_bad = sum(t for _, t in rows)
    if not n_bad or n_bad == len(rows):
        return None
    bad, clean = Counter(), Counter()
    for w, toxic in rows:
        (bad if toxic else clean).update({p for x in set(w) for p in parts_of(x)})
    odds = {p: np.log((c + 0.1) / (n_bad + 0.2)) - np.log((clean[p] + 0.1) / (len(rows) - n_bad + 0.2)) for p, c in bad.items() if c >= max(3, RARE * n_bad)}
    index = {p: i for i, p in enumerate(sorted(p for p, v in odds.items() if v > ODDS))}
    features = Features(index)
    hits = [features.hits(w) for w, _ in rows]
    density = sorted(len(h) / len(w) for h, (w, toxic) in zip(hits, rows, strict=True) if toxic and h)
    cuts = [density[len(density) // 3], density[2 * len(density) // 3]] if density else [1, 1]
    graded = []
    for h, (w, toxic) in zip(hits, rows, strict=True):
        level = 1 + sum(len(h) / len(w) >= c for c in cuts) if toxic and h else 0
        graded += [(x, level) for x in windows(h, len(w))] or [([], 0)]
    order = np.random.Generator(np.random.PCG64(9)).permutation(len(graded))
    w, theta = ordinal([graded[i] for i in order], len(index))
    return {"index": index, "w": w, "theta": theta}


def severity(text: str | None, model: dict | None, features: Features | None) -> tuple[float, float]:
    """Expected grade (0 to 3) and P(grade > 0); a text without features has none."""
    words = WORD.findall((text or "").lower())
    if not words or not model:
        return 0.0, 0.0
    found = windows(features.hits(words), len(words))
    best = max((float(model["w"][x].sum() * SCALE) for x in found), default=0.0)
    p = sigmoid(best - model["theta"])
    return float(p.sum()), float(p[0])


def grade(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row of docs: doc_id, severity, p_toxic, toxic."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the features of the sample

    @F.pandas_udf("severity double, p_toxic double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(shared.value["index"]) if shared.value else None
        for batch in batches:
            yield pd.DataFrame([severity(t, shared.value, features) for t in batch], columns=["severity", "p_toxic"])

    graded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run.asNondeterministic()(F.col("text")).alias("g"))
    return graded.select("doc_id", "g.severity", "g.p_toxic", (F.col("g.p_toxic") >= TOXIC_FROM).alias("toxic"))
