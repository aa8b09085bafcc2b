"""Language ID (operator 2): sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties, then one temperature is
fitted on rows that training has not seen. Features are hashed 1- to 4-grams of the lower-cased
text, all of it. Document frequencies are counted over every labelled row that may be learnt
from; the weights are fitted on a sample of at most ``bound`` such rows (8,000, a parameter) of at most ``most_bytes`` each
(128 KB, a parameter), which bounds what the driver holds.

Cases. Null text, or text without a letter: ``und`` with score 1. No labelled rows: ``und``
with score 0, and ``kept`` keeps all. Repeated rows keep their rows; a null doc_id is never held out; extra
columns of any name stay as they are. Equal likelihoods: the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, fresh, tidied

DIM, GRAMS, BOUND, MOST_BYTES = 1 << 15, 4, 8000, 1 << 17
REJECT_BELOW = 0.5


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids and their counts."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    total, h = np.zeros(DIM, np.int64), np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(GRAMS):
            h = (h[: len(codes) - n] * np.uint32(0x9E3779B1) + codes[n:]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            total += np.bincount(h & np.uint32(DIM - 1), minlength=DIM)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = counts(text)
    x = (1 + np.log(n)) * idf[ids]
    return ids.astype(np.uint16), (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            if has_letter(text):
                df[counts(text)[0]] += 1
                n += 1
    if n:
        yield pd.DataFrame({"n": [n], "df": [df.tolist()]})


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights (DIM, classes) by FTRL-proximal with elastic net; rows are seen in the order given."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    for _ in range(epochs):
        for ids, x, y in rows:
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[ids] = ni + g * g
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def temperature(logits: list[np.ndarray], gold: list[int]) -> float:
    """The temperature of a fixed grid under which the held-back rows are likeliest."""
    grid = np.geomspace(0.05, 10, 80)
    loss = [sum(-np.log(max(softmax(z / t)[y], 1e-12)) for z, y in zip(logits, gold, strict=True)) for t in grid]
    return float(grid[int(np.argmin(loss))]) if logits else 1.0


def fit(labelled: DataFrame, bound: int = BOUND, most_bytes: int = MOST_BYTES) -> dict:
    """labelled(doc_id, text, lang) -> model. Weights from at most ``bound`` rows, frequencies from all."""
    arrow_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sums = labelled.select("text").mapInPandas(tidied(_frequencies), "n long, df array<long>").select("n", F.posexplode("df").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    n, df = (sums[0]["n"] if sums else 0), np.zeros(DIM)
    for r in sums:
        df[r["i"]] = r["c"]
    share = min(1.0, bound / max(n, 1))
    picked = labelled.where(F.octet_length("text") <= most_bytes).where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).limit(bound).collect()
    picked = sorted((r for r in picked if has_letter(r["text"])), key=lambda r: (hash_order(r["doc_id"]), r["text"]))
    langs = sorted({r["lang"] for r in picked})
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = [(*vector(r["text"], idf), langs.index(r["lang"])) for r in picked]
    held, train = rows[::6], [r for i, r in enumerate(rows) if i % 6] or rows
    w = ftrl(train, len(langs)) if langs else np.zeros((DIM, 0))
    t = temperature([x @ w[ids] for ids, x, _ in held], [y for *_, y in held])
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "t": t}


def hash_order(doc_id: int | None) -> int:
    return ((doc_id or 0) * 0x9E3779B97F4A7C15) & 0xFFFFFFFF


def predict(text: str | None, model: dict) -> tuple[str, float]:
    if not has_letter(text):
        return "und", 1.0
    if not model["langs"]:
        return "und", 0.0
    ids, x = vector(text, model["idf"])
    p = softmax((x @ model["w"][ids]) / model["t"])
    best = int(np.argmax(p))
    return model["langs"][best], float(p[best])


def identify(docs: DataFrame, model: dict) -> tuple[DataFrame, str]:
    """docs with a column of struct(lang_pred, score), and that column's name, which no other has. The
    prediction reads text alone, and no other column passes through Python."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages: a fixed size

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([predict(t, shared.value) for t in batch], columns=["lang_pred", "score"])

    (name,) = fresh(docs.columns, "language")
    return docs.withColumn(name, label.asNondeterministic()(F.col("text"))), name


def kept(docs: DataFrame, model: dict, least: float = REJECT_BELOW) -> DataFrame:
    """docs without those that have no letter or no language likelier than ``least``; all of docs if the
    model knows no language."""
    if not model["langs"]:
        return docs
    scored, name = identify(docs, model)
    return scored.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).select(*docs.columns)


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
