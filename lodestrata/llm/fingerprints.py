"""Document fingerprints (operator 5): consistent weighted sampling.

Terms are word bigrams (the word itself, if a text has but one), known by 64-bit hashes and
weighted by their counts. For each of 64 samples a term has r, c ~ Gamma(2, 1) and b ~ U(0, 1);
t = floor(ln w / r + b), ln a = ln c - r (t - b) - r, and the term with the least a is kept with
its t. Two signatures agree in a sample with probability equal to the generalised Jaccard
similarity of their weights.

The draws are functions of the whole hash and the sample, no table: of three exponential draws
x, y and z, c = x + y, r = ln(1 + y / x) + z and b = z / r have those distributions and are
independent. Then ln a = ln x - r t, and t is 0 at weight 1, where the least x alone decides. A
term of more weight cannot have a below x exp(-z) / w, so few need y, r and t.

Cases. Null text is empty. A text without words has the fingerprint of zeros: like another
such text 1, like any other 0. Equal texts have equal fingerprints. Null doc_ids come last; rows that share one
are in descending order of their texts. Empty table: empty result. Extra columns are ignored.

A range is read as a stream and sorted on disk, so a range of any length fits. Each is one task and one file: there
is one for 16 MB of text, two for a core at least, but no more than documents / 400 and 32,768, which bounds what the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, back, letters, mix, reader_batches, rolling, word_hashes

SAMPLES, ROWS_PER_RANGE, MOST_RANGES, BLOCK = 64, 400, 32_768, 128
BYTES_PER_RANGE, RANGES_PER_CORE = 1 << 24, 2
_PLUS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TIMES = mix(_PLUS + np.uint64(1)) | np.uint64(1)
_Y, _Z, _T = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _unit(h: np.ndarray) -> np.ndarray:
    """Within (0, 1)."""
    return (h.astype(np.float64) + 0.5) * (0.5**64 * (1 - 2.0**-53))


def weights(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and their counts, of each text."""
    for h in word_hashes(texts, letters(), "all"):
        yield np.unique(rolling(h, min(2, max(1, len(h)))), return_counts=True)


def signature(terms: np.ndarray, w: np.ndarray) -> np.ndarray:
    """16 bits for each sample, of the term with the least a and its t; zeros for no term."""
    if not len(terms):
        return np.zeros(SAMPLES, np.uint16)
    with np.errstate(over="ignore"):
        # The terms are mixed already, so h -> a h + b modulo 2^64 draws anew for each sample.
        least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        room = np.empty((min(BLOCK, len(terms)), SAMPLES), np.uint64)
        for i in range(0, len(terms), BLOCK):
            part = terms[i : i + BLOCK, None]
            h = np.multiply(part, _TIMES, out=room[: len(part)])
            h += _PLUS
            np.minimum(least, h.min(axis=0), out=least)
        x = -np.log1p(-_unit(least))
        best, drawn, t = np.log(x), least, np.zeros(SAMPLES, np.uint64)
        heavy = w > 1
        more, times = terms[heavy], w[heavy].astype(np.float64)
        for i in range(0, len(more), BLOCK):
            h = more[i : i + BLOCK, None] * _TIMES + _PLUS
            z = _unit(mix(h + _Z))
            row, at = np.nonzero(_unit(h) * z <= times[i : i + BLOCK, None] * x)
            h = h[row, at]
            x_, y, z = -np.log1p(-_unit(h)), -np.log(_unit(mix(h + _Y))), -np.log(z[row, at])
            r = np.log1p(y / x_) + z
            level = np.floor((np.log(times[i + row]) + z) / r)
            ln_a = np.log(x_) - r * level
            order = np.lexsort((ln_a, at))
            order = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            order = order[ln_a[order] < best[at[order]]]
            best[at[order]], drawn[at[order]], t[at[order]] = ln_a[order], h[order], level[order].astype(np.uint64)
        return (mix(drawn + t * _T) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def fingerprints(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    for ids, w in weights(texts):
        yield signature(ids, w)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that collide."""
    return float((a == b).mean())


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range after another, in descending order within a range; the row after a range's last one comes with it as a guest."""
    held = None
    for batch in batches:
        for i in range(0, len(batch), 1000):
            part = batch.iloc[i : i + 1000]
            pairs, marks = [], fingerprints(part["text"])
            for home, doc, text, guest, mark in zip(part["home"], part["doc_id"], part["text"], part["guest"], marks, strict=True):
                text = text or ""
                if held is not None and held[0] == home:
                    pairs.append((*held[1:], edited(held[2], text), mark))
                held = None if guest else (home, doc, text, mark)
            rows = [
                (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, mark))
                for (doc, text, own, other, mark), changed in zip(pairs, fingerprints(p[3] for p in pairs), strict=True)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_next(docs: DataFrame) -> DataFrame:
    """Per row of docs its fingerprint, that of its edited text, and their likeness, in descending doc_id.

    One range shuffle of the texts. Each range's first row also goes, as a guest, to the range
    before it (the very first to the last), so neighbours meet without a global window. Null
    doc_ids come last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 62))))
    arrow_batches(docs.sparkSession)
    reader_batches(docs.sparkSession)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    wanted = max(size // BYTES_PER_RANGE, RANGES_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    ranges = max(2, min(MOST_RANGES, n // ROWS_PER_RANGE, wanted))
    edges = sorted(set(docs.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []), reverse=True)
    home = _search(edges, _keys(docs.sparkSession, ranges))
    placed = docs.withColumn("home", home.cast("int"))
    tops = {r["home"]: r["top"] for r in placed.groupBy("home").agg(F.max("o").alias("top")).collect()}  # a row a range
    order = sorted(tops, key=tops.get, reverse=True)
    before = {tops[h]: order[i - 1] for i, h in enumerate(order)}
    table = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "o long, back int")
    # A doc_id with several rows sends one of them; which one is fixed by its text.
    first = placed.join(F.broadcast(table), "o").groupBy("o", "doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("back").alias("home"))
    both = placed.select("home", "o", "doc_id", "text", F.lit(False).alias("guest")).unionByName(first.select("home", "o", "doc_id", "text", F.lit(True).alias("guest")))
    dealt = both.repartition(ranges, "home").sortWithinPartitions("home", "guest", F.desc("o"), F.desc(F.coalesce("text", F.lit(""))))
    made = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return back(dealt.select("home", F.col("doc_id").cast("string").alias("doc_id"), "text", "guest").mapInPandas(_compare, made))


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Integers that ``repartition(n, key)`` sends to partitions of their own."""
    key = F.col("id").cast("int")
    found = spark.range(20 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("at")).agg(F.min(key).alias("key"))
    at = {r["at"]: r["key"] for r in found.collect()}
    return [at.get(i, -1 - i) for i in range(n)]


def _search(edges: list[int], keys: list[int]):
    @F.pandas_udf("int")
    def home(o: pd.Series) -> pd.Series:
        up = np.array(edges[::-1])
        return pd.Series(np.array(keys)[len(up) - np.searchsorted(up, o.to_numpy(), "left")])

    return home("o")
