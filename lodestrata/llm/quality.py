"""Quality selection (operator 4): importance resampling with hashed n-gram generative models.

Target model: hashed uni- and bigrams of the documents labelled good, at most ``bound`` of them (50,000, a
parameter; those of the least hash of doc_id), so that their ids are broadcast and no text is shuffled; raw
model: those of all documents. The weight of a document is the log ratio of the two models' likelihoods, per n-gram
and scaled by ``scale``, so that length alone does not decide: with the plain sum long texts stand at either end (README). Gumbel noise (a hash of doc_id and a seed)
is added and the top ``share`` of all documents is taken: sampling without replacement in
proportion to the weights. The k-th key is found by a histogram that is refined until the
remaining bin is small, not by a global sort.

Cases. Null, empty or word-less text: ratio 0 and only noise decides. No labels: ratio 0 throughout. Repeated rows
share their noise and are all ranked. Ties go by doc_id, null first, and among rows of one doc_id by any order that
a rerun repeats or not: they have the same key. Null doc_ids share one noise. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, letters, rolling, word_hashes

BUCKETS, SHARE, SCALE, SEED, BOUND = 10_000, 0.75, 40.0, 11, 50_000


def buckets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The hashed uni- and bigrams of each text."""
    for h in word_hashes(texts, letters(), "all"):
        yield (np.concatenate([rolling(h, 1), rolling(h, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for found, is_good in zip(buckets(batch["text"]), batch["good"], strict=True):
            n = np.bincount(found, minlength=BUCKETS)
            raw += n
            if is_good:
                good += n
    yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "good": good})


def log_ratios(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> np.ndarray:
    """log p_target - log p_raw of each bucket; raw counts over all documents, add-one smoothed."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(bound).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.mapInPandas(_tally, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["good"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def threshold(keys: DataFrame, k: int) -> float:
    """The k-th largest of keys.key, by refining one histogram bin at a time."""
    low, high, k_left = *keys.agg(F.min("key"), F.max("key")).first(), k
    for _ in range(6):
        if high <= low:
            return low
        width = (high - low) / 4096
        inside = keys.where(F.col("key").between(low, high))
        bins = {r["b"]: r["count"] for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("b")).count().collect()}
        for b in sorted(bins, reverse=True):
            if bins[b] >= k_left:
                edges = keys.where(F.col("key").between(low, high)).where(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)) == b).agg(F.min("key"), F.max("key")).first()
                if bins[b] <= 1000:
                    top = keys.where(F.col("key").between(*edges)).orderBy(F.desc("key")).limit(k_left).agg(F.min("key")).first()
                    return top[0]
                low, high = edges
                break
            k_left -= bins[b]
    return low


def select(docs: DataFrame, labels: DataFrame, share: float = SHARE, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, log_ratio (per n-gram), key, selected."""
    arrow_batches(docs.sparkSession)
    ratios = log_ratios(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(shared.value[b].mean()) if len(b) else 0.0 for b in buckets(batch)], dtype="float64")

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("log_ratio"))
    keys = cut(scored.withColumn("key", F.col("log_ratio") * scale - F.log(-F.log(uniform))), "keys")
    k = int(np.floor(share * keys.count()))
    if k == 0:
        return keys.withColumn("selected", F.lit(False))
    at = threshold(keys, k)
    room = k - keys.where(F.col("key") > at).count()
    # Of the rows that tie at the threshold, whole doc_ids are taken in order, and of the last one as many rows as there is room.
    tied = keys.where(F.col("key") == at).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("doc_id"))
    taken, edge = [], 0
    for r in tied.limit(room).collect():
        edge = min(room, r["n"])
        taken.append((r["doc_id"], edge))
        room -= edge
        if not room:
            break
    table = docs.sparkSession.createDataFrame(taken, "_id long, _room long")
    w = Window.partitionBy("key", "doc_id").orderBy(F.lit(0))
    ranked = keys.where(F.col("key") == at).withColumn("_n", F.row_number().over(w))
    ranked = ranked.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("selected", F.col("_n") <= F.coalesce("_room", F.lit(0)))
    rest = keys.where(F.col("key") != at).withColumn("selected", F.col("key") > at)
    return rest.unionByName(ranked.select("doc_id", "log_ratio", "key", "selected"))
