"""N-gram Jaccard join (operator 1): MinHash bands propose, full n-gram sets decide.

Method. Texts with the same word-5-gram set are one class. A class's set gets 100 MinHash values
in 20 bands of 5 rows: two sets of similarity 0.8 share a band with probability
1-(1-0.8^5)^20 = 0.9996. Every pair of classes that shares a band is compared on the full sets
once, in the first band the two share. A bucket is dealt in blocks, and each pair of blocks is a
group of rows, compared in one task; of its links only the number at each class and a spanning
forest leave the task, so no table holds a row for each pair. A first pass, without the sets,
finds the classes that have a pair to compare in a group; only their sets travel there. No
bucket is capped and no pair that shares a band is left out.

Cases. Null and empty text, or text without words: no set, never linked, a class of its own.
Under five words: the whole word sequence is the only gram. Repeated rows of a doc_id keep
their rows. A null doc_id is an id like others, after all of them. Empty table: empty result.
Extra columns are ignored by the join and kept by keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import back, components, cut, doc_ids, drop, fresh, letters, mix, rolling, tidied, word_hashes

BANDS, ROWS, N, THRESHOLD = 20, 5, 5, 0.8
#: Members and grams of a block of a bucket, about; columns of a matrix product.
MEMBERS, GRAMS, WIDTH = 1024, 4_000_000, 4096
# The grams are mixed already, so x -> a x + b modulo 2^64 orders them anew for each value.
_PLUS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(_PLUS + np.uint64(1)) | np.uint64(1)


def gram_sets(texts: Iterable[str | None], n: int = N) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of the n-grams of its lower-cased words."""
    for h in word_hashes(texts, letters(), "all"):
        yield np.unique(rolling(h, min(n, len(h)))) if len(h) else h


def minhash(sets: np.ndarray) -> np.ndarray:
    """One band hash per band."""
    low = np.full(len(_PLUS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(sets), 256):
            low = np.minimum(low, (sets[i : i + 256, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) for b in range(BANDS)], np.uint64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, found = list(dict.fromkeys(batch["text"])), {}
        for text, s in zip(texts, gram_sets(texts), strict=True):
            found[text] = (xxhash.xxh3_128_digest(s.tobytes()), len(s), minhash(s).view(np.int64).tolist()) if len(s) else (None, 0, None)
        key, size, bands = zip(*(found[t] for t in batch["text"]), strict=True) if len(batch) else ((), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "key": key, "size": size, "bands": bands})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "bands": batch["bands"], "grams": [s.tobytes() for s in gram_sets(batch["text"])]})


def _to_compare(band: int, sides: np.ndarray, bands: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a group are compared here: those of its two blocks that share no earlier band
    and whose sizes allow the threshold."""
    out = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    out &= np.not_equal.outer(sides, sides) if (sides != sides[0]).any() else ~np.eye(len(sides), dtype=bool)
    for k in range(band):
        out &= np.not_equal.outer(bands[:, k], bands[:, k])
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    flat, who = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    times = np.diff(np.r_[np.flatnonzero(new), len(flat)])
    # A gram of one set alone is in no intersection.
    often = times > 1
    column, who = (np.cumsum(often) - 1)[np.cumsum(new) - 1], who[np.repeat(often, times)]
    column = column[np.repeat(often, times)]
    out = np.zeros((n, n))
    for c in range(0, int(often.sum()), WIDTH):
        i, j = np.searchsorted(column, (c, c + WIDTH))
        has = np.zeros((n, WIDTH), np.float32)
        has[who[i:j], column[i:j] - c] = 1
        out += has @ has.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index that each index is linked to, by any path."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label, len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (band, hash, x, y), which come together."""
    key, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row[:4] != key:
                if rows:
                    yield key, rows
                key, rows = row[:4], []
            rows.append(row[4:])
    if rows:
        yield key, rows


def _needed(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows whose classes have a pair to compare in their group."""
        out = []
        for key, rows in _grouped(batches):
            side, node, size, bands = zip(*rows, strict=True)
            some = _to_compare(key[0], np.array(side), np.array(bands), np.array(size), threshold).any(axis=1)
            out += [(*key, side[i], node[i]) for i in np.flatnonzero(some)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["band", "hash", "x", "y", "side", "node"])
                out = []
        yield pd.DataFrame(out, columns=["band", "hash", "x", "y", "side", "node"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per group and linked class, its links there and the class its component there is named by."""
        out = []
        for key, rows in _grouped(batches):
            side, node, bands, grams = zip(*rows, strict=True)
            sets = [np.frombuffer(g, np.uint64) for g in grams]
            size = np.array([len(s) for s in sets])
            both = shared(sets)
            linked = (both >= threshold * (np.add.outer(size, size) - both)) & _to_compare(key[0], np.array(side), np.array(bands), size, threshold)
            count, root = linked.sum(axis=1), _roots(linked)
            out += [(node[i], node[root[i]], int(count[i])) for i in np.flatnonzero(count)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b", "n"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "n"])

    return run


def _together(rows: DataFrame) -> DataFrame:
    key = ["band", "hash", "x", "y"]
    return rows.repartition(*key).sortWithinPartitions(*key)


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Per row of docs its doc_id, mark (a hash of the text) and class key; per class key class_id, group (a
    number of its own), group_id and n_links. Classes, not doc_ids, are the nodes, so doc_ids may be null or repeat."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    signed = doc_ids(docs, "text", "mark").mapInPandas(tidied(_signatures), "doc_id string, mark long, key binary, size long, bands array<long>")
    signed = cut(back(signed), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    own = signed.where("key is not null").groupBy("key").agg(one.alias("one"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    classes = cut(own.select("key", F.xxhash64("key").alias("node"), F.col("one.doc_id").alias("class_id"), F.col("one.mark").alias("mark"), "size", "bands"), "classes")

    spread = classes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.collect_list("node").alias("nodes"), F.sum("size").alias("grams")).where(F.size("nodes") > 1)
    blocks = F.ceil(F.greatest(F.size("nodes") / MEMBERS, F.col("grams") / GRAMS)).cast("int")
    members = buckets.select("band", "hash", blocks.alias("blocks"), F.explode("nodes").alias("node"))
    members = members.withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "hash", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node")
    sized = members.join(classes.select("node", "size", "bands"), "node").select("band", "hash", "x", "y", "side", "node", "size", "bands")
    needed = cut(_together(sized).mapInPandas(tidied(_needed(threshold)), "band int, hash long, x int, y int, side int, node long"), "needed")

    wanted = classes.join(needed.select("node").distinct(), "node", "left_semi").select("node", "bands", F.col("class_id").alias("_id"), F.col("mark").alias("_mark"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).dropDuplicates(["node"])
    sets = cut(texts.select("node", "bands", "text").mapInPandas(tidied(_sets), "node long, bands array<long>, grams binary"), "sets")
    dealt = needed.join(sets, "node").select("band", "hash", "x", "y", "side", "node", "bands", "grams")
    links = cut(_together(dealt).mapInPandas(tidied(_verified(threshold)), "a long, b long, n long"), "links")
    drop(needed)
    drop(sets)

    groups = components(links.select("a", "b")).withColumnRenamed("component", "group")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    joined = classes.select("key", "node", "class_id").join(groups, "node", "left").join(counts, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = joined.groupBy("group").agg(F.min("class_id").alias("group_id"))
    return signed.select("doc_id", "mark", "key"), joined.join(least, "group").select("key", "class_id", "group", "group_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, class_id (least doc_id of the same gram set), group_id (least doc_id
    linked through similarities of at least threshold), n_links (other classes its class is linked to)."""
    signed, classes = _classes(docs, threshold)
    return signed.select("doc_id", "key").join(classes, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group: that of the least doc_id (null last), of its texts the
    least hash. Rows without words are never linked: all stay. Of rows of one doc_id and text one stays; with a
    null doc_id that holds for rows with words, which are exact copies, and not for those without."""
    signed, classes = _classes(docs, THRESHOLD)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one")
    first = signed.join(classes.select("key", "group"), "key").groupBy("group").agg(one).select("one.doc_id", "one.mark", F.lit(False).alias("each"))
    wordless = signed.where("key is null").select("doc_id", "mark", F.col("doc_id").isNull().alias("each")).distinct()
    k, of, each, mark, n = fresh(docs.columns, "_keep", "_of", "_each", "_mark", "_n")
    keep = first.unionByName(wordless).select(F.col("doc_id").alias(k), F.col("mark").alias(of), F.col("each").alias(each))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(mark) == F.col(of)))
    kept = kept.withColumn(n, F.when(F.col(each), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", mark, n]).select(*docs.columns)
