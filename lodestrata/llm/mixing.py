"""Mixing sources to target weights (operator 10): pivotal dependent rounding.

Each source's target in words is its share by weight, capped at ``most`` times its size, the
excess reshared. target / size is a document's expected number of copies: the whole part is
sure, the fraction is rounded by pivotal sampling weighted by size. Two fractional documents
meet; the one takes words from the other until one of them is integral, in either direction
with odds that keep both expectations. So a source's words keep their sum but for one last
document. Groups of documents (source, salt) leave one fractional document each; these residuals
meet in a reduction tree of fan-in 64 until a source has one. Draws are hashes of the pair, so reruns agree.

Cases. Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_ids stay null. Repeated
rows are documents of their own. Empty table: empty result. Extra columns are ignored by mix and kept by apply_mix, whatever
their names. The driver and each executor hold one row a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import back, cut, doc_ids, fresh

WEIGHTS, SHARE, MOST, PER_GROUP, FAN_IN = (3, 1, 2), 1.5, 2.0, 3000, 64
_EPS = 1e-9


def n_words() -> Column:
    return F.coalesce(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source; sources by code point, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, order
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def pivotal(key: list[int], size: list[int], part: list[float], salt: int) -> tuple[np.ndarray, int]:
    """Rounds the fractions in order; returns them and the index of the one that stays fractional, or -1."""
    p, held = np.array(part, float), -1
    for j in range(len(p)):
        if p[j] <= _EPS or p[j] >= 1 - _EPS:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        a, b = size[i], size[j]
        up = min(a * (1 - p[i]), b * p[j])  # words that i may take from j
        down = min(a * p[i], b * (1 - p[j]))  # words that j may take from i
        u = (xxhash.xxh3_64_intdigest(f"{salt}:{key[i]}:{key[j]}:{j}".encode()) >> 11) / (1 << 53)
        move = up if u * (up + down) < down else -down
        p[i] += move / a
        p[j] -= move / b
        held = -1
        for k in (i, j):
            if p[k] <= _EPS or p[k] >= 1 - _EPS:
                p[k] = round(p[k])
            else:
                held = k
    return p, held


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    p, held = pivotal(rows["row"].tolist(), rows["size"].tolist(), rows["part"].tolist(), int(rows["level"].iloc[0]))
    rows["part"], rows["open"] = p, np.arange(len(rows)) == held
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 5) -> DataFrame:
    """Per row of docs: row (a hash of it), doc_id, source, size, source_size, target, copies, taken."""
    named = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", "source", "text").alias("row"))
    base = cut(named, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # a row a source
    sizes, total = {r["source"]: r["n"] for r in sums}, sum(r["rows"] for r in sums)
    wanted = targets(sizes, weights, share, most)
    table = docs.sparkSession.createDataFrame([(s, sizes[s], float(wanted[s]), wanted[s] / sizes[s] if sizes[s] else 0.0) for s in sizes], "s string, source_size long, target double, rate double")
    salts = max(1, math.ceil(total / PER_GROUP))
    rated = base.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("sure", F.floor(F.col("rate") + _EPS))
    flat = doc_ids(
        rated, "row", "source", "size", "source_size", "target", "sure", F.lit(seed).alias("level"), F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(salts)).alias("salt"),
        F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0))).otherwise(0.0).alias("part"), F.lit(False).alias("open"),
    )
    schema = flat.schema
    now, settled = cut(flat.groupBy("source", "salt").applyInPandas(_round, schema), "rounded"), []
    while True:
        settled.append(now.where("not open"))
        rest = now.where("open").withColumn("level", F.col("level") + 1)
        if salts == 1:
            break
        salts = math.ceil(salts / FAN_IN)
        now = cut(rest.withColumn("salt", F.col("salt") % salts).groupBy("source", "salt").applyInPandas(_round, schema), "rounded")
    # One document of a source is left: the nearer whole number leaves at most half its words between mix and target.
    settled.append(rest.withColumn("part", F.round("part")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("part")).cast("long")
    return back(out).select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    own = docs.columns
    row, key, copies, n = fresh(own, "_row", "_key", "_copies", "_copy")
    taken = mix(docs).where("copies > 0").groupBy(F.col("row").alias(key)).agg(F.sum("copies").alias(copies))
    # Rows of one doc_id, source and text are told apart by nothing here: the first stands for all.
    marked = docs.withColumn(row, F.xxhash64("doc_id", "source", "text"))
    picked = marked.dropDuplicates([row]).join(taken, F.col(row) == F.col(key))
    return picked.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*own)
