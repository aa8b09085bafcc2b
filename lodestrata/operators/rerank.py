"""The reranker's stages over cards(query_id, query, chunk_id, path, content, score), many queries at once.

Every stage takes the query's greatest score as it then stands; a query whose greatest score is 0 is left as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions import text as fn

# Strength of the stages.
COHERENCE, DEFINITION, SYMBOL_DEFINITION, STEM_MATCH, IMPORTS, STEM, STEM_LEAST = 0.15, 4.0, 12.0, 1.5, 0.2, 1.5, 0.1
PROXIMITY, HOPS, SEEDS, HOP_DECAY, SEED_LEAST, SATURATION = 0.25, 2, 8, 0.5, 0.1, 0.5


@dataclass(frozen=True)
class Config:
    coherence: bool = True
    definitions: bool = True
    stems: bool = True
    proximity: bool = True
    penalties: bool = True
    saturation: bool = True


def best() -> Column:
    return F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0))


def coherence(cards: DataFrame) -> DataFrame:
    """The best chunk of a file gains in proportion to the file's sum."""
    file = Window.partitionBy("query_id", "path")
    sums = cards.withColumn("_top", best()).withColumn("_sum", F.sum("score").over(file)).withColumn("_rn", F.row_number().over(file.orderBy(F.desc("score"), "chunk_id")))
    most = F.max("_sum").over(Window.partitionBy("query_id"))
    gain = F.when((F.col("_rn") == 1) & (F.col("_top") > 0) & (F.col("_most") > 0), F.col("_top") * COHERENCE * F.col("_sum") / F.nullif(F.col("_most"), F.lit(0.0))).otherwise(0.0)
    return sums.withColumn("_most", most).withColumn("score", F.col("score") + gain).drop("_top", "_sum", "_rn", "_most")


def definitions(cards: DataFrame) -> DataFrame:
    """Chunks of imports lose four fifths; others that define a name of the query gain, more for a symbol query and where the stem has the name."""
    names = fn.query_names(F.col("query"))
    unit = F.col("_top") * F.when(fn.is_symbol_query(F.col("query")), SYMBOL_DEFINITION).otherwise(DEFINITION)
    stem = F.lower(paths.stem(F.col("path")))
    gain = F.when(fn.defines_symbol(F.col("content"), names), unit * F.when(F.exists(names, lambda n: stem.contains(n)), STEM_MATCH).otherwise(1.0)).otherwise(0.0)
    new = F.when((F.col("_top") == 0) | (F.size(names) == 0), F.col("score")).when(fn.mostly_imports(F.col("content")), F.col("score") * IMPORTS).otherwise(F.col("score") + gain)
    return cards.withColumn("_top", best()).withColumn("score", new).drop("_top")


def stems(cards: DataFrame) -> DataFrame:
    """Chunks gain by the share of the query's words that begin a part of their path."""
    asked = fn.query_stems(F.col("query"))
    parts = paths.path_parts(F.col("path"))
    met = F.size(F.filter(asked, lambda w: F.exists(parts, lambda p: p.startswith(w))))
    share = met / F.greatest(F.size(asked), F.lit(1))
    return cards.withColumn("_top", best()).withColumn("score", F.col("score") + F.when(share >= STEM_LEAST, F.col("_top") * STEM * share).otherwise(0.0)).drop("_top")


def seeds(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): the files whose scores sum to a tenth of the greatest score or more, the foremost eight."""
    summed = cards.withColumn("_top", best()).join(nodes, "path").groupBy("query_id", "node").agg(F.sum("score").alias("s"), F.max("_top").alias("top"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "node")
    return summed.where((F.col("top") > 0) & (F.col("s") >= F.col("top") * SEED_LEAST)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SEEDS).select("query_id", "node")


def proximity(cards: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files within two steps of a seed, either way, gain; seeds don't."""
    from lodestrata.operators import graph

    near = graph.reach(edges, seeds(cards, nodes), HOPS, both=True, key=["query_id"]).join(nodes, "node").select("query_id", "path", "hop")
    met = cards.withColumn("_top", best()).join(near, ["query_id", "path"], "left")
    gain = F.coalesce(F.col("_top") * PROXIMITY * F.pow(F.lit(HOP_DECAY), F.col("hop") - 1), F.lit(0.0))
    return met.withColumn("score", F.col("score") + gain).drop("_top", "hop")


def penalties(cards: DataFrame) -> DataFrame:
    return cards.withColumn("score", F.col("score") * paths.penalty(F.col("path")))


def saturate(cards: DataFrame) -> DataFrame:
    """The n-th chunk of a file counts half as much as the one before."""
    w = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id")
    return cards.withColumn("score", F.col("score") * F.pow(F.lit(SATURATION), F.row_number().over(w) - 1))


def run(cards: DataFrame, k: int, nodes: DataFrame | None = None, edges: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(query_id, chunk_id, score, rank): the top k after the stages that are on; proximity needs a graph."""
    if config.coherence:
        cards = coherence(cards)
    if config.definitions:
        cards = definitions(cards)
    if config.stems:
        cards = stems(cards)
    if config.proximity and nodes is not None:
        cards = proximity(cards, nodes, edges)
    if config.penalties:
        cards = penalties(cards)
    if config.saturation:
        cards = saturate(cards)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return cards.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
