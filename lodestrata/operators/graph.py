"""Import graph: nodes(node, path), edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import paths


def reach(edges: DataFrame, seeds: list[int] | DataFrame, hops: int, reverse: bool = True, both: bool = False, key: list[str] | None = None) -> DataFrame:
    """(node, hop): least number of steps from the seeds, at most ``hops``; seeds are left out.

    seeds: a short list, or a table (key..., node) whose rows are searched from together for each key. One join
    and one anti join a hop; hops are few and fixed, so the plan stays small, and the step table is one reused exchange.
    """
    key = key or []
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")) if reverse else edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if both:
        step = step.unionByName(step.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct()
    if isinstance(seeds, list):
        seeds = edges.sparkSession.createDataFrame([(s,) for s in seeds], "node long")
    seen = front = seeds.select(*key, "node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        near = front.drop("hop").join(step, "node").select(*key, F.col("next").alias("node")).distinct()
        front = near.join(seen, [*key, "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def suffix_index(nodes: DataFrame) -> DataFrame:
    """(suffix, node, dir): every tail of every path, without extension."""
    return nodes.select(F.explode(paths.suffixes(F.col("path"))).alias("suffix"), "node", paths.folder(F.col("path")).alias("dir"))


def resolve(imports: DataFrame, nodes: DataFrame, many: int = 5, picks: int = 2) -> DataFrame:
    """Edges of imports(node, path, raw): the files whose path ends in the import, else in its parent; of over
    ``many`` the ``picks`` that share most leading folders with the importer, first ones first. No edge to itself.

    The two tries are two equi joins on suffix. Where a suffix has many files, no pair of importer and file is made: each leading part
    of the files' folders keeps its first ones, and an importer looks its own leading parts up.
    """
    wanted = imports.select("node", paths.folder(F.col("path")).alias("own"), paths.normalize_import(F.col("raw")).alias("full")).distinct()
    wanted = wanted.withColumn("parent", F.when(F.col("full").contains("/"), F.regexp_extract("full", "^(.*)/", 1)))
    index = suffix_index(nodes)
    counts = index.groupBy("suffix").agg(F.count("*").alias("n"))
    named = wanted.join(counts.select(F.col("suffix").alias("full"), F.col("n").alias("n_full")), "full", "left")
    named = named.withColumn("suffix", F.when(F.col("n_full").isNotNull(), F.col("full")).otherwise(F.col("parent"))).where("suffix is not null")
    asked = named.select("own", "suffix").distinct().join(counts, "suffix")
    few = asked.where(F.col("n") <= many).join(index, "suffix").select("own", "suffix", F.col("node").alias("dst"))

    def leading(folder: str):
        parts = F.split(folder, "/")
        return F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("level", "part")

    first = Window.partitionBy("suffix", "level", "part").orderBy("node")
    heads = index.join(counts.where(F.col("n") > many).select("suffix"), "suffix").select("suffix", "node", leading("dir"))
    heads = heads.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= picks).drop("rn")
    # A file is found at each part that it shares with the importer; the longest tells how near it is.
    near = asked.where(F.col("n") > many).select("own", "suffix", leading("own")).join(heads, ["suffix", "level", "part"])
    near = near.groupBy("own", "suffix", "node").agg(F.max("level").alias("level"))
    w = Window.partitionBy("own", "suffix").orderBy(F.desc("level"), "node")
    best = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= picks).select("own", "suffix", F.col("node").alias("dst"))
    edges = named.join(few.unionByName(best), ["own", "suffix"]).select(F.col("node").alias("src"), "dst")
    return edges.where("src <> dst").distinct()


def build(files: DataFrame, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of files(file_id, path, content); with seeds(file_id) only their imports count."""
    from lodestrata.operators import code

    nodes = files.select(F.col("file_id").alias("node"), "path")
    sources = files if seeds is None else files.join(seeds.select("file_id").distinct(), "file_id", "left_semi")
    found = code.imports(sources).select(F.col("file_id").alias("node"), "path", "raw")
    return nodes, resolve(found, nodes)


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out)."""
    ends = F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return edges.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def boundary(nodes: DataFrame, edges: DataFrame, prefix: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Files outside a folder or file that import from it (file, symbols: the stems they import) and that it imports (file,
    symbols: how many times), the ``most`` foremost of each."""
    inside = nodes.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/") | F.lit(prefix == ""))
    own, other = inside.select(F.col("node").alias("own"), paths.stem(F.col("path")).alias("stem")), nodes.select(F.col("node").alias("other"), F.col("path").alias("file"))
    outside = other.join(own, F.col("other") == F.col("own"), "left_anti")
    into = edges.join(own, F.col("dst") == F.col("own")).join(outside, F.col("src") == F.col("other"))
    into = into.groupBy("file").agg(F.array_sort(F.collect_set("stem")).alias("symbols")).orderBy(F.desc(F.size("symbols")), "file").limit(most)
    out = edges.join(own, F.col("src") == F.col("own")).join(outside, F.col("dst") == F.col("other"))
    return into, out.groupBy("file").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "file").limit(most)
