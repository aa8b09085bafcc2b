"""Cuts files into chunks: chunks(file_id, path, chunk, content, start_line, end_line, start_byte, end_byte, language)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths

TARGET, OVERLAP = 1500, 200


def line_cuts(content: Column, target: int = TARGET) -> Column:
    """array<struct(at, line)>: the byte offsets where chunks of whole lines begin, with the lines before them, and the end. A chunk
    ends with the first line that brings it to ``target`` bytes. One fold over line lengths; only cuts are appended."""
    pieces = F.split(content, "\n")
    # Every piece but the last ends with an LF.
    sized = lambda xs, lf: F.transform(xs, lambda x: F.struct((F.octet_length(x) + lf).cast("long").alias("n"), F.lit(lf).alias("lf")))
    sizes = F.concat(sized(F.slice(pieces, F.lit(1), F.size(pieces) - 1), 1), sized(F.slice(pieces, -1, 1), 0))
    cut = lambda at, line: F.struct(at.cast("long").alias("at"), line.cast("int").alias("line"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("held"), F.array(cut(F.lit(0), F.lit(0))).alias("cuts"))

    def step(s, x):
        full = (x["lf"] == 1) & (s["held"] + x["n"] >= target)
        at, line = s["at"] + x["n"], s["line"] + x["lf"]
        cuts = F.when(full, F.array_append(s["cuts"], cut(at, line))).otherwise(s["cuts"])
        return F.struct(at.alias("at"), line.alias("line"), F.when(full, F.lit(0).cast("long")).otherwise(s["held"] + x["n"]).alias("held"), cuts.alias("cuts"))

    return F.aggregate(sizes, zero, step, lambda s: F.when(F.element_at(s["cuts"], -1)["at"] < s["at"], F.array_append(s["cuts"], cut(s["at"], s["line"]))).otherwise(s["cuts"]))


def by_lines(files: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of whole lines. All but the first begin up to ``overlap`` bytes earlier, after the next LF
    there, though not before their predecessor's own lines."""
    made = files.where("content <> ''").select("file_id", "path", F.col("content").cast("binary").alias("b"), line_cuts(F.col("content"), target).alias("cuts"))
    own = made.select("*", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("chunk", "own"))
    own = own.withColumn("end", F.get("cuts", F.col("chunk") + 1)).withColumn("before", F.when(F.col("chunk") > 0, F.get("cuts", F.col("chunk") - 1)))
    # The LF before the chunk's own lines is the last that may be found, so only the overlap itself is read.
    back = F.coalesce(F.greatest(F.col("own.at") - overlap, F.col("before.at")), F.lit(0).cast("long"))
    part = lambda a, b: F.substring(F.col("b"), (a + 1).cast("int"), (b - a).cast("int"))
    spare = F.decode(part(back, F.col("own.at")), "iso-8859-1")
    start = back + F.length(F.substring_index(spare, "\n", 1)) + 1 if overlap else F.col("own.at")
    rows = own.withColumn("start_byte", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(start).cast("long"))
    earlier = F.regexp_count(F.decode(part(F.col("start_byte"), F.col("own.at")), "iso-8859-1"), F.lit("\n"))
    return rows.select(
        "file_id", "path", F.col("chunk").cast("int").alias("chunk"), F.decode(part(F.col("start_byte"), F.col("end.at")), "utf-8").alias("content"),
        (F.col("own.line") + 1 - earlier).cast("int").alias("start_line"), (F.col("end.line") + 1).alias("end_line"), "start_byte", F.col("end.at").alias("end_byte"), paths.language(F.col("path")).alias("language"),
    )


def chunks(files: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks by structure where the language is one that has it, else by lines.

    Structure goes through Arrow batches of whole files; lines stay in the JVM.
    """
    from lodestrata.functions import code

    known = F.coalesce(paths.extension(F.col("path")).isin(sorted(code.BLOCKS)), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, content, ext in zip(batch["file_id"], batch["path"], batch["content"], batch["ext"], strict=True):
                for i, c in enumerate(code.chunk_spans(content, ext, target, overlap)):
                    rows.append((file_id, path, i, *c))
            yield pd.DataFrame(rows, columns=["file_id", "path", "chunk", "content", "start_line", "end_line", "start_byte", "end_byte"])

    made = files.where(known & (F.col("content") != "")).select(F.col("file_id").cast("string").alias("file_id"), "path", "content", paths.extension(F.col("path")).alias("ext"))
    found = made.mapInPandas(run, "file_id string, path string, chunk int, content string, start_line int, end_line int, start_byte long, end_byte long")
    found = found.withColumn("file_id", F.col("file_id").cast("long")).withColumn("language", paths.language(F.col("path")))
    return found.unionByName(by_lines(files.where(~known), target, overlap))
