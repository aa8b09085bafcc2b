"""The engine's entities (files, lines, edges, telemetry) over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as fn

# Folders and name endings, so that every path predicate has cases.
DIRS = ["src", "src/tests", "lib/compat", "pkg/examples", "tests", "core", "app/utils", "src/__tests__", "docs", "legacy"]
ENDS = [".py", ".rs", ".test.ts", ".d.ts", "/__init__.py", ".go", ".md"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(doc_id: Column) -> Column:
    dirs, ends = F.array(*map(F.lit, DIRS)), F.array(*map(F.lit, ENDS))
    return F.concat(dirs[(doc_id % 10).cast("int")], F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), doc_id.cast("string"), ends[(doc_id % 7).cast("int")])


def files(documents: DataFrame) -> DataFrame:
    """files(file_id, path, size, language, content)."""
    doc_id = F.col("doc_id")
    return documents.select(doc_id.alias("file_id"), path_of(doc_id).alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("language"), F.col("text").alias("content"))


def line_rows(files_: DataFrame) -> DataFrame:
    """(file_id, path, line from 1, text)."""
    return files_.select("file_id", "path", F.posexplode(fn.lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def part_edges(lineitem: DataFrame) -> DataFrame:
    """Directed edges between parts on consecutive lines of an order."""
    a = lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def telemetry(events: DataFrame) -> DataFrame:
    """(command, actual_bytes, baseline_bytes) of every event, in whole bytes; the baseline's factor is read from JSON and may lie below 1."""
    k = F.get_json_object("props", "$.k").cast("long")
    actual = F.floor(F.col("value") * 100).cast("long")
    return events.select(F.col("event_type").alias("command"), actual.alias("actual_bytes"), F.floor(actual * k / 4).cast("long").alias("baseline_bytes"))


def queries(conversations: DataFrame) -> DataFrame:
    """(query_id, query): turns, and short queries made of their first words, so that every class of query occurs."""
    both = F.concat(F.coalesce(F.get(F.split("text", " "), F.lit(0)), F.lit("")), F.lit("{}"), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")))
    made = lambda sep: F.replace(both, F.lit("{}"), F.lit(sep))
    kind = F.col("query_id") % 8
    query = (
        F.when(kind == 1, made(" ")).when(kind == 2, made("_")).when(kind == 3, made("::")).when(kind == 4, F.concat(F.lit("Auth of db "), made(" "))).when(kind == 5, F.concat(F.lit("$"), made(" in ")))
        .when(kind == 6, F.initcap(made(""))).when(kind == 7, made(" [x] or ")).otherwise(F.col("text"))
    )
    return conversations.withColumn("query_id", F.col("conv_id") * 100 + F.col("turn")).select("query_id", query.alias("query"))


# Sources in four languages, by doc_id; {i} is the doc_id, {t} and {u} are others that it imports.
SOURCES = {
    "rs": "//! Module {i}.\n//! Made.\nuse crate::m{t};\n\npub struct Thing{i} {\n    x: i32,\n}\n\nimpl Thing{i} {\n    pub fn build{i}() -> i32 {\n        // fn hidden()\n        {i}\n    }\n}\n",
    "py": "import m{t}\nfrom m{u} import helper{u}\n\n\nclass Box{i}:\n    def open{i}(self):\n        return {i}  # open\n\n\ndef helper{i}(a):\n    return m{t}.run(a)\n",
    "js": "import { run } from './m{t}';\nconst fs = require('fs');\n\nclass View{i} {\n  draw{i}(x) {\n    return x;\n  }\n}\n\nexport function helper{i}(a) {\n  return run(a);\n}\n",
    "go": "package p\n\nimport (\n\t\"fmt\"\n\t\"m{t}\"\n)\n\nfunc Start{i}() {\n\tfmt.Println({i})\n}\n\nfunc (s *S) Stop{i}() {\n}\n",
}


def sources(documents: DataFrame) -> DataFrame:
    """files(file_id, path, content): a small source file for every document."""
    i = F.col("doc_id")
    ext = F.array(*map(F.lit, SOURCES))[(i % 4).cast("int")]
    body = F.array(*map(F.lit, SOURCES.values()))[(i % 4).cast("int")]
    for mark, value in (("{i}", i), ("{t}", (i * 13 + 5) % 199), ("{u}", (i * 4 + 1) % 200)):
        body = F.replace(body, F.lit(mark), value.cast("string"))
    return documents.select(i.alias("file_id"), F.concat(F.lit("pkg"), (i % 10).cast("string"), F.when(i % 9 == 0, "/tests").otherwise(""), F.lit("/m"), i.cast("string"), F.lit("."), ext).alias("path"), body.alias("content"))


def vocabulary(benchmark: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(token, vec): the words of the passages, each with one of the vectors."""
    words = benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    numbered = words.withColumn("vec_id", (F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long") % 500))
    return numbered.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("token", "vec")
