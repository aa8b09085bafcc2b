"""Files, JSON lines and index tables, read and written.

Paths of Parquet and JSON may be anything Spark reads. ``walk`` also lists names that Spark's own file sources leave
out (those beginning with a dot or underscore, as __init__.py does), for folders that driver and executors both mount.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.operators import chunking, code, graph, retrieval

MAX_BYTES, SNIFF, VERSION, OWN, IGNORES = 1_048_576, 8192, "2", ".lodestrata", (".gitignore", ".lodeignore")
FILES = "file_id long, path string, size long, language string, content string, hash string"


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.lit(b"\0"), F.substring(content, 1, SNIFF)) > 0


def decoded(rows: DataFrame) -> DataFrame:
    """files(file_id, path, size, language, content, hash) of rows(file_id, path, size, bytes): text files that are UTF-8."""
    text = rows.where(~is_binary(F.col("bytes")) & F.is_valid_utf8(F.col("bytes").cast("string")))
    return text.select("file_id", "path", "size", paths.language(F.col("path"), listed=True).alias("language"), F.col("bytes").cast("string").alias("content"), F.md5("bytes").alias("hash"))


def ignore_rules(text: str) -> list[tuple[bool, re.Pattern]]:
    """(kept, pattern) of each line of an ignore file; patterns match paths below its folder, the last that does decides."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        kept, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        anchored, body = "/" in line.rstrip("/"), line.strip("/")
        pattern = "".join(
            {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|[^*?\[/]+|/|\[", body)
        )
        out.append((kept, re.compile(("" if anchored else "(?:.*/)?") + pattern + ("/" if line.endswith("/") else "(?:/|$)"))))
    return out


def listed(root: str, most: int = MAX_BYTES) -> Iterator[tuple[str, int]]:
    """(path below root, bytes) of files up to ``most`` bytes that no ignore file excludes."""
    def excluded(path: str, rules: list[tuple[str, list]]) -> bool:
        verdict = False
        for base, own in rules:
            if base and not path.startswith(base + "/"):
                continue
            for kept, pattern in own:
                if pattern.match(path[len(base) + 1 if base else 0 :]):
                    verdict = not kept
        return verdict

    def down(folder: str, rules: list[tuple[str, list]]) -> Iterator[tuple[str, int]]:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        for name in IGNORES:
            if any(e.name == name and e.is_file() for e in entries):
                with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, (folder, ignore_rules(f.read()))]
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name != OWN and not excluded(path + "/", rules):
                    yield from down(path, rules)
            elif e.is_file(follow_symlinks=False) and e.stat().st_size <= most and not excluded(path, rules):
                yield path, e.stat().st_size

    yield from down("", [])


def walk(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Text files below a folder, with ignore files honoured. Names are listed on the driver, contents read in tasks.

    A root that is no mounted folder is listed by Spark's own binary reader, whose size filter reaches the listing and
    which leaves out names that begin with a dot or underscore.
    """
    most = int(os.environ.get("LODESTRATA_MAX_FILE_SIZE") or MAX_BYTES) if most is None else most
    if not os.path.isdir(root):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
        below = F.coalesce(paths.under(F.regexp_replace("path", "^[a-z]+:/*", "/"), re.sub("^[a-z]+:/*", "/", root)), F.col("path"))
        rows = rows.select(below.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
        # Numbers go by name; only names and no contents meet in one task.
        numbers = rows.select("path").withColumn("file_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
        return decoded(rows.join(numbers, "path"))
    top = os.path.abspath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                data = []
                for path in part["path"]:
                    try:
                        with open(os.path.join(top, path), "rb") as f:
                            data.append(f.read())
                    except FileNotFoundError:  # gone since it was listed
                        data.append(None)
                yield part.assign(bytes=data)

    names = spark.createDataFrame([(i, *n) for i, n in enumerate(listed(top, most))], "file_id long, path string, size long")
    return decoded(names.repartition(max(1, min(10_000, spark.sparkContext.defaultParallelism * 4)), "path").mapInPandas(read, "file_id long, path string, size long, bytes binary"))


def workspace_root(target: str) -> str | None:
    """The nearest folder upward, up to 32, that has .git, the index folder or Cargo.toml."""
    at = os.path.realpath(target)
    at = os.path.dirname(at) if os.path.isfile(at) else at
    for _ in range(32):
        if any(os.path.exists(os.path.join(at, m)) for m in (".git", OWN, "Cargo.toml")):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return None


def git(root: str, *args: str) -> str | None:
    """What git prints; null if it fails."""
    import subprocess

    done = subprocess.run(["git", *args], cwd=root, capture_output=True, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def changed_files(spark: SparkSession, root: str, ref: str | None = None) -> DataFrame | None:
    """(path) that differ between a commit and HEAD, or without a commit between HEAD and the folder; null if git can't tell."""
    out = git(root, "diff", "--name-only", f"{ref}..HEAD" if ref else "HEAD")
    return None if out is None else spark.createDataFrame([(p,) for p in out.splitlines() if p], "path string")


def at_commit(spark: SparkSession, root: str, ref: str, wanted: list[str]) -> DataFrame:
    """(path, content) of files as a commit has them; those it lacks are left out."""
    found = [(p, git(root, "show", f"{ref}:{p}")) for p in wanted]
    return spark.createDataFrame([f for f in found if f[1] is not None], "path string, content string")


def execute(spark: SparkSession, command: list[str], run_id: int = 0) -> DataFrame:
    """A run of a command on the driver, as a row that the parsers read."""
    import subprocess

    if not command:
        raise ValueError("no command provided")
    began = time.monotonic()
    done = subprocess.run(command, capture_output=True, check=False)
    row = (run_id, command, done.returncode if done.returncode >= 0 else -1, done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace"), int(1000 * (time.monotonic() - began)))
    return spark.createDataFrame([row], "run_id long, command array<string>, exit_code int, stdout string, stderr string, duration_ms long")


TELEMETRY = "ts long, command string, actual_bytes long, baseline_bytes long, baseline_strategy string, wall_ms long, tokens_saved long"
ERRORS = "ts long, command string, error string, fallback_cmd string, fallback_bytes long"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are none are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a table or a file of any store; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def commands(spark: SparkSession, path: str) -> DataFrame:
    """(value, id, cmd, command, error) of JSON lines; blank lines are skipped, lines that are no JSON have an error."""
    return parsed_commands(spark.read.text(path))


COMMAND = "id string, cmd string, query string, path string, top_k long, budget long, file string, skeleton boolean, hash boolean, outline boolean, if_changed string, mode string, pattern string, depth long"


def parsed_commands(rows: DataFrame) -> DataFrame:
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = rows.select(value.alias("value")).where("value <> ''")
    bad = F.try_parse_json("value").isNull()
    command = F.from_json("value", COMMAND)
    known = ["search", "read", "exists", "find", "outline"]
    error = F.when(bad, "invalid JSON").when(command["cmd"].isNull(), "invalid argument cmd: missing 'cmd' field").when(~command["cmd"].isin(known), F.concat(F.lit("invalid argument cmd: unknown command: "), command["cmd"]))
    return rows.select("value", F.when(~bad, command["id"]).alias("id"), F.when(~bad, command["cmd"]).alias("cmd"), F.when(error.isNull(), command).alias("command"), error.alias("error"))


DATASET = "root string, queries array<struct<query:string,category:string,relevant:array<struct<file:string,relevance:int>>,negative:boolean>>"


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, query, category, negative) and labels(query_id, position, file, relevance) of a labelled set."""
    doc = spark.read.schema(DATASET).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("queries").alias("query_id", "q")).withColumn("query_id", F.col("query_id").cast("long"))
    queries = rows.select("query_id", "q.query", "q.category", F.coalesce("q.negative", F.lit(False)).alias("negative"))
    return queries, rows.select("query_id", F.posexplode("q.relevant").alias("position", "r")).select("query_id", "position", "r.file", "r.relevance")


# ---- the index: tables in one folder

TABLES = ["files", "chunks", "postings", "nodes", "edges", "symbols", "refs"]


def hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.md5("content").alias("hash"))


def delta(files: DataFrame, kept: DataFrame) -> DataFrame:
    """file_id, path, content, hash, reused of files: whether kept(path, hash) has the same content; kept files that are gone don't show."""
    old = kept.select("path", F.col("hash").alias("_hash"))
    rows = files.select("file_id", "path", "content", F.md5("content").alias("hash")).join(old, "path", "left")
    return rows.withColumn("reused", F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))).drop("_hash")


def is_valid(files: DataFrame, kept: DataFrame) -> bool:
    """Whether kept(path, hash) says the same of the same paths."""
    a, b = hashes(files), kept.select("path", F.col("hash").alias("_hash"))
    return a.join(b, "path", "full_outer").where(~F.col("hash").eqNullSafe(F.col("_hash"))).limit(1).count() == 0


def cached_vectors(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts(chunk_id, text) those whose vector cache(hash, vec) has, (chunk_id, vec), and those to embed."""
    own = texts.withColumn("hash", F.md5("text"))
    known = cache.dropDuplicates(["hash"])
    return own.join(known, "hash").select("chunk_id", "vec"), own.join(known.select("hash"), "hash", "left_anti").drop("hash")


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("hash"), "content")


def build(files: DataFrame, kept: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The index's tables for files(file_id, path, content); chunks and symbols of unchanged files are taken from kept.

    Terms are weighed anew, as any change moves the statistics; their counts come from the chunks, not from the files.
    """
    own = files.select("file_id", "path", "content")
    if kept is None:
        fresh, chunks, symbols = own, None, None
    else:
        state = delta(own, kept["files"])
        same = state.where("reused").select("file_id", "path")
        fresh = state.where(~F.col("reused")).select("file_id", "path", "content")
        chunks, symbols = (kept[t].drop("file_id").join(same, "path").select(*kept[t].columns) for t in ("chunks", "symbols"))
    made, found = chunking.chunks(fresh), code.symbols(fresh)
    chunks = made if chunks is None else chunks.unionByName(made)
    symbols = found if symbols is None else symbols.unionByName(found)
    nodes, edges = graph.build(own)
    return {
        "files": snapshot(own), "chunks": chunks,
        "postings": retrieval.postings(retrieval.enriched(chunks)), "nodes": nodes, "edges": edges, "symbols": symbols, "refs": code.references(symbols, chunks),
    }


META = "version string, number long, timestamp long, file_count long, chunk_count long"


def save(tables: dict[str, DataFrame | None], folder: str, number: int) -> None:
    """Writes the tables into a folder of their own below ``folder``, chunks before postings, which are made of them; then one line of meta:
    tables without it are no index, so a writer that is stopped leaves the one before in place.

    Postings are ranged by term, so a query's terms skip most row groups. A table that is None is there already.
    """
    spark, own = tables["chunks"].sparkSession, f"{folder}/{number}"
    for name in [t for t in tables if t != "postings"]:
        if tables[name] is not None:
            tables[name].write.mode("overwrite").parquet(f"{own}/{name}")
    made = retrieval.postings(retrieval.enriched(spark.read.parquet(f"{own}/chunks")))
    made.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{own}/postings")
    counts = spark.read.parquet(f"{own}/files").agg(F.count("*").alias("file_count")).crossJoin(spark.read.parquet(f"{own}/chunks").agg(F.count("*").alias("chunk_count")))
    counts.select(F.lit(VERSION).alias("version"), F.lit(number).alias("number"), F.lit(int(time.time())).alias("timestamp"), "file_count", "chunk_count").coalesce(1).write.mode("append").json(f"{folder}/meta")


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The last line of meta; null if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.schema(META).json(f"{folder}/meta").orderBy(F.desc("number")).first()
    return row and row.asDict()


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of an index of this version; null if there is none."""
    meta = latest(spark, folder)
    return None if meta is None or meta["version"] != VERSION else {t: spark.read.parquet(f"{folder}/{meta['number']}/{t}") for t in TABLES}


def index(files: DataFrame, folder: str, rebuild: bool = False) -> tuple[str, dict[str, DataFrame]]:
    """("up_to_date" or "built", tables): builds what has changed, beside the tables that are there. These stay for their readers
    until the index after next; older ones go."""
    spark = files.sparkSession
    before = latest(spark, folder)
    kept = None if rebuild else load(spark, folder)
    if kept is not None and is_valid(files, kept["files"]):
        return "up_to_date", kept
    number = 1 + (before["number"] if before else 0)
    # Files are read once: all tables are made of what they then were.
    snapshot(files).write.mode("overwrite").parquet(f"{folder}/{number}/files")
    made = build(spark.read.parquet(f"{folder}/{number}/files"), kept)
    save(made | {"files": None}, folder, number)
    if number > 2:
        remove(spark, f"{folder}/{number - 2}")
    return "built", load(spark, folder)
