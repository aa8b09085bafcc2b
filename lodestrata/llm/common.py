"""Shared helpers: shared-folder tables, word hashing, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Words as runs of anything but space, tab, LF, VT, FF and CR.
BLANK_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_BLOCK = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_made: list[list[str]] = []
#: Rows of edges in a file, about, and files at least.
_EDGES, _FILES = 100_000, 12
#: What clears the caches that tasks leave to the next ones in their Python worker.
cleared: list[Callable[[], None]] = []


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which maps batches, in a worker that other operators' tasks have used: what they left in ``cleared`` goes first, and
    memory that run has freed goes back to the system at its end, since Spark keeps workers for later tasks."""

    def tidy(batches: Iterator) -> Iterator:
        for clear in cleared:
            clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a single machine
    (local master) gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches, unless the session has set its own: at whole texts a row, 10,000 rows are tens of MB in
    the JVM, in Arrow and in pandas at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def reader_batches(spark: SparkSession, rows: int = 512) -> None:
    """Smaller batches of the Parquet reader, unless the session has set its own: 4,096 whole texts are arrays of 10 to 25 MB,
    for which the JVM takes more heap than the rows need."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(name) == "4096":
        spark.conf.set(name, str(rows))


def cut(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, lost executors
    cost nothing. The table goes when the session's JVM ends, or earlier through ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{kind}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    for made in _made:
        made.append(path)
    table = spark.read.schema(schema).parquet(path)
    table.cut_at = path
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that ``cut`` returned; nothing lazy may read it after that."""
    at, files = _files(table.sparkSession, table.cut_at)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that ``cut`` writes inside are deleted at the end, but for those whose path is taken off the
    list; nothing lazy may read the others after it."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        for path in made:
            at, files = _files(spark, path)
            files.delete(at, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front as far as a column in ``taken`` has that name, in any case."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def doc_ids(docs: DataFrame, *others: Column | str) -> DataFrame:
    """doc_id as a string, and others. Python sees a column of integers with a null in it as doubles, which
    merges large ids; strings keep them. ``back`` makes integers of them."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *others)


def back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def _table(inside) -> np.ndarray:
    return np.fromiter(map(inside, map(chr, range(0x110000))), bool, 0x110000)


@lru_cache(1)
def letters() -> np.ndarray:
    r"""Code points of WORD, the class ``\w``."""
    return _table(lambda c: c.isalnum() or c == "_")


@lru_cache(1)
def not_blank() -> np.ndarray:
    """Code points of BLANK_SPLIT."""
    out = np.ones(0x110000, bool)
    out[[32, *range(9, 14)]] = False
    return out


@lru_cache(1)
def _draws() -> np.ndarray:
    """A random 64-bit number for each code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0xD1342543DE82EF95
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block(texts: list[str], inside: np.ndarray, lower: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin; whole arrays, no loop over words."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    if lower == "ascii":
        codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    edge = np.flatnonzero(np.diff(inside[codes].view(np.int8))) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(18, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    # A word is a polynomial in its code points: a difference of prefix sums, moved to power 0.
    np.cumsum(_draws()[codes] * up[: len(codes)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return hashes, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def word_hashes(texts: Iterable[str | None], inside: np.ndarray, lower: str = "") -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text (none if null), in order. ``inside`` tells which code
    points are in words (blanks never are); ``lower`` is "all", "ascii" or nothing. Worked in blocks of some 200,000 characters; a longer text is cut at blanks."""
    held, size = [], 0

    def flush() -> Iterator[np.ndarray]:
        hashes, at = _block(held, inside, lower)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield hashes[a:b]

    for text in texts:
        text = (text or "").lower() if lower == "all" else text or ""
        if len(text) > _BLOCK:
            yield from flush() if held else ()
            held, size, parts, at = [], 0, [], 0
            while at < len(text):
                cut_at = text.find(" ", at + _BLOCK)
                cut_at = len(text) if cut_at < 0 else cut_at
                parts.append(_block([text[at:cut_at]], inside, lower)[0])
                at = cut_at
            yield np.concatenate(parts)
            continue
        held.append(text)
        size += len(text) + 1
        if size >= _BLOCK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words; empty if there are fewer. Prefix sums, so k costs nothing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(18, len(hashes).bit_length()))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``, the component's least node.

    Alternating large-star and small-star steps; each is one shuffle over the edges, and the
    number of rounds grows with the logarithm of the longest path. State is cut each round, into
    no more files than its rows need.
    """
    before, files = None, None
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        old, now = now, cut(small.coalesce(files) if files else small, "edges")
        drop(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, files = tuple(state), max(_FILES, state[0] // _EDGES)
