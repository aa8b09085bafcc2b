"""Static embedding models as tables: vocabulary(token, token_id, vec), read from a tensor file and a tokenizer's vocabulary."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as fn

_KINDS = {"F32": "<f4", "F16": "<f2"}


def matrix(data: bytes) -> np.ndarray:
    """The embedding matrix of a safetensors file: the tensor named embeddings, else the first whose name has "embed"."""
    (size,) = struct.unpack("<Q", data[:8])
    heads = {k: v for k, v in json.loads(data[8 : 8 + size]).items() if k != "__metadata__"}
    name = next((n for n in ("embeddings", "model.embeddings") if n in heads), None) or next((n for n in sorted(heads) if "embed" in n), None)
    if name is None or heads[name]["dtype"] not in _KINDS or len(heads[name]["shape"]) != 2:
        raise ValueError("no embedding matrix of 32 or 16 bit floats")
    a, b = heads[name]["data_offsets"]
    return np.frombuffer(data[8 + size + a : 8 + size + b], _KINDS[heads[name]["dtype"]]).reshape(heads[name]["shape"]).astype(np.float32)


def vocabulary(spark: SparkSession, tensors: str, tokenizer: str) -> DataFrame:
    """Both files are read through Spark, so they may lie in any store; tokens beyond the matrix are left out."""
    data = spark.read.format("binaryFile").load(tensors).select("content").first()["content"]
    weights = matrix(bytes(data))
    known = json.loads("\n".join(r["value"] for r in spark.read.text(tokenizer, wholetext=True).collect()))["model"]["vocab"]
    rows = [(t, int(i), weights[i].tolist()) for t, i in known.items() if isinstance(i, int) and 0 <= i < len(weights)]
    return spark.createDataFrame(rows, "token string, token_id int, vec array<float>")


def verified(path: str, sha256: str) -> bool:
    """Whether a local file has the digest."""
    total = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            total.update(block)
    return total.hexdigest() == sha256.lower()


class Bloom:
    """A set of terms in a fixed number of bits: what was added is always found, other terms in about a share of ``wrong``."""

    def __init__(self, capacity: int = 100_000, wrong: float = 0.02, bits: bytes | None = None) -> None:
        self.size = max(8, -8 * (-math.ceil(-capacity * math.log(wrong) / math.log(2) ** 2) // 8))
        self.hashes = max(1, round(self.size / capacity * math.log(2)))
        self.bits = np.frombuffer(bits, np.uint8).copy() if bits else np.zeros(self.size // 8, np.uint8)

    def places(self, terms: list[str]) -> np.ndarray:
        """Two halves of a digest give all places of a term."""
        both = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in terms), "<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            return (both[:, :1] + np.arange(self.hashes, dtype=np.uint64) * both[:, 1:]) % np.uint64(self.size)

    def add(self, terms: list[str]) -> None:
        at = self.places(terms).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, terms: list[str]) -> np.ndarray:
        at = self.places(terms)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def bloom(files: DataFrame, capacity: int = 100_000, wrong: float = 0.02) -> Bloom:
    """The tokens of files(content): each task fills a filter of its own, 64 groups unite these, and the driver the groups."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Bloom(capacity, wrong)
        for batch in batches:
            for terms in batch["terms"]:
                if len(terms):
                    own.add(list(terms))
        yield pd.DataFrame({"bits": [own.bits.tobytes()]})

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in part["bits"]]).tobytes()]})

    filled = files.select(F.array_distinct(fn.tokens(F.col("content"))).alias("terms")).mapInPandas(fill, "bits binary")
    groups = filled.withColumn("g", F.spark_partition_id() % 64).groupBy("g").applyInPandas(lambda part: unite(part), "bits binary")
    found = [np.frombuffer(r["bits"], np.uint8) for r in groups.collect()]
    out = Bloom(capacity, wrong)
    out.bits = np.bitwise_or.reduce([out.bits, *found])
    return out


def probably_exists(filter_: Bloom, terms: list[str]) -> tuple[bool, str]:
    """(all terms are found, "probable" or "exact"); no terms: not found."""
    ok = bool(terms) and bool(filter_.has(terms).all())
    return ok, "probable" if ok else "exact"
